"""Lexical retrieval packing: documents into training sequences, each filled with what BM25 finds for its seed.

1. Each document is tokenised once. Its full windows are sequences of their own; what is left, the tail
   of under one window, is to be packed. The rows (tail ids, digests of the full windows) are checkpointed.
2. Token document frequencies and lengths are counted over all documents. They have a fixed size (the vocabulary), so the
   driver may hold them.
3. Tails are routed to shards of about ``SHARD_DOCS`` at every input size, so that neighbours meet: by a tree of two levels
   of centroids over hashed token weights, fitted on at most ``SAMPLE`` tails, and within a leaf by a min-hash of the tail's
   token pairs, where near copies agree. Every tail is routed; a histogram of all routes says which small ones share a shard
   and which are split, by a hash of the row, as they have more tails than a shard takes.
4. Each shard builds the inverted index of its tails, weighted with the corpus-wide statistics. The
   longest unused tail seeds a sequence; the index returns unused neighbours by BM25 score over all terms of the seed, and they fill
   the window in that order. A neighbour that does not fit is cut, and its rest stays unused. When no
   scored neighbour is left, the next unused tail is taken. What remains of a shard, less than one window,
   becomes sequences whose lengths are powers of two. So no sequence needs padding.

Search is local to a shard; a shard is a bounded part of the corpus. README has the share of the corpus-wide neighbours
that lie in a seed's shard.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed, lean
from quillmark.llm.kernel import mix

SEQUENCE = 1024
END = 0
SHARD_DOCS = 8192
#: Hashed dimensions; tails that the centroids are fitted on; leaves at most; parts of a leaf by min-hash.
DIMENSIONS, SAMPLE, LEAVES, PARTS = 256, 32768, 4096, 64
#: Seeds that are scored at once.
BATCH = 32
K1, B = 1.2, 0.75
_SPECIAL = "<|endoftext|>"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(2)
def _encoder(paths: tuple[str, str]):
    import public_tokenizers
    import tiktoken

    with open(paths[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: 1 << 20})  # no text that has it comes here


@functools.lru_cache(2)
def _reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, paths: tuple[str, str]) -> np.ndarray:
    """The ids that the tokenizer file gives, without the end.

    The rank file holds the same vocabulary and its library is some times faster; a text with the string
    of the special token, or one that the faster library refuses, goes to the tokenizer file itself.
    """
    if _SPECIAL not in text:
        try:
            return _encoder(paths).encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # a panic of the native library is no Exception
            if type(e).__name__ != "PanicException":
                raise
    return np.array(_reference(paths[0]).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _parts(tails: list[np.ndarray]) -> np.ndarray:
    """Min-hashes of the token pairs of tails, cut to parts; a tail of one token has none and goes to the first part."""
    flat = np.concatenate([*tails, np.zeros(1, np.uint32)]).astype(np.uint64)
    pairs = mix(flat[:-1] << np.uint64(17) | flat[1:])
    end = np.cumsum([len(t) for t in tails])
    pairs[end - 1] = np.iinfo(np.uint64).max  # these cross tails
    least = np.minimum.reduceat(pairs, np.concatenate([[0], end[:-1]]))
    return np.where(np.diff(end, prepend=0) > 1, least % np.uint64(PARTS), 0).astype(np.int32)


class Weights:
    """Where a token is counted in a vector, and with which weight and sign."""

    def __init__(self, idf: np.ndarray) -> None:
        hashed = mix(np.arange(len(idf), dtype=np.uint64) + np.uint64(1))
        self.place = (hashed % np.uint64(DIMENSIONS)).astype(np.int64)
        self.weight = np.where(hashed >> np.uint64(63), idf, -idf)

    def vectors(self, tails: list[np.ndarray]) -> np.ndarray:
        """Unit vectors: token weights, hashed with signs into few dimensions, under a square root."""
        flat = np.concatenate([*tails, np.zeros(0, np.uint32)])
        place = self.place[flat] + np.repeat(np.arange(len(tails)) * DIMENSIONS, [len(t) for t in tails])
        x = np.bincount(place, weights=self.weight[flat], minlength=len(tails) * DIMENSIONS).reshape(-1, DIMENSIONS)
        x = np.sign(x) * np.sqrt(np.abs(x))
        return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds if k > 1 else 0):
        own = np.argmax(x @ c.T, axis=1)
        for j in np.unique(own):
            mean = x[own == j].sum(0)
            c[j] = mean / max(1e-9, float(np.linalg.norm(mean)))
    return c


class Tree:
    """Two levels of centroids; leaves are numbered so that those of one top centroid follow each other."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.top = _centres(sample, int(np.ceil(np.sqrt(leaves)))) if len(sample) else np.zeros((1, DIMENSIONS), np.float32)
        own = np.argmax(sample @ self.top.T, axis=1) if len(sample) else np.zeros(0, np.int64)
        share = [max(1, round(leaves * float((own == k).sum()) / max(1, len(sample)))) for k in range(len(self.top))]
        self.below = [_centres(sample[own == k], n) if (own == k).any() else self.top[k : k + 1] for k, n in enumerate(share)]
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in self.below])])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        own = np.argmax(x @ self.top.T, axis=1)
        out = self.first[own]
        for k in np.unique(own):
            at = np.flatnonzero(own == k)
            out[at] += np.argmax(x[at] @ self.below[k].T, axis=1)
        return out


def _routed(tails: list[np.ndarray]) -> np.ndarray:
    """Parts, also of rows without a tail, which go to the first part."""
    out = np.zeros(len(tails), dtype=np.int32)
    some = [k for k, t in enumerate(tails) if len(t)]
    if some:
        out[some] = _parts([tails[k] for k in some])
    return out


def _tokenise(docs: DataFrame, key: str, text: str, paths: tuple[str, str], size: int, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rows, tails = [], []
                for t in part.column(1).to_pylist():
                    ids = np.append(token_ids(t or "", paths), np.uint32(END))
                    whole = len(ids) // size * size
                    small = "<u2" if ids.max() < 1 << 16 else "<u4"
                    tail = ids[whole:]
                    tails.append(tail)
                    rows.append((len(ids), [crc(ids[i : i + size]) for i in range(0, whole, size)], ids[:whole].astype("<u4").tobytes() if with_ids else b"", small == "<u2", tail.astype(small).tobytes()))
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.bool_(), pa.binary())
                columns = [*(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)), pa.array(_routed(tails))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", "n", "crcs", "full", "narrow", "tail", "part"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"key {kind}, n long, crcs array<long>, full binary, narrow boolean, tail binary, part int")


def _tail(narrow: bool, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if narrow else "<u4").astype(np.uint32)


def _statistics(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency by token, documents and tokens: of the tails of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, place, tokens, documents = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), 0, 0
        for batch in batches:
            documents += batch.num_rows
            for narrow, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _tail(narrow, raw)
                tokens += len(ids)
                if not narrow and len(ids) and (most := int(ids.max())) >= len(df):
                    df, place = (np.concatenate([x, np.zeros(most + 1 - len(x), dtype=np.int64)]) for x in (df, place))
                turn = np.arange(len(ids))
                place[ids] = turn
                df[ids[place[ids] == turn]] += 1  # one place of each distinct token
        for kind, values in ((0, df), (1, np.array([documents, tokens]))):
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at), pa.array(values[at])], ["kind", "at", "n"])

    counted = rows.select("narrow", "tail").mapInArrow(lean(run), "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    df = np.zeros(int(max(got.loc[got.kind == 0, "at"], default=0)) + 1, dtype=np.int64)
    words = got[got.kind == 0]
    df[words["at"].to_numpy()] = words["n"].to_numpy()
    total = dict(zip(got.loc[got.kind == 1, "at"], got.loc[got.kind == 1, "n"], strict=True))
    return df, int(total.get(0, 0)), int(total.get(1, 0))


def _tree(rows: DataFrame, weights: Weights, documents: int, shard_docs: int) -> Tree:
    """Centroids for two leaves a shard, from a sample by a hash of the tail (copies of a text count once)."""
    leaves = min(LEAVES, max(1, -(-2 * documents // shard_docs)))
    below = min(1 << 32, (1 << 32) * 2 * SAMPLE // max(1, documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(m, _tail(x, y)) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (m := zlib.crc32(y)) < below]
            if found:
                x = weights.vectors([t for _, t in found]).astype("<f2")
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in found], pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], ["mark", "x"])

    drawn = checkpointed(rows.select("narrow", "tail").mapInArrow(lean(run), "mark long, x binary").distinct().orderBy("mark", "x").limit(SAMPLE)).toArrow()
    sample = np.frombuffer(b"".join(drawn.column("x").to_pylist()), "<f2").reshape(-1, DIMENSIONS).astype(np.float32)
    return Tree(sample, leaves)


def shard_plan(bins: np.ndarray, size: int = SHARD_DOCS) -> tuple[np.ndarray, np.ndarray, int]:
    """First shard and number of shards of each routing key, and the number of all shards."""
    first, ways = np.zeros(len(bins), dtype=np.int64), np.ones(len(bins), dtype=np.int64)
    shard, filled = 0, 0
    for k, n in enumerate(bins.tolist()):
        if n > size:
            shard += filled > 0
            first[k], ways[k] = shard, -(-n // size)
            shard, filled = shard + int(ways[k]), 0
            continue
        if filled and filled + n > size:
            shard, filled = shard + 1, 0
        first[k] = shard
        filled += n
    return first, ways, shard + (filled > 0)


class Index:
    """BM25 over the tails of a shard, with the statistics of the corpus."""

    def __init__(self, tails: list[np.ndarray], df: np.ndarray, documents: int, tokens: int) -> None:
        lengths = np.array([len(t) for t in tails])
        flat = np.concatenate(tails).astype(np.int64) if tails else np.zeros(0, dtype=np.int64)
        keys, tf = np.unique(flat * len(tails) + np.repeat(np.arange(len(tails)), lengths), return_counts=True)
        term, self.doc = np.divmod(keys, max(1, len(tails)))
        n = df[term]
        idf = np.log1p((documents - n + 0.5) / (n + 0.5))
        self.weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / max(1e-9, tokens / max(1, documents))))
        new = np.ones(len(term), dtype=bool)
        new[1:] = term[1:] != term[:-1]  # terms are in order
        start, local = np.flatnonzero(new), np.cumsum(new) - 1
        self.start = np.append(start, len(term))
        self.size = len(tails)
        order = np.argsort(self.doc.astype(np.uint16) if self.size <= 1 << 16 else self.doc, kind="stable")
        self.query, self.edge = local[order], np.searchsorted(self.doc[order], np.arange(len(tails) + 1))
        # the postings of terms that many tails have are one dense matrix, of fewer than 16 cells for each posting
        common = np.diff(self.start) * 16 >= self.size
        self.row = np.cumsum(common) - 1
        self.row[~common] = -1
        self.dense = np.zeros((int(common.sum()), self.size), dtype=np.float32)
        own = common[local]
        self.dense[self.row[local[own]], self.doc[own]] = self.weight[own]
        self.columns = np.arange(self.size)

    def leave(self, free: np.ndarray) -> None:
        """Used tails leave the matrix, once there are enough of them; their scores are those of rare terms from then on."""
        keep = free[self.columns]
        if keep.sum() < 0.75 * len(keep):
            self.dense, self.columns = np.ascontiguousarray(self.dense[:, keep]), self.columns[keep]

    def scores(self, seed: int) -> np.ndarray:
        """Of all tails, for all terms of the seed."""
        return self.scores_of([seed])[0]

    def scores_of(self, seeds: list[int]) -> np.ndarray:
        """A row of scores for each seed."""
        asked = np.zeros((len(seeds), len(self.dense)), dtype=np.float32)
        terms = [self.query[self.edge[s] : self.edge[s + 1]] for s in seeds]
        for k, t in enumerate(terms):
            at = self.row[t]
            asked[k, at[at >= 0]] = 1
        out = np.zeros((len(seeds), self.size))
        out[:, self.columns] = asked @ self.dense
        for k, t in enumerate(terms):
            rare = t[self.row[t] < 0]
            begin, n = self.start[rare], self.start[rare + 1] - self.start[rare]
            if total := int(n.sum()):
                postings = np.arange(total) + np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                out[k] += np.bincount(self.doc[postings], weights=self.weight[postings], minlength=self.size)
        return out


def fill(tails: list[np.ndarray], index: Index, size: int) -> Iterator[list[tuple[int, int, int]]]:
    """The sequences of a shard: lists of (tail, start, length)."""
    length = [len(t) for t in tails]
    start = [0] * len(tails)
    free = np.array(length) > 0
    order = np.argsort(-np.array(length), kind="stable") if tails else np.zeros(0, dtype=np.int64)
    at = 0
    scored: dict[int, np.ndarray] = {}  # of tails that come next

    def take(d: int, room: int, sequence: list) -> int:
        n = min(room, length[d] - start[d])
        sequence.append((d, start[d], n))
        start[d] += n
        free[d] = start[d] < length[d]
        return room - n

    while True:
        while at < len(order) and not free[order[at]]:
            at += 1
        if at == len(order):
            return
        seed = int(order[at])
        sequence: list[tuple[int, int, int]] = []
        room = take(seed, size, sequence)
        if room:
            if seed not in scored:
                ahead = order[at:]
                following = [seed, *ahead[free[ahead]][:BATCH].tolist()]
                index.leave(free)
                scored = dict(zip(following, index.scores_of(following), strict=True))
            scores = scored.pop(seed)
            scores[~free] = 0
            scores[seed] = 0
            k = min(len(scores), 64)
            while room:
                best = np.argpartition(-scores, k - 1)[:k] if k < len(scores) else np.arange(len(scores))
                best = best[scores[best] > 0]
                for d in best[np.lexsort((best, -scores[best]))].tolist():
                    room = take(d, room, sequence)
                    scores[d] = 0
                    if not room:
                        break
                if not len(best):
                    break
            rest = at
            while room and rest < len(order):
                if free[order[rest]]:
                    room = take(int(order[rest]), room, sequence)
                rest += 1
        if not room:
            yield sequence
            continue
        for n in (1 << b for b in range(size.bit_length() - 1, -1, -1)):  # all that is left
            if not (size - room) & n:
                continue
            part = []
            need = n
            while need:
                d, s, m = sequence[0]
                part.append((d, s, min(need, m)))
                if m > need:
                    sequence[0] = (d, s + need, m - need)
                else:
                    sequence.pop(0)
                need -= min(need, m)
            yield part
        return


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, size: int = SEQUENCE, with_ids: bool = False, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence; with_ids also its token ids.

    A null or empty text is the end id alone. Rows that repeat an id or a text are packed one by one; a null id
    stays null. A text of any length is cut into full windows and a tail. No documents give no rows. Columns
    other than the two are not carried.
    """
    paths = paths or default_paths()
    rows = checkpointed(_tokenise(docs, key, text, paths, size, with_ids))
    df, documents, tokens = _statistics(rows)
    idf = np.log1p((documents - df + 0.5) / (df + 0.5))
    weights = Weights(idf)
    tree = docs.sparkSession.sparkContext.broadcast((_tree(rows, weights, documents, shard_docs), weights))

    def bins(narrow: pa.Array, tail: pa.Array, part: pa.Array) -> np.ndarray:
        found, how = tree.value
        return found.leaf(how.vectors([_tail(x, y) for x, y in zip(narrow.to_pylist(), tail.to_pylist(), strict=True)])) * PARTS + part.to_numpy()

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                values, n = np.unique(bins(*batch.slice(at, 1024).columns), return_counts=True)
                for v, k in zip(values.tolist(), n.tolist(), strict=True):
                    total[v] = total.get(v, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["bin", "n"])

    counted = rows.select("narrow", "tail", "part").mapInArrow(lean(histogram), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # LEAVES * PARTS rows at most
    amounts = np.zeros(int(tree.value[0].first[-1]) * PARTS, dtype=np.int64)
    amounts[counted["bin"].to_numpy(dtype=np.int64)] = counted["n"]
    first, ways, _ = shard_plan(amounts, shard_docs)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                b = bins(part.column(4), part.column(5), part.column(6))
                salt = np.array([zlib.crc32(f"{k}:{n}".encode()) for k, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first[b] + salt % ways[b]), *part.columns[:6]], ["shard", "key", "n", "crcs", "full", "narrow", "tail"])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        shard = table.column("shard")[0].as_py()
        keys, counts = table.column("key").to_pylist(), table.column("n").to_pylist()
        tails = [_tail(x, y) for x, y in zip(table.column("narrow").to_pylist(), table.column("tail").to_pylist(), strict=True)]
        turn = sorted(range(len(keys)), key=lambda k: (keys[k] is None, keys[k] or 0, counts[k], tails[k].tobytes()))
        out: list[tuple] = []
        sequence = shard << 32
        for d, (crcs, full) in enumerate(zip(table.column("crcs").to_pylist(), table.column("full").to_pylist(), strict=True)):
            for i, c in enumerate(crcs):
                out.append((d, i * size, size, c, sequence, 0, np.frombuffer(full, "<u4")[i * size : (i + 1) * size].tolist() if with_ids else None))
                sequence += 1
        tails = [tails[k] for k in turn]
        for pieces in fill(tails, Index(tails, df, documents, tokens), size):
            offset = 0
            for d, s, n in pieces:
                ids = tails[d][s : s + n]
                out.append((turn[d], s + counts[turn[d]] // size * size, n, crc(ids), sequence, offset, ids.tolist() if with_ids else None))
                offset += n
            sequence += 1
        at = [o[0] for o in out]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        columns = [[o[1] for o in out], [o[2] for o in out], [o[3] for o in out], [counts[d] for d in at], [o[4] for o in out], [o[5] for o in out], [o[6] for o in out]]
        return pa.table([table.column("key").take(pa.array(at, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=["key", *(x.split()[0] for x in SCHEMA.split(", "))])

    kind = docs.schema[key].dataType.simpleString()
    routed = rows.mapInArrow(lean(route), f"shard long, key {kind}, n long, crcs array<long>, full binary, narrow boolean, tail binary")
    packed = routed.groupBy("shard").applyInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
    return packed if with_ids else packed.drop("ids")

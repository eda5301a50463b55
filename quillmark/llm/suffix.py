"""Removal of repeated byte strings by the sampling of a difference cover.

Only prefixes of LENGTH bytes are compared, so this is not a whole suffix sort: there is no recursion down to distinct
ranks, and names are hashes that are brought together by buckets of the name range and sorted there, not ranks of sorted
triples (README says why). What it takes from the difference-cover algorithm is the sample, the names, and the merge:

1. Sample. Positions whose residue modulo PERIOD lies in the difference cover are sampled: any two positions of a text
   or of two texts have a shift below PERIOD that takes both to sampled ones. So two equal strings of LENGTH bytes
   hold equal blocks of BLOCK = LENGTH - PERIOD + 1 bytes at sampled positions. Blocks are named, names are sorted in
   buckets of the name range, and names that occur once leave.
2. Longer names. Each repeated sample gets a longer name: the block with all that strings over it could hold on both sides.
   Where an earlier sample has the same name, every string within is a repetition, and its bytes go.
3. Merge. What is not decided are the strings over a repeated sample near the edge of a match. These are named by
   their LENGTH bytes, sorted with their place, and compared with their neighbour: all but the first go.

The first occurrence of a string is never decided in step 2, so step 3 sees it and each later occurrence finds it.
Names are hashes (at least 38 bits in step 1, where a false match is only work; 64 bits after that). Texts travel as
compressed packs of documents; names travel as packed arrays by pack and bucket, each distinct name once for a pack, so
a text that a third of all rows have costs one entry for each pack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import bucket_bits, checkpointed, chunk_bytes, lean
from quillmark.llm.kernel import _BYTE, SLICE_BYTES, _tables, mix, slices

LENGTH = 100
PERIOD = 31
#: A perfect difference set: each residue but 0 is a difference of its members once.
COVER = (0, 1, 3, 8, 12, 18)
BLOCK = LENGTH - PERIOD + 1
PACK_BYTES = 8 << 20
_U = np.uint64
_LEFT, _RIGHT = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_SAMPLED = np.isin(np.arange(PERIOD), COVER)
_NO_KEY = np.iinfo(np.int64).max


def _packs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """pack, keys, sizes, data: documents in order of their keys, compressed together."""
    size = chunk_bytes(docs, PACK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            batch = batch.take(pa.compute.sort_indices(batch.column(0), null_placement="at_end"))
            for a, b, buf, offsets in slices(batch.column(1), size):
                listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                data = zstandard.ZstdCompressor(level=3).compress(buf.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), listed(batch.column(0).slice(a, b - a).cast(pa.int64())), listed(pa.array(np.diff(offsets))), pa.array([data], pa.binary())], ["pack", "keys", "sizes", "data"])
                pack += 1

    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), "pack long, keys array<long>, sizes array<long>, data binary")


@dataclass
class Slice:
    """Some documents of a pack: their numbers, bytes, offsets, and what hashes spans."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def named(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


class Pack:
    def __init__(self, keys: pa.Array, sizes: np.ndarray, data: bytes) -> None:
        import zstandard

        total = int(sizes.sum())
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, total))
        self.keys = keys.fill_null(_NO_KEY).to_numpy(zero_copy_only=False).astype(np.int64)
        self.buf = np.frombuffer(raw, dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])

    def slices(self) -> Iterator[Slice]:
        first, n = 0, len(self.keys)
        while first < n:
            end = int(np.searchsorted(self.offsets, self.offsets[first] + SLICE_BYTES, side="right")) - 1
            end = min(n, max(end, first + 1))
            lo, hi = int(self.offsets[first]), int(self.offsets[end])
            buf = self.buf[lo:hi]
            power, inverse = _tables(len(buf) + 1)
            sums = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
            yield Slice(first, buf, self.offsets[first : end + 1] - lo, sums, inverse)
            first = end


def samples(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions whose block lies in a document of LENGTH bytes or more, and their documents (in the slice)."""
    sizes = np.diff(part.offsets)
    at, doc = [], []
    for d in np.flatnonzero(sizes >= LENGTH).tolist():
        n = int(sizes[d]) - BLOCK + 1
        own = np.flatnonzero(np.resize(_SAMPLED, n))
        at.append(own + part.offsets[d])
        doc.append(np.full(len(own), d))
    if not at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(at), np.concatenate(doc)


def contexts(part: Slice, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings over a sample begin at first and end at last."""
    return np.maximum(part.offsets[doc], at - (PERIOD - 1)), np.minimum(part.offsets[doc + 1], at + LENGTH)


def _cut(names: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of names whose buckets are in order."""
    bucket = names >> _U(64 - bits)
    if not len(names):
        return
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for i, j in zip(edge.tolist(), np.append(edge[1:], len(names)).tolist(), strict=True):
        yield int(bucket[i]), i, j


def _pack_sorted(x: np.ndarray) -> bytes:
    """Increasing numbers as their differences, in three bytes each where that is enough; after their number and width."""
    gaps = np.diff(x, prepend=np.uint32(0))
    wide = 3 if gaps.max(initial=0) < 1 << 24 else 4
    return np.array([len(x), wide], dtype="<i8").tobytes() + gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()


def _unpack_sorted(blob: bytes) -> tuple[np.ndarray, int]:
    """The numbers, and where what follows them begins."""
    n, wide = np.frombuffer(blob, "<i8", 2).tolist()
    gaps = np.zeros((n, 4), dtype=np.uint8)
    gaps[:, :wide] = np.frombuffer(blob, np.uint8, n * wide, 16).reshape(n, wide)
    return np.cumsum(gaps.view("<u4").reshape(-1), dtype=np.uint32), 16 + n * wide


class Blocks:
    """Step 1 in a pack: the distinct short names of its samples, in order."""

    def __init__(self, pack: Pack, bits: int) -> None:
        self.parts = []
        found = []
        for part in pack.slices():
            at, doc = samples(part)
            self.parts.append((part, at, doc))
            found.append(part.named(at, at + BLOCK))
        self.rest = 64 - bits - 32
        names = np.concatenate(found) >> _U(self.rest) if found else np.zeros(0, dtype=np.uint64)
        self.distinct, self.back, count = np.unique(names, return_inverse=True, return_counts=True)
        self.twice = count > 1
        self.bits = bits

    def send(self) -> list[tuple[int, bytes]]:
        short = self.distinct.astype(np.uint32)
        return [(b, _pack_sorted(short[i:j]) + np.packbits(self.twice[i:j]).tobytes()) for b, i, j in _cut(self.distinct << _U(self.rest), self.bits)]

    def repeated(self, back: list[dict]) -> list[tuple[Slice, np.ndarray, np.ndarray]]:
        """For each slice the samples whose name occurs again somewhere, and their documents."""
        flags = np.zeros(len(self.distinct), dtype=bool)
        got = {x["bucket"]: x["flags"] for x in back}
        for b, i, j in _cut(self.distinct << _U(self.rest), self.bits):
            flags[i:j] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=j - i).astype(bool)
        every, out, k = flags[self.back], [], 0
        for part, at, doc in self.parts:
            keep = every[k : k + len(at)]
            k += len(at)
            out.append((part, at[keep], doc[keep]))
        return out


def _any_twice(table: pa.Table) -> pa.Table:
    """Of a bucket: which of the short names of each pack occur twice in all packs."""
    blobs = table.column("blob").to_pylist()
    parts = [_unpack_sorted(b) for b in blobs]
    sizes = [len(x) for x, _ in parts]
    names = np.concatenate([x for x, _ in parts])
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, offset=at), count=len(x)) for b, (x, at) in zip(blobs, parts, strict=True)]).astype(bool)
    ordered = np.sort(names)
    again = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], names[twice]]))
    at = np.minimum(np.searchsorted(again, names), max(0, len(again) - 1))
    flags = again[at] == names if len(again) else np.zeros(len(names), dtype=bool)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return table.select(["pack", "bucket"]).append_column("flags", pa.array([np.packbits(flags[i:j]).tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary()))


class Places:
    """Names with the documents they lie in, in the order of the pack: which have an equal name earlier?"""

    def __init__(self, names: np.ndarray, keys: np.ndarray, bits: int) -> None:
        _, first = np.unique(names, return_index=True)
        first = np.sort(first)
        self.total = len(names)
        self.order = first[np.argsort(names[first] >> _U(64 - bits), kind="stable")]
        self.names, self.keys, self.bits = names[self.order], keys[self.order], bits

    def send(self) -> list[tuple[int, bytes]]:
        out = []
        for b, i, j in _cut(self.names, self.bits):
            k = self.keys[i:j]
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            out.append((b, np.array([j - i, len(edge)], dtype="<i8").tobytes() + self.names[i:j].tobytes() + k[edge].tobytes() + np.diff(np.append(edge, j - i)).astype("<u4").tobytes()))
        return out

    def later(self, back: list[dict]) -> np.ndarray:
        flags = np.ones(self.total, dtype=bool)
        got = {x["bucket"]: x["flags"] for x in back}
        for b, i, j in _cut(self.names, self.bits):
            flags[self.order[i:j]] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=j - i).astype(bool)
        return flags


def _not_first(table: pa.Table) -> pa.Table:
    """Of a bucket: which names of each pack occur earlier, in a smaller document (of one document that is given twice: in a smaller pack)."""
    blobs = table.column("blob").to_pylist()
    heads = [np.frombuffer(b, "<i8", 2).tolist() for b in blobs]
    names = np.concatenate([np.frombuffer(b, "<u8", n, 16) for b, (n, _) in zip(blobs, heads, strict=True)])
    keys = np.concatenate([np.repeat(np.frombuffer(b, "<i8", m, 16 + 8 * n), np.frombuffer(b, "<u4", m, 16 + 8 * n + 8 * m)) for b, (n, m) in zip(blobs, heads, strict=True)])
    sizes = [n for n, _ in heads]
    pack = np.repeat(table.column("pack").to_numpy(), sizes)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    again = np.zeros(len(names), dtype=bool)
    same = ordered[1:] == ordered[:-1]
    again[1:] |= same
    again[:-1] |= same
    order = order[again]  # only names that packs share need their places compared
    order = order[np.lexsort((pack[order], keys[order], names[order]))]
    flags = np.zeros(len(names), dtype=bool)
    ordered = names[order]
    flags[order[1:][ordered[1:] == ordered[:-1]]] = True
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return table.select(["pack", "bucket"]).append_column("flags", pa.array([np.packbits(flags[i:j]).tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary()))


def _spread(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions below n that lie in one of the ranges."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


class Decision:
    """Steps 2 and 3 in a pack, as far as answers are there."""

    def __init__(self, pack: Pack, bits: int, blocks: list[dict]) -> None:
        self.bits, self.pack = bits, pack
        self.parts = Blocks(pack, bits).repeated(blocks)
        names, keys = [], []
        self.spans = []
        for part, at, doc in self.parts:
            lo, hi = contexts(part, at, doc)
            wide = hi - lo >= LENGTH
            lo, hi, p, d = lo[wide], hi[wide], at[wide], doc[wide]
            self.spans.append((lo, hi, p, d))
            names.append(mix(part.named(lo, hi) + (p - lo).astype(np.uint64) * _LEFT + (hi - p).astype(np.uint64) * _RIGHT))
            keys.append(pack.keys[part.first + d])
        self.long = Places(np.concatenate(names), np.concatenate(keys), bits) if names else Places(np.zeros(0, np.uint64), np.zeros(0, np.int64), bits)

    def windows(self, back: list[dict]) -> Places:
        """The strings that step 2 does not decide."""
        later, k = self.long.later(back), 0
        self.gone, self.open = [], []
        names, keys = [], []
        for (part, _, _), (lo, hi, p, d) in zip(self.parts, self.spans, strict=True):
            gone = later[k : k + len(lo)]
            k += len(lo)
            n = len(part.buf)
            last = part.offsets[d + 1] - LENGTH
            candidate = _spread(n, lo, np.minimum(p, last) + 1)
            decided = _spread(n, lo[gone], hi[gone] - LENGTH + 1)
            w = np.flatnonzero(candidate & ~decided)
            self.gone.append((lo[gone], hi[gone]))
            self.open.append(w)
            names.append(part.named(w, w + LENGTH))
            keys.append(self.pack.keys[part.first + np.searchsorted(part.offsets, w, side="right") - 1])
        self.last = Places(np.concatenate(names), np.concatenate(keys), self.bits) if names else Places(np.zeros(0, np.uint64), np.zeros(0, np.int64), self.bits)
        return self.last

    def removed(self, back: list[dict]) -> Iterator[tuple[Slice, np.ndarray]]:
        """For each slice, which bytes go."""
        later, k = self.last.later(back), 0
        for (part, _, _), (lo, hi), w in zip(self.parts, self.gone, self.open, strict=True):
            out = w[later[k : k + len(w)]]
            k += len(w)
            yield part, _spread(len(part.buf), np.concatenate([lo, out]), np.concatenate([hi, out + LENGTH]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) and, with_text, the remaining bytes: one row for each input row.

    Removed is each byte under a string of LENGTH bytes that also starts earlier (in a smaller key, or further ahead in the
    same document). A null text is an empty one; texts below LENGTH bytes lose nothing. Rows with a null key come
    after all others; rows that repeat a key come one after another, in an order that is not fixed between them.
    Texts of any length count whole. An empty table gives none. Columns other than the two are not carried; keys
    are integers.
    """
    bits = bucket_bits(docs)
    packs = checkpointed(_packs(docs, key, text))
    sent = "bucket int, pack long, blob binary"
    returned = "pack long, bucket int, flags binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Pack, list[list[dict]]]]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.column(0)[k].as_py(), Pack(batch.column(1)[k].values, batch.column(2)[k].values.to_numpy(), batch.column(3)[k].as_py()), [c[k].as_py() or [] for c in batch.columns[4:]]

    def out(pack: int, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([pack] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], ["bucket", "pack", "blob"])

    def answer(found: DataFrame, decide) -> DataFrame:
        flags = found.groupBy("bucket").applyInArrow(decide, returned)
        return checkpointed(flags.groupBy("pack").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags")))  # one entry for each bucket

    def step1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, pack, _ in rows(batches):
            yield out(k, Blocks(pack, bits).send())

    def step2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, pack, (blocks,) in rows(batches):
            yield out(k, Decision(pack, bits, blocks).long.send())

    def step3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, pack, (blocks, long) in rows(batches):
            yield out(k, Decision(pack, bits, blocks).windows(long).send())

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                for _, pack, (blocks, long, short) in rows([batch.slice(r, 1)]):
                    decision = Decision(pack, bits, blocks)
                    decision.windows(long)
                    size, removed, spans, digest, texts = [], [], [], [], []
                    for part, gone in decision.removed(short):
                        for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True):
                            g = gone[a:b]
                            m = int(g.sum())
                            kept = (part.buf[a:b][~g] if m else part.buf[a:b]).tobytes()
                            size.append(b - a)
                            removed.append(m)
                            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if m else 0)
                            digest.append(hashlib.sha256(kept).hexdigest())
                            if with_text:
                                texts.append(kept)
                    columns = [batch.column(1)[r].values, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary())] * with_text, ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    first = answer(packs.mapInArrow(lean(step1), sent), _any_twice).withColumnRenamed("flags", "flags1")
    second = answer(packs.join(first, "pack", "left").mapInArrow(lean(step2), sent), _not_first).withColumnRenamed("flags", "flags2")
    known = packs.join(first, "pack", "left").join(second, "pack", "left")
    third = answer(known.mapInArrow(lean(step3), sent), _not_first).withColumnRenamed("flags", "flags3")
    whole = known.join(third, "pack", "left").mapInArrow(lean(last), "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    return whole.withColumnRenamed("key", key)

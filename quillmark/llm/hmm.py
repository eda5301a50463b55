"""A hidden Markov language model over word classes.

1. Documents are cut into chunks; a chunk sends its distinct words with their training counts to buckets of the hash
   range, and gets back the corpus-wide counts. So c, N and V are exact, and a word costs a chunk one entry.
2. Words fall into classes: the ``TOP`` most frequent each have their own, the others share ``TAILS`` classes by their
   last three bytes; the end and unknown words have a class each. With p the smoothed unigram probability,
   P(word | class) = p(word) / p(class).
3. Latent states emit classes. Starting values come from all training documents: these are dealt to states by the likelihood of
   their whole class sequence, ``CLUSTER_ROUNDS`` times over, from seeds that are far apart among the class counts of ``SEEDS``
   whole documents drawn by a hash. Then Baum-Welch runs over all training documents until a round gains less than ``LEAST_GAIN``
   a token (``ROUNDS`` at most): partitions add up expected counts over whole documents, which are summed by key. A long document
   is recomputed segment by segment, with forward and backward states carried across, so memory is bounded and no transition is lost.
4. The scaled forward recursion over the whole document gives the exact likelihood of its class sequence, and with
   P(word | class) that of the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import bucket_bits, checkpointed, chunk_bytes, discard, lean
from quillmark.llm.kernel import slices, span_hashes, word_spans

CHUNK_BYTES = 8 << 20
TOP, TAILS = 2048, 512
UNKNOWN, FINAL = 0, 1
STATES = 8
SEEDS, CLUSTER_ROUNDS, ROUNDS = 256, 3, 4
#: Log10 a token.
LEAST_GAIN = 0.002
#: Tokens whose forward states are held at once, of all sequences that run side by side.
SEGMENT = 1 << 18
#: The hash of the end token; no word has it, as it is the hash of no bytes and words are not empty.
_END = np.uint64(0)
_U = np.uint64


def held_out(key: object) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1


def _encode(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For each chunk: its documents, its distinct words with suffix class and training count, and the words of the text by index."""
    size = chunk_bytes(docs, CHUNK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column(1), size):
                keys = batch.column(0).slice(a, b - a)
                parts, tails, firsts, at = [], [], [np.zeros(1, dtype=np.int64)], 0
                for i, j, piece, own in slices(pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(buf.tobytes()))):
                    starts, ends, first = word_spans(piece, own)
                    parts.append(span_hashes(piece, starts, ends))
                    tails.append((span_hashes(piece, np.maximum(starts, ends - 3), ends) % _U(TAILS)).astype(np.uint16))
                    firsts.append(first[1:] + at)
                    at += len(starts)
                words, tail, first = np.concatenate(parts), np.concatenate(tails), np.concatenate(firsts)
                n = np.diff(first)
                # an end after each document
                words = np.insert(words, first[1:], _END)
                tail = np.insert(tail, first[1:], 0)
                held = np.array([held_out(k) for k in keys.to_pylist()])
                vocabulary, where, index = np.unique(words, return_index=True, return_inverse=True)
                counts = np.bincount(index, weights=np.repeat(~held, n + 1), minlength=len(vocabulary)).astype(np.uint32)
                listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                blobs = [vocabulary.tobytes(), tail[where].tobytes(), counts.tobytes(), zlib.compress(index.astype("<u4").tobytes(), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), listed(keys), listed(pa.array(n + 1)), listed(pa.array(held)), *(pa.array([x], pa.binary()) for x in blobs)], ["chunk", "keys", "n", "held", "words", "tails", "counts", "index"])
                chunk += 1

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"chunk long, keys array<{kind}>, n array<long>, held array<boolean>, words binary, tails binary, counts binary, index binary")


def _totals(chunks: DataFrame, bits: int) -> DataFrame:
    """Rows by chunk and bucket with the corpus counts of the words sent; and rows without chunk: statistics of a bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, tails, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, t, c = np.frombuffer(words, "<u8"), np.frombuffer(tails, "<u2"), np.frombuffer(counts, "<u4")
                edge = np.searchsorted(w >> _U(64 - bits), np.arange((1 << bits) + 1))  # words are sorted
                full = np.flatnonzero(np.diff(edge))
                blobs = [w[i:j].tobytes() + c[i:j].tobytes() + t[i:j].tobytes() for i, j in zip(edge[full].tolist(), edge[full + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk)), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

    def add(table: pa.Table) -> pa.Table:
        chunk, blobs = table.column("chunk").to_pylist(), table.column("blob").to_pylist()
        sizes = [len(b) // 14 for b in blobs]
        w = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(blobs, sizes, strict=True)])
        c = np.concatenate([np.frombuffer(b, "<u4", n, 8 * n) for b, n in zip(blobs, sizes, strict=True)])
        t = np.concatenate([np.frombuffer(b, "<u2", n, 12 * n) for b, n in zip(blobs, sizes, strict=True)])
        every, where, index = np.unique(w, return_index=True, return_inverse=True)
        total = np.bincount(index, weights=c, minlength=len(every)).astype(np.uint64)
        tail = t[where]
        seen = total > 0
        ordinary = seen & (every != _END)
        top = np.flatnonzero(ordinary)
        top = top[np.lexsort((every[top], -total[top].astype(np.int64)))[:TOP]]
        edge = np.concatenate([[0], np.cumsum(sizes)])
        back = [total[index[i:j]].tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        sums = np.bincount(tail[ordinary], weights=total[ordinary], minlength=TAILS).astype(np.int64)
        types = np.bincount(tail[ordinary], minlength=TAILS)
        statistics = [(0, int(every[k].view(np.int64)), int(total[k]), int(tail[k])) for k in top] + [(1, k, int(sums[k]), int(types[k])) for k in np.flatnonzero(types).tolist()]
        # the end token is counted for itself, however rare it is among the words
        statistics += [(2, 0, int(total[k]), 0) for k in np.flatnonzero(seen & (every == _END)).tolist()]
        pad = len(statistics)
        m = len(blobs)
        return pa.table(
            [
                pa.array([*chunk, *[None] * pad], pa.int64()), pa.array([table.column("bucket")[0].as_py()] * (m + pad), pa.int32()), pa.array([*back, *[None] * pad], pa.binary()),
                *(pa.array([*[None] * m, *(s[k] for s in statistics)], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))),
            ],
            names=["chunk", "bucket", "totals", "kind", "item", "amount", "other"],
        )

    sent = chunks.select("chunk", "words", "tails", "counts").mapInArrow(lean(send), "bucket int, chunk long, blob binary")
    return sent.groupBy("bucket").applyInArrow(add, "chunk long, bucket int, totals binary, kind int, item long, amount long, other long")


@dataclass
class Unigrams:
    """N, V, and log10 of the smoothed probability of each class; top: hashes of the words with a class of their own, sorted."""

    tokens: int
    types: int
    top: np.ndarray
    log_class: np.ndarray

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _unigrams(totals: DataFrame) -> Unigrams:
    statistics = totals.filter(F.col("kind").isNotNull())
    top = checkpointed(statistics.filter("kind = 0").orderBy(F.desc("amount"), "item").limit(TOP)).toPandas()
    tails = statistics.filter("kind = 1").groupBy("item").agg(F.sum("amount").alias("amount"), F.sum("other").alias("other")).toPandas()
    sums, types = np.zeros(TAILS), np.zeros(TAILS)
    sums[tails["item"].to_numpy(dtype=np.int64)], types[tails["item"].to_numpy(dtype=np.int64)] = tails["amount"], tails["other"]
    ends = float(statistics.filter("kind = 2").agg(F.coalesce(F.sum("amount"), F.lit(0))).first()[0])  # the number of training documents
    tokens, kinds = int(sums.sum() + ends), int(types.sum() + (ends > 0))
    hashes = top["item"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    amount, tail = top["amount"].to_numpy(dtype=float)[order], top["other"].to_numpy(dtype=np.int64)[order]
    np.subtract.at(sums, tail, amount)
    np.subtract.at(types, tail, 1)
    mass = np.concatenate([[0.5, ends + 0.5], amount + 0.5, np.full(TOP - len(amount), 1e-300), np.maximum(sums + 0.5 * types, 1e-300)])
    return Unigrams(tokens, kinds, hashes[order], np.log10(mass / (tokens + 0.5 * (kinds + 1))))


def _classes(chunks: DataFrame, totals: DataFrame, unigrams: Unigrams) -> DataFrame:
    """For each chunk: keys, held, n, known, base, shift (base minus the log of its classes) and the classes of its tokens."""
    back = totals.filter(F.col("chunk").isNotNull()).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias("totals"))  # one entry for each bucket, the chunk's own words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("keys", "n", "held", "words", "tails", "index", "totals")}
                counts = np.frombuffer(b"".join(x["totals"] for x in row["totals"].as_py()), "<u8").astype(np.float64)
                words, tails = np.frombuffer(row["words"].as_buffer(), "<u8"), np.frombuffer(row["tails"].as_buffer(), "<u2")
                index = np.frombuffer(zlib.decompress(row["index"].as_buffer()), "<u4")
                n = row["n"].values.to_numpy()
                kind = 2 + TOP + tails.astype(np.int64)
                if len(unigrams.top):
                    at = np.minimum(np.searchsorted(unigrams.top, words), len(unigrams.top) - 1)
                    kind = np.where(unigrams.top[at] == words, 2 + at, kind)
                kind[counts == 0] = UNKNOWN
                kind[words == _END] = FINAL
                logs = unigrams.log10(counts)
                start = np.concatenate([[0], np.cumsum(n)[:-1]])
                base = np.add.reduceat(logs[index], start)
                shift = base - np.add.reduceat(unigrams.log_class[kind][index], start)
                known = np.add.reduceat((counts > 0)[index].astype(np.int64), start)
                packed = zlib.compress(kind.astype(np.uint16)[index].tobytes(), 1)
                listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([*(listed(row[c].values) for c in ("keys", "held", "n")), listed(pa.array(known)), listed(pa.array(base)), listed(pa.array(shift)), pa.array([packed], pa.binary())], ["keys", "held", "n", "known", "base", "shift", "classes"])

    joined = chunks.select("chunk", "keys", "n", "held", "words", "tails", "index").join(back, "chunk").select("keys", "n", "held", "words", "tails", "index", "totals")
    kind = chunks.schema["keys"].dataType.simpleString()
    return joined.mapInArrow(lean(run), f"keys {kind}, held array<boolean>, n array<long>, known array<long>, base array<double>, shift array<double>, classes binary")


@dataclass
class Model:
    """Start, transition and emission probabilities; emission[class, state]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts: starts, transitions, emissions."""
    return _expected(model, sequences)[:3]


def _expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of whole sequences, and their log10 likelihood.

    The states before each segment are kept; going backwards, a segment's forward states are computed again.
    """
    k = len(model.start)
    starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    sequences = sorted((s for s in sequences if len(s)), key=len, reverse=True)
    for first in range(0, len(sequences), 512):
        part = sequences[first : first + 512]
        length = np.array([len(s) for s in part])
        flat = np.concatenate(part).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        longest = int(length[0])
        active = np.searchsorted(-length, -np.arange(longest), side="left")  # how many are longer than t

        def forward(t: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = active[t]
            e = model.emit[flat[begin[:n] + t]]  # noqa: B023
            a = model.start * e if before is None else (before[:n] @ model.move) * e
            c = a.sum(1, keepdims=True)
            return a / c, e, c

        edges = np.unique((np.cumsum(active) - 1) // SEGMENT, return_index=True)[1].tolist()
        kept: list[np.ndarray | None] = [None]
        state: np.ndarray | None = None
        for t in range(edges[-1]):
            state = forward(t, state)[0]
            if t + 1 == (edges[len(kept)] if len(kept) < len(edges) else -1):
                kept.append(state)
        weighted = None
        for edge, end, before in zip(reversed(edges), reversed([*edges[1:], longest]), reversed(kept), strict=True):
            alphas, emissions, scales, state = [], [], [], before
            for t in range(edge, end):
                state, e, c = forward(t, state)
                alphas.append(state)
                emissions.append(e)
                scales.append(c)
            total += float(np.log10(np.concatenate(scales)).sum())
            for i in range(len(alphas) - 1, -1, -1):
                beta = np.ones((len(alphas[i]), k))
                if weighted is not None:
                    m = len(weighted)
                    moves += alphas[i][:m].T @ weighted
                    beta[:m] = weighted @ model.move.T
                weighted = emissions[i] * beta / scales[i]
                alphas[i] = alphas[i] * beta
            gamma = np.concatenate(alphas)
            seen = np.concatenate([flat[begin[: len(a)] + t] for t, a in enumerate(alphas, edge)])
            for s in range(k):
                emits[:, s] += np.bincount(seen, weights=gamma[:, s], minlength=len(emits))
            if not edge:
                starts += alphas[0].sum(0)
    return starts, moves * model.move, emits, total


def maximise(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: np.ndarray) -> Model:
    """Probabilities from counts; ``prior`` (class probabilities) is added to the emissions with the weight of ten tokens.

    Training texts have no unknown words, so that class keeps its prior in every state.
    """
    starts = starts + 0.1
    moves = moves + 0.1
    emits = emits + 10 * prior[:, None]
    emits[UNKNOWN] = 0
    emits = emits / emits.sum(0) * (1 - prior[UNKNOWN])
    emits[UNKNOWN] = prior[UNKNOWN]
    return Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits)


def log10_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Of whole sequences, by the scaled forward recursion."""
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    out = np.zeros(len(sequences))
    length = np.array([len(sequences[k]) for k in order])
    flat = np.concatenate([sequences[k] for k in order]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    total = np.zeros(len(order))
    alpha = np.tile(model.start, (len(order), 1))
    ends = np.bincount(length, minlength=int(length[0]) + 1)
    n = len(order)
    for t in range(int(length[0])):
        n -= int(ends[t])
        at = flat[begin[:n] + t]
        a = model.emit[at] * (alpha[:n] if t == 0 else alpha[:n] @ model.move)
        c = a.sum(1)
        alpha = a / c[:, None]
        total[:n] += np.log(c)
    out[order] = total / np.log(10)
    return out


def _split(n: np.ndarray, classes: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(zlib.decompress(classes), "<u2"), np.cumsum(n)[:-1])


def _summed(rows: DataFrame, size: int, run) -> np.ndarray:
    """The sum over all chunks of what run(training sequences) gives for each; a fixed number of values, whatever the input."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for k in range(batch.num_rows):
                held = batch.column(0)[k].values.to_numpy(zero_copy_only=False)
                sequences = _split(batch.column(1)[k].values.to_numpy(), batch.column(2)[k].as_buffer())
                found = run([s for s, h in zip(sequences, held, strict=True) if not h])
                total = found if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "amount"])

    counted = rows.select("held", "n", "classes").mapInArrow(lean(every), "at long, amount double").groupBy("at").agg(F.sum("amount").alias("amount")).toPandas()
    total = np.zeros(size)
    total[counted["at"].to_numpy(dtype=np.int64)] = counted["amount"]
    return total


def _seeds(rows: DataFrame, prior: np.ndarray, states: int) -> np.ndarray:
    """Class probabilities by state, from documents whose class counts are far apart; none without training documents."""
    documents = rows.agg(F.sum(F.size("keys")).alias("n")).first()["n"] or 0
    ceiling = min(1 << 32, (1 << 32) * 4 * SEEDS // max(1, documents))  # four times the seeds, so that the rest is little to sort

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = batch.column(1)[k].as_py()
                marks = [zlib.crc32(f"seed:{x}".encode()) for x in batch.column(0)[k].as_py()]
                keep = [i for i, m in enumerate(marks) if m < ceiling and not held[i]]
                if keep:
                    sequences = _split(batch.column(2)[k].values.to_numpy(), batch.column(3)[k].as_buffer())
                    counts = [np.bincount(sequences[i], minlength=len(prior)).astype("<f4").tobytes() for i in keep]
                    yield pa.RecordBatch.from_arrays([pa.array([marks[i] for i in keep], pa.int64()), pa.array(counts, pa.binary())], ["mark", "counts"])

    found = checkpointed(rows.select("keys", "held", "n", "classes").mapInArrow(lean(drawn), "mark long, counts binary").orderBy("mark", "counts").limit(SEEDS)).toPandas()
    if not len(found):
        return np.zeros((len(prior), 0))
    counts = np.stack([np.frombuffer(x, "<f4") for x in found["counts"]]).astype(float)
    places = np.sqrt(counts / counts.sum(1, keepdims=True))
    centres = [int(np.argmax(counts.sum(1)))]
    for _ in range(states - 1):
        far = np.min([((places - places[c]) ** 2).sum(1) * np.sqrt(counts.sum(1)) for c in centres], axis=0)
        centres.append(int(np.argmax(far)))
    return _probabilities(counts[centres].T, prior)


def _probabilities(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Class probabilities of each column of counts, drawn towards the prior by a twentieth of the mean column and 100 tokens."""
    smooth = counts + prior[:, None] * (100 + 0.05 * counts.sum() / max(1, counts.shape[1]))
    return smooth / smooth.sum(0)


def _dealt(emits: np.ndarray, sequences: list[np.ndarray]) -> np.ndarray:
    """Class counts by state, each whole document in the state that gives its classes the largest likelihood."""
    logs, out = np.log(emits), np.zeros(emits.shape)
    sequences = [s for s in sequences if len(s)]
    at = 0
    while at < len(sequences):
        size, end = 0, at
        while end < len(sequences) and (size < 1 << 18 or end == at):
            size += len(sequences[end])
            end += 1
        part = sequences[at:end]
        at = end
        length = np.array([len(s) for s in part])
        flat = np.concatenate(part).astype(np.int64)
        own = np.argmax(np.add.reduceat(logs[flat], np.concatenate([[0], np.cumsum(length)[:-1]])), axis=1)
        out += np.bincount(flat * emits.shape[1] + np.repeat(own, length), minlength=out.size).reshape(out.shape)
    return out.reshape(-1)


def learn(rows: DataFrame, prior: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """The model of all training documents."""
    emits = _seeds(rows, prior, states)
    if not emits.shape[1]:
        return Model(np.full(states, 1 / states), np.full((states, states), 1 / states), np.repeat(prior[:, None], states, 1))
    for _ in range(CLUSTER_ROUNDS):
        emits = _probabilities(_summed(rows, emits.size, lambda s, e=emits: _dealt(e, s)).reshape(emits.shape), prior)
    model = maximise(np.ones(states), np.eye(states) * 50 + 1, emits * 1e6, prior)
    before = -np.inf
    for _ in range(rounds):
        got = _summed(rows, states + states**2 + emits.size + 1, lambda s, m=model: np.concatenate([np.asarray(x).reshape(-1) for x in _expected(m, s)]))
        starts, moves, seen, likelihood = got[:states], got[states : states + states**2].reshape(states, states), got[states + states**2 : -1].reshape(emits.shape), got[-1]
        model = maximise(starts, moves, seen, prior)
        if likelihood - before < LEAST_GAIN * seen.sum():
            break
        before = likelihood
    return model


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each input row.

    A null or empty text is the end token alone. Rows that repeat count as often as they occur; a null key counts as the
    empty string when the fold is drawn, and stays null. Texts of any length are scored whole. Without training
    rows every token is unknown. Columns other than the two are not carried. Words are known by 64-bit hashes.
    """
    bits = bucket_bits(docs)
    chunks = checkpointed(_encode(docs, key, text))
    totals = checkpointed(_totals(chunks, bits))
    unigrams = _unigrams(totals)
    rows = checkpointed(_classes(chunks, totals, unigrams))
    discard(chunks, totals)
    prior = 10**unigrams.log_class
    prior /= prior.sum()

    model = learn(rows, prior, states, rounds)
    tokens = unigrams.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, held, n, known, base, shift = (batch.column(c)[k].values for c in range(6))
                likelihood = log10_likelihood(model, _split(n.to_numpy(), batch.column(6)[k].as_buffer()))
                yield pa.RecordBatch.from_arrays([keys, held, n, known, pa.array(np.full(len(n), tokens)), base, pa.array(likelihood + shift.to_numpy())], ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)

"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over binary features of a text: its words and their first four to six bytes, as
64-bit hashes. It learns from confirmed toxic texts (P) and from texts whose label is not looked at (U),
with the class prior pi, by the non-negative risk estimator

    pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])        with l(z) = log(1 + exp(-z)),

where a step goes against the gradient of the bracket while that is negative. Weights start at zero; steps are those of
Adam, each followed by a shrinkage of all weights (an L1 penalty), from the strongest of ``PENALTIES`` on. Rows for learning
are those outside fold 0; of these, fold 1 trains no weights: it chooses the penalty and fits the logistic curve that turns f
into a probability. U is drawn from documents without a look at labels. Samples are bounded numbers of rows (``POSITIVE``,
``UNLABELLED``, ``CALIBRATION``, taken by a hash of the id); features are counted and chosen on the executors, so that the driver holds positions of at most
``FEATURES`` features for each sampled text. Scores cover all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import checkpointed, lean
from quillmark.llm.kernel import mix, runs, shingle_sets, slices, span_hashes

POSITIVE, UNLABELLED, CALIBRATION = 3000, 9000, 3000
#: Features that are learned: at most so many, and only those whose rates in P and U differ by so many standard errors.
FEATURES, LEAST_Z = 8192, 4.0
PREFIXES = (4, 5, 6)
STEPS, RATE = 120, 0.1
#: Strengths of the shrinkage, from the strongest on; each starts where the one before ended.
PENALTIES = (0.01, 0.003, 0.001, 0.0003)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def fold(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word and of its prefixes; pairs may repeat."""
    starts, ends, first = runs(_LETTER[buf], offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, docs = [span_hashes(buf, starts, ends)], [doc]
    for k in PREFIXES:
        longer = ends - starts > k
        hashes.append(mix(span_hashes(buf, starts[longer], starts[longer] + k) + np.uint64(k)))
        docs.append(doc[longer])
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass
class Model:
    """hashes: sorted; probability = 1 / (1 + exp(-(slope * f + shift)))."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def raw(self, docs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """f of n documents; a feature counts once in each."""
        out = np.full(n, self.bias)
        if len(self.hashes) and len(hashes):
            near = np.zeros(1 << 20, dtype=bool)
            near[self.hashes & np.uint64((1 << 20) - 1)] = True
            keep = near[hashes & np.uint64((1 << 20) - 1)]
            docs, hashes = docs[keep], hashes[keep]
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            keep = self.hashes[at] == hashes
            pairs = np.unique(docs[keep] * len(self.hashes) + at[keep])
            out += np.bincount(pairs // len(self.hashes), weights=self.weights[pairs % len(self.hashes)], minlength=n)
        return out

    def probability(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -30, 30)))


Texts = tuple[np.ndarray, np.ndarray, int]


def _sparse(texts: list[np.ndarray]) -> Texts:
    """(row, feature) of all texts, and their number."""
    return np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64), len(texts)


def _outputs(texts: Texts, w: np.ndarray, bias: float) -> np.ndarray:
    return np.bincount(texts[0], weights=w[texts[1]], minlength=texts[2]) + bias


def risk_gradient(positive: Texts, unlabelled: Texts, w: np.ndarray, bias: float, prior: float) -> tuple[np.ndarray, float]:
    """Of the non-negative risk at (w, bias): the direction that a step goes against, for weights and bias."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    zp, zu = _outputs(positive, w, bias), _outputs(unlabelled, w, bias)
    if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
        gp, gu = np.full(len(zp), -prior / len(zp)), sigmoid(zu) / len(zu)
    else:  # the estimate of a risk is negative: undo what has been overfitted
        gp, gu = prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)
    back = lambda t, g: np.bincount(t[1], weights=g[t[0]], minlength=len(w))
    return back(positive, gp) + back(unlabelled, gu), float(gp.sum() + gu.sum())


def learn(positive: Texts, unlabelled: Texts, n: int, prior: float, penalties: tuple[float, ...] = PENALTIES, steps: int = STEPS) -> Iterator[tuple[np.ndarray, float]]:
    """Weights of n features and the bias, after the steps of each penalty; from zero."""
    w = np.zeros(n + 1)  # the bias comes last
    w[n] = np.log(prior / (1 - prior))
    mean, square, t = np.zeros(n + 1), np.zeros(n + 1), 0
    for penalty in penalties:
        for _ in range(steps):
            t += 1
            g, b = risk_gradient(positive, unlabelled, w[:n], w[n], prior)
            g = np.append(g, b)
            mean = 0.9 * mean + 0.1 * g
            square = 0.99 * square + 0.01 * g * g
            size = RATE / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
            w = w - size * mean / (1 - 0.9**t)
            w[:n] = np.sign(w[:n]) * np.maximum(0, np.abs(w[:n]) - np.minimum(size[:n], 100.0) * penalty * prior)
        yield w[:n].copy(), float(w[n])


def fit(hashes: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], labelled: list[tuple[np.ndarray, int]], prior: float, penalties: tuple[float, ...] = PENALTIES, steps: int = STEPS) -> Model:
    """From the positions in hashes that each text has. Without positive texts or features every score is the prior."""
    prior = min(max(prior, 1e-6), 0.5)
    if not positive or not unlabelled or not len(hashes):
        p = min(prior, 0.4)
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0, 1.0, float(np.log(p / (1 - p))))
    x = _sparse([t for t, _ in labelled])
    y = np.array([label for _, label in labelled], dtype=float)
    best, least = None, np.inf
    found = list(learn(_sparse(positive), _sparse(unlabelled), len(hashes), prior, penalties, steps))
    for k, (w, bias) in enumerate(found):
        slope, shift, loss = 1.0, 0.0, float(abs(2 * k - len(found)))  # without labels of both classes the middle penalty
        if 0 < y.sum() < len(y):
            f = _outputs(x, w, bias)
            slope, shift = _logistic(f, y)
            z = slope * f + shift
            loss = float((np.logaddexp(0, z) - y * z).mean())
        if loss < least - 1e-9:
            keep = w != 0
            best, least = Model(hashes[keep], w[keep], bias, slope, shift), loss
    return best


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with a little weight on slope 1 and shift 0 so that they stay finite."""
    scale = max(1e-9, float(np.abs(f).mean()))
    x = np.stack([f / scale, np.ones(len(f))], 1)
    start = np.array([1.0, 0.0])
    theta, cost = start, lambda t: np.logaddexp(0, x @ t).sum() - y @ (x @ t) + 0.25 * ((t - start) ** 2).sum()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (q - y) + 0.5 * (theta - start))
        while np.abs(step).max() > 1e-9 and cost(theta - step) > cost(theta):
            step = step / 2
        theta = theta - step
    return float(max(theta[0], 1e-6) / scale), float(theta[1])


def _drawn(rows: DataFrame, n: int, limit: int, salt: int) -> DataFrame:
    """Up to limit of n rows, by a hash of the id; a threshold leaves about four times the limit to be sorted."""
    mark = F.xxhash64("doc_id", F.lit(salt))
    below = F.shiftrightunsigned(mark, 33) < min(1 << 31, 4 * limit * (1 << 31) // max(1, n) + 1)
    return rows.filter(below).distinct().orderBy(mark, "doc_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, penalties: tuple[float, ...] = PENALTIES, steps: int = STEPS) -> Model:
    """From rows of ``labels`` outside fold 0 (rows that repeat an id: the larger label; null labels do not count), and documents outside it.

    P and the fold for calibration have labels; U is drawn from all documents outside both folds, whether or not they have one.
    Of texts that share the smallest hash of their shingles one stays in P and in U each: copies would vouch for their every word.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    inner = fold(F.col("doc_id")) == 1
    total = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(inner).alias("inner"), F.count_if(inner & (F.col("toxic") == 1)).alias("inner_p")).first()
    prior = total["p"] / max(1, total["n"])
    role = lambda k, label: (F.lit(k).alias("role"), label.cast("int").alias("label"))
    sample = _drawn(known.filter(~inner & (F.col("toxic") == 1)).select("doc_id", *role(0, F.lit(1))), total["p"] - total["inner_p"], POSITIVE, 0)
    others = docs.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) > 1)).select("doc_id", *role(1, F.lit(-1)))
    sample = sample.unionByName(_drawn(others, others.count(), UNLABELLED, 0))
    sample = sample.unionByName(_drawn(known.filter(inner).select("doc_id", *role(2, F.col("toxic"))), total["inner"], CALIBRATION, 7))
    roles = sample.groupBy("doc_id").agg(F.collect_set(F.struct("role", "label")).alias("roles"))  # bounded by the three limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column(1)):
                docs_, hashes = features(buf, offsets)
                order_ = np.argsort(docs_, kind="stable")
                edge = np.searchsorted(docs_[order_], np.arange(b - a + 1))
                found = [np.unique(hashes[order_[i:j]]).tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
                marks = [int(mix(x).min().view(np.int64)) if len(x) else 0 for x in shingle_sets(buf, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(marks, pa.int64()), pa.array(found, pa.binary())], ["roles", "mark", "found"])

    picked = docs.select("doc_id", "text").join(F.broadcast(roles), "doc_id").select("roles", F.coalesce("text", F.lit("")).alias("text"))
    each = picked.mapInArrow(lean(run), "roles array<struct<role int, label int>>, mark long, found binary").select(F.explode("roles").alias("r"), "mark", "found")
    each = each.groupBy("r.role", "r.label", F.when(F.col("r.role") == 2, F.xxhash64("mark", "found")).otherwise(F.col("mark")).alias("mark")).agg(F.min("found").alias("found"), F.when(F.col("role") == 2, F.count(F.lit(1))).otherwise(1).alias("times"))
    each = checkpointed(each)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in part.column(1)]
                own = np.repeat(part.column(0).to_numpy() == 0, [len(t) for t in texts])
                every, at = np.unique(np.concatenate(texts), return_inverse=True)
                p = np.bincount(at, weights=own, minlength=len(every)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(p), pa.array(np.bincount(at, minlength=len(every)) - p)], ["feature", "p", "u"])

    n = {r["role"]: r["n"] for r in each.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = each.filter("role < 2").select("role", "found").mapInArrow(lean(count), "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    np_, nu = float(n.get(0, 0) or 1), float(n.get(1, 0) or 1)
    pooled = (F.col("p") + F.col("u")) / (np_ + nu)
    gain = F.abs(F.col("p") / np_ - F.col("u") / nu) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / np_ + 1 / nu))
    chosen = counted.select("feature", gain.alias("gain")).filter(F.col("gain") >= LEAST_Z).orderBy(F.desc("gain"), "feature").limit(FEATURES).toPandas()
    hashes = np.sort(chosen["feature"].to_numpy(dtype=np.int64).view(np.uint64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(3)]
            found = [np.flatnonzero(np.isin(hashes, t, assume_unique=True)).astype("<u2").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["role", "label", "times", "at"])

    got = each.select("role", "label", F.col("times").cast("int").alias("times"), "found").mapInArrow(lean(place), "role int, label int, times int, at binary").toArrow()
    sets: dict[int, list] = {0: [], 1: [], 2: []}
    for role_, label, times, at in sorted(zip(*(got.column(c).to_pylist() for c in ("role", "label", "times", "at")), strict=True)):  # the order of rows plays no part
        sets[role_] += [(np.frombuffer(at, "<u2").astype(np.int64), label)] * times
    return fit(hashes, [t for t, _ in sets[0]], [t for t, _ in sets[1]], sets[2], prior, penalties, steps)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs that have no such name, and held_out, score, predicted.

    A null text is an empty one; it gets the score of a text without known words. A null id counts as the empty
    string for the fold. Each row gives one row, whatever repeats. Columns of docs that are named as a
    result column are replaced.
    """
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    base = docs.select(*names).withColumn("held_out", fold(F.col("doc_id")) == 0)
    carried = base.columns
    text = carried.index("text")
    shared = base.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column(text)):
                p = m.probability(m.raw(*features(buf, offsets), b - a))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*carried, "score", "predicted"])

    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(lean(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn and score; see ``train`` and ``score``."""
    return score(docs, train(docs, labels))

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import documents, text

from quillmark.llm import hmm


def test_forward_is_exact():
    g = np.random.default_rng(1)
    model = hmm.Model(g.dirichlet([1, 1, 1]), g.dirichlet([1, 1, 1], 3), g.dirichlet(np.ones(5), 3).T)
    sequences = [np.array(s) for s in ([0], [1, 2], [4, 4, 0, 1], [2, 3, 0, 0, 1])]
    for s, got in zip(sequences, hmm.log10_likelihood(model, sequences), strict=True):
        total = sum(model.start[p[0]] * model.emit[s[0], p[0]] * math.prod(model.move[p[k - 1], p[k]] * model.emit[s[k], p[k]] for k in range(1, len(s))) for p in itertools.product(range(3), repeat=len(s)))
        assert abs(got - math.log10(total)) < 1e-12


def test_baum_welch_counts_and_progress():
    g = np.random.default_rng(2)
    sequences = [g.integers(1, 6, n) for n in (1, 3, 40, 600, 7)]
    prior = np.full(6, 1 / 6)
    model = hmm.Model(g.dirichlet([1, 1]), g.dirichlet([1, 1], 2), g.dirichlet(np.ones(6), 2).T)
    starts, moves, emits = hmm.expected(model, sequences)
    assert abs(starts.sum() - 5) < 1e-9 and abs(emits.sum() - 651) < 1e-6 and abs(moves.sum() - 646) < 1e-6
    before = hmm.log10_likelihood(model, sequences).sum()
    assert hmm.log10_likelihood(hmm.maximise(starts, moves, emits, prior), sequences).sum() > before


def plain(rows):
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not hmm.held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens]


def test_the_end_counts_where_many_words_are_more_frequent(spark):
    rows = [(k, " ".join(f"w{x}" for x in range(hmm.TOP + 100)) + f" own{k}") for k in range(4)]
    rows = [(k, f"{t} {t}") for k, t in rows]
    out = {x["doc_id"]: x for x in hmm.score(documents(spark, rows)).collect()}
    for i, n, known, total, base in plain(rows):
        x = out[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (n, known, total) and abs(x["base_score"] - base) < 1e-6 * n


def test_base_is_exact_and_the_model_is_better(spark):
    r = random.Random(5)
    tongues = [[f"{p}{k}" for k in range(300)] for p in ("a", "b", "c")]
    rows = [(k, " ".join(r.choices(tongues[k % 3], k=r.randint(5, 200)))) for k in range(300)]
    out = {x["doc_id"]: x for x in hmm.score(documents(spark, rows)).collect()}
    for i, n, known, total, base in plain(rows):
        x = out[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"], x["held_out"]) == (n, known, total, zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(x["base_score"] - base) < 1e-8 * max(1, abs(base))
    held = [x for x in out.values() if x["held_out"]]
    gain = sum(x["score"] - x["base_score"] for x in held) / sum(x["n_tokens"] for x in held)
    assert gain > 0.3  # log10 3 is 0.48


def test_nulls_repeats_long_and_empty(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, text(1, 30000)), (4, "same"), (4, "same"), (5, " \t\n")]
    df = documents(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "score")
    out = hmm.score(df).collect()
    assert len(out) == 7 and sorted(r["n_tokens"] for r in out) == [1, 1, 1, 2, 2, 3, 30001]
    assert all(math.isfinite(r["score"]) for r in out)
    assert hmm.score(documents(spark, [])).collect() == []
    only = next(k for k in range(100) if hmm.held_out(k))
    r = hmm.score(documents(spark, [(only, "a b")])).first()
    assert (r["n_known"], r["train_tokens"], round(r["base_score"], 9)) == (0, 0, 0.0)


def test_segments_carry_states(monkeypatch):
    g = np.random.default_rng(7)
    sequences = [g.integers(1, 6, n) for n in (1, 9, 10, 11, 64, 200)]
    model = hmm.Model(g.dirichlet([1, 1, 1]), g.dirichlet([1, 1, 1], 3), g.dirichlet(np.ones(6), 3).T)
    whole = hmm._expected(model, sequences)
    monkeypatch.setattr(hmm, "SEGMENT", 5)
    for a, b in zip(whole, hmm._expected(model, sequences), strict=True):
        assert np.allclose(a, b, atol=1e-9)
    assert abs(whole[3] - hmm.log10_likelihood(model, sequences).sum()) < 1e-9


def test_probabilities_sum_to_one(spark):
    rows = [(k, w) for k, w in enumerate(["x", "y", "x z", "y y", "z q r", "", "x"] * 6)]
    chunks = hmm._encode(documents(spark, rows), "doc_id", "text")
    unigrams = hmm._unigrams(hmm._totals(chunks, 6))
    assert abs((10**unigrams.log_class).sum() - 1) < 1e-9
    prior = 10**unigrams.log_class
    model = hmm.learn(hmm._classes(chunks, hmm._totals(chunks, 6), unigrams).cache(), prior / prior.sum(), states=3)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and abs(model.start.sum() - 1) < 1e-9
    live = np.flatnonzero(prior > 1e-200)
    pairs = [np.array(p) for p in itertools.product(live.tolist(), repeat=2)]
    assert abs((10 ** hmm.log10_likelihood(model, pairs)).sum() - 1) < 1e-6


def test_documents_are_dealt_whole():
    prior = np.full(4, 0.25)
    emits = hmm._probabilities(np.array([[9.0, 0], [9, 0], [0, 9], [0, 9]]), prior)
    late = np.array([0] * 10 + [2, 3] * 40)  # begins like the first state, is of the second as a whole
    got = hmm._dealt(emits, [late, np.array([0, 1, 1]), np.zeros(0, int)]).reshape(4, 2)
    assert got[:, 1].sum() == 90 and got[:, 0].tolist() == [1, 2, 0, 0]

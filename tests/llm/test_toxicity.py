from __future__ import annotations

import random
import zlib

from helpers import documents, words

from quillmark.llm import toxicity


def corpus(n: int):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        w = words(k, r.randint(20, 150))
        bad = r.random() < 0.15
        if bad:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["grolk", "zurgh", "blarxing", "blarxed", "blarxt"]))
        rows.append((k, " ".join(w)))
        if r.random() < 0.6:
            labels.append((k, 1, int(bad)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500)
    out = {r["doc_id"]: r for r in toxicity.toxicity(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for k, r in out.items())
    held = [(out[k]["predicted"], t) for k, _, t in labels if out[k]["held_out"]]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.9 and hit / max(1, sum(p for p, _ in held)) > 0.9


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows, labels = corpus(400)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(documents(spark, rows), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flipped))
    assert a == b


def test_nulls_clashes_no_labels_and_empty(spark):
    rows = [(None, "a"), (1, None), (2, ""), (3, "x y"), (3, "x y")]
    df = documents(spark, rows).withColumnRenamed("lang", "score")
    none = spark.createDataFrame([(1, 1, None), (None, 1, 1)], LABELS)
    out = toxicity.toxicity(df, none).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in out)
    assert toxicity.toxicity(documents(spark, []), none).collect() == []


def test_gradient_follows_a_plain_loop():
    import math

    import numpy as np

    g = np.random.default_rng(4)
    texts = lambda n: [np.flatnonzero(g.random(6) < 0.4) for _ in range(n)]
    for scale in (0.1, 6.0):  # the second one makes the bracket negative
        p, u = texts(20), texts(30)
        w, bias, prior = g.normal(size=6) * scale, -0.3 if scale < 1 else -9.0, 0.4

        def parts(w, bias):
            f = lambda t: sum(w[k] for k in t) + bias  # noqa: E731, B023
            loss = lambda z: math.log1p(math.exp(-z))
            mean = lambda x: sum(x) / len(x)
            return prior * mean([loss(f(t)) for t in p]), mean([loss(-f(t)) for t in u]) - prior * mean([loss(-f(t)) for t in p])  # noqa: B023

        first, bracket = parts(w, bias)
        target = (lambda w, b: sum(parts(w, b))) if bracket >= 0 else (lambda w, b: -parts(w, b)[1])
        got, got_bias = toxicity.risk_gradient(toxicity._sparse(p), toxicity._sparse(u), w, bias, prior)
        for k in range(6):
            step = np.eye(6)[k] * 1e-5
            assert abs((target(w + step, bias) - target(w - step, bias)) / 2e-5 - got[k]) < 1e-6
        assert abs((target(w, bias + 1e-5) - target(w, bias - 1e-5)) / 2e-5 - got_bias) < 1e-6


def test_learning_decides(spark):
    """Without steps, and without the positive texts, nothing is found."""
    rows, labels = corpus(800)
    docs, known = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    truth = {k: t for k, _, t in labels if zlib.crc32(str(k).encode()) % 5 == 0}
    hits = lambda model: sum(r["predicted"] for r in toxicity.score(docs, model).collect() if truth.get(r["doc_id"]))
    assert hits(toxicity.train(docs, known)) > 0.8 * sum(truth.values())
    assert hits(toxicity.train(docs, known, steps=0)) == 0


def test_very_long_and_null_texts_meet_a_trained_model(spark):
    rows, labels = corpus(600)
    rows = [*rows, (9001, None), (9002, " ".join(words(1, 40000)) + " grolk zurgh blarxt grolk"), (None, "grolk"), (9003, "")]
    out = {r["doc_id"]: r for r in toxicity.toxicity(documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (77, 1, None)], LABELS)).collect()}
    assert len(out) == 604 and out[9001]["score"] == out[9003]["score"] < 0.5 and out[9002]["predicted"] == 1


def test_documents_without_a_label_take_part(spark):
    """U is drawn from all documents: what only unlabelled ones hold changes the weights."""
    rows, labels = corpus(800)
    known = {k for k, _, _ in labels}
    docs = lambda extra: documents(spark, [(k, t if k in known else f"{t} {extra}") for k, t in rows])
    model = lambda extra: toxicity.train(docs(extra), spark.createDataFrame(labels, LABELS))
    a, b = model(""), model("grolk blarxing")
    weights = lambda m: dict(zip(m.hashes.tolist(), m.weights.tolist(), strict=True))
    assert weights(a) != weights(b) and weights(a)

from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers import documents, text

from quillmark.llm import packing


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def check(rows, source, reference):
    by_sequence: dict[int, list] = {}
    pieces: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for sequence in by_sequence.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    for doc, t in source:
        ids = np.array([*reference(t), 0], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_pieces_cover_every_document(spark, reference):
    source = [(0, None), (1, ""), (2, "word"), (3, text(1, 9000)), (4, "x <|endoftext|> y"), (5, "a" * 5000), (6, " \n\t  \n"), *[(k, text(k, 60 + k)) for k in range(10, 90)], *[(k, text(7, 300)) for k in range(100, 130)]]
    check(packing.pack(documents(spark, source)).collect(), source, reference)


def test_with_ids_returns_the_tokens(spark, reference):
    source = [(1, text(1, 1500)), (2, text(2, 40))]
    rows = packing.pack(documents(spark, source), with_ids=True).collect()
    for doc, t in source:
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [i for r in own for i in r["ids"]] == [*reference(t), 0]


def test_null_id_repeats_and_other_columns(spark):
    df = documents(spark, [(None, "a b c"), (7, "same"), (7, "same")]).withColumnRenamed("lang", "shard").withColumnRenamed("source", "key")
    rows = packing.pack(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 7), (False, 7), (True, 0)]


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).collect() == []


def test_large_keys_are_split_and_small_ones_merged():
    bins = np.array([10, 5000, 0, 3, 2000, 100])
    first, ways, n = packing.shard_plan(bins, 2048)
    assert ways.tolist() == [1, 3, 1, 1, 1, 1] and n == 6
    assert len({int(first[k]) for k in (0, 1)}) == 2


def test_neighbours_by_bm25():
    tails = [np.array(x, dtype=np.uint32) for x in ([1, 2, 3, 4], [9, 8, 7], [1, 2, 30], [40, 41])]
    index = packing.Index(tails, np.bincount(np.concatenate(tails)), 4, 12)
    scores = index.scores(0)
    assert scores[2] > 0 and scores[1] == 0 and scores[3] == 0
    sequences = list(packing.fill(tails, index, 8))
    assert sequences[0][:2] == [(0, 0, 4), (2, 0, 3)]


def test_scores_are_those_of_plain_bm25():
    """All terms of the seed count, common and rare ones alike."""
    import math

    g = np.random.default_rng(3)
    tails = [np.append(g.zipf(1.3, g.integers(1, 200)) % 900, 0).astype(np.uint32) for _ in range(120)] + [np.array([7, 8], dtype=np.uint32)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=1000) * 3
    documents, tokens = 400, 40_000
    index = packing.Index(tails, df, documents, tokens)

    def plain(q, d):
        out = 0.0
        for t in set(q.tolist()):
            tf = int((d == t).sum())
            if tf:
                out += math.log1p((documents - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / (tokens / documents)))
        return out

    got = index.scores_of([0, 5, 120])
    for k, s in enumerate((0, 5, 120)):
        assert np.allclose(got[k], [plain(tails[s], d) for d in tails], atol=1e-3)
    assert np.allclose(index.scores(5), got[1], atol=1e-3)


def test_windows_follow_a_plain_packer(spark):
    """With one shard the greedy windows are those of a packer written plainly: longest seed, then the best scored unused tails."""
    g = np.random.default_rng(5)
    tails = [g.integers(0, 300, int(n)).astype(np.uint32) for n in g.integers(5, 120, 60)]
    index = packing.Index(tails, np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=300), 60, sum(map(len, tails)))
    left = {d: len(t) for d, t in enumerate(tails)}
    want = []
    while sum(left.values()) >= 256:
        seed = min((d for d in left if left[d]), key=lambda d: (-len(tails[d]), d))
        room, window, scores = 256, [], index.scores(seed)
        for d in [seed, *sorted((d for d in left if left[d] and d != seed and scores[d] > 0), key=lambda d: (-scores[d], d))]:
            n = min(room, left[d])
            if n:
                window.append((d, len(tails[d]) - left[d], n))
                left[d] -= n
                room -= n
        if room:
            break
        want.append(window)
    assert list(packing.fill(tails, index, 256))[: len(want)] == want and len(want) > 10


def test_several_shards_keep_neighbours_together(spark, reference):
    """Four tongues, more tails than a shard takes: all pieces are there, and most of the neighbours by plain BM25 over all tails share a shard."""
    import random

    r = random.Random(2)
    tongues = [[f"{p}{k}{q}" for k in range(150) for q in ("o", "ix")] for p in ("ba", "ku", "tze", "mli")]
    source = [(k, " ".join(r.choices(tongues[k % 4], k=r.randint(10, 60)))) for k in range(800)] + [(1000 + k, "one hot text of many copies") for k in range(400)]
    rows = packing.pack(documents(spark, source), shard_docs=128).collect()
    check(rows, source, reference)
    shard = {x["doc_id"]: x["sequence_id"] >> 32 for x in rows}
    assert len(set(shard.values())) >= 9
    amount = {s: sum(v == s for v in shard.values()) for s in set(shard.values())}
    assert max(amount.values()) <= 2 * 128
    together = [len({k % 4 for k in range(800) if shard[k] == s}) for s in amount if any(shard[k] == s for k in range(800))]
    assert sum(together) / len(together) < 1.8


def test_tree_is_the_same_whatever_the_order_of_rows():
    g = np.random.default_rng(1)
    x = g.normal(size=(50, packing.DIMENSIONS)).astype(np.float32)
    tree = packing.Tree(x, 9)
    leaf = tree.leaf(x)
    assert leaf.min() >= 0 and leaf.max() < tree.first[-1] <= 12 and (tree.leaf(x[::-1])[::-1] == leaf).all()
    assert packing.Tree(x[:0], 3).leaf(x).tolist() == [0] * 50

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from helpers import documents, text, words

from quillmark.llm import jaccard


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(x), find(y))] = min(find(x), find(y))
    groups: dict[int, list] = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def got(spark, rows):
    return sorted(map(tuple, jaccard.jaccard_join(documents(spark, rows).repartition(3)).collect()), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        if k and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words(1, 50))
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randint(0, 12))]
            rows.append((k, " ".join(w)))
        else:
            rows.append((k, text(r.randint(0, 10**6), r.choice([1, 3, 5, 6, 9, 30, 80, 120]))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (903, "One TWO"), (904, "one two"), (905, text(1, 20000)), (906, text(1, 20000)), (None, text(1, 20000)), (903, "One TWO")]
    assert got(spark, rows) == plain(rows)


def test_chain_of_near_copies_and_common_passage(spark):
    base = words(3, 100)
    rows, w = [], list(base)
    for k in range(40):  # each differs a little from the one before, and far copies do not link directly
        w[(k * 2) % 100] = f"new{k}"
        rows.append((k, " ".join(w)))
    common = text(77, 30)
    rows += [(1000 + k, common + " " + text(5000 + k, 20)) for k in range(60)]
    assert got(spark, rows) == plain(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 400)
    rows = corpus(3)
    assert got(spark, rows) == plain(rows)


def test_hot_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    base, rows = words(9, 100), []
    for k in range(120):  # all near the first text
        w = list(base)
        w[(7 * k) % 100] = f"own{k}"
        rows.append((k, " ".join(w)))
    w = rows[119][1].split()
    for k in range(12):  # further and further from it
        w[(5 * k + 3) % 100] = f"far{k}"
        rows.append((500 + k, " ".join(w)))
    assert got(spark, rows) == plain(rows)


def test_a_united_group_meets_other_nodes_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    heavy = spark.createDataFrame([(1, k, 10, b"", b"") for k in range(200)], "label long, node long, n long, names binary, df binary")
    united = spark.createDataFrame([(k, 0 if k < 180 else 180) for k in range(185)], "node long, label long")
    rows = jaccard._block_pairs(heavy, united).collect()
    pairs = {(r["i"], r["j"]) for r in rows}
    assert pairs == {(i, j) for i in (0, 1) for j in range(i, 20)}  # 2 shared blocks, 18 of the group
    assert {r["node"] for r in rows} == set(range(200))


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    df = documents(spark, [(2, "a b c d e"), (1, "A b c d e")]).withColumnRenamed("lang", "node").withColumnRenamed("source", "n")
    assert sorted(map(tuple, jaccard.jaccard_join(df).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_components(spark):
    from quillmark.llm.graph import connected_components

    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (None, 4), (4, None), (1, 2)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (8, 6), (9, 6)}
    assert connected_components(edges.filter("false")).count() == 0
    path = spark.range(300).selectExpr("id a", "id + 1 b", "'x' label")
    assert {r["label"] for r in connected_components(path).collect()} == {0}


def test_rounds_do_not_multiply_the_estimate_of_a_size(spark):
    from quillmark.llm.graph import connected_components

    for n in (3, 300):
        labels = connected_components(spark.range(n).selectExpr("id a", "id + 1 b"))
        assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64  # of one number for each node of a plan
        assert {tuple(r) for r in labels.collect()} == {(k, 0) for k in range(n + 1)}


def shared_sets(seed, n, size, edits, differ):
    """Near copies of two sets, as link takes them: sizes, the shingles that others have too, and their document frequencies."""
    r = np.random.default_rng(seed)
    base = r.integers(1, 1 << 63, (2, size), dtype=np.uint64)
    base[1, differ:] = base[0, differ:]
    sets = []
    for k in range(n):
        s = base[k % 2].copy()
        s[r.integers(0, size, edits)] = r.integers(1, 60, edits)
        sets.append(np.unique(s))
    names, df = np.unique(np.concatenate(sets), return_counts=True)
    found = [df[np.searchsorted(names, s)] for s in sets]
    return [len(s) for s in sets], [s[d > 1] for s, d in zip(sets, found, strict=True)], [d[d > 1].astype(np.uint16) for d in found]


@pytest.mark.parametrize("seed", range(6))
def test_links_between_sides_against_brute_force(seed):
    sizes, sets, dfs = shared_sets(seed, 90, 60, 3 + seed, 7)
    for side in (None, [k % 3 % 2 for k in range(90)]):
        plain = jaccard._Groups(90)
        for x in range(90):
            for y in range(x):
                both = len(np.intersect1d(sets[x], sets[y]))
                if (side is None or side[x] != side[y]) and 100 * both >= 80 * (sizes[x] + sizes[y] - both):
                    plain.union(x, y)
        got = jaccard.link(sizes, sets, dfs, side)
        assert [got.find(k) for k in range(90)] == [plain.find(k) for k in range(90)]


def test_a_large_group_of_near_copies_is_linked_fast():
    sizes, sets, dfs = shared_sets(1, 1500, 400, 8, 0)
    began = time.process_time()
    groups = jaccard.link(sizes, sets, dfs)
    assert {groups.find(k) for k in range(1500)} == {0}
    assert time.process_time() - began < 6

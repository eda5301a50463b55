from __future__ import annotations

import hashlib
import random

import pytest
from helpers import documents, text

from quillmark.llm import suffix


def plain(rows):
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(spark, rows, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(documents(spark, rows).repartition(5), **options).collect()}


def test_cover():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))
    assert suffix.BLOCK + suffix.PERIOD - 1 == suffix.LENGTH


def test_against_brute_force(spark):
    r = random.Random(4)
    passages = [text(1000 + k, r.randint(12, 60)) for k in range(12)]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(r.randint(0, 5)):
            x = r.random()
            parts.append(r.choice(passages) if x < 0.4 else text(r.randint(0, 10**6), r.randint(1, 60)) if x < 0.8 else r.choice(passages)[r.randint(0, 40) :][: r.randint(50, 140)])
        rows.append((k, "é ".join(parts)))
    rows += [(200 + k, rows[3][1]) for k in range(9)] + [(300, "ab" * 400), (301, "a" * 1000), (302, "ba" * 75), (303, None), (304, ""), (305, "x" * 100), (306, "x" * 99), (None, rows[5][1]), (400, text(5, 3000) + text(5, 3000))]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("cut", [99, 100, 101, 113, 130, 131, 160])
def test_matches_of_just_the_length(spark, cut):
    a, b = text(1, 200), text(2, 200)
    rows = [(k, b[:shift] + "#" + a[300 : 300 + cut] + "#" + b[200 : 200 + k]) for k, shift in enumerate((0, 7, 31, 40, 62))] + [(9, a)]
    assert got(spark, rows) == plain(rows)


def test_small_packs_empty_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PACK_BYTES", 500)
    rows = [(k, text(k % 4, 80)) for k in range(20)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == {}
    twice = suffix.remove_repeats(documents(spark, [(1, text(1, 60))] * 2)).collect()
    assert sorted(r["n_removed"] for r in twice) == [0, len(text(1, 60))]


def test_remaining_text(spark):
    a = text(1, 60)
    out = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix.remove_repeats(documents(spark, [(1, a), (2, "new " + a + " end")]).withColumnRenamed("lang", "kept"), with_text=True).collect()}
    assert out == {1: a, 2: "new  end"}

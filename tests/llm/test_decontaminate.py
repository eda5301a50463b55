from __future__ import annotations

import random
import re

from helpers import documents, text

from quillmark.llm import decontaminate as d


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


QUESTION = "A farmer has 12 apples and gives 5 of them to Anna before walking 3 km home with the 7 apples that remain"


def found(spark, docs, bench):
    return {(r["doc_id"], r["item_id"]): r for r in d.contamination(documents(spark, docs), items(spark, bench)).collect()}


def test_exact_and_other_parameters(spark):
    other = QUESTION.replace("12", "40").replace("Anna", "Boris Novak").replace("5", "19").replace("3 km", "8 km").replace("the 7", "the 21")
    out = found(spark, [(1, f"{text(1, 50)} {QUESTION} {text(2, 50)}"), (2, f"{text(3, 80)}. {other}. {text(4, 20)}"), (3, text(5, 300))], [(10, QUESTION), (11, text(99, 40))])
    assert set(out) == {(1, 10), (2, 10)}
    assert out[1, 10]["changed"] == 0 and out[2, 10]["changed"] == 5


def test_slots_must_be_consistent(spark):
    item = "take 4 red stones and put 4 red stones on the left table then count 9 grey birds near the tall old tower"
    twisted = item.replace("take 4", "take 6").replace("put 4", "put 8")
    fine = item.replace("4", "6")
    out = found(spark, [(1, twisted), (2, fine)], [(1, item)])
    assert set(out) == {(2, 1)}


def test_items_of_one_template_keep_their_own_values(spark):
    item = "Tom has {} apples and buys {} more pears at the old market"
    bench = [(1, item.format(5, 5)), (2, item.format(3, 8)), (3, item.format(3, 8))]
    out = found(spark, [(1, item.format(3, 8)), (2, item.format(5, 5)), (3, item.format(7, 9))], bench)
    assert set(out) == {(1, 2), (1, 3), (2, 1), (3, 2), (3, 3)}
    assert out[1, 2]["changed"] == out[2, 1]["changed"] == 0 and out[3, 2]["changed"] == 2


def test_items_of_numbers_and_short_items_are_found_word_for_word(spark):
    bench = [(1, "What is 12 + 7 * 3?"), (2, "Rome 1960 Tokyo 1964 Mexico 1968 Munich 1972 Montreal 1976"), (3, "blue quokka")]
    docs = [(1, f"{text(1, 20)}. {bench[0][1]} {text(2, 20)}"), (2, f"{text(3, 20)} {bench[1][1]} {text(4, 20)}"), (3, f"{text(5, 20)} blue quokka {text(6, 9)}"), (4, "What is 12 + 8 * 3? A blue tall quokka")]
    out = found(spark, docs, bench)
    assert set(out) == {(1, 1), (2, 2), (3, 3)} and all(r["changed"] == 0 for r in out.values())


def test_passage_inside_a_sentence_and_long_text(spark):
    item = text(7, 30).capitalize()
    out = found(spark, [(1, text(8, 30000) + " " + item + " " + text(9, 10)), (2, text(10, 30000))], [(5, item)])
    assert set(out) == {(1, 5)}


def test_short_items_nulls_and_empty_tables(spark):
    docs = [(1, None), (2, ""), (None, QUESTION), (3, "we saw four tall green trees today"), (3, "we saw four tall green trees today")]
    out = found(spark, docs, [(1, None), (2, ""), (3, "four tall green trees"), (4, "one"), (None, QUESTION)])
    assert set(out) == {(3, 3)}
    assert found(spark, [], [(1, QUESTION)]) == {} and found(spark, [(1, QUESTION)], []) == {}


def test_without_filter_the_result_is_the_same(spark, monkeypatch):
    docs, bench = [(1, f"{text(1, 50)} {QUESTION}"), (2, text(5, 300))], [(10, QUESTION)]
    one = found(spark, docs, bench)
    monkeypatch.setattr(d, "FILTER_WINDOWS", -1)
    assert set(found(spark, docs, bench)) == set(one) == {(1, 10)}


def test_decontaminate_keeps_the_others(spark):
    docs = documents(spark, [(1, QUESTION), (2, text(5, 30)), (None, None)])
    assert {r["doc_id"] for r in d.decontaminate(docs, items(spark, [(1, QUESTION)])).collect()} == {2, None}


def plain_contamination(doc: str, item: str) -> tuple[int, int] | None:
    """(windows, item windows) by the definitions, for texts of small letters and numbers alone, so that numbers are the only slots."""
    spell = lambda t: [(m[0], m[0].isdigit()) for m in re.finditer(r"[0-9]+|[a-z]+", t)]
    a, b = spell(doc), spell(item)
    best = None
    literal = len(b) < d.SHORTEST or not all(sum(not n for _, n in b[i : i + min(d.WINDOW, len(b))]) >= d.LITERALS * min(d.WINDOW, len(b)) for i in range(len(b) - min(d.WINDOW, len(b)) + 1))
    for exact in (False, True):
        if (exact and not literal) or (not exact and len(b) < d.SHORTEST):
            continue
        width = min(d.WINDOW, len(b))
        face = (lambda t: t[0]) if exact else (lambda t: "<n>" if t[1] else t[0])
        good = [i for i in range(len(b) - width + 1) if exact or sum(not n for _, n in b[i : i + width]) >= d.LITERALS * width]
        if not good:
            continue
        shifts: dict[int, list[int]] = {}
        for i in good:
            for j in range(len(a) - width + 1):
                if [face(x) for x in a[j : j + width]] == [face(x) for x in b[i : i + width]]:  # noqa: B023
                    shifts.setdefault(j - i, []).append(i)
        found: set[int] = set()
        for shift, own in shifts.items():
            pairs = set() if exact else {(b[i + k][0], a[i + shift + k][0]) for i in own for k in range(width) if b[i + k][1]}
            if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                found |= set(own)
        if len(found) / len(good) >= d.COVERAGE and (best is None or len(found) / len(good) > best[0] / best[1]):
            best = (len(found), len(good))
    return best


def test_brute_force(spark):
    """Random items and documents with whole, cut, re-parameterised, twisted and distant copies."""
    r = random.Random(11)
    pool = ["apple", "book", "cat", "door", "egg", "fish", "goat", "hat", "ink", "jar", "kite", "lamp"]

    def item() -> list[str]:
        n = r.choice([2, 5, 9, 14, 25])
        return [str(r.randint(1, 9)) if r.random() < r.choice([0.1, 0.3, 0.7]) else r.choice(pool) for _ in range(n)]

    items_ = [item() for _ in range(30)]
    docs = []
    for k in range(150):
        words = r.choices(pool, k=r.randint(0, 12))
        own = list(r.choice(items_))
        kind = k % 5
        if kind == 1:
            own = own[: max(1, len(own) * 2 // 3)]
        elif kind == 2:
            swap = {str(i): str(i * 7 + 10) for i in range(10)}
            own = [swap.get(w, w) for w in own]
        elif kind == 3:
            own = [str(r.randint(1, 9)) if w.isdigit() else w for w in own]
        elif kind == 4 and len(own) > 3:
            own[len(own) // 2] = "zzz"
        docs.append(" ".join([*words, *own, *r.choices(pool, k=r.randint(0, 12))]))
    texts = [" ".join(x) for x in items_]
    want = {(i, j): w for i, t in enumerate(docs) for j, u in enumerate(texts) if (w := plain_contamination(t, u))}
    got = {k: (x["windows"], x["item_windows"]) for k, x in found(spark, list(enumerate(docs)), list(enumerate(texts))).items()}
    assert set(got) == set(want) and len(want) > 60
    assert all(abs(got[k][0] / got[k][1] - want[k][0] / want[k][1]) < 1e-9 for k in want)


def test_columns_of_documents_may_clash(spark):
    docs = documents(spark, [(1, QUESTION), (2, text(5, 30))]).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "template").withColumnRenamed("n_chars", "window")
    assert {(x["doc_id"], x["item_id"]) for x in d.contamination(docs, items(spark, [(7, QUESTION)])).collect()} == {(1, 7)}
    assert d.decontaminate(docs, items(spark, [(7, QUESTION)])).columns == docs.columns


def test_a_text_that_repeats_a_template_very_often(spark):
    """40,000 lines with other numbers, 3 MB: alignments are rows, so the work is linear in them."""
    import time

    item = "A train leaves the town at 5 and meets the other train after 7 hours near the old bridge"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    took = []
    for n in (4_000, 40_000):
        text = "\n".join(item.replace("5", str(10 + k)).replace("7", str(200_000 + k)) for k in range(n))
        began = time.time()
        rows = d.contamination(documents(spark, [(1, text)]), benchmark).collect()
        took.append(time.time() - began)
        assert [(r["doc_id"], r["item_id"], r["coverage"], r["changed"]) for r in rows] == [(1, 1, 1.0, 2 * n)]
    assert took[1] < 10 * took[0] + 20

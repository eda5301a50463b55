from __future__ import annotations

import hashlib
import re

import numpy as np
from helpers import documents, text
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import pii


def plain(t: str) -> list[tuple[int, int, int]]:
    """The four definitions, as they are written."""
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return sorted((k, *m.span()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t) if ok(m[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123459.-+ ()@ab%é", max_size=60))
def test_base_spans_follow_the_definitions(t):
    assert pii.base_spans(t) == plain(t)


def test_base_spans_of_cards_and_addresses():
    t = "a@b.co 4111 1111 1111 1111 x 4111111111111111 +1 (456) 555-2186, 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 j@k"
    assert pii.base_spans(t) == plain(t)
    assert [s[0] for s in pii.base_spans(t)] == [0, 1, 1, 1, 2, 2, 3]


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000, "@" * 100_000, "+" * 100_000, "1." * 100_000, "a@" * 100_000):
        pii.base_spans(t)
        pii.candidates(t[:100_000])


def test_query_columns(spark):
    rows = [(1, None), (2, ""), (None, "x a@b.co"), (3, f"{text(1, 40000)} +49 30 1234567 {text(2, 20)}"), (4, "é 10.1.2.3"), (4, "é 10.1.2.3")]
    out = pii.find_pii(documents(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "spans"), redact=True).collect()
    assert len(out) == 6
    for r in out:
        t = next(t for i, t in rows if i == r["doc_id"]) or ""
        base = plain(t)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(pii.spell(base).split(",")) <= set(r["spans"].split(",")) | {""}
    assert {r["redacted"] for r in out if r["doc_id"] == 4} == {"é <ip>"}
    assert pii.find_pii(documents(spark, [])).collect() == []


def test_trees_add_other_notations_and_leave_numbers_alone(spark):
    x, y = pii.grammar(1500, seed=11)
    forest = pii.fit(x, y)
    hx, hy = pii.grammar(600, seed=77)
    p = forest.probability(hx) >= forest.threshold
    assert p[hy == 1].mean() > 0.8 and p[hy == 0].mean() < 0.05
    added = pii.add_spans("call me on (456) 555-2186 or mail jo.doe (at) example.org please", [], forest)
    assert [s[0] for s in added] == [0, 3]
    assert pii.add_spans("version 3.14.159 of 2021-03-04 10, id=deadbeef12345678cafe", [], forest) == []
    assert np.isfinite(forest.probability(x)).all()


def test_numbers_side_by_side_are_found_whole():
    forest = pii.fit(*pii.grammar())
    found = lambda t: [t[a:b] for _, a, b in pii.add_spans(t, pii.base_spans(t), forest)]
    assert found("555-123-4567 555-765-4321") == ["555-123-4567", "555-765-4321"]
    assert found("call 020 7946 0958 or 020 7946 0959.") == ["020 7946 0958", "020 7946 0959"]
    assert "555-123-4567" in found("on 2024-05-01 555-123-4567 rang")


def test_recall_of_planted_data_and_clean_texts():
    """Keys, passwords, account numbers and other notations inside prose, none of which the base rules know."""
    forest = pii.fit(*pii.grammar())
    g = np.random.default_rng(9)
    of = lambda letters, k: "".join(letters[x] for x in g.integers(0, len(letters), k))
    upper, low, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "0123456789"
    makers = [
        lambda: ("", "AKIA" + of(upper, 16)), lambda: ("password=", of(low, 18)), lambda: ('token = "', of(low, 40)), lambda: ("tel: ", f"({of(digits, 3)}) {of(digits, 3)}-{of(digits, 4)}"),
        lambda: ("write to ", f"{of('abcdefg', 6)} (at) {of('hijklm', 7)}.org"), lambda: ("", "GB82 WEST 1234 5698 7654 32"), lambda: ("host ", ":".join(of(low, 4) for _ in range(8))),
    ]
    hits = 0
    for k in range(210):
        lead, body = makers[k % len(makers)]()
        head = text(k, 30) + " " + lead
        spans = pii.add_spans(f"{head}{body} {text(k + 1000, 20)}", [], forest)
        hits += any(a <= len(head) and b >= len(head) + len(body) for _, a, b in spans)
    assert hits >= 0.9 * 210
    clean = [f"{text(k, 40)} in 2021, page {k} of 300, version {k}.2.1, 12:30:45, {k}00 items" for k in range(200)]
    assert sum(bool(pii.add_spans(t, [], forest)) for t in clean) <= 4
    assert pii._account("GB82 WEST 1234 5698 7654 32") and not pii._account("GB82 WEST 1234 5698 7654 33")


def test_many_spans_take_near_linear_time():
    import time

    forest = pii.fit(*pii.grammar())
    spent = []
    for n in (2_000, 8_000):
        t = "a@b.co 555-123-4567 x " * n
        began = time.process_time()
        assert len(pii.add_spans(t, pii.base_spans(t), forest)) == 2 * n
        spent.append(time.process_time() - began)
    assert spent[1] < 9 * spent[0]

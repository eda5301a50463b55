from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.operators import lexicon as lx
from quillmark.plans import catalog

LEXICON = lx.Lexicon.of([
    ("sector", "transport", 3, "keyword", "mobilité"), ("sector", "transport", 3, "keyword", "mobilité durable"), ("sector", "transport", 3, "pattern", r"transport\w*"),
    ("sector", "entreprise_mission", 4, "keyword", "société à mission"), ("expertise", "strategie", 3, "keyword", "plan stratégique"), ("expertise", "raison_etre", 3, "keyword", "raison d'être"),
    ("posture", "posture", 3, "keyword", "accompagnement"), ("red_flag", "red_flag", 1, "keyword", "mod"), ("red_flag", "red_flag", 1, "pattern", r"travaux de \w+"), ("reference_client", "clients", 1, "keyword", "ter"),
])


def hits(text: str, keywords: list[str], patterns: list[str] = ()) -> list[str]:
    rows = [("sector", "c", 3, "keyword", k) for k in keywords] + [("sector", "c", 3, "pattern", p) for p in patterns]
    c = lx.Lexicon.of(rows).axes["sector"][0]
    return lx.match(lx.plain(text), c.keywords, c.patterns)


def test_longest_first_and_covered():
    assert hits("la mobilite durable", ["mobilité", "mobilité durable"]) == ["mobilité durable"]
    assert hits("mobilite durable et mobilite", ["mobilité", "mobilité durable"]) == ["mobilité durable", "mobilité"]


def test_word_boundary_and_escapes():
    assert hits("automobilite", ["mobilité"]) == [] and hits("c++ et r.s.e", ["c++", "r.s.e", "rxsxe"]) == ["r.s.e", "c++"]


def test_accented_and_plain_spelling_take_different_places():
    assert hits("energie puis energie", ["énergie", "energie"]) == ["énergie", "energie"] and hits("energie", ["énergie", "energie"]) == ["énergie"]


def test_patterns_use_their_first_place():
    assert hits("transport, transport", [], [r"transport"]) == ["transport"]
    assert hits("le transport", ["transport"], [r"le trans"]) == ["transport", "le trans"]
    assert hits("transport", ["transport"], [r"trans"]) == ["transport"]


def score(spark, title, description="", buyer="", flags=None):
    df = spark.createDataFrame([(title, description, buyer)], "title string, description string, acheteur string")
    return lx.score(df, LEXICON, flags).first()


def test_scores_bonuses_and_gate(spark):
    r = score(spark, "Plan stratégique de mobilité durable", "accompagnement du COMEX")
    assert (r["sector_score"], r["expertise_score"], r["posture_score"]) == (7, 7, 7) and r["base_score"] == 21
    assert r["bonuses"] == ["executive_level", "strategy_or_innovation"] and r["keyword_score"] == 37
    assert r["confidence"] == "LOW" and tuple(r["gate"]) == (True, "confidence_faible", "LOW")


def test_bonus_of_purpose_excludes_that_of_mission(spark):
    r = score(spark, "société à mission : raison d'être")
    assert "purpose_expertise" in r["bonuses"] and "mission_sector" not in r["bonuses"]
    assert "mission_sector" in score(spark, "société à mission")["bonuses"]


def test_codir_is_no_executive_level_but_comdir_is(spark):
    assert "executive_level" not in score(spark, "codir")["bonuses"] and "executive_level" in score(spark, "comdir")["bonuses"]


def test_flags_have_no_boundary_and_buyers_count_for_clients(spark):
    r = score(spark, "modernisation et Travaux de voirie", buyer="Intervention SA")
    assert r["red_flags"] == ["mod", "travaux de voirie"] and {"red_flags", "no_sector", "reference_client"} <= set(r["bonuses"]) and r["keyword_score"] == 0
    assert "dynamic_red_flag" in score(spark, "mobilité", flags=["MOBILITÉ"])["bonuses"]


def test_nulls(spark):
    df = spark.createDataFrame([(None, None, None)], "title string, description string, acheteur string")
    assert lx.score(df, LEXICON).first()["keyword_score"] == 0


def test_read_and_lookup(spark):
    rules = spark.createDataFrame([("sector", "a", 3, "keyword", "mobilité durable", 1), ("sector", "b", 3, "pattern", r"trans\w+", 2)], schemas.LEXICON)
    assert [c.name for c in lx.Lexicon.read(rules).axes["sector"]] == ["a", "b"]
    assert [r["category"] for r in lx.category_of_term(rules, "Mobilité").collect()] == ["a"]
    assert [r["category"] for r in lx.category_of_term(rules, "transport").collect()] == ["b"]


def reference(title: str, text: str, buyer: str) -> tuple:
    """The scoring of the catalogue's demo lexicon, written as loops."""
    fold = lambda s: " ".join("".join(c for c in unicodedata.normalize("NFD", s.lower()) if not 0x300 <= ord(c) <= 0x36F).split())
    full, wide = fold(f"{title} {text}"), fold(f"{title} {text} {buyer}")
    import math

    def count(keywords, patterns):
        spans, found = [], set()
        inside = lambda a, b: any(x <= a and b <= y for x, y in spans)
        for k in sorted(keywords, key=len, reverse=True):
            for m in re.finditer(rf"(?<![a-zA-Z]){re.escape(k)}(?![a-zA-Z])", full):
                if not inside(m.start(), m.end()):
                    spans.append((m.start(), m.end()))
                    found.add(k)
                    break
        for p in patterns:
            for m in re.finditer(p, full, re.I):
                a = full.find(m[0])
                if not inside(a, a + len(m[0])):
                    spans.append((a, a + len(m[0])))
                    found.add(m[0])
        return len(found)

    points = lambda n, cap: min(cap, math.floor(math.log(n + 1) * 10.5 + 0.5)) if n else 0
    mobility, energy = points(count(["the thonti", "tion"], []), 15), points(count([], [r"eren\w+"]), 15)
    strategy, purpose, posture = points(count(["and the"], []), 10), points(count(["de la"], []), 10), points(count(["for"], []), 15)
    sector, expertise = min(50, mobility + energy), min(40, strategy + purpose)
    total = sector + expertise + min(15, posture)
    total += 15 * ("src1" in wide) + 10 * (purpose > 0) + 8 * bool(re.search("co(m(ex|dir))", wide)) + 5 * (strategy > 0 and purpose > 0) + 8 * ("strategi" in wide or "innov" in wide)
    total -= 30 * ("idiot" in wide) + 30 * ("scum" in full) + 15 * (sector == 0)
    return max(0, min(100, total)), sector, expertise, min(15, posture)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_catalogue_query_against_loops(spark, sf):
    out = {r["doc_id"]: r for r in catalog.keyword_score(spark, sf).collect()}
    for n in catalog.notices(spark, sf).select("doc_id", "title", "description", "acheteur").collect():
        r = out[n["doc_id"]]
        assert (r["keyword_score"], r["sector_score"], r["expertise_score"], r["posture_score"]) == reference(n["title"], n["description"], n["acheteur"])


def test_matcher_runs_in_batches(spark):
    df = spark.createDataFrame([("mobilite durable",)] * 3, "t string").select(lx.matches(F.col("t"), LEXICON, "sector").alias("m"))
    assert [r["m"][0]["terms"] for r in df.collect()] == [["mobilité durable"]] * 3


def test_automaton_finds_every_place_of_every_term(monkeypatch):
    """Random texts and terms that overlap, in lanes of a few characters."""
    import random

    from quillmark.operators import automaton

    r = random.Random(4)
    for lane in (1, 3, 1024):
        monkeypatch.setattr(automaton, "LANE", lane)
        monkeypatch.setattr(automaton, "AT_ONCE", 200)
        for _ in range(30):
            terms = ["".join(r.choices("ab é", k=r.randrange(0, 6))) for _ in range(12)]
            texts = ["".join(r.choices("ab éz-😀", k=r.randrange(0, 60))) for _ in range(20)]
            a = automaton.Automaton(terms)
            letter = lambda c: c.isascii() and c.isalpha()
            want = sorted((k, n, i, not (i and letter(t[i - 1])) and not letter(t[i + len(b) : i + len(b) + 1])) for k, t in enumerate(texts) for n, b in enumerate(a.terms) for i in range(len(t)) if t.startswith(b, i))
            assert list(zip(*(x.tolist() for x in a.hits(texts)), strict=True)) == want
    assert [len(x) for x in automaton.Automaton([]).hits(["a"])] == [0] * 4


def test_one_pass_gives_what_the_plain_matcher_gives(spark):
    """Terms inside terms, in several categories and axes, with patterns."""
    import random

    r = random.Random(6)
    pool = ["eau", "eau potable", "potable", "au pot", "reseau", "réseau d'eau", "d'eau", "o", "e"]
    rows = [(axis, f"c{k % 3}", 3, "keyword", t) for k, axis in enumerate(("sector", "expertise", "posture")) for t in r.sample(pool, 6)] + [("sector", "c0", 3, "pattern", r"eau p\w+"), ("red_flag", "f", 1, "keyword", "seau"), ("red_flag", "f", 1, "keyword", "")]
    lexicon = lx.Lexicon.of(rows)
    texts = [" ".join(r.choices([*pool, "le", "x"], k=r.randrange(0, 14))) for _ in range(120)] + [None, ""]
    frame = spark.createDataFrame([(k, None if t is None else lx.plain(t)) for k, t in enumerate(texts)], "k int, t string")
    axes = ("sector", "expertise", "posture")
    for row in frame.select("k", "t", lx.axis_matches(F.col("t"), lexicon, axes, ("red_flag",)).alias("m")).collect():
        full = row["t"] or ""
        for a in axes:
            want = [(c.name, h) for c in lexicon.axes[a] if (h := lx.match(full, c.keywords, c.patterns))]
            assert [(m["category"], m["terms"]) for m in row["m"][a]] == want
        assert row["m"]["red_flag"] == [k for k, b in lexicon.axes["red_flag"][0].keywords if b in full]


def test_a_term_is_told_with_its_categories(spark):
    """Whole words within keywords, keywords within the term, patterns, red flags, and terms that nothing knows."""
    rules = spark.createDataFrame([("sector", "a", 3, "keyword", "réseau d'eau", 1), ("expertise", "b", 2, "keyword", "c++", 2), ("red_flag", "f", 1, "keyword", "eau", 3), ("sector", "p", 1, "pattern", r"\bgaz\w*", 4), ("sector", "e", 1, "keyword", " ", 5)], schemas.LEXICON)
    labels = spark.createDataFrame([("a", "Eaux", "Des eaux."), ("f", "Drapeau", "Hors sujet.")], "category string, label string, description string")
    told = lambda t: lx.term_summary(lx.category_of_term(rules, t), labels, t).first()
    assert told("Eau")["summary"] == '"Eau" est classé dans Eaux (weight: 3). Cependant, il est aussi signalé comme red flag potentiel dans certains contextes : Hors sujet.'
    assert told("D")["summary"] == '"D" → Eaux (weight: 3). Des eaux.'
    assert told("eaux")["summary"] == '"eaux" est un red flag : Hors sujet. Il signale que l\'AO est probablement hors périmètre.'
    assert [r["category"] for r in lx.category_of_term(rules, "C++ et").collect()] == ["b"] and lx.category_of_term(rules, "c+").count() == 0
    assert [r["category"] for r in lx.category_of_term(rules, "gazier").collect()] == ["p"]
    assert (told("xyz")["found"], told("xyz")["summary"].startswith('"xyz" n')) == (False, True)

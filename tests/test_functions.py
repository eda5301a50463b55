from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmark.functions import extract, scores, temporal, text

UUID = "0A1B2C3D-1111-4222-8333-444455556666"


@pytest.fixture(scope="module")
def one(spark):
    base = spark.range(1)

    def value(column):
        return base.select(column.alias("v")).first()["v"]

    return value


@pytest.mark.parametrize("raw", ["Élan  d’Été", "ÀÇÑ ö ß œ", "é x", "", "  a\tb\nc ", "Ǆ ﬁ Ω Ё й"])
def test_normalize_is_decomposition_without_marks(one, raw):
    plain = "".join(c for c in unicodedata.normalize("NFD", raw.lower()) if not 0x300 <= ord(c) <= 0x36F)
    assert one(text.normalize(F.lit(raw))) == " ".join(plain.split())


def test_keys_and_words(one):
    assert one(text.normalize_words(F.lit("L'École n°3, Saint-Étienne!"))) == "l ecole n 3 saint etienne"
    assert one(text.normalize_key(F.lit("é" * 150))) == "e" * 100 and one(text.normalize_key(F.lit(None).cast("string"))) == ""


def test_overlap_and_similarity(one):
    a, b = text.long_tokens(F.lit("la ville de Lyon Métropole")), text.long_tokens(F.lit("Ville Lyon"))
    assert one(text.overlap(a, b)) == pytest.approx(2 / 3)
    assert one(text.overlap(a, text.long_tokens(F.lit("")))) == 0
    assert one(text.similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(4 / 7) and one(text.similarity(F.lit(""), F.lit(""))) == 1


def test_formats(one):
    assert one(text.format_eur(F.lit(1234567.4))) == "1 234 567 €"
    assert one(text.plural(F.lit(1), "jour", "jours")) == "1 jour" and one(text.plural(F.lit(3), "jour", "jours")) == "3 jours"
    assert one(text.escape_html(F.lit("<a href='x'>&"))) == "&lt;a href=&#39;x&#39;&gt;&amp;"
    assert one(text.strip_html(F.lit("<p>a<br/>b</p>  c"))) == "a b c"


def test_uuid_notations_and_cascade(one):
    low = UUID.lower()
    for raw in (UUID, UUID.replace("-", ""), UUID.replace("-", "_")):
        assert one(extract.uuid_of(F.lit(f"x {raw} y"))) == low
    assert one(extract.uuid_of(F.lit("none"))) is None
    none = F.lit(None).cast("string")

    def cascade(field=None, data=None, description=None, url=None):
        c = [none if x is None else F.lit(x) for x in (field, data, description, url)]
        return tuple(one(extract.uuid_cascade(*c)) or (None, None))

    assert cascade(field=" F ") == ("F", "field")
    assert cascade(field="", data='{"CONTRACT_FOLDER_ID": "ABC"}') == ("abc", "key")
    assert cascade(data='{"MARCHE": {"contractfolderid": "N1"}}') == ("n1", "nested")
    assert cascade(data=f'{{"x": "{UUID}"}}') == (low, "json")
    assert cascade(description=f"p {UUID}") == (low, "description") and cascade(url=f"http://h/{UUID}") == (low, "url")
    assert cascade() == (None, None)


def test_extractors(one):
    assert one(extract.siret_of(F.lit("SIRET 12345678901234."))) == "12345678901234" and one(extract.siret_of(F.lit("123456789012345"))) is None
    for raw, number in (("Annonce n° 26-1234", "26-1234"), ("Annonce No 26-12345", "26-12345"), ("annonce 26-9999 x", "26-9999"), ("Annonce du jour 26-77777", "26-77777"), ("Annonce n° 26-12", None), ("26-1234", None)):
        assert one(extract.notice_number(F.lit(raw))) == number
    assert one(extract.buyer_of(F.lit("Nom complet de l'acheteur : Ville de X<br>"))) == "Ville de X"
    assert one(extract.buyer_of(F.lit("1.1 Acheteur\n Nom officiel: REGION Y\nz"))) == "REGION Y" and one(extract.buyer_of(F.lit("Organisme : Z\n"))) == "Z"
    assert [one(extract.market_type(F.lit(t))) for t in ("Conseil en travaux", "Fournitures", "Construction", "x")] == ["SERVICES", "FOURNITURES", "TRAVAUX", None]
    assert one(extract.email_of(F.lit('<span data-email="a@b.fr">c@d.fr'))) == "a@b.fr" and one(extract.email_of(F.lit("write c@d.fr"))) == "c@d.fr"
    assert one(extract.is_cancellation(F.lit(None).cast("string"), F.lit("MARCHÉ ANNULÉ"))) is True and one(extract.is_cancellation(F.lit("x"), F.lit("y"))) is False
    assert one(extract.is_award(F.lit("http://h/attribution/1"), F.lit(None).cast("string"))) is True and one(extract.is_award(F.lit("u"), F.lit("AVIS D'ATTRIBUTION"))) is False
    assert one(extract.useful_categories(F.array(F.lit(" Services"), F.lit("services"), F.lit(" audit "), F.lit(None).cast("string"), F.lit(" ")))) == ["Services", "audit"]


def test_dates(one):
    as_of = F.lit("2024-03-01").cast("timestamp")
    assert one(temporal.days_left(F.lit("2024-03-11"), as_of)) == 10 and one(temporal.days_left(F.lit("2024-03-01T01:00:00Z"), as_of)) == 1 and one(temporal.days_left(F.lit("soon"), as_of)) is None
    assert one(temporal.day(F.lit("2024-03-01T23:30:00-02:00"))) == "2024-03-02"
    assert one(temporal.french_range(F.lit("2024-03-01").cast("date"), F.lit("2024-03-02").cast("date"))) == "du 01/03/2024 au 02/03/2024"
    assert one(temporal.french_weekday(F.lit("2024-03-01").cast("date"))) == "vendredi" and one(temporal.reads_feed(F.lit("2024-03-01").cast("date"))) is True
    assert one(temporal.is_open(F.lit(None).cast("string"), "2024-01-01")) is True


def test_category_score(one):
    got = [[one(scores.category_score(F.lit(n), F.lit(w), F.lit(99))) for n in (0, 1, 2, 3)] for w in (3, 4)]
    assert got == [[0, 7, 12, 15], [0, 10, 15, 19]] and one(scores.category_score(F.lit(9), F.lit(4), F.lit(18))) == 18


@pytest.mark.parametrize(
    ("score", "confidence", "flagged", "expected"),
    [
        (19, "HIGH", False, (True, "score_trop_faible", "SKIP")), (44, "HIGH", True, (True, "red_flags_critiques", "SKIP")), (45, "LOW", True, (False, None, "MEDIUM")), (20, "MEDIUM", False, (False, None, "MEDIUM")),
        (29, "LOW", False, (True, "score_faible", "LOW")), (39, "LOW", False, (True, "confidence_faible", "LOW")), (40, "LOW", False, (False, None, "MEDIUM")), (30, "MEDIUM", False, (False, None, "MEDIUM")), (60, "LOW", False, (False, None, "HIGH")), (30, "HIGH", False, (False, None, "HIGH")),
    ],
)
def test_gate(one, score, confidence, flagged, expected):
    assert tuple(one(scores.gate(F.lit(score), F.lit(confidence), F.lit(flagged)))) == expected


def test_confidence(one):
    t = lambda s, e: one(scores.confidence(F.lit(s), F.lit(e), F.lit(s > 0), F.lit(e > 0)))
    assert [t(20, 20), t(30, 0), t(0, 30), t(15, 0), t(13, 12), t(12, 12), t(0, 0)] == ["HIGH", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_final_score_and_promotion(one):
    """Semantic 8.8, keywords 72.6, 30 days: 4.4 + 0.2178 + 1.0, low by number, high by recommendation."""
    s = scores.final_score(F.lit(8.8), F.lit(72.6), F.lit(30))
    assert one(s) == pytest.approx(5.6178) and one(scores.priority(s)) == "LOW"
    assert one(scores.promoted(F.lit("LOW"), F.lit("HAUTE_PRIORITE"), F.lit(8.8))) == "HIGH"
    assert one(scores.promoted(F.lit("MEDIUM"), F.lit("HAUTE_PRIORITE"), F.lit(8.8))) == "MEDIUM"
    assert one(scores.promoted(F.lit("LOW"), F.lit("HAUTE_PRIORITE"), F.lit(0.0))) == "LOW"
    assert one(scores.final_score(F.lit(8.8), F.lit(72.6), F.lit(None).cast("int"))) is None and one(scores.priority(F.lit(float("nan")))) == "LOW"
    assert one(scores.final_score(F.lit(10.0), F.lit(100), F.lit(-30))) == pytest.approx(8.3)


def test_cosine_and_cost(one):
    v = lambda *x: F.array(*(F.lit(float(i)).cast("float") for i in x))
    assert one(scores.cosine(v(1, 0), v(1, 1))) == pytest.approx(2**-0.5) and one(scores.cosine(v(0, 0), v(1, 1))) is None
    assert one(scores.token_cost(F.lit(1_000_000), F.lit(500_000), F.lit(2.5), F.lit(10.0))) == pytest.approx(7.5)


def test_marks_of_every_code_point(spark):
    """Each code point alone and between others, against Python's canonical decomposition."""
    import unicodedata

    from quillmark.functions import text

    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F)
    step = 97
    texts = [chr(c) for c in codes if strip(chr(c)) != chr(c)] + ["".join(f"{chr(c)}|" for c in codes[k : k + step]) for k in range(0, len(codes), step)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip_marks(F.col("t")).alias("s")).collect()
    assert [r["t"] for r in rows if r["s"] != (None if r["t"] is None else strip(r["t"]))] == []

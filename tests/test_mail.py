from __future__ import annotations

from quillmark.functions.links import sign
from quillmark.operators import mail

COUNTS = "source string, high long, medium long, low long"
ROWS = "position int, priority string, title string, acheteur string, deadline string, reason string, url string, source string, source_id string"


def parts(spark, relevant=(), low=(), counts=()):
    return tuple(spark.createDataFrame(list(x), s) for x, s in ((counts, COUNTS), (relevant, ROWS), (low, ROWS)))


def body(lines) -> list[str]:
    return mail.assemble(lines).first()["body"].split("\n")


def test_text_mail_of_one_day(spark):
    frames = parts(spark, [(1, "HIGH", "T1", "Ville", "01/02/2024", "bon", "u1", "s", "i1"), (2, "MEDIUM", "T2", None, "", None, "u2", "s", "i2")], [(1, "LOW", "L", None, None, "non", "u3", "s", "i3")], [("s", 1, 1, 1)])
    assert body(mail.text_mail(*frames, 0, "2024-01-31")) == [
        "Veille Appels d'Offres - mercredi 31/01/2024", "Récapitulatif", "3 appels d'offres analysés", "2 appels pertinents (HIGH/MEDIUM)", "1 appel d'offres à faible priorité (LOW)",
        "s", "3 appels d'offres analysés", "2 pertinents", mail.RELEVANT, "1. [HIGH] T1", "   Acheteur: Ville", "   Date limite: 01/02/2024", "   Justification: bon", "   Lien: u1", "2. [MEDIUM] T2", "   Lien: u2",
        mail.LOW, mail.LESS, "1. [FAIBLE PRIORITÉ] L (s)", "   Raison: non", "   Lien: u3", "---", mail.FOOT,
    ]


def test_mails_without_tenders_and_without_relevant_ones(spark):
    nothing = body(mail.text_mail(*parts(spark), 0, "2024-01-31"))
    assert nothing == ["Veille Appels d'Offres - mercredi 31/01/2024", "Récapitulatif", "Aucun appel d'offres analysé", mail.NO_TENDERS, "---", mail.FOOT]
    only = body(mail.text_mail(*parts(spark, low=[(1, "LOW", "L", None, None, None, "u", "s", "i")], counts=[("s", 0, 0, 1)]), 4, "2024-01-31"))
    assert [mail.LOW, mail.WHY_NONE, mail.NONE_JUDGED, "1. [FAIBLE PRIORITÉ] L (s)", "   Lien: u"] == only[only.index(mail.LOW) :][:5] and only[-3].startswith("+ 4 AO(s) exclus")


def test_html_escapes_and_signs(spark):
    frames = parts(spark, [(1, "HIGH", "<b>&", "V'", "01/02/2024", "x", 'u"1', "s", "i 1"), (2, "MEDIUM", "T", None, None, None, "u2", "s", None)], [(1, "LOW", "L<", None, None, "r", "u3", "s&", "i3")], [("s&", 1, 1, 1)])
    found = "\n".join(body(mail.html_mail(*frames, 2, "2024-01-01", "2024-01-31", "https://a/feedback", "key")))
    assert "<h1>Veille Appels d&#39;Offres - 01/01/2024 au 31/01/2024</h1>" in found and "<h2>s&amp;</h2>" in found
    assert '<div class="high"><span>HAUTE PRIORITÉ</span><h3><a href="u&quot;1">&lt;b&gt;&amp;</a></h3><p><strong>Acheteur :</strong> V&#39;</p>' in found
    assert f'href="https://a/feedback?ao_id=i+1&amp;token={sign("i 1", "key")}">' in found and found.count("token=") == 1 and "PRIORITÉ MOYENNE" in found
    assert '<div class="low"><span>FAIBLE PRIORITÉ</span><h3><a href="u3">L&lt;</a></h3><small>(s&amp;)</small><p><strong>Raison :</strong> r</p></div>' in found
    assert "<b>" not in found and found.endswith(f"<footer>{mail.FOOT}</footer>")

"""The whole report mail, as rows of sections: a plain text and an HTML body, assembled from capped rows.

Each section is a small DataFrame of (section, row, line): the head, the totals, a block for each source, the relevant tenders, the low ones and
the foot. ``assemble`` joins what a mail shows into one row; what it shows is capped, so it is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import links, temporal, text
from quillmark.operators import report

# Fixed texts of a mail.
TITLE = "Veille Appels d'Offres"
SUMMARY = "Récapitulatif"
RELEVANT = "Appels d'Offres Pertinents"
LOW = "Appels d'Offres à Faible Priorité"
NO_TENDERS = "Aucun appel d'offres n'a été trouvé pour cette date."
WHY_NONE = "Pourquoi aucun AO n'est pertinent ?"
NONE_JUDGED = "Les appels d'offres ci-dessous ont été analysés mais n'ont pas été jugés pertinents selon les critères d'analyse sémantique et de mots-clés."
LESS = "Les appels d'offres suivants ont été analysés mais jugés moins pertinents que ceux listés ci-dessus."
FILTERED = (" AO(s) exclus par filtre mots-clés (hors périmètre métier — non analysés par l'IA)", "+ ")
FOOT = "Ce message a été généré automatiquement."
BUYER, DEADLINE, REASON, WHY, LINK = "Acheteur", "Date limite", "Justification", "Raison", "Lien"
OPEN_LINK, NOT_RELEVANT = "Voir l'appel d'offres →", "Signaler comme non pertinent"
LEVELS = {"HIGH": "HAUTE PRIORITÉ", "MEDIUM": "PRIORITÉ MOYENNE", "LOW": "FAIBLE PRIORITÉ"}
# End of the fixed texts.

#: The order of the sections; sources stand between the totals and the tenders.
HEAD, TOTALS, SOURCES, TENDERS, LOW_ONES, END = range(6)


def lists_by_source(rows: DataFrame) -> DataFrame:
    """source, and for each priority the list of (position, title) of its rows in order; rows must be capped."""
    entry = F.struct("position", "title")
    return rows.groupBy("source").agg(*(F.array_sort(F.collect_list(F.when(F.col("priority") == p, entry))).alias(p.lower()) for p in LEVELS))


def _lines(df: DataFrame, section: int, place: Column | str, *lines: Column | str) -> DataFrame:
    """section, place, k, line of the lines that are not null."""
    every = F.filter(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)), lambda x: x.isNotNull())
    own = place if isinstance(place, Column) else F.lit(place)
    return df.select(F.lit(section).alias("section"), own.cast("string").alias("place"), F.posexplode(every).alias("k", "line"))


def _number(position: Column) -> Column:
    return F.lpad(position.cast("string"), 6, "0")


def text_mail(counts: DataFrame, relevant: DataFrame, low: DataFrame, filtered: int, since: str, until: str | None = None) -> DataFrame:
    """section, place, k, line of a plain text mail; its order is that of the first three.

    counts: rows of ``report.by_source``; relevant and low: capped rows (position, priority, title, acheteur, deadline as text, reason, url, source). filtered: how
    many tenders keywords alone have left out. A missing buyer, deadline or reason has no line.
    """
    one = counts.sparkSession.range(1)
    said = report.text_summary(counts)
    day = F.lit(since).cast("date")
    head = _lines(one, HEAD, "", F.concat(F.lit(f"{TITLE} - "), _days(day, None if until is None else F.lit(until).cast("date"))))
    totals = _lines(one, TOTALS, "", SUMMARY).unionByName(said.filter("section = ''").select(F.lit(TOTALS).alias("section"), F.lit("").alias("place"), (F.col("k") + 1).alias("k"), "line"))
    nothing = counts.agg(F.coalesce(F.sum(F.col("high") + F.col("medium") + F.col("low")), F.lit(0)).alias("n")).filter("n = 0")
    totals = totals.unionByName(_lines(nothing, TOTALS, "z", NO_TENDERS))
    named = said.filter("section <> ''")
    sources = named.filter("k = 0").select(F.lit(SOURCES).alias("section"), F.col("section").alias("place"), F.lit(0).alias("k"), F.col("section").alias("line"))
    sources = sources.unionByName(named.select(F.lit(SOURCES).alias("section"), F.col("section").alias("place"), (F.col("k") + 1).alias("k"), "line"))
    some = relevant.agg(F.count(F.lit(1)).alias("n"))
    shown = low.agg(F.count(F.lit(1)).alias("m"))
    both = some.crossJoin(F.broadcast(shown))  # two rows of one number
    field = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"   {name}: "), c))
    tenders = _lines(some.filter("n > 0"), TENDERS, "", RELEVANT).unionByName(
        _lines(relevant, TENDERS, _number(F.col("position")), F.concat(F.col("position").cast("string"), F.lit(". ["), F.col("priority"), F.lit("] "), F.col("title")), field(BUYER, F.col("acheteur")), field(DEADLINE, F.col("deadline")), field(REASON, F.col("reason")), field(LINK, F.col("url")))
    )
    some_low = both.filter((F.col("m") > 0) | F.lit(filtered > 0))
    intro = [F.when(F.col("m") > 0, F.when(F.col("n") == 0, WHY_NONE).otherwise(LESS)), F.when((F.col("m") > 0) & (F.col("n") == 0), NONE_JUDGED)]
    lows = _lines(some_low, LOW_ONES, "", LOW, *intro).unionByName(
        _lines(low, LOW_ONES, _number(F.col("position")), F.concat(F.col("position").cast("string"), F.lit(f". [{LEVELS['LOW']}] "), F.col("title"), F.lit(" ("), F.col("source"), F.lit(")")), field(WHY, F.col("reason")), field(LINK, F.col("url")))
    )
    if filtered > 0:
        lows = lows.unionByName(_lines(one, LOW_ONES, "z", f"{FILTERED[1]}{filtered}{FILTERED[0]}"))
    return reduce(DataFrame.unionByName, [head, totals, sources, tenders, lows, _lines(one, END, "", "---", FOOT)])


def _days(since: Column, until: Column | None) -> Column:
    if until is None:
        return F.concat(temporal.french_weekday(since), F.lit(" "), temporal.french_date(since))
    return F.concat(temporal.french_date(since), F.lit(" au "), temporal.french_date(until))


def html_mail(counts: DataFrame, relevant: DataFrame, low: DataFrame, filtered: int, since: str, until: str | None = None, answers: str | None = None, secret: str | None = None) -> DataFrame:
    """section, place, k, line of the HTML body. Every value is escaped; ``answers`` is the address of the answering service, whose links are signed with the secret.

    Relevant rows have source_id too, which the signed link names.
    """
    lines = text_mail(counts, relevant, low, filtered, since, until).filter((F.col("section") <= SOURCES) | (F.col("place").isin("", "z") & (F.col("section") < END)))
    tag = F.when((F.col("k") == 0) & (F.col("section") == HEAD), "h1").when((F.col("k") == 0) & (F.col("place") != "z"), "h2").otherwise("p")
    plain = lines.withColumn("line", F.concat(F.lit("<"), tag, F.lit(">"), text.escape_html(F.col("line")), F.lit("</"), tag, F.lit(">")))
    said = lambda c: text.escape_html(F.coalesce(F.col(c).cast("string"), F.lit("")))
    field = lambda name, c: F.when(said(c) != "", F.concat(F.lit(f"<p><strong>{name} :</strong> "), said(c), F.lit("</p>"))).otherwise("")
    title = F.concat(F.lit('<h3><a href="'), said("url"), F.lit('">'), said("title"), F.lit("</a></h3>"))
    level = lambda p: F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), p)
    button = F.concat(F.lit('<p><a class="button" href="'), said("url"), F.lit(f'">{OPEN_LINK}</a>'))
    if answers is not None and secret is not None:
        link = F.concat(F.lit(f' <a class="answer" href="{answers}?ao_id='), F.url_encode("source_id"), F.lit("&amp;token="), links.signed(F.col("source_id"), secret), F.lit(f'">{NOT_RELEVANT}</a>'))
        button = F.concat(button, F.coalesce(link, F.lit("")))
    block = lambda kind, *parts: F.concat(F.lit('<div class="'), kind, F.lit('">'), *parts, F.lit("</div>"))
    tenders = _lines(relevant, TENDERS, _number(F.col("position")), block(F.lower("priority"), F.concat(F.lit("<span>"), level(F.col("priority")), F.lit("</span>")), title, field(BUYER, "acheteur"), field(DEADLINE, "deadline"), field(REASON, "reason"), button, F.lit("</p>")))
    lows = _lines(low, LOW_ONES, _number(F.col("position")), block(F.lit("low"), F.lit(f"<span>{LEVELS['LOW']}</span>"), title, F.lit("<small>("), said("source"), F.lit(")</small>"), field(WHY, "reason")))
    one = counts.sparkSession.range(1)
    return reduce(DataFrame.unionByName, [plain, tenders, lows, _lines(one, END, "", f"<footer>{FOOT}</footer>")])


def assemble(lines: DataFrame) -> DataFrame:
    """(body): the lines of a mail in order, as one text; what a mail shows is capped, so it is one small row."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "place", "k", "line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))

"""Aggregates and rows of the daily report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import temporal, text
from quillmark.schemas import PRIORITIES

ROWS = 100


def priority_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: total, analysed by the model, cancelled, and the mean keyword score."""
    called = F.col("semantic_score").isNotNull() & ~F.col("is_cancelled") & ~F.col("skip")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(called).alias("llm_calls"), F.count_if("is_cancelled").alias("cancelled"), F.avg("keyword_score").alias("mean_keyword_score"))


def by_source(rows: DataFrame) -> DataFrame:
    """Counts by source and priority, in one row for each source."""
    wide = rows.groupBy("source").pivot("priority", list(PRIORITIES)).agg(F.count(F.lit(1)))
    return wide.select("source", *(F.coalesce(F.col(p), F.lit(0)).cast("long").alias(p.lower()) for p in PRIORITIES))


def skip_reasons(rows: DataFrame) -> DataFrame:
    return rows.filter("skip").groupBy(F.coalesce("skip_reason", F.lit("unknown")).alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"))


def completeness(fetched: DataFrame, expected: int) -> DataFrame:
    """One row: how much of what a source announced was read?"""
    n = fetched.agg(F.count(F.lit(1)).alias("fetched")).withColumn("total_count", F.lit(expected).cast("long"))
    missing = F.greatest(F.lit(0), F.col("total_count") - F.col("fetched"))
    return n.withColumns({"missing": missing, "missing_ratio": F.coalesce(F.try_divide(missing, F.col("total_count")), F.lit(0.0)), "status": F.when(missing > 0, "INCOMPLETE").otherwise("COMPLETE")})


def completeness_by(fetched: DataFrame, announced: DataFrame, key: str) -> DataFrame:
    """For each row of announced (key, total_count): how much of it was read? A source that announced nothing is complete; one that was not read at all has 0."""
    n = fetched.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    joined = announced.join(n, announced[key] == F.col("_key"), "left").select(key, F.coalesce("_n", F.lit(0)).alias("fetched"), F.col("total_count").cast("long").alias("total_count"))
    missing = F.greatest(F.lit(0), F.col("total_count") - F.col("fetched"))
    return joined.withColumns({"missing": missing, "missing_ratio": F.coalesce(F.try_divide(missing, F.col("total_count")), F.lit(0.0)), "status": F.when(missing > 0, "INCOMPLETE").otherwise("COMPLETE")})


def by_day(rows: DataFrame, at: str, column: str, values: dict[str, str], score: str, mean: str = "mean_score") -> DataFrame:
    """By day of a timestamp: all rows, those of each value of a column under its name, and the mean of a score."""
    return rows.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(column) == v).alias(name) for v, name in values.items()), F.avg(score).alias(mean))


def daily(rows: DataFrame, at: str, days: int, as_of: str, score: str = "final_score", priority: str = "priority") -> DataFrame:
    """By day of a timestamp, over the last days: all, those of each priority, mean score."""
    recent = rows.filter(F.to_date(at) >= F.date_sub(F.lit(as_of).cast("date"), days))
    return by_day(recent, at, priority, {p: p.lower() for p in PRIORITIES}, score)


def capped(rows: DataFrame, tier: Column, order: list[Column], limit: int = ROWS) -> DataFrame:
    """The first rows by tier and order, up to the limit, with position and, in each row, the number left out.

    The limit is the feature: a mail shows so many rows. Only the kept rows are ranked in one task.
    """
    top = rows.withColumn("tier", tier).orderBy("tier", *order).limit(limit)
    ranked = top.withColumn("position", F.row_number().over(W.orderBy("tier", *order)))
    count = rows.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - limit).alias("omitted"))
    return ranked.crossJoin(F.broadcast(count))  # a table of one row


def low_tier(skip: Column, reason: Column) -> Column:
    """Low rows that the model has seen come before those that keywords alone have priced."""
    return F.when(skip | F.coalesce(reason.isin("score_trop_faible", "score_faible", "confidence_faible", "red_flags_critiques"), F.lit(False)), 2).otherwise(1)


def mail_mode(requests: DataFrame, log: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Adds mode: FULL if nothing was sent for (client_id, since, until); DELTA if there are rows newer than the last mail; CONFIRMATION otherwise."""
    key = ["client_id", "since", "until"]
    last = log.groupBy(*key).agg(F.max("sent_at").alias("last_sent"))
    joined = requests.join(last, [requests[k].eqNullSafe(last[k]) for k in key], "left").select(*(requests[c] for c in requests.columns), "last_sent")
    fresh = new_rows.groupBy(F.col("client_id").alias("_client")).agg(F.max("analyzed_at").alias("_newest"))
    joined = joined.join(fresh, joined["client_id"] == fresh["_client"], "left")
    return joined.withColumn("mode", F.when(F.col("last_sent").isNull(), "FULL").when(F.col("_newest") > F.col("last_sent"), "DELTA").otherwise("CONFIRMATION")).drop("_client", "_newest")


def subject(high: Column, medium: Column, day: Column) -> Column:
    return F.concat(F.lit("Veille du "), F.date_format(day, "dd/MM/yyyy"), F.lit(" : "), high.cast("string"), F.lit(" prioritaires, "), medium.cast("string"), F.lit(" à étudier"))


def render_text(rows: DataFrame) -> DataFrame:
    """(position, line) of a plain text mail; rows must be capped."""
    line = F.concat(F.col("position").cast("string"), F.lit(". ["), F.col("priority"), F.lit("] "), F.col("title"), F.lit(" — "), F.coalesce("acheteur", F.lit("?")))
    return rows.select("position", line.alias("line"))


def daily_posts(runs: DataFrame) -> DataFrame:
    """Runs, one for each (client, since, until or since, source)."""
    return runs.dropDuplicates(["client_id", "since", "until", "source"])


def mail_rows(rows: DataFrame) -> DataFrame:
    """What a mail shows of a tender; the reason is the first that there is."""
    why = F.coalesce("human_readable_reason", "semantic_reason", "rejet_raison", F.lit("Analyse disponible"))
    return rows.select("position", "priority", "title", F.coalesce("acheteur", F.lit("Non communiqué")).alias("acheteur"), F.coalesce("deadline", F.lit("Non précisée")).alias("deadline"), "url_ao", why.alias("reason"))


def render_html(rows: DataFrame) -> DataFrame:
    """(position, html): one table row for each row of ``mail_rows``; every value is escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), text.escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    return rows.select("position", F.concat(F.lit("<tr>"), *(cell(c) for c in ("position", "priority", "title", "acheteur", "deadline", "reason")), F.lit("</tr>")).alias("html"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page under a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def log_mail(log: DataFrame, sent: DataFrame) -> DataFrame:
    """The log with what has been sent appended; columns that one side lacks are null."""
    return log.unionByName(sent, allowMissingColumns=True)


def ranked(rows: DataFrame, score: str, identity: str) -> DataFrame:
    """Adds position: by score, the highest first, then by identity.

    Rows of one score are numbered after those of higher ones: counts by score (there are few scores) give where each begins, so
    that no task sorts all rows.
    """
    begin = rows.groupBy(score).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy(F.desc_nulls_last(score)).rowsBetween(W.unboundedPreceding, -1)))
    begin = begin.select(F.col(score).alias("_score"), F.coalesce("_before", F.lit(0)).alias("_before"))
    within = rows.withColumn("_at", F.row_number().over(W.partitionBy(score).orderBy(identity)))
    joined = within.join(begin, within[score].eqNullSafe(begin["_score"]))
    return joined.withColumn("position", F.col("_before") + F.col("_at")).drop("_score", "_before", "_at")


def high_open(rows: DataFrame, as_of: str, identity: str, limit: int = 10) -> DataFrame:
    """The best rows of high priority that are open; the limit is the feature."""
    return rows.filter((F.col("priority") == "HIGH") & temporal.is_open(F.col("deadline"), as_of)).orderBy(F.desc("final_score"), identity).limit(limit)


# Fixed texts: for one and for several.
ANALYSED = ("appel d'offres analysé", "appels d'offres analysés")
RELEVANT = ("appel pertinent", "appels pertinents")
RELEVANT_IN_SOURCE = ("pertinent", "pertinents")
RELEVANT_LEVELS = " (HIGH/MEDIUM)"
LOW = ("appel d'offres à faible priorité (LOW)", "appels d'offres à faible priorité (LOW)")
NONE_ANALYSED = "Aucun appel d'offres analysé"
NONE_RELEVANT = "Aucun appel d'offres pertinent identifié"
# End of the fixed texts.


def text_summary(counts: DataFrame) -> DataFrame:
    """(section, k, line): the head of a plain text mail and a section for each source, from the rows of ``by_source``."""
    said = lambda n, words: text.plural(n, *words)
    total, wanted = F.col("high") + F.col("medium") + F.col("low"), F.col("high") + F.col("medium")
    every = counts.agg(F.coalesce(F.sum(total), F.lit(0)).alias("total"), F.coalesce(F.sum(wanted), F.lit(0)).alias("wanted"), F.coalesce(F.sum("low"), F.lit(0)).alias("low"))
    some = F.col("total") > 0
    head = F.array(
        F.when(some, said(F.col("total"), ANALYSED)).otherwise(NONE_ANALYSED),
        F.when(some & (F.col("wanted") > 0), F.concat(said(F.col("wanted"), RELEVANT), F.lit(RELEVANT_LEVELS))).when(some, NONE_RELEVANT),
        F.when(some & (F.col("low") > 0), said(F.col("low"), LOW)),
    )
    body = F.array(said(total, ANALYSED), F.when(wanted > 0, said(wanted, RELEVANT_IN_SOURCE)))
    lines = lambda a: F.posexplode(F.filter(a, lambda x: x.isNotNull())).alias("k", "line")
    return every.select(F.lit("").alias("section"), lines(head)).unionByName(counts.filter(total > 0).select(F.col("source").alias("section"), lines(body)))

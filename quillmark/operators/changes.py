"""Amendments: which tender is amended, and does the change matter?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import temporal, text
from quillmark.operators import canonical, matching

# Fixed thresholds.
BUDGET_SHARE, DEADLINE_DAYS, TITLE_SIMILARITY, TITLE_PREFIX = 0.2, 7, 0.8, 50
# End of the fixed thresholds.

CHANGE = "struct<field string, old string, new string, amount double>"


def is_amendment(nature: Column, notice_kind: Column, linked: Column) -> Column:
    """By the nature of the notice, its kind, or a link to an earlier one."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("rectificatif"))
    return has(nature) | has(notice_kind) | F.coalesce(linked != "", F.lit(False))


def changes(old: Column, new: Column) -> Column:
    """array(struct(field, old, new, amount)) between two structs of budget_max, deadline, cap_eco, cap_tech, type_marche, region and title.

    A missing value on either side is no change, but for the two criteria, which are compared as JSON texts.
    """
    def when(field: str, test: Column, amount: Column, shown: bool = True) -> Column:
        show = (lambda s: s[field].cast("string")) if shown else (lambda s: F.lit(None).cast("string"))
        return F.when(test, F.struct(F.lit(field).alias("field"), show(old).alias("old"), show(new).alias("new"), amount.cast("double").alias("amount")))

    nothing = F.lit(None)
    share = F.abs(F.try_divide(new["budget_max"] - old["budget_max"], old["budget_max"]))
    days = F.abs(temporal.days_between(temporal.instant(old["deadline"]), temporal.instant(new["deadline"])))
    alike = text.similarity(old["title"], new["title"])
    present = lambda f: (F.coalesce(old[f], F.lit("")) != "") & (F.coalesce(new[f], F.lit("")) != "")
    found = F.array(
        when("budget_max", (old["budget_max"] != 0) & (new["budget_max"] != 0) & (share > BUDGET_SHARE), F.floor(share * 100 + 0.5)),
        when("deadline", days > DEADLINE_DAYS, F.floor(days + 0.5)),
        when("cap_eco", ~old["cap_eco"].eqNullSafe(new["cap_eco"]), nothing),
        when("cap_tech", ~old["cap_tech"].eqNullSafe(new["cap_tech"]), nothing),
        when("type_marche", present("type_marche") & (old["type_marche"] != new["type_marche"]), nothing),
        when("region", present("region") & (old["region"] != new["region"]), nothing),
        when("title", present("title") & (alike < TITLE_SIMILARITY), F.floor(alike * 100 + 0.5) / 100, shown=False),
    )
    return F.filter(found, lambda c: c.isNotNull())


def is_substantial(found: Column) -> Column:
    return F.size(found) > 0


def summary(found: Column) -> Column:
    """One French line for each change."""
    line = lambda c: (
        F.when(c["field"] == "budget_max", F.concat(F.lit("Budget : "), text.format_eur(c["old"].cast("double")), F.lit(" → "), text.format_eur(c["new"].cast("double"))))
        .when(c["field"] == "deadline", F.concat(F.lit("Date limite décalée de "), text.plural(c["amount"].cast("int"), "jour", "jours")))
        .when(c["field"] == "cap_eco", F.lit("Critères financiers modifiés"))
        .when(c["field"] == "cap_tech", F.lit("Critères techniques modifiés"))
        .when(c["field"] == "title", F.concat(F.lit("Titre modifié (similarité "), c["amount"].cast("string"), F.lit(")")))
        .otherwise(F.concat(c["field"], F.lit(" : "), c["old"], F.lit(" → "), c["new"]))
    )
    return F.array_join(F.transform(found, line), "\n")


def _two_best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, second: the newest entries (analyzed_at, id, source) of two different sources. Rows are thinned out before they are dealt."""
    each = rows.groupBy(*keys, "source").agg(F.max(F.struct("analyzed_at", "id")).alias("_e"))
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_e"), "source"))).filter(F.col("_r") <= 2)
    entry = F.struct(F.col("_e.analyzed_at").alias("analyzed_at"), F.col("_e.id").alias("id"), "source")
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, entry)).alias("first"), F.max(F.when(F.col("_r") == 2, entry)).alias("second"))


def _entries(best: DataFrame, keys: list[str]) -> DataFrame:
    return best.select(*keys, F.explode(F.array_compact(F.array("first", "second"))).alias("_e")).select(*keys, "_e.*")


def by_title(amendments: DataFrame, stored: DataFrame) -> DataFrame:
    """(source_id, near): for each amendment the newest stored row of another source_id and the same buyer whose title holds the head of its own.

    Distinct heads meet distinct titles of their buyer by an index of grams. A title keeps its newest entry and the newest
    of another source_id, as does a head, so an amendment can leave its own entry out.
    """
    asked = amendments.select(F.col("source_id").alias("_own"), "acheteur", F.lower(F.substring("title", 1, TITLE_PREFIX)).alias("needle")).filter(F.col("needle") != "")
    held = stored.filter(F.col("source_id").isNotNull()).select("acheteur", F.lower("title").alias("text"), F.col("source_id").alias("source"), "analyzed_at", "id")
    pairs = matching.contained(asked, held, ["acheteur"])
    titles = _entries(_two_best(held, ["acheteur", "text"]), ["acheteur", "text"])
    heads = _two_best(pairs.join(titles.hint("merge"), ["acheteur", "text"]), ["acheteur", "needle"])
    entry = F.when(F.col("first.source") != F.col("_own"), F.col("first")).otherwise(F.when(F.col("second.source") != F.col("_own"), F.col("second")))
    near = asked.distinct().join(heads.hint("merge"), ["acheteur", "needle"]).select("_own", entry.alias("_e")).filter("_e IS NOT NULL")
    return near.groupBy(F.col("_own").alias("source_id")).agg(F.max_by("_e.id", F.struct("_e.analyzed_at", "_e.id")).alias("near"))


def originals(amendments: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds original_id: the stored row that an amendment amends, by link, source_id, buyer with the head of the title, or normalised id.

    The first way that finds a row counts; within it the row analysed last (then the largest id). Ways with a
    unique key are joins with one row for each key; the third is a join by containment (``by_title``). Keys grow with the stored rows and
    their files tell little of it, so none is sent to all tasks by way of the driver.
    """
    newest = lambda key: stored.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by("id", F.struct("analyzed_at", "id")).alias("_v"))
    out = amendments
    for k, (own, other) in enumerate((("annonce_lie", "source_id"), ("source_id", "source_id"), ("normalized_id", "normalized_id"))):
        side = newest(other).select(F.col("_k").alias(f"_k{k}"), F.col("_v").alias(f"_v{k}"))
        out = out.join(side.hint("merge"), out[own] == side[f"_k{k}"], "left").drop(f"_k{k}")
    best = by_title(amendments, stored).select(F.col("source_id").alias("_own"), F.col("near").alias("_near"))
    out = out.join(best.hint("merge"), out["source_id"] == best["_own"], "left")
    return out.withColumn("original_id", F.coalesce("_v0", "_v1", "_near", "_v2")).drop("_v0", "_v1", "_v2", "_near", "_own")


def amendment_view(tenders: DataFrame, link: str = "annonce_lie", newest: str | None = None) -> DataFrame:
    """Each amended tender beside its original, with the difference of scores; ``newest`` names the date by which the last comes first."""
    o = tenders.select(F.col("source_id").alias("original_id"), F.col("title").alias("original_title"), F.col("final_score").alias("original_score"))
    r = tenders.filter(F.col(link).isNotNull())
    view = r.join(o, r[link] == o["original_id"], "left").withColumn("score_delta", F.col("final_score") - F.col("original_score"))
    return view if newest is None else view.orderBy(F.desc(newest), "source_id")


def with_history(stored: DataFrame, amended: DataFrame, at: str) -> DataFrame:
    """Stored rows after substantial amendments (source_id, changes): history grows by an entry, the count by one."""
    entry = F.struct(F.lit(at).alias("at"), F.col("_changes").alias("changes"))
    joined = stored.join(amended.select(F.col("source_id").alias("_sid"), F.col("changes").alias("_changes")), stored["source_id"] == F.col("_sid"), "left")
    hit = F.col("_sid").isNotNull()
    return joined.withColumns({
        "history": F.when(hit, F.array_append(F.coalesce("history", F.array().cast(stored.schema["history"].dataType)), entry)).otherwise(F.col("history")),
        "rectification_count": F.coalesce("rectification_count", F.lit(0)) + hit.cast("int"),
        "is_rectified": F.coalesce("is_rectified", F.lit(False)) | hit,
    }).drop("_sid", "_changes")


def apply_minor(stored: DataFrame, minor: DataFrame, at: str) -> DataFrame:
    """Stored rows after minor amendments (original_id, title, acheteur, deadline, siret, uuid_procedure, raw): the deadline, the raw record and the keys for matching, which a new deadline changes.

    Of several amendments of one row that with the largest (publication_date, source_id) counts; each adds to the count. Rows without one stay as they are.
    """
    keyed = canonical.dedup_keys(minor).select("original_id", "deadline", "raw", "composite_key", "siret_deadline_key", F.struct("publication_date", "source_id").alias("_turn"))
    last = keyed.groupBy(F.col("original_id").alias("_oid")).agg(F.max_by(F.struct("deadline", "raw", "composite_key", "siret_deadline_key"), "_turn").alias("_new"), F.count(F.lit(1)).alias("_times"))
    joined = stored.join(last, stored["id"] == F.col("_oid"), "left")
    hit = F.col("_oid").isNotNull()
    changed = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("deadline", "raw", "composite_key", "siret_deadline_key")}
    return joined.withColumns(changed | {
        "rectification_date": F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("rectification_date")),
        "rectification_count": F.coalesce("rectification_count", F.lit(0)) + F.coalesce("_times", F.lit(0)),
    }).drop("_oid", "_new", "_times")

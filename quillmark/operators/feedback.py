"""Corrections by users: reversible rules, their duplicates, their impact and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import temporal, text
from quillmark.operators import matching
from quillmark.operators.dedup import latest


def active_rules(rules: DataFrame, client_id: str, kind: str = "red_flag") -> DataFrame:
    return rules.filter((F.col("client_id") == client_id) & F.col("active") & (F.col("type") == kind))


def duplicates(proposals: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds duplicate_of: the first active rule (by id) of the client and type whose value contains the proposed one or lies in it; one row for each proposal.

    Distinct proposed values meet the distinct values of rules by an index of grams, either way round, so a client may
    have any number of both. Proposals are joined with what was found, so that equal proposals stay separate rows.
    """
    on = ["_c", "_t"]
    side = rules.filter("active").groupBy(F.col("client_id").alias("_c"), F.col("type").alias("_t"), F.lower("value").alias("_v")).agg(F.min("id").alias("_id"))
    asked = proposals.select(F.col("client_id").alias("_c"), F.col("type").alias("_t"), F.lower(F.trim("value")).alias("_own"))
    own = lambda name: asked.select(*on, F.col("_own").alias(name))
    known = lambda name: side.select(*on, F.col("_v").alias(name))
    inside = matching.contained(own("needle"), known("text"), on).select(*on, F.col("needle").alias("_own"), F.col("text").alias("_v"))
    around = matching.contained(known("needle"), own("text"), on).select(*on, F.col("text").alias("_own"), F.col("needle").alias("_v"))
    found = inside.unionByName(around).join(side, [*on, "_v"]).groupBy(*on, "_own").agg(F.min("_id").alias("duplicate_of"))
    same = (proposals["client_id"] == F.col("_c")) & (proposals["type"] == F.col("_t")) & (F.lower(F.trim(proposals["value"])) == F.col("_own"))
    return proposals.join(found, same, "left").drop("_c", "_t", "_own")


def similar_rules(rules: DataFrame, term: str) -> DataFrame:
    return rules.filter(F.col("active") & text.contains_folded(F.col("value"), F.lit(term))).orderBy(F.desc("created_at"), "id")


def concerns(term: Column) -> Column:
    """Do title or description contain the term?"""
    return text.contains_folded(F.coalesce("title", F.lit("")), term) | text.contains_folded(F.coalesce("description", F.lit("")), term)


def impact(tenders: DataFrame, term: str, as_of: str, days: int = 30) -> DataFrame:
    """One row: recent tenders that a term concerns; how many are open, of high or medium, and of low or no priority."""
    recent = tenders.filter(F.col("analyzed_at") >= F.date_sub(F.lit(as_of).cast("date"), days)).filter(concerns(F.lit(term)))
    return recent.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(temporal.is_open(F.col("deadline"), as_of)).alias("open"),
        F.count_if(temporal.is_open(F.col("deadline"), as_of) & F.col("priority").isin("HIGH", "MEDIUM")).alias("high_medium"),
        F.count_if(temporal.is_open(F.col("deadline"), as_of) & (F.col("priority").isNull() | (F.col("priority") == "LOW"))).alias("low"),
    )


def simulate(tenders: DataFrame, term: str, direction: str, as_of: str, days: int = 30, only_open: bool = False) -> DataFrame:
    """(source_id, title, priority, effect) of the tenders that a rule would concern.

    An excluding rule would rightly exclude low ones and hit others; an including one would lift low ones, others pass already.
    """
    recent = tenders.filter(F.col("analyzed_at") >= F.date_sub(F.lit(as_of).cast("date"), days)).filter(concerns(F.lit(term)))
    if only_open:
        recent = recent.filter(temporal.is_open(F.col("deadline"), as_of))
    low = F.col("priority").isNull() | (F.col("priority") == "LOW")
    effect = F.when(low, "correctly_excluded").otherwise("would_be_excluded") if direction == "exclude" else F.when(low, "would_be_included").otherwise("correctly_excluded")
    return recent.select("source_id", "title", "priority", effect.alias("effect"))


def correction_type(forced: Column, direction: Column, proposed: Column) -> Column:
    """A forced type wins; including is a boost; else the proposal holds."""
    return F.coalesce(forced, F.when(direction == "include", "keyword_boost"), proposed)


def history(feedback: DataFrame, rules: DataFrame) -> DataFrame:
    """Feedback with rule_id and is_active: keyword corrections are active as their rule is, others while they are applied."""
    side = rules.select(F.col("feedback_id").alias("_f"), F.col("id").alias("rule_id"), F.col("active").alias("_active"))
    joined = feedback.join(side, feedback["id"] == F.col("_f"), "left")
    keyword = F.col("correction_type").isin("keyword_red_flag", "keyword_boost")
    return joined.withColumn("is_active", F.when(keyword, F.coalesce("_active", F.lit(False))).otherwise(F.col("status") == "applied")).drop("_f", "_active").orderBy(F.desc("created_at"), "id")


def details(tenders: DataFrame, feedback: DataFrame, n: int = 3) -> DataFrame:
    """Tenders with their last applied corrections, newest first."""
    last = latest(feedback.filter("status = 'applied'"), ["source_id"], [F.desc("created_at"), F.desc("id")], n)
    lists = last.groupBy(F.col("source_id").alias("_sid")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id", "feedback", "correction_type")))).alias("feedbacks"))  # n entries at most
    return tenders.join(lists, tenders["source_id"] == F.col("_sid"), "left").drop("_sid").withColumn("feedbacks", F.coalesce("feedbacks", F.array().cast(lists.schema["feedbacks"].dataType)))


def enrich(feedback: DataFrame, tenders: DataFrame) -> DataFrame:
    """Feedback with its tender; both must exist."""
    t = tenders.select(F.col("source_id").alias("_sid"), "title", "description", "priority")
    return feedback.join(t, feedback["source_id"] == F.col("_sid")).drop("_sid")


def deactivate(rules: DataFrame, rule_id: str | None = None, value: str | None = None) -> DataFrame:
    """Rules with exactly one of them switched off, by id or by a piece of its value."""
    hit = F.col("active") & ((F.col("id") == rule_id) if rule_id is not None else text.contains_folded(F.col("value"), F.lit(value)))
    n = rules.filter(hit).limit(2).count()
    if n != 1:
        raise ValueError("no rule matches" if n == 0 else "several rules match")
    return rules.withColumn("active", F.when(hit, F.lit(False)).otherwise(F.col("active")))


def transition(events: DataFrame) -> DataFrame:
    """The state of each feedback: the last of its events (id, status, at, seq)."""
    return events.groupBy("id").agg(F.max_by("status", F.struct("at", "seq")).alias("status"), F.max("at").alias("at"), F.count(F.lit(1)).alias("events"))


def revert_manual(tenders: DataFrame, feedback: DataFrame) -> DataFrame:
    """Manual priorities go; the reason is joined from the corrections that still apply, oldest first."""
    applied = feedback.filter("status = 'applied'").groupBy(F.col("source_id").alias("_sid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "feedback"))), lambda x: x["feedback"]), " — ").alias("_reason"))
    return tenders.join(applied, tenders["source_id"] == F.col("_sid"), "left").withColumns({"manual_priority": F.lit(None).cast("string"), "reason": F.col("_reason")}).drop("_sid", "_reason")


def choices(terms: Column) -> Column:
    """The first two terms and the free choice, lettered."""
    two = F.slice(terms, 1, 2)
    return F.transform(F.concat(two, F.array(F.lit("autre"))), lambda t, k: F.struct(F.element_at(F.array(*(F.lit(x) for x in "ABC")), k + 1).alias("letter"), t.alias("term")))


def duplicate_chunks(proposals: DataFrame, feedback: DataFrame) -> DataFrame:
    """Adds duplicate_of: applied retrieval corrections of the client whose text contains the proposed one or lies in it."""
    applied = feedback.filter("status = 'applied' AND correction_type = 'rag_chunk'")
    return duplicates(proposals.withColumn("type", F.lit("rag_chunk")), applied.select("id", "client_id", F.lit("rag_chunk").alias("type"), F.coalesce("correction_value", "chunk_content").alias("value"), F.lit(True).alias("active")))


def simulated_term(direction: Column, boost: Column, flag: Column, title: Column, rule: Column) -> Column:
    """The term whose effect is shown before a correction is confirmed; empty values count as missing."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.when(direction == "include", F.coalesce(some(boost), some(rule))).otherwise(F.coalesce(some(flag), some(title), some(rule)))


def chunk_vector(feedback: DataFrame) -> DataFrame:
    """(id, text, type): applied retrieval corrections as rows for the index, under one name for their kind."""
    return feedback.filter("status = 'applied' AND correction_type = 'rag_chunk'").select(F.concat(F.lit("feedback_"), "id").alias("id"), F.coalesce("chunk_content", "correction_value").alias("text"), F.lit("user_feedback").alias("type"))

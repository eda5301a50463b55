"""Evaluation of decisions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.small import small

LEVELS = ("non_pertinent", "basse", "moyenne", "haute")


def _share(c: Column | str) -> Column:
    return F.avg((F.expr(c) if isinstance(c, str) else c).cast("int"))


def accuracy(results: DataFrame, by: str | None = None) -> DataFrame:
    """Shares of right decisions, right priorities, grounded and cited answers, and the number of errors; over all or by a column."""
    rows = results.groupBy(by) if by else results.groupBy()
    return rows.agg(F.count(F.lit(1)).alias("n"), _share("decision_correct").alias("decision_accuracy"), _share("priority_correct").alias("priority_accuracy"), _share("rag_grounded").alias("grounded"), _share("policy_cited").alias("cited"), F.count("error").alias("errors"))


def level_of(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LEVELS)), c) - 1


def level_bias(results: DataFrame, expected: str, actual: str) -> DataFrame:
    """By expected level: how many, the share of right ones, and how many are placed above and below."""
    e, a = level_of(F.col(expected)), level_of(F.col(actual))
    return results.groupBy(F.col(expected).alias("level")).agg(F.count(F.lit(1)).alias("n"), _share(e == a).alias("accuracy"), F.count_if(a > e).alias("over"), F.count_if(a < e).alias("under"))


def gap_coverage(results: DataFrame) -> DataFrame:
    """One row: right decisions among cases with a gap, and among cases that an older system got wrong."""
    gap, wrong = F.col("has_gap"), F.lower("old_ia_correct") == "false"
    return results.agg(F.count_if(gap).alias("gap_cases"), F.count_if(gap & F.col("decision_correct")).alias("gap_right"), F.count_if(wrong).alias("old_wrong"), F.count_if(wrong & F.col("decision_correct")).alias("now_right"))


def balanced_accuracy(results: DataFrame, expected: str, correct: str) -> DataFrame:
    """The mean of the classes' recalls: labels are far from even."""
    return results.groupBy(expected).agg(_share(F.col(correct)).alias("recall")).agg(F.avg("recall").alias("balanced_accuracy"))


def join_expected(cases: DataFrame, results: DataFrame) -> DataFrame:
    return cases.join(results, "id").withColumns({"decision_correct": F.col("decision_expected") == F.col("actual_decision"), "has_gap": F.col("gap").isNotNull()})


def compare_models(runs: DataFrame, production: DataFrame, prices: DataFrame) -> DataFrame:
    """By model: agreement with production decisions, errors, tokens, cost and mean duration. runs: model, id, decision, error, prompt_tokens, completion_tokens, ms."""
    joined = runs.join(production.select("id", F.col("decision").alias("_expected")), "id", "left").join(small(prices, "the table of prices"), "model", "left")
    cost = F.col("prompt_tokens") / 1e6 * F.col("price_in") + F.col("completion_tokens") / 1e6 * F.col("price_out")
    return joined.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == F.col("_expected")).alias("agreed"), F.count("error").alias("errors"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(cost).alias("cost"), F.avg("ms").alias("mean_ms"))


def stratified(tenders: DataFrame, limit: int) -> DataFrame:
    """Half of the limit from the newest passed tenders, half from the newest rejected ones."""
    half = limit // 2
    take = lambda gate: tenders.filter(F.col("decision_gate") == gate).orderBy(F.desc("analyzed_at"), "source_id").limit(half)
    return take("PASS").unionByName(take("REJECT"))


def select_cases(cases: DataFrame, ids: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    if ids:
        return cases.filter(F.col("id").isin(ids))
    return cases.filter(F.col("category").isin(categories)) if categories else cases

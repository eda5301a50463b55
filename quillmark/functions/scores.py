"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed constants of the scores.
CATEGORY_FACTOR = 3.5
SECTOR_CAP, EXPERTISE_CAP, POSTURE_CAP = 50, 40, 15
SECTOR_EACH, MISSION_EACH, EXPERTISE_EACH = 15, 18, 10
WEIGHT_SEMANTIC, WEIGHT_KEYWORD, WEIGHT_URGENCY, URGENCY_DAYS = 0.50, 0.30, 0.20, 60
HIGH, MEDIUM = 8, 6
GATE_LOW, GATE_MIDDLE, GATE_HIGH, FLAG_PENALTY, FLAG_FLOOR = 20, 30, 40, 30, 15
# End of the fixed constants.


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity, as ECMAScript does."""
    return F.floor(x + 0.5)


def category_score(matches: Column, weight: Column, cap: Column) -> Column:
    """Rewards distinct matches by their logarithm."""
    return F.when(matches == 0, F.lit(0)).otherwise(F.least(cap, half_up(F.log(matches + 1) * weight * CATEGORY_FACTOR))).cast("int")


def confidence(sector: Column, expertise: Column, has_sector: Column, has_expertise: Column) -> Column:
    both = sector + expertise
    return (
        F.when(has_sector & has_expertise & (both >= 40), "HIGH")
        .when((sector >= 30) | (expertise >= 30), "HIGH")
        .when((has_sector & (sector >= 15)) | (has_expertise & (expertise >= 15)) | (both >= 25), "MEDIUM")
        .otherwise("LOW")
    )


def gate(score: Column, confidence: Column, flagged: Column) -> Column:
    """struct(skip, reason, priority): is the costly analysis worth while?"""
    def row(skip: bool, reason: str | None, priority: str) -> Column:
        return F.struct(F.lit(skip).alias("skip"), F.lit(reason).cast("string").alias("reason"), F.lit(priority).alias("priority"))
    return (
        F.when(score < GATE_LOW, row(True, "score_trop_faible", "SKIP"))
        .when(flagged & (F.greatest(F.lit(0), score - FLAG_PENALTY) < FLAG_FLOOR), row(True, "red_flags_critiques", "SKIP"))
        .when((score < GATE_MIDDLE) & confidence.isin("HIGH", "MEDIUM"), row(False, None, "MEDIUM"))
        .when(score < GATE_MIDDLE, row(True, "score_faible", "LOW"))
        .when((score < GATE_HIGH) & (confidence == "LOW"), row(True, "confidence_faible", "LOW"))
        .when((score >= 60) | (confidence == "HIGH"), row(False, None, "HIGH"))
        .when((score >= GATE_HIGH) | (confidence == "MEDIUM"), row(False, None, "MEDIUM"))
        .otherwise(row(False, None, "LOW"))
    )


def final_score(semantic: Column, keyword: Column, days_left: Column) -> Column:
    """keyword: 0 to 100. Null where a part is null. Urgency has no upper bound: days may be negative."""
    urgency = (1 - F.least(days_left / URGENCY_DAYS, F.lit(1.0))) * 10 * WEIGHT_URGENCY
    return F.when(days_left.isNotNull(), semantic * WEIGHT_SEMANTIC + keyword / 100 * WEIGHT_KEYWORD + urgency)


def priority(score: Column) -> Column:
    """A missing score, and one that is no number, is low."""
    return F.when(score.isNull() | F.isnan(score), "LOW").when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def promoted(numeric: Column, recommendation: Column, semantic: Column) -> Column:
    """A low priority follows the analyst's recommendation; other priorities stay as they are."""
    real = recommendation.isNotNull() & (recommendation != "NON_PERTINENT") & (F.coalesce(semantic, F.lit(0.0)) > 0)
    return F.when(real & (numeric == "LOW") & (recommendation == "HAUTE_PRIORITE"), "HIGH").when(real & (numeric == "LOW") & (recommendation == "MOYENNE_PRIORITE"), "MEDIUM").otherwise(numeric)


def skipped_score(keyword: Column) -> Column:
    """The score of a tender that is not analysed."""
    return keyword / 10 * 0.7


def fallback_score(keyword: Column, factor: float = 0.5) -> Column:
    """The score when the analysis fails: of its result, or as a whole with 0.7."""
    return keyword / 100 * factor


def semantic_score(sector: Column, expertise: Column, posture: Column) -> Column:
    return sector * 0.35 + expertise * 0.35 + posture * 0.20


def token_cost(prompt: Column, completion: Column, per_million_in: Column, per_million_out: Column) -> Column:
    return prompt / 1e6 * per_million_in + completion / 1e6 * per_million_out


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null where a norm is 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0).cast("double"), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return F.try_divide(dot, norm(a) * norm(b))

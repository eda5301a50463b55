"""Which way a tender takes, and what it is worth at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import scores, temporal
from quillmark.schemas import SEMANTIC


def route(has_original: Column, is_cancelled: Column, is_amendment: Column, is_substantial: Column, skip: Column) -> Column:
    """The first branch that holds: context, cancelled, minor, skip, substantial, new."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(is_amendment) & ~yes(has_original), "context")
        .when(yes(is_cancelled), "cancelled")
        .when(yes(is_amendment) & ~yes(is_substantial), "minor")
        .when(yes(skip), "skip")
        .when(yes(is_amendment), "substantial")
        .otherwise("new")
    )


def needs_analysis(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("route").isin("new", "substantial"))


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def rule_scorer(rows: pd.DataFrame) -> pd.DataFrame:
    """A deterministic analyst: scores follow the keyword axes, and the recommendation follows the score."""
    sector, expertise, posture = rows["sector_score"] / 5.0, rows["expertise_score"] / 4.0, rows["posture_score"] / 1.5
    total = sector * 0.35 + expertise * 0.35 + posture * 0.20
    keep = total >= 2.0
    wish = pd.cut(total, [-1, 2, 4, 6, 100], labels=["NON_PERTINENT", "BASSE_PRIORITE", "MOYENNE_PRIORITE", "HAUTE_PRIORITE"], right=False).astype(str)
    gate = keep.map({True: "PASS", False: "REJECT"})
    return pd.DataFrame({"decision_gate": gate, "rejet_raison": keep.map({True: None, False: "hors périmètre"}), "recommandation": wish, "score_semantique_global": total, "score_secteur": sector, "score_expertise": expertise, "score_posture": posture, "reason": "règles", "confidence": "MEDIUM"}, index=rows.index)


def analyse(tenders: DataFrame, scorer: Scorer = rule_scorer, columns: tuple[str, ...] = ("sector_score", "expertise_score", "posture_score")) -> DataFrame:
    """Adds ``semantic``, which a plug-in makes from whole batches of the given columns; filter before, as it may be costly."""
    names = SEMANTIC.names
    carried = tenders.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = scorer(rows[list(columns)])
            yield rows.assign(**{f"_sem_{n}": found[n].to_numpy() for n in names})

    schema = T.StructType([*tenders.schema.fields, *(T.StructField(f"_sem_{f.name}", f.dataType) for f in SEMANTIC.fields)])
    out = tenders.mapInPandas(run, schema)
    return out.select(*carried, F.struct(*(F.col(f"_sem_{n}").alias(n) for n in names)).alias("semantic"))


def finish(analysed: DataFrame, as_of: str) -> DataFrame:
    """Adds days_left, final_score and priority from semantic, keyword_score and deadline."""
    days = temporal.days_left(F.col("deadline"), F.lit(as_of).cast("timestamp"))
    semantic = F.col("semantic.score_semantique_global")
    score = scores.final_score(semantic, F.col("keyword_score"), days)
    numeric = scores.priority(score)
    return analysed.withColumns({"days_left": days, "final_score": score, "priority": scores.promoted(numeric, F.col("semantic.recommandation"), semantic)})


def price_skipped(skipped: DataFrame) -> DataFrame:
    """Tenders that the gate keeps from analysis: their score comes from keywords alone."""
    score = scores.skipped_score(F.col("keyword_score"))
    return skipped.withColumns({"final_score": score, "priority": F.when(score >= 5.6, "MEDIUM").otherwise("LOW")})


def keep_minor(minor: DataFrame, stored: DataFrame) -> DataFrame:
    """Minor amendments take over the scores of their originals (matched by original_id); without any they are low."""
    o = stored.select(F.col("id").alias("_id"), F.col("final_score").alias("_score"), F.col("priority").alias("_priority"))
    joined = minor.join(o, minor["original_id"] == F.col("_id"), "left")
    return joined.withColumns({"final_score": F.coalesce("_score", F.lit(0.0)), "priority": F.coalesce("_priority", F.lit("LOW"))}).drop("_id", "_score", "_priority")


# Fixed texts.
SKIPPED = ("Écarté automatiquement — score mots-clés insuffisant (", "/100)")
REJECTED = "Écarté : "
KEPT = ("Retenu — forte adéquation (score ", "/10)")
KEPT_WITH_DOUBTS = ("Retenu avec réserves (score ", "/10)")
NO_REASON = "Analyse disponible"
# End of the fixed texts.


def reason(skip: Column, keyword_score: Column, gate: Column, rejection: Column, priority: Column, semantic: Column, fallback: Column) -> Column:
    """Why a tender was kept or not, in a French sentence."""
    around = lambda words, value: F.concat(F.lit(words[0]), F.coalesce(value.cast("string"), F.lit("?")), F.lit(words[1]))
    return (
        F.when(skip, around(SKIPPED, keyword_score))
        .when(gate == "REJECT", F.concat(F.lit(REJECTED), F.coalesce(rejection, F.lit("null"))))
        .when(priority == "HIGH", around(KEPT, semantic))
        .when(priority == "MEDIUM", around(KEPT_WITH_DOUBTS, semantic))
        .otherwise(F.coalesce(fallback, F.lit(NO_REASON)))
    )

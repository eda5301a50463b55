"""What surrounds a plug-in analyst: prompts, retries, guards, and the validation of what comes back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import scores
from quillmark.operators.routing import Scorer
from quillmark.schemas import SEMANTIC

GATES = ("PASS", "REJECT")
RECOMMENDATIONS = ("HAUTE_PRIORITE", "MOYENNE_PRIORITE", "BASSE_PRIORITE", "NON_PERTINENT")
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")
REASON_TYPES = ("A", "B", "C")
SHORTEST_TEXT, LONGEST_TEXT = 30, 3000
REASON = "type string, terms array<string>, term string, confidence double, explanation string"


def prompt(tenders: DataFrame) -> Column:
    """The question for an analyst, from title, acheteur, description, keywords and the scores of ``lexicon.score``."""
    names = lambda c, none: F.coalesce(F.nullif(F.array_join(F.transform(c, lambda m: m["category"]), ", "), F.lit("")), F.lit(none))
    listed = lambda c, none: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(none))
    text = lambda c, none: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none))
    return F.concat_ws(
        "\n", F.concat(F.lit("Titre : "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Organisme : "), text("acheteur", "Non communiqué")), F.concat(F.lit("Description : "), text("description", "Non disponible")),
        F.concat(F.lit("Mots-clés : "), listed(F.col("keywords"), "Aucun")), F.concat(F.lit("Score : "), F.coalesce(F.col("keyword_score").cast("string"), F.lit("0")), F.lit("/100, confiance "), F.coalesce("confidence", F.lit("UNKNOWN"))),
        F.concat(F.lit("Secteurs : "), names("sector_matches", "aucun")), F.concat(F.lit("Expertises : "), names("expertise_matches", "aucune")), F.concat(F.lit("Exclusions : "), listed(F.col("red_flags"), "aucun")),
    )


def parsed(answer: Column) -> Column:
    """An answer in JSON, perhaps among other text, as a SEMANTIC struct; null if there is none."""
    return F.from_json(F.get(F.filter(F.array(F.regexp_extract(answer, r"(?s)\{.*\}", 0)), lambda x: x != ""), 0), SEMANTIC)


def faults(semantic: Column) -> Column:
    """The names of fields that are missing or out of range; empty for a valid analysis."""
    score = lambda n: semantic[n].isNull() | ~semantic[n].between(0, 10)
    rules = [("decision_gate", ~F.coalesce(semantic["decision_gate"].isin(*GATES), F.lit(False))), ("recommandation", ~F.coalesce(semantic["recommandation"].isin(*RECOMMENDATIONS), F.lit(False))), ("confidence", ~F.coalesce(semantic["confidence"].isin(*CONFIDENCES), F.lit(False)))]
    rules += [(n, score(n)) for n in ("score_semantique_global", "score_secteur", "score_expertise", "score_posture")]
    return F.filter(F.array(*(F.when(bad, F.lit(n)) for n, bad in rules)), lambda x: x.isNotNull())


def fallback(keyword_score: Column) -> Column:
    """The analysis that stands in when an analyst fails: a low score from keywords, and a gate that stays open."""
    points = keyword_score / 100 * 0.5
    return F.struct(F.lit("PASS").alias("decision_gate"), F.lit(None).cast("string").alias("rejet_raison"), F.lit("NON_PERTINENT").alias("recommandation"), points.alias("score_semantique_global"), F.lit(0.0).alias("score_secteur"), F.lit(0.0).alias("score_expertise"), F.lit(0.0).alias("score_posture"), F.lit("analyse indisponible").alias("reason"), F.lit("LOW").alias("confidence"))


def valid_reason(answer: Column) -> Column:
    """A classified reason in JSON, or null: the type is one of three, confidence lies in 0 to 1, and type B names its term."""
    r = F.from_json(answer, REASON)
    good = F.coalesce(r["type"].isin(*REASON_TYPES) & r["confidence"].between(0, 1) & r["explanation"].isNotNull() & ((r["type"] != "B") | r["term"].isNotNull()), F.lit(False))
    return F.when(good, r)


def retrying(scorer: Scorer, attempts: int = 3, wait: Callable[[int], float] = lambda k: 65.0 + 5 * k, sleep: Callable[[float], None] = time.sleep) -> Scorer:
    """A scorer that is asked again when it is refused; the last failure is raised."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        for k in range(attempts):
            try:
                return scorer(rows)
            except ConnectionError:
                if k + 1 == attempts:
                    raise
                sleep(wait(k))
        raise AssertionError

    return run


Verifier = Callable[[str, list[str]], list[str]]


def verify_conditions(tenders: DataFrame, verifier: Verifier) -> DataFrame:
    """Adds status and verdicts (one for each entry of ``conditions``): skipped without conditions, all unknown for a short text.

    Only rows that pass both guards reach the plug-in, with the first part of their text (the length is the analyst's limit).
    """
    text = F.concat_ws(" ", "title", "description")
    none = F.coalesce(F.size("conditions"), F.lit(0)) < 1
    short = F.length(F.trim(text)) < SHORTEST_TEXT

    @F.pandas_udf("array<string>")
    def ask(texts: pd.Series, conditions: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or c is None or not len(c) else verifier(t, list(c)) for t, c in zip(texts, conditions, strict=True)])

    out = tenders.withColumn("status", F.when(none, "skipped").when(short, "unknown").otherwise("verified"))
    asked = ask(F.when(F.col("status") == "verified", F.substring(text, 1, LONGEST_TEXT)), F.col("conditions"))
    return out.withColumn("verdicts", F.when(none, F.array().cast("array<string>")).when(short, F.transform("conditions", lambda _: F.lit("unknown"))).otherwise(asked))


Embedder = Callable[[list[str]], list[list[float]]]
#: Calls of an embedder after which their rows leave the task's Python.
EMBEDDED = 10


def embed(chunks: DataFrame, embedder: Embedder, batch: int = 20) -> DataFrame:
    """Adds ``vector`` by a plug-in that is called with at most ``batch`` texts at once.

    Rows travel as Arrow and stay as they are; only the texts of one call are Python objects, and rows go on ``EMBEDDED`` calls at a time.
    """
    text = chunks.columns.index("content")
    kind = pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for first in range(0, rows.num_rows, EMBEDDED * batch):
                part = rows.slice(first, EMBEDDED * batch)
                asked = (part.column(text).slice(k, batch).to_pylist() for k in range(0, part.num_rows, batch))
                vectors = pa.concat_arrays([pa.array(embedder(texts), kind) for texts in asked])
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, "vector"])

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


# Fixed text.
OUT_OF_SCOPE = "Hors périmètre — score mots-clés insuffisant."
# End of the fixed text.


def second_gate(scored: DataFrame) -> DataFrame:
    """Adds skip, semantic and semantic_reason: the gate once more, right before an analyst would be asked.

    Rows that it stops get the stand-in analysis, whichever way they came; the others have no analysis yet. scored: as ``lexicon.score``
    gives it.
    """
    skip = scores.gate(F.col("keyword_score"), F.col("confidence"), F.size("red_flags") > 0)["skip"]
    return scored.withColumn("skip", skip).withColumns({"semantic": F.when(F.col("skip"), fallback(F.col("keyword_score"))), "semantic_reason": F.when(F.col("skip"), F.lit(OUT_OF_SCOPE))})

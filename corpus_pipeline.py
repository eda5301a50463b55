"""The corpus pipeline: named stages, each one of the corpus operators.

Every stage gets what its predecessor kept, and its decisions take effect: toxic documents go, recurring lines are
taken out of the texts, one document of each group of near copies stays, documents with benchmark items go, and what is
left is packed into sequences. Stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, jaccard, linededup, packing, toxicity
from quillmark.llm.common import checkpointed, table


def _aside(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """Documents whose columns but some lie in one struct, where no result column can clash with them; and what brings them back."""
    others = [c for c in docs.columns if c not in own]
    struct = [F.struct(*(docs[c] for c in others)).alias("__others")] if others else []
    packed = docs.select(*(c for c in docs.columns if c in own), *struct)
    return packed, [F.col("__others")[c].alias(c) if c in others else F.col(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. The model learns from labels outside the held-out fold.

    A null or empty text has the score of a text without known words; rows that repeat are judged alike, long texts whole. Without positive
    labels every document stays. Other columns come back as they were, whatever their names.
    """
    packed, columns = _aside(docs, "doc_id", "text")
    return toxicity.toxicity(packed, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines.

    A null text comes back empty; n_chars, if there is one, follows the text. Of rows that repeat an id a line goes from all or
    from none. Other columns come back as they were, whatever their names.
    """
    packed, columns = _aside(docs, "doc_id", "text", "n_chars")
    return linededup.line_dedup(packed).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id (then text hash); of rows that repeat id and text, one.

    A document is known by id and text, so rows that share an id are judged one by one. Rows without words, which link with
    nothing, and rows without an id all stay.
    """
    key = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)), F.xxhash64("text")]
    names = ["__lacks", "__id", "__hash"]  # flat columns, so that the join's partitioning serves the aggregation too
    named = docs.withColumns(dict(zip(names, key, strict=True)))
    groups = jaccard.jaccard_join(named.select(F.struct(*names).alias("__document"), "text"), key="__document")
    stays = (F.col("__document") == F.col("component_id")) | F.col("__document.__lacks")
    least = groups.filter(stays).select("__document.*", (F.col("__document.__lacks") | (F.col("n_shingles") == 0)).alias("__alone")).distinct()
    kept = named.join(least, names).withColumn("__row", F.when(F.col("__alone"), F.monotonically_increasing_id()).otherwise(-1))
    return kept.dropDuplicates([*names, "__row"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items.

    Null and empty texts hold none and stay, as do rows with a null id; of rows that repeat an id all go if one holds an item. With an empty
    benchmark every document stays. Long texts are searched whole.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences; null and empty texts are the end token alone, rows that repeat are packed one by one."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn a model, join sets and tokenise, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after another; what a stage returns is kept in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs

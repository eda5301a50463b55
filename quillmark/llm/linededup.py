"""Line deduplication by a fixed-depth tree of line templates, in DataFrame operations only.

1. A line is trimmed, and each token with a digit or an at sign becomes the wildcard ``<*>``. (A line of wildcards
   alone stays as it is.)
2. The tree has the token count and then the first ``DEPTH`` tokens; its leaves hold lines of one length that
   start alike. Within a leaf a position is constant where one token has more than half of the distinct lines,
   and variable elsewhere. A line with at least ``LEAST_TOKENS`` tokens, ``LEAST_ALIKE`` of which are constant, has
   the leaf's template; any other line is its own.
3. A template that occurs in ``LEAST_DOCUMENTS`` documents or more is recurring. Its lines are dropped but for the
   first (smallest doc_id, then position), so that no content is lost altogether.

Lines travel as hashes; the texts of lines are shuffled once, to their leaves, and never as a group: leaves
and templates are counted with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed, discard, parts_for

DEPTH = 3
LEAST_TOKENS = 5
LEAST_ALIKE = 0.7
LEAST_DOCUMENTS = 3
WILDCARD = "<*>"
#: Lines that one part of an intermediate result holds.
LINES = 25_000


def _masked(line: Column) -> Column:
    """A trimmed line with wildcards."""
    tokens = F.transform(F.split(line, " "), lambda t: F.when(t.rlike("[0-9@]"), F.lit(WILDCARD)).otherwise(t))
    masked = F.array_join(tokens, " ")
    return F.when(F.replace(F.replace(masked, F.lit(WILDCARD), F.lit("")), F.lit(" "), F.lit("")) == "", line).otherwise(masked)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, masked, n, leaf of the lines that are not blank. Most texts have nothing to mask, which one look at the text tells."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    lines = F.when(text.rlike("[0-9@]"), F.transform(lines, lambda x: F.when(x.rlike("[0-9@]"), _masked(x)).otherwise(x))).otherwise(lines)
    lines = docs.select("doc_id", F.posexplode(lines).alias("pos", "masked")).filter("masked <> ''")
    n = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return lines.withColumn("n", n).withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", DEPTH)))


def line_dedup(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The columns of docs with recurring lines taken out of text, and n_lines, n_dropped; n_chars follows the text.

    A null text is an empty one and comes back empty. Blank lines stay. Rows that repeat a doc_id count as one
    document: a position that is dropped is dropped in all of them; rows with a null id are one document. A
    document may lose all its lines; its row stays. Other columns are carried; columns of docs that are named
    n_lines or n_dropped are replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    own = docs.select("doc_id", "text")
    light = checkpointed(_lines(own).select("doc_id", "pos", F.xxhash64("masked").alias("line"), "leaf", "n"))
    parts = parts_for(spark, light.count(), LINES)
    mixed = light.filter(F.col("n") >= LEAST_TOKENS).groupBy("leaf").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter("low <> high").select("leaf")
    mixed = checkpointed(mixed, parts)  # neither side of the join is aggregated in its stage, nor is its result, so that a hot leaf can be split
    picked = checkpointed(_lines(own).filter(F.col("n") >= LEAST_TOKENS).select("leaf", "n", "masked").join(mixed, "leaf", "left_semi"), parts)
    distinct = checkpointed(picked.distinct(), parts)
    sizes = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    tokens = distinct.select("leaf", F.posexplode(F.split("masked", " ")).alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("lines"))
    constant = tokens.join(sizes, "leaf").filter(2 * F.col("lines") > F.col("size")).groupBy("leaf").agg(F.collect_list(F.concat_ws(" ", "at", "token")).alias("constant"))
    placed = F.transform(F.split("masked", " "), lambda t, k: F.concat_ws(" ", k, t))
    alike = F.size(F.array_intersect("constant", placed))
    general = distinct.join(constant, "leaf").filter(alike >= LEAST_ALIKE * F.col("n")).select(F.xxhash64("masked").alias("line"), F.xxhash64(F.lit("leaf"), "leaf").alias("general"))
    general = checkpointed(general, parts)
    discard(mixed, picked, distinct)
    known = light.join(general, "line", "left").select("doc_id", "pos", F.coalesce("general", "line").alias("template"))
    each = known.groupBy("template", "doc_id").agg(F.min("pos").alias("pos"))
    recurring = each.groupBy("template").agg(F.count(F.lit(1)).alias("documents"), F.min(F.struct("doc_id", "pos")).alias("first")).filter(F.col("documents") >= least_documents)
    recurring = checkpointed(recurring.select("template", "first"), parts)  # apart from the join, which can then split the rows of a hot template
    gone = known.join(recurring, "template").filter(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    gone = checkpointed(gone.groupBy("doc_id").agg(F.collect_set("pos").alias("__gone")).select(F.col("doc_id").alias("__gone_id"), "__gone"), parts)
    discard(light, general, recurring)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    left = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.transform("__gone", lambda k: k + 1))  # in order, by a set: linear in the lines
    kept = F.array_join(F.transform(left, lambda k: F.element_at("__lines", k)), "\n")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone_id"]), "left").withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    columns = [F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    out = joined.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


ORACLE = f"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, CAST(unnest(range(len(lines))) AS BIGINT) AS pos, trim(unnest(lines), ' ') AS line FROM raw
), put AS (
  SELECT *, array_to_string(list_transform(string_split(line, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9@]') THEN '{WILDCARD}' ELSE t END), ' ') AS put FROM line
), masked AS (
  SELECT doc_id, pos, CASE WHEN replace(replace(put, '{WILDCARD}', ''), ' ', '') = '' THEN line ELSE put END AS masked FROM put
), node AS (
  SELECT doc_id, pos, masked, len(string_split(masked, ' ')) AS n, array_to_string(string_split(masked, ' ')[1:{DEPTH}], ' ') AS head FROM masked WHERE masked <> ''
), dl AS (
  SELECT DISTINCT n, head, masked FROM node WHERE n >= {LEAST_TOKENS}
), leaf AS (
  SELECT n, head, count(*) AS size FROM dl GROUP BY n, head HAVING count(*) > 1
), token AS (
  SELECT n, head, masked, unnest(range(n)) AS spot, unnest(string_split(masked, ' ')) AS token FROM dl JOIN leaf USING (n, head)
), constant AS (
  SELECT n, head, spot, token FROM token JOIN leaf USING (n, head) GROUP BY n, head, spot, token, size HAVING 2 * count(*) > size
), general AS (
  SELECT n, head, masked FROM token JOIN constant USING (n, head, spot, token) GROUP BY n, head, masked HAVING count(*) >= {LEAST_ALIKE} * n
), known AS (
  SELECT doc_id, pos, CASE WHEN general.n IS NULL THEN 'line ' || node.masked ELSE 'leaf ' || node.n || ' ' || node.head END AS template
  FROM node LEFT JOIN general ON node.n = general.n AND node.head = general.head AND node.masked = general.masked
), recurring AS (
  SELECT template, min({{'d': doc_id, 'p': pos}}) AS first FROM known GROUP BY template HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}
), gone AS (
  SELECT doc_id, list(DISTINCT pos) AS gone FROM known JOIN recurring USING (template) WHERE {{'d': doc_id, 'p': pos}} <> first GROUP BY doc_id
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
  coalesce(array_to_string(list_transform(list_filter(range(len(lines)), lambda k: gone IS NULL OR NOT list_contains(gone, k)), lambda k: lines[k + 1]), chr(10)), '') AS text
FROM raw LEFT JOIN gone USING (doc_id)
"""

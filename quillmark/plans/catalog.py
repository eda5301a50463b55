"""The registered queries: operators of this library on the driver's tables, each with SQL of equal result where SQL can express it.

The driver's tables hold no tenders, so ``notices`` reads documents as such: the title is the first line, the buyer is the
source, and dates, scores and flags are derived from columns. No row is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import extract, scores, temporal, text
from quillmark.operators import canonical, changes, dedup, evaluation, feedback, lexicon, matching, merge, report, retrieval, routing, vectors
from quillmark.operators.lineage import shared_folder
from quillmark.operators.small import small
from quillmark.sources.buckets import BucketTable
from quillmark.sources.files import table
from quillmark.streaming import ingest

AS_OF = "2024-03-01"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOTICES = """
notices AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS source_id, source, split_part(text, chr(10), 1) AS title, text AS description, source AS acheteur,
    CASE WHEN n_chars % 7 = 0 THEN NULL ELSE strftime(DATE '2024-01-15' + CAST(n_chars % 90 AS INTEGER), '%Y-%m-%d') END AS deadline,
    DATE '2024-02-01' + CAST(doc_id % 28 AS INTEGER) AS analyzed_at,
    CAST(n_chars % 101 AS INTEGER) AS keyword_score, CAST(n_chars % 11 AS DOUBLE) AS semantic_score,
    CASE WHEN n_chars % 3 = 0 THEN 'HIGH' WHEN n_chars % 3 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, n_chars % 5 = 0 AS flagged,
    CASE n_chars % 4 WHEN 0 THEN 'HAUTE_PRIORITE' WHEN 1 THEN 'MOYENNE_PRIORITE' WHEN 2 THEN 'NON_PERTINENT' END AS recommendation, lang
  FROM documents
)"""


def notices(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("source_id"), "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("description"), F.col("source").alias("acheteur"),
        F.when(n % 7 != 0, F.date_format(F.date_add(F.lit("2024-01-15").cast("date"), (n % 90).cast("int")), "yyyy-MM-dd")).alias("deadline"),
        F.date_add(F.lit("2024-02-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("analyzed_at"),
        (n % 101).cast("int").alias("keyword_score"), (n % 11).cast("double").alias("semantic_score"),
        F.when(n % 3 == 0, "HIGH").when(n % 3 == 1, "MEDIUM").otherwise("LOW").alias("confidence"), (n % 5 == 0).alias("flagged"),
        F.when(n % 4 == 0, "HAUTE_PRIORITE").when(n % 4 == 1, "MOYENNE_PRIORITE").when(n % 4 == 2, "NON_PERTINENT").alias("recommendation"), "lang",
    )


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


GATED = NOTICES + """, gated AS (
  SELECT *, CASE
    WHEN keyword_score < 20 THEN 'score_trop_faible'
    WHEN flagged AND greatest(0, keyword_score - 30) < 15 THEN 'red_flags_critiques'
    WHEN keyword_score < 30 AND confidence = 'LOW' THEN 'score_faible'
    WHEN keyword_score >= 30 AND keyword_score < 40 AND confidence = 'LOW' THEN 'confidence_faible' END AS skip_reason
  FROM notices
), routed AS (
  SELECT *, skip_reason IS NOT NULL AS skip, CASE
    WHEN skip_reason IN ('score_trop_faible', 'red_flags_critiques') THEN 'SKIP'
    WHEN skip_reason IS NOT NULL THEN 'LOW'
    WHEN keyword_score < 30 THEN 'MEDIUM'
    WHEN keyword_score >= 60 OR confidence = 'HIGH' THEN 'HIGH'
    WHEN keyword_score >= 40 OR confidence = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS gate_priority
  FROM gated
)"""


def gated(spark: SparkSession, sf: str) -> DataFrame:
    g = scores.gate(F.col("keyword_score"), F.col("confidence"), F.col("flagged"))
    return notices(spark, sf).withColumn("gate", g).withColumns({"skip": F.col("gate.skip"), "skip_reason": F.col("gate.reason"), "gate_priority": F.col("gate.priority")})


@query("WITH " + GATED + " SELECT source, gate_priority, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE skip) AS BIGINT) AS skipped FROM routed GROUP BY ALL")
def source_route_counts(spark, sf):
    """The gate's outcome by source."""
    return gated(spark, sf).groupBy("source", "gate_priority").agg(F.count(F.lit(1)).alias("n"), F.count_if("skip").alias("skipped"))


@query("WITH " + GATED + " SELECT skip_reason, CAST(count(*) AS BIGINT) AS n FROM routed WHERE skip GROUP BY ALL")
def skip_reasons(spark, sf):
    return report.skip_reasons(gated(spark, sf))


PRICED = NOTICES + f""", days AS (
  SELECT *, CAST(date_diff('day', DATE '{AS_OF}', CAST(deadline AS DATE)) AS BIGINT) AS days_left FROM notices
), scored AS (
  SELECT *, CASE WHEN days_left IS NOT NULL THEN semantic_score * 0.50 + keyword_score / 100.0 * 0.30 + (1 - least(days_left / 60.0, 1.0)) * 10 * 0.20 END AS final_score FROM days
), numeric AS (
  SELECT *, CASE WHEN final_score IS NULL THEN 'LOW' WHEN final_score >= 8 THEN 'HIGH' WHEN final_score >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS numeric_priority FROM scored
), priced AS (
  SELECT *, CASE WHEN numeric_priority = 'LOW' AND semantic_score > 0 AND recommendation = 'HAUTE_PRIORITE' THEN 'HIGH'
    WHEN numeric_priority = 'LOW' AND semantic_score > 0 AND recommendation = 'MOYENNE_PRIORITE' THEN 'MEDIUM' ELSE numeric_priority END AS priority FROM numeric
)"""


def priced(spark: SparkSession, sf: str) -> DataFrame:
    days = temporal.days_left(F.col("deadline"), F.lit(AS_OF).cast("timestamp"))
    out = notices(spark, sf).withColumn("days_left", days).withColumn("final_score", scores.final_score(F.col("semantic_score"), F.col("keyword_score"), F.col("days_left")))
    numeric = scores.priority(F.col("final_score"))
    return out.withColumn("numeric_priority", numeric).withColumn("priority", scores.promoted(F.col("numeric_priority"), F.col("recommendation"), F.col("semantic_score")))


@query("WITH " + PRICED + " SELECT doc_id, days_left, round(final_score, 6) AS final_score, numeric_priority, priority FROM priced")
def final_scores(spark, sf):
    """Days left, the fused score, and both priorities."""
    return priced(spark, sf).select("doc_id", "days_left", F.round("final_score", 6).alias("final_score"), "numeric_priority", "priority")


@query("WITH " + PRICED + " SELECT source, CAST(count(*) FILTER (WHERE priority = 'HIGH') AS BIGINT) AS high, CAST(count(*) FILTER (WHERE priority = 'MEDIUM') AS BIGINT) AS medium, CAST(count(*) FILTER (WHERE priority = 'LOW') AS BIGINT) AS low FROM priced GROUP BY ALL")
def priorities_by_source(spark, sf):
    return report.by_source(priced(spark, sf))


@query("WITH " + PRICED + f""", recent AS (SELECT * FROM priced WHERE analyzed_at >= DATE '{AS_OF}' - 7)
SELECT analyzed_at AS day, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE priority = 'HIGH') AS BIGINT) AS high, CAST(count(*) FILTER (WHERE priority = 'MEDIUM') AS BIGINT) AS medium,
  CAST(count(*) FILTER (WHERE priority = 'LOW') AS BIGINT) AS low, round(avg(final_score), 6) AS mean_score FROM recent GROUP BY ALL""")
def daily_priorities(spark, sf):
    return report.daily(priced(spark, sf), "analyzed_at", 7, AS_OF).withColumn("mean_score", F.round("mean_score", 6))


@query("WITH " + PRICED + """, tier AS (SELECT *, CASE WHEN keyword_score < 40 THEN 2 ELSE 1 END AS tier FROM priced WHERE priority = 'LOW'),
r AS (SELECT *, row_number() OVER (ORDER BY tier, keyword_score DESC, doc_id) AS position, count(*) OVER () AS total FROM tier)
SELECT doc_id, CAST(tier AS INTEGER) AS tier, CAST(position AS INTEGER) AS position, CAST(greatest(0, total - 100) AS BIGINT) AS omitted FROM r WHERE position <= 100""")
def capped_report(spark, sf):
    """The first hundred low rows, in two tiers, with the number left out."""
    low = priced(spark, sf).filter("priority = 'LOW'")
    return report.capped(low, F.when(F.col("keyword_score") < 40, 2).otherwise(1), [F.desc("keyword_score"), F.asc("doc_id")]).select("doc_id", "tier", "position", F.col("omitted").cast("long").alias("omitted"))


@query("WITH " + PRICED + f""", r AS (SELECT *, deadline IS NULL OR deadline >= '{AS_OF}' AS open FROM priced WHERE analyzed_at >= DATE '{AS_OF}' - 30 AND (contains(lower(title), 'the of') OR contains(lower(description), 'the of')))
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE open) AS BIGINT) AS open, CAST(count(*) FILTER (WHERE open AND priority IN ('HIGH', 'MEDIUM')) AS BIGINT) AS high_medium,
  CAST(count(*) FILTER (WHERE open AND priority = 'LOW') AS BIGINT) AS low FROM r""")
def impact_term(spark, sf):
    """How many recent notices a term concerns."""
    return feedback.impact(priced(spark, sf), "the of", AS_OF)


@query("WITH " + PRICED + f"""SELECT source_id, priority, CASE WHEN priority = 'LOW' THEN 'correctly_excluded' ELSE 'would_be_excluded' END AS effect FROM priced
WHERE analyzed_at >= DATE '{AS_OF}' - 30 AND (contains(lower(title), 'tion') OR contains(lower(description), 'tion')) AND (deadline IS NULL OR deadline >= '{AS_OF}')""")
def simulated_rule(spark, sf):
    return feedback.simulate(priced(spark, sf), "tion", "exclude", AS_OF, only_open=True).select("source_id", "priority", "effect")


PLAIN = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
KEYED = NOTICES + f""", keyed AS (
  SELECT *, substr({PLAIN.format('title')}, 1, 100) || '|' || coalesce(deadline, '') || '|' || substr({PLAIN.format('acheteur')}, 1, 100) AS composite_key FROM notices
)"""


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return canonical.dedup_keys(notices(spark, sf).withColumns({"uuid_procedure": none, "siret": none, "notice_number": none}))


@query("WITH " + KEYED + " SELECT doc_id, composite_key FROM keyed")
def normalize_dedup_key(spark, sf):
    return keyed(spark, sf).select("doc_id", "composite_key")


@query("WITH " + KEYED + " SELECT composite_key, CAST(count(*) AS BIGINT) AS n, max(doc_id) AS last_id FROM keyed GROUP BY ALL HAVING count(*) > 1")
def exact_dup_keys(spark, sf):
    return keyed(spark, sf).groupBy("composite_key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_id")).filter("n > 1")


CROSS = KEYED + f""", title_key AS (SELECT *, substr({PLAIN.format('title')}, 1, 100) AS tk FROM keyed),
stored AS (SELECT tk, max(doc_id) AS id FROM title_key WHERE lang = 'en' GROUP BY tk), same AS (SELECT composite_key, max(doc_id) AS id FROM title_key WHERE lang = 'en' GROUP BY composite_key),
new AS (SELECT n.doc_id, coalesce(same.id, stored.id) AS matched_id, CASE WHEN same.id IS NOT NULL THEN 'composite' WHEN stored.id IS NOT NULL THEN 'title' END AS match_strategy
  FROM title_key n LEFT JOIN same ON n.composite_key = same.composite_key LEFT JOIN stored ON n.tk = stored.tk WHERE n.lang <> 'en')"""


def crossed(spark: SparkSession, sf: str) -> DataFrame:
    rows = keyed(spark, sf).withColumn("title_key", text.normalize_key(F.col("title")))
    return dedup.match(rows.filter("lang <> 'en'"), rows.filter("lang = 'en'"), (("composite", "composite_key", "composite_key"), ("title", "title_key", "title_key")), identity="doc_id")


@query("WITH " + CROSS + " SELECT doc_id, matched_id, match_strategy FROM new")
def cross_source_match(spark, sf):
    """Two keys in strict priority."""
    return crossed(spark, sf).select("doc_id", "matched_id", "match_strategy")


@query("WITH " + CROSS + " SELECT count(*) AS unmatched, CAST(count(DISTINCT doc_id) AS BIGINT) AS ids FROM new WHERE matched_id IS NULL")
def cross_source_left(spark, sf):
    return dedup.unmatched(crossed(spark, sf)).agg(F.count(F.lit(1)).alias("unmatched"), F.countDistinct("doc_id").alias("ids"))


@query("WITH " + CROSS + " SELECT match_strategy, CAST(count(*) AS BIGINT) AS n FROM new WHERE match_strategy IS NOT NULL GROUP BY ALL")
def match_strategies(spark, sf):
    return dedup.strategy_counts(crossed(spark, sf))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def already_labeled(spark, sf):
    """Two-stage membership: by id, or else by a second key that is missing here."""
    docs = table(spark, sf, "documents").select("doc_id", F.lit("x").alias("source"), F.col("doc_id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("uuid_procedure"))
    done = table(spark, sf, "labels").select(F.lit("x").alias("source"), F.col("doc_id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("uuid_procedure"), F.lit("analyzed").alias("status"))
    return dedup.already_analysed(docs, done).select("doc_id", "known")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with known: have they a label? Stored rows are matched by (source, source_id)."""
    name = lambda c: F.col(c).cast("string").alias("source_id")
    docs = table(spark, sf, "documents").select("doc_id", F.lit("x").alias("source"), name("doc_id"), F.lit(None).cast("string").alias("uuid_procedure"))
    done = table(spark, sf, "labels").select(F.lit("x").alias("source"), name("doc_id"), F.lit(None).cast("string").alias("uuid_procedure"), F.lit("analyzed").alias("status"))
    return dedup.already_analysed(docs, done)


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def already_labeled_semi(spark, sf):
    return _labelled(spark, sf).filter("known").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def already_labeled_anti(spark, sf):
    return _labelled(spark, sf).filter("NOT known").select("doc_id")


@query("""SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus <> 'P'""")
def prequalify_orders(spark, sf):
    """Orders of two years and two segments that are not pending."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    kept = canonical.prequalified(o, c, ("o_custkey", "c_custkey"), "o_orderdate", "1995-01-01", "1996-12-31", "c_mktsegment", ["BUILDING", "MACHINERY"], "o_orderstatus", "P")
    return kept.select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_user(spark, sf):
    return dedup.latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'click') WHERE r <= 3")
def last_three_clicks(spark, sf):
    return dedup.latest(table(spark, sf, "events").filter("event_type = 'click'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


PREVIOUS = """
paired AS (
  SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, o_orderpriority, lag(o_orderkey) OVER w AS previous, lag(o_totalprice) OVER w AS old_price, lag(o_orderdate) OVER w AS old_date, lag(o_orderpriority) OVER w AS old_priority
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
)"""


def previous_orders(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = lambda c: F.lag(c).over(w)
    return table(spark, sf, "orders").withColumns({"previous": before("o_orderkey"), "old_price": before("o_totalprice"), "old_date": before("o_orderdate"), "old_priority": before("o_orderpriority")})


@query("WITH " + PREVIOUS + " SELECT r.o_orderkey AS source_id, r.previous AS original_id, round(r.o_totalprice - o.o_totalprice, 6) AS score_delta FROM paired r LEFT JOIN orders o ON o.o_orderkey = r.previous WHERE r.previous IS NOT NULL")
def amend_delta(spark, sf):
    """Each order beside the one that it follows, as an amendment beside its original."""
    rows = previous_orders(spark, sf).select(F.col("o_orderkey").alias("source_id"), F.col("previous").alias("annonce_lie"), F.col("o_totalprice").alias("final_score"), F.col("o_orderpriority").alias("title"))
    return changes.amendment_view(rows).select("source_id", "original_id", F.round("score_delta", 6).alias("score_delta"))


@query("WITH " + PREVIOUS + """, d AS (SELECT o_orderkey, previous, abs((o_totalprice - old_price) / old_price) > 0.2 AS budget, abs(epoch_ms(o_orderdate) - epoch_ms(old_date)) / 86400000.0 > 7 AS deadline,
  o_orderpriority <> old_priority AS kind, levenshtein(old_priority, o_orderpriority) * 1.0 / greatest(length(old_priority), length(o_orderpriority)) > 0.2 AS title FROM paired WHERE previous IS NOT NULL)
SELECT o_orderkey, CAST(CAST(budget AS INTEGER) + CAST(deadline AS INTEGER) + CAST(kind AS INTEGER) + CAST(title AS INTEGER) AS INTEGER) AS n_changes, budget OR deadline OR kind OR title AS substantial,
  array_to_string(list_filter([CASE WHEN budget THEN 'budget_max' END, CASE WHEN deadline THEN 'deadline' END, CASE WHEN kind THEN 'type_marche' END, CASE WHEN title THEN 'title' END], lambda x: x IS NOT NULL), ',') AS fields FROM d""")
def change_detect(spark, sf):
    """The change rules between an order and its predecessor."""
    none = F.lit(None).cast("string")
    side = lambda price, date, kind: F.struct(F.col(price).alias("budget_max"), F.col(date).cast("string").alias("deadline"), none.alias("cap_eco"), none.alias("cap_tech"), F.col(kind).alias("type_marche"), none.alias("region"), F.col(kind).alias("title"))
    rows = previous_orders(spark, sf).filter(F.col("previous").isNotNull()).withColumn("found", changes.changes(side("old_price", "old_date", "old_priority"), side("o_totalprice", "o_orderdate", "o_orderpriority")))
    return rows.select("o_orderkey", F.size("found").alias("n_changes"), changes.is_substantial(F.col("found")).alias("substantial"), F.array_join(F.transform("found", lambda c: c["field"]), ",").alias("fields"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round((greatest(length(a.p_name), length(b.p_name)) - levenshtein(a.p_name, b.p_name)) * 1.0 / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey""")
def title_similarity(spark, sf):
    """Edit similarity within equal brand, type and size."""
    classes = matching.paired(table(spark, sf, "part"), ["p_brand", "p_size", "p_type"], "p_partkey", "p_name")
    alike = classes.select("a", "b", "same", F.round(text.similarity(F.col("a_value"), F.col("b_value")), 6).alias("similarity"))
    opened = alike.select(F.explode("a").alias("_x"), "b", "same", "similarity").select("_x", F.explode("b").alias("_y"), "same", "similarity").filter("_x < _y OR (_x > _y AND NOT same)")
    return opened.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "similarity")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS query, label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(q.query::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings e ON q.label = e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_topk_by_label(spark, sf):
    """Search with the stated query set; the filter comes before the top five."""
    e = table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    return retrieval.nearest(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), 5, ["label"]).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(q.query::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM q CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.nearest(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 3).select("query_id", "id", "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(q.query::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM q CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def vector_topk_indexed(spark, sf):
    """The ten nearest by an inverted file of cells, exact by its bounds."""
    e = table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vectors.VectorIndex.build(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return index.nearest(queries, 10)[0].withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT lower(n_name) AS name, n_nationkey AS ord FROM nation), b AS (SELECT DISTINCT s_name || ' ' || n_name AS buyer FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT buyer, trim(regexp_replace(regexp_replace(lower(buyer), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM b),
h AS (SELECT buyer, name, ord FROM p JOIN c ON contains(plain, trim(regexp_replace(regexp_replace(name, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AND length(trim(regexp_replace(regexp_replace(name, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) > 4)
SELECT buyer, name AS nom_normalise, 0.95::DOUBLE AS match_score, 'HIGH' AS match_confidence FROM (SELECT *, row_number() OVER (PARTITION BY buyer ORDER BY ord) AS r FROM h) WHERE r = 1""")
def fuzzy_name_lookup(spark, sf):
    """Known names inside free spellings: nations in suppliers' names."""
    nation = table(spark, sf, "nation")
    clients = nation.select(F.col("n_nationkey").alias("ord"), F.lower("n_name").alias("nom_normalise"), F.array().cast("array<string>").alias("aliases"), F.lit("historical").alias("statut"))
    s = table(spark, sf, "supplier")
    buyers = s.join(nation, s["s_nationkey"] == nation["n_nationkey"]).select(F.concat_ws(" ", "s_name", "n_name").alias("buyer")).distinct()
    return retrieval.known_buyer(buyers, clients).filter("match_type = 'substring'").select("buyer", "nom_normalise", "match_score", "match_confidence")


@query("""SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases,
round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def daily_event_stats(spark, sf):
    """Events by day."""
    found = report.by_day(table(spark, sf, "events"), "ts", "event_type", {"click": "clicks", "purchase": "purchases"}, "value", "mean_value")
    return found.withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(count(json_extract_string(props, '$.k')) AS BIGINT) AS n FROM events GROUP BY 1")
def json_props(spark, sf):
    """Numbers of a JSON column, by type of event."""
    return table(spark, sf, "events").select("event_type", extract.json_long(F.col("props"), "k").alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("n"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '([a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+\\.[a-zA-Z0-9_-]+)', 1), '') AS email,
CAST(length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}\\x{000b}]+', ' ', 'g'))) AS INTEGER) AS n FROM pages""")
def html_extract(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", extract.first_group(F.col("html"), "<title>([^<]*)</title>").alias("title"), extract.email_of(F.col("html")).alias("email"), F.length(text.strip_html(F.col("html"))).alias("n"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 15")
def last_turns(spark, sf):
    """The memory of a conversation: its last fifteen messages."""
    return dedup.latest(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 15).select("conv_id", "turn", "role")


RESULTS = """
results AS (
  SELECT d.source AS category, l.quality = 1 AS expected, d.n_chars >= 1000 AS actual, (l.quality = 1) = (d.n_chars >= 1000) AS right_one, l.toxic = 0 AS cited,
    CASE WHEN l.quality = 1 THEN CASE WHEN l.toxic = 1 THEN 'moyenne' ELSE 'haute' END ELSE 'basse' END AS level, CASE WHEN d.n_chars >= 3000 THEN 'haute' WHEN d.n_chars >= 1000 THEN 'moyenne' WHEN d.n_chars >= 500 THEN 'basse' ELSE 'non_pertinent' END AS placed
  FROM documents d JOIN labels l USING (doc_id)
)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("source").alias("category"), (F.col("quality") == 1).alias("expected"), ((F.col("quality") == 1) == (n >= 1000)).alias("decision_correct"), ((F.col("quality") == 1) == (n >= 1000)).alias("priority_correct"), F.lit(True).alias("rag_grounded"), (F.col("toxic") == 0).alias("policy_cited"), F.lit(None).cast("string").alias("error"),
        F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "moyenne").otherwise("haute")).otherwise("basse").alias("level"), F.when(n >= 3000, "haute").when(n >= 1000, "moyenne").when(n >= 500, "basse").otherwise("non_pertinent").alias("placed"),
        (n % 2 == 0).alias("has_gap"), F.when(n % 3 == 0, "false").otherwise("true").alias("old_ia_correct"), n,
    )


@query("WITH " + RESULTS + " SELECT category, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(right_one AS INTEGER)), 6) AS decision_accuracy, round(avg(CAST(cited AS INTEGER)), 6) AS cited FROM results GROUP BY 1")
def eval_accuracy(spark, sf):
    out = evaluation.accuracy(results(spark, sf), "category")
    return out.select("category", "n", F.round("decision_accuracy", 6).alias("decision_accuracy"), F.round("cited", 6).alias("cited"))


@query("WITH " + RESULTS + """, r AS (SELECT level, list_position(['non_pertinent', 'basse', 'moyenne', 'haute'], level) AS e, list_position(['non_pertinent', 'basse', 'moyenne', 'haute'], placed) AS a FROM results)
SELECT level, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(e = a AS INTEGER)), 6) AS accuracy, CAST(count(*) FILTER (WHERE a > e) AS BIGINT) AS over, CAST(count(*) FILTER (WHERE a < e) AS BIGINT) AS under FROM r GROUP BY 1""")
def eval_levels(spark, sf):
    return evaluation.level_bias(results(spark, sf), "level", "placed").withColumn("accuracy", F.round("accuracy", 6))


@query("WITH " + RESULTS + ", c AS (SELECT expected, avg(CAST(right_one AS INTEGER)) AS recall FROM results GROUP BY 1) SELECT round(avg(recall), 6) AS balanced_accuracy FROM c")
def eval_balanced(spark, sf):
    return evaluation.balanced_accuracy(results(spark, sf), "expected", "decision_correct").withColumn("balanced_accuracy", F.round("balanced_accuracy", 6))


@query("""WITH r AS (SELECT (l.quality = 1) = (d.n_chars >= 1000) AS ok, d.n_chars % 2 = 0 AS gap, d.n_chars % 3 = 0 AS wrong FROM documents d JOIN labels l USING (doc_id))
SELECT CAST(count(*) FILTER (WHERE gap) AS BIGINT) AS gap_cases, CAST(count(*) FILTER (WHERE gap AND ok) AS BIGINT) AS gap_right, CAST(count(*) FILTER (WHERE wrong) AS BIGINT) AS old_wrong, CAST(count(*) FILTER (WHERE wrong AND ok) AS BIGINT) AS now_right FROM r""")
def eval_gaps(spark, sf):
    return evaluation.gap_coverage(results(spark, sf))


@query("""WITH r AS (SELECT o_orderpriority AS model, CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'PASS' END AS decision, CASE WHEN o_orderstatus = 'F' THEN 'REJECT' ELSE 'PASS' END AS wanted, l_quantity AS p, l_linenumber AS c, l_tax AS ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT model, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE decision = wanted) AS BIGINT) AS agreed, CAST(sum(c) AS BIGINT) AS completion_tokens, round(sum(p / 1e6 * 2.5 + c / 1e6 * 10.0), 6) AS cost, round(avg(ms), 6) AS mean_ms FROM r GROUP BY 1""")
def model_comparison(spark, sf):
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    runs = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_orderpriority").alias("model"), F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("PASS").alias("decision"), F.lit(None).cast("string").alias("error"), F.col("l_quantity").alias("prompt_tokens"), F.col("l_linenumber").alias("completion_tokens"), F.col("l_tax").alias("ms"))
    production = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "REJECT").otherwise("PASS").alias("decision"))
    prices = o.select(F.col("o_orderpriority").alias("model")).distinct().select("model", F.lit(2.5).alias("price_in"), F.lit(10.0).alias("price_out"))
    out = evaluation.compare_models(runs, production, prices)
    return out.select("model", "n", "agreed", "completion_tokens", F.round("cost", 6).alias("cost"), F.round("mean_ms", 6).alias("mean_ms"))


@query("""WITH u AS (SELECT o_custkey AS c, max(o_orderdate) AS seen FROM orders GROUP BY 1)
SELECT c_custkey, c_name, c_mktsegment, seen FROM customer LEFT JOIN u ON c = c_custkey""")
def update_from_orders(spark, sf):
    """Some columns of a keyed table from newer rows."""
    base = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(None).cast("timestamp").alias("seen"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("seen"))
    return merge.update(base, new, "c_custkey", ["seen"])


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT s_suppkey, upper(s_name), 0.0 FROM supplier WHERE s_acctbal < 0""")
def upsert_suppliers(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return merge.upsert(s, s.filter("s_acctbal < 0").select("s_suppkey", F.upper("s_name").alias("s_name"), F.lit(0.0).alias("s_acctbal")), "s_suppkey")


@query("""SELECT 'unique doc_id' AS rule, CAST((SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) AS n UNION ALL
SELECT 'unique text', CAST((SELECT count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) UNION ALL SELECT 'n_chars fits', CAST((SELECT count(*) FROM documents WHERE n_chars <> length(text)) AS BIGINT)""")
def quality_checks(spark, sf):
    return merge.violations(table(spark, sf, "documents"), ["doc_id", "text"], {"n_chars fits": F.col("n_chars") == F.length("text")})


@query("WITH " + PRICED + """, s AS (SELECT *, CASE WHEN keyword_score < 40 THEN true ELSE false END AS skip FROM priced)
SELECT doc_id, CASE WHEN skip THEN 'Écarté automatiquement — score mots-clés insuffisant (' || keyword_score || '/100)' WHEN recommendation = 'NON_PERTINENT' THEN 'Écarté : ' || lang
  WHEN priority = 'HIGH' THEN 'Retenu — forte adéquation (score ' || CAST(semantic_score AS INTEGER) || '/10)' WHEN priority = 'MEDIUM' THEN 'Retenu avec réserves (score ' || CAST(semantic_score AS INTEGER) || '/10)' ELSE source END AS reason FROM s""")
def readable_reason(spark, sf):
    rows = priced(spark, sf)
    gate = F.when(F.col("recommendation") == "NON_PERTINENT", "REJECT").otherwise("PASS")
    return rows.select("doc_id", routing.reason(F.col("keyword_score") < 40, F.col("keyword_score"), gate, F.col("lang"), F.col("priority"), F.col("semantic_score").cast("int"), F.col("source")).alias("reason"))


@query("WITH " + GATED + """, b AS (SELECT *, doc_id % 2 = 0 AS amended, doc_id % 3 = 0 AS original, doc_id % 5 = 0 AS substantial, doc_id % 17 = 0 AS cancelled FROM routed)
SELECT CASE WHEN amended AND NOT original THEN 'context' WHEN cancelled THEN 'cancelled' WHEN amended AND NOT substantial THEN 'minor' WHEN skip THEN 'skip' WHEN amended THEN 'substantial' ELSE 'new' END AS route, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1""")
def branch_routes(spark, sf):
    i = F.col("doc_id")
    r = routing.route(i % 3 == 0, i % 17 == 0, i % 2 == 0, i % 5 == 0, F.col("skip"))
    return gated(spark, sf).withColumn("route", r).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + NOTICES + " SELECT doc_id, round(keyword_score / 10.0 * 0.7, 6) AS final_score, CASE WHEN keyword_score / 10.0 * 0.7 >= 5.6 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM notices")
def skipped_prices(spark, sf):
    return routing.price_skipped(notices(spark, sf)).select("doc_id", F.round("final_score", 6).alias("final_score"), "priority")


@query("""SELECT doc_id, least(18, CAST(floor(ln(m + 1) * 4 * 3.5 + 0.5) AS INTEGER)) AS points FROM (SELECT doc_id, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'and') AS INTEGER) + CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'en') AS INTEGER) AS m FROM documents)""")
def category_points(spark, sf):
    """The logarithmic score of distinct matches."""
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in ("the", "and", "tion", "en")), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", scores.category_score(hits, F.lit(4), F.lit(18)).alias("points"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def third_page(spark, sf):
    """A page is the feature: twenty rows under a total order, after forty."""
    return report.page(table(spark, sf, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 20, 40).select("p_partkey", "p_name")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.idweb'), json_extract_string(props, '$.boamp_id'), json_extract_string(props, '$.id')) AS record_id, json_extract_string(props, '$.k') AS k FROM events")
def record_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", extract.record_id(F.col("props")).alias("record_id"), F.get_json_object("props", "$.k").alias("k"))


@query("WITH " + PRICED + """ SELECT doc_id, '<td>' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') || '</td>' AS cell FROM priced""")
def escaped_titles(spark, sf):
    return priced(spark, sf).select("doc_id", F.concat(F.lit("<td>"), text.escape_html(F.col("title")), F.lit("</td>")).alias("cell"))


@query("WITH " + NOTICES + """ SELECT doc_id, regexp_extract(lang, '.*') AS lang, CASE WHEN n_flags > 0 THEN 'dynamic' ELSE 'none' END AS flag FROM (SELECT *, CAST(contains(lower(description), 'idiot') AS INTEGER) + CAST(contains(lower(description), 'scum') AS INTEGER) AS n_flags FROM notices)""")
def dynamic_flags(spark, sf):
    """Existence of any active rule's value in a text: rules of other clients, kinds and states do not count."""
    rules = spark.createDataFrame([("c", "red_flag", "idiot", True), ("c", "red_flag", "SCUM", True), ("c", "red_flag", "the", False), ("d", "red_flag", "der", True), ("c", "required_keyword", "la", True)], "client_id string, type string, value string, active boolean")
    active = small(feedback.active_rules(rules, "c").select("value"), "the table of active rules")
    rows = notices(spark, sf)
    flagged = rows.join(active, text.contains_folded(F.col("description"), F.col("value")), "left_semi").select(F.col("doc_id").alias("_id"))
    return rows.join(flagged, rows["doc_id"] == flagged["_id"], "left").select("doc_id", "lang", F.when(F.col("_id").isNotNull(), "dynamic").otherwise("none").alias("flag"))


DEMO = lexicon.Lexicon.of([
    ("sector", "mobility", 3, "keyword", "the thonti"), ("sector", "mobility", 3, "keyword", "tion"), ("sector", "energy", 3, "pattern", r"eren\w+"), ("expertise", "strategy", 3, "keyword", "and the"),
    ("expertise", "raison_etre", 3, "keyword", "de la"), ("posture", "posture", 3, "keyword", "for"), ("red_flag", "red_flag", 1, "keyword", "scum"), ("reference_client", "clients", 1, "keyword", "src1"),
])


@query()
def keyword_score(spark, sf):
    """The whole lexicon scoring with a small lexicon; compared with a plain version in the tests."""
    out = lexicon.score(notices(spark, sf), DEMO, ["idiot"])
    return out.select("doc_id", "keyword_score", "confidence", "sector_score", "expertise_score", "posture_score", F.array_join("bonuses", ",").alias("bonuses"), F.size("red_flags").alias("n_flags"), F.col("gate.reason").alias("skip_reason"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_dedup_events(spark, sf):
    """Events as a file stream: deduplicated by id within the watermark, kept batch by batch in a replay-safe table, then counted."""
    events = table(spark, sf, "events")
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    arriving = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = BucketTable(spark, f"{place}/table", "event_id", 16)
    ingest.upsert_buckets(ingest.deduplicated(arriving, "event_id", "ts", "3650 days"), kept, f"{place}/checkpoint", "ts").awaitTermination()
    return kept.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

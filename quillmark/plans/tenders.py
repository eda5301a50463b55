"""Registered queries on tenders that are spelled out from orders: each notice has the fields, notations and keys that the operators look for.

``feed`` and ``bulletin`` write the raw records of the two kinds of source, one for each order; nothing is left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.functions import extract, scores, tables, temporal, text
from quillmark.operators import analysis, canonical, changes, dedup, evaluation, feedback, lexicon, mail, merge, report, retrieval, retry, routing
from quillmark.operators.lineage import checkpointed, shared_folder
from quillmark.plans.catalog import NOTICES, PRICED, notices, priced, query
from quillmark.sources.buckets import BucketTable
from quillmark.sources.files import inline, rewrite, table
from quillmark.streaming import ingest, timers

AS_OF = "1996-06-15"
REGIONS = [("75", "Île-de-France"), ("69", "Auvergne-Rhône-Alpes"), ("33", "Nouvelle-Aquitaine")]
_REGIONS = "regions(department, region) AS (VALUES ('75', 'Île-de-France'), ('69', 'Auvergne-Rhône-Alpes'), ('33', 'Nouvelle-Aquitaine'))"

FEED = """
numbered AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h, CAST(o_orderdate AS DATE) AS d FROM orders
), feed AS (SELECT k, h, d, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u,
  'https://feed/' || CASE WHEN k % 13 = 0 THEN 'attribution/' ELSE 'avis/' END || k AS link,
  CASE k % 4 WHEN 0 THEN 'Conseil en mobilité' WHEN 1 THEN 'Fourniture de papier' WHEN 2 THEN 'Construction d''une école' ELSE 'Nettoyage' END || CASE WHEN k % 17 = 0 THEN ' (marché annulé)' ELSE '' END AS title,
  CASE k % 5 WHEN 0 THEN 'Annonce n°24-' || (10000 + k % 90000) || '<br>' WHEN 1 THEN 'Annonce 24-' || (10000 + k % 90000) || '<br>' WHEN 2 THEN 'Annonce n° 24-12<br>' ELSE '' END
  || CASE k % 7 WHEN 0 THEN 'Nom complet de l''acheteur : Ville ' || k || '<br>' WHEN 1 THEN 'Nom officiel : Commune ' || k || '<br>' WHEN 2 THEN 'Organisme : Syndicat ' || k || '<br>' ELSE '' END
  || CASE k % 6 WHEN 0 THEN '<a data-email="c' || k || '@x.fr">' WHEN 1 THEN 'contact m' || k || '@y.org' ELSE '' END
  || CASE WHEN k % 3 = 0 THEN ' SIRET ' || lpad(CAST(k * 7919 AS VARCHAR), 14, '1') || '.' ELSE '' END
  || CASE WHEN k % 8 < 4 THEN ' Code Postal : 69' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') ELSE '' END
  || CASE k % 9 WHEN 0 THEN ' Avis d''annulation' WHEN 1 THEN ' Avis d''attribution' ELSE '' END
  || CASE k % 4 WHEN 0 THEN ' Identifiant de la procédure : ' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) WHEN 2 THEN ' ref ' || h ELSE '' END AS description,
  CASE k % 3 WHEN 0 THEN '75 - Paris' WHEN 1 THEN '974 - Réunion' END AS location FROM numbered
)"""


def feed(spark: SparkSession, sf: str) -> DataFrame:
    k, h = F.col("k"), F.col("h")
    part = lambda a, n: F.substring(h, a, n)
    u = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    say = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    pick = lambda n, cases: _cases(k % n, cases)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"), F.to_date("o_orderdate").alias("d")).select(
        "k", "h", "d", u.alias("u"), say("https://feed/", F.when(k % 13 == 0, "attribution/").otherwise("avis/"), k).alias("link"),
        say(pick(4, {0: F.lit("Conseil en mobilité"), 1: F.lit("Fourniture de papier"), 2: F.lit("Construction d'une école"), None: F.lit("Nettoyage")}), F.when(k % 17 == 0, " (marché annulé)").otherwise("")).alias("title"),
        say(
            pick(5, {0: say("Annonce n°24-", 10000 + k % 90000, "<br>"), 1: say("Annonce 24-", 10000 + k % 90000, "<br>"), 2: F.lit("Annonce n° 24-12<br>"), None: F.lit("")}),
            pick(7, {0: say("Nom complet de l'acheteur : Ville ", k, "<br>"), 1: say("Nom officiel : Commune ", k, "<br>"), 2: say("Organisme : Syndicat ", k, "<br>"), None: F.lit("")}),
            pick(6, {0: say('<a data-email="c', k, '@x.fr">'), 1: say("contact m", k, "@y.org"), None: F.lit("")}),
            pick(3, {0: say(" SIRET ", F.lpad((k * 7919).cast("string"), 14, "1"), "."), None: F.lit("")}),
            F.when(k % 8 < 4, say(" Code Postal : 69", F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(""),
            pick(9, {0: F.lit(" Avis d'annulation"), 1: F.lit(" Avis d'attribution"), None: F.lit("")}),
            pick(4, {0: say(" Identifiant de la procédure : ", u), 2: say(" ref ", h), None: F.lit("")}),
        ).alias("description"),
        pick(3, {0: F.lit("75 - Paris"), 1: F.lit("974 - Réunion"), None: F.lit(None).cast("string")}).alias("location"),
    )


def _cases(n: Column, cases: dict) -> Column:
    out = F
    for value, then in cases.items():
        if value is not None:
            out = out.when(n == value, then)
    return out.otherwise(cases[None])


_NOTICE = "(CASE WHEN regexp_matches({0}, '^[0-9]{{2}}-[0-9]{{4,}}$') THEN {0} END)"
_N1, _N2, _N3 = (f"nullif(regexp_extract(description, '{p}', 1), '')" for p in ("(?i)Annonce\\s+n[°ºoO\\s]\\s*([0-9]{2}-[0-9]+)", "(?i)Annonce\\s+([0-9]{2}-[0-9]+)", "(?i)Annonce[^<]*?([0-9]{2}-[0-9]{4,})"))
NOTICE_NUMBER = f"coalesce({_NOTICE.format(_N1)}, {_NOTICE.format(_N2)}, {_NOTICE.format(_N3)})"
LABELLED = "lower(coalesce(nullif(regexp_extract(description, '(?i)Identifiant\\s+de\\s+la\\s+procédure\\s*[:=]\\s*([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})', 1), ''), nullif(regexp_extract(description, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}'), '')))"
SIRET = "nullif(regexp_extract(' ' || description || ' ', '[^0-9A-Za-z_]([0-9]{14})[^0-9A-Za-z_]', 1), '')"
BUYER = "coalesce(" + ", ".join(f"trim(nullif(regexp_extract(description, '{p}', 1), ''))" for p in ("(?i)Nom\\s+complet\\s+de\\s+l''acheteur\\s*:\\s*([^<\\n]+)", "(?i)Nom\\s+officiel\\s*:\\s*([^<\\n]+)", "(?i)1\\.1\\s+Acheteur[^<]*?Nom\\s+officiel\\s*:\\s*([^<\\n]+)", "(?i)(?:Acheteur|Organisme)[\\s:]+([^<\\n]+)")) + ")"
EMAIL = "coalesce(nullif(regexp_extract(description, '(?i)data-email\\s*=\\s*[\"'']([^\"'']+@[^\"'']+)[\"'']', 1), ''), nullif(regexp_extract(description, '([a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+\\.[a-zA-Z0-9_-]+)', 1), ''))"
CANCELLED = "(regexp_matches(description || ' ' || title, '(?i)avis\\s+d''annulation|annulation\\s+d''avis|marché\\s+annulé|procédure\\s+annulée'))"
MARKET = "CASE WHEN contains({0}, 'SERVICE') OR contains({0}, 'CONSEIL') THEN 'SERVICES' WHEN contains({0}, 'FOURNITURE') THEN 'FOURNITURES' WHEN contains({0}, 'TRAVAUX') OR contains({0}, 'CONSTRUCTION') THEN 'TRAVAUX' END"
AWARD = "(contains(link, '/attribution/') OR contains(link, '/am-') OR contains(description, 'Avis d''attribution') OR contains(description, 'avis d''attribution') OR contains(description, 'Attribution de marché'))"


@query(f"WITH {FEED} SELECT k, {LABELLED} AS labelled, {SIRET} AS siret, {NOTICE_NUMBER} AS notice, CASE WHEN k % 4 IN (0, 2) THEN u END AS any_uuid FROM feed")
def feed_identifiers(spark, sf):
    """Procedure, company and notice numbers in free text."""
    d = F.col("description")
    return feed(spark, sf).select("k", extract.labelled_uuid(d).alias("labelled"), extract.siret_of(d).alias("siret"), extract.notice_number(d).alias("notice"), extract.uuid_of(d).alias("any_uuid"))


@query(f"WITH {FEED} SELECT k, {BUYER} AS buyer, {EMAIL} AS email, {MARKET.format('upper(title)')} AS market, nullif(regexp_extract(location, '^([0-9]{{2,3}})\\s*-\\s*', 1), '') AS place, nullif(regexp_extract(description, '(?i)Code\\s+Postal\\s*:\\s*([0-9]{{2,3}})[0-9]{{3}}', 1), '') AS post FROM feed")
def feed_buyers(spark, sf):
    """Buyer, mail address, market type and department in free text."""
    d = F.col("description")
    place, post = extract.department_of(F.col("location"), d)
    return feed(spark, sf).select("k", extract.buyer_of(d).alias("buyer"), extract.email_of(d).alias("email"), extract.market_type(F.col("title")).alias("market"), place.alias("place"), post.alias("post"))


@query(f"WITH {FEED} SELECT k, {CANCELLED} AS cancelled, {AWARD} AS award, array_to_string(list_transform(list_filter(['Services', ' études ', '  ', 'travaux', title], lambda c: upper(c) NOT IN ('SERVICES', 'FOURNITURES', 'TRAVAUX') AND trim(c) <> ''), lambda c: trim(c)), ';') AS categories FROM feed")
def feed_flags(spark, sf):
    """Cancellations and awards by their wording; categories that say something."""
    listed = F.array(F.lit("Services"), F.lit(" études "), F.lit("  "), F.lit("travaux"), F.col("title"))
    return feed(spark, sf).select("k", extract.is_cancellation(F.col("description"), F.col("title")).alias("cancelled"), extract.is_award(F.col("link"), F.col("description")).alias("award"), F.array_join(extract.useful_categories(listed), ";").alias("categories"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return feed(spark, sf).select(
        F.col("link").alias("guid"), none.alias("link"), "title", "description", none.alias("contentSnippet"), F.when(F.col("k") % 10 != 0, F.date_format("d", "yyyy-MM-dd'T'10:00:00'Z'")).alias("pubDate"), none.alias("date"), none.alias("dateAccepted"),
        F.col("location").alias("Location"), F.lit("portail").alias("creator"), F.array(F.lit("Services"), F.lit("voirie")).alias("category"),
    )


RSS = f"""{FEED}, {_REGIONS}, rss AS (
  SELECT k, title, link AS source_id, {LABELLED} AS uuid, coalesce({BUYER}, 'portail') AS buyer, CASE WHEN k % 10 <> 0 THEN strftime(d, '%Y-%m-%d') END AS published, {CANCELLED} AS cancelled, {AWARD} AS award, {SIRET} AS siret, {NOTICE_NUMBER} AS notice,
    coalesce(a.region, b.region) AS region, {MARKET.format("upper(title || ' ' || trim(regexp_replace(regexp_replace(description, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))")} AS market
  FROM feed LEFT JOIN regions a ON a.department = regexp_extract(location, '^([0-9]{{2,3}})\\s*-\\s*', 1) LEFT JOIN regions b ON b.department = regexp_extract(description, '(?i)Code\\s+Postal\\s*:\\s*([0-9]{{2,3}})[0-9]{{3}}', 1)
)"""


@query(f"WITH {RSS} SELECT source_id, title, uuid, buyer, published, region, market, siret, notice, CASE WHEN cancelled THEN 'AVIS_ANNULE' END AS etat, cancelled AS is_cancelled FROM rss")
def feed_canonical(spark, sf):
    """Feed items as canonical tenders, then flat."""
    flat = canonical.flatten(canonical.from_rss(items(spark, sf), inline(spark, REGIONS, "department string, region string")))
    return flat.select("source_id", "title", F.col("uuid_procedure").alias("uuid"), F.col("acheteur").alias("buyer"), F.col("publication_date").alias("published"), "region", F.col("type_marche").alias("market"), "siret", F.col("notice_number").alias("notice"), "etat", "is_cancelled")


@query(f"WITH {RSS} SELECT source_id FROM rss WHERE NOT award AND (published IS NULL OR published BETWEEN '1995-01-01' AND '1995-12-31') AND market = 'SERVICES'")
def feed_kept(spark, sf):
    """No awards, within the dates (or without one), of one market type."""
    return canonical.keep_rss(canonical.from_rss(items(spark, sf)), "1995-01-01", "1995-12-31", "SERVICES").select(F.col("tender.source_id").alias("source_id"))


BULLETIN = """
b AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h, CAST(o_orderdate AS DATE) AS d FROM orders
), bulletin AS (SELECT k, d, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u, strftime(d, '%Y-%m-%d') AS published,
  CASE WHEN k % 5 <> 0 THEN strftime(DATE '1996-06-15' + CAST(k % 30 AS INTEGER), '%Y-%m-%d') END AS deadline, CASE WHEN k % 4 < 2 THEN 'appeloffre/standard' ELSE 'resultat' END AS nature, CASE WHEN k % 11 = 0 THEN 'l' || k END AS linked,
  CASE WHEN k % 13 = 0 THEN 'AVIS_ANNULE' END AS etat, k % 3 <> 2 AS services, CASE WHEN k % 7 = 0 THEN 'ACME' END AS holder, k FROM b
)"""


def bulletin(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records: wrapped, half wrapped or not at all; lists as JSON text or scalars."""
    k, h = F.col("k"), F.col("h")
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"), F.to_date("o_orderdate").alias("d"))
    u = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    say = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    values = {
        "idweb": say("24-", k), "objet": say("Objet ", F.when(k % 6 == 4, u).otherwise("sans")), "nomacheteur": say("Acheteur ", k % 100), "dateparution": F.date_format("d", "yyyy-MM-dd"),
        "datelimitereponse": F.when(k % 5 != 0, F.date_format(F.date_add(F.lit(AS_OF).cast("date"), (k % 30).cast("int")), "yyyy-MM-dd")), "nature_categorise": F.when(k % 4 < 2, "appeloffre/standard").otherwise("resultat"),
        "annonce_lie": F.when(k % 11 == 0, say("l", k)), "etat": F.when(k % 13 == 0, "AVIS_ANNULE"), "type_marche": F.when(k % 3 == 0, '["TRAVAUX","SERVICES"]').when(k % 3 == 1, "SERVICES").otherwise('["FOURNITURES"]'),
        "titulaire": F.when(k % 7 == 0, "ACME"), "code_departement": F.when(k % 2 == 0, '["75","92"]').otherwise("99"), "contractfolderid": F.when(k % 6 == 0, u), "url_avis": F.when(k % 6 == 5, say("https://b/", h)).otherwise("https://b/"),
        "donnees": _cases(k % 6, {1: say('{"CONTRACT_FOLDER_ID": "', F.upper(u), '"}'), 2: say('{"PROCEDURE": {"IDENTIFIANT": "', u, '"}, "IDENTITE": {"MEL": "a@b.fr", "CP": "75001"}}'), 3: say('{"X": [{"Y": "', F.replace(u, F.lit("-"), F.lit("_")), '"}]}'), None: F.lit("{broken")}),
    }
    r = F.struct(*(values.get(f.name, F.lit(None)).cast("string").alias(f.name) for f in schemas.RAW_FIELDS.fields))
    rows = base.withColumn("r", r)
    none = F.lit(None).cast(schemas.RAW_FIELDS)
    wrap = lambda n, c: F.when(k % 3 == n, c)
    return rows.select("k", *(wrap(0, F.col(f"r.{f.name}")).alias(f.name) for f in schemas.RAW_FIELDS.fields), wrap(1, F.col("r")).otherwise(none).alias("fields"), wrap(2, F.struct(F.col("r").alias("fields"))).alias("record"))


@query(f"WITH {BULLETIN} SELECT '24-' || k AS source_id, u AS uuid, CASE k % 6 WHEN 0 THEN 'field' WHEN 1 THEN 'key' WHEN 2 THEN 'nested' WHEN 3 THEN 'json' WHEN 4 THEN 'description' ELSE 'url' END AS origin, CASE WHEN k % 2 = 0 THEN 'Île-de-France' ELSE '99' END AS region, CASE WHEN k % 3 = 0 THEN 'TRAVAUX' WHEN k % 3 = 1 THEN 'SERVICES' ELSE 'FOURNITURES' END AS market, CASE WHEN k % 6 = 2 THEN 'a@b.fr' END AS email, etat IS NOT NULL AS is_cancelled FROM bulletin")
def bulletin_canonical(spark, sf):
    """Raw records in three wrappings as canonical tenders; where the procedure's identifier was found."""
    rows = canonical.from_bulletin(bulletin(spark, sf), inline(spark, REGIONS, "department string, region string"))
    flat = canonical.flatten(rows.withColumn("notice_number", F.col("uuid_origin")))
    return flat.select("source_id", F.col("uuid_procedure").alias("uuid"), F.col("notice_number").alias("origin"), "region", F.col("type_marche").alias("market"), F.col("acheteur_email").alias("email"), "is_cancelled")


@query(f"WITH {BULLETIN} SELECT '24-' || k AS source_id FROM bulletin WHERE published BETWEEN '1995-01-01' AND '1996-06-15' AND (nature = 'appeloffre/standard' OR linked IS NOT NULL OR etat IS NOT NULL) AND services AND (deadline IS NULL OR CAST(deadline AS DATE) >= DATE '1996-06-15' + 7) AND holder IS NULL")
def bulletin_kept(spark, sf):
    """The remote query's conditions."""
    rows = checkpointed(canonical.from_bulletin(checkpointed(bulletin(spark, sf))))  # written, as a scan is: nested expressions of both would swell the optimiser's constraints
    return canonical.keep_bulletin(rows, "1995-01-01", AS_OF, AS_OF).select(F.col("tender.source_id").alias("source_id"))


TITLE_KEY = "substr(trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 100)"
STORED = f"""{FEED}, keyed AS (
  SELECT k, {NOTICE_NUMBER} AS notice, {LABELLED} AS uuid_key, {TITLE_KEY} || '|' || coalesce(CASE WHEN k % 6 <> 0 THEN strftime(d, '%Y-%m-%d') END, '') || '|acheteur ' || k % 10 AS composite_key,
    CASE WHEN {SIRET} IS NOT NULL AND k % 6 <> 0 THEN {SIRET} || '|' || strftime(d, '%Y-%m-%d') END AS siret_key, '24-' || (10000 + k % 90000) AS source_id, k % 2 = 0 AS old FROM feed
)"""


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("description"), F.col("k")
    rows = feed(spark, sf).select(
        "k", F.lit("BOAMP").alias("source"), F.concat(F.lit("24-"), (10000 + k % 90000).cast("string")).alias("source_id"), extract.notice_number(d).alias("notice_number"), extract.labelled_uuid(d).alias("uuid_procedure"), "title",
        F.when(k % 6 != 0, F.date_format("d", "yyyy-MM-dd")).alias("deadline"), F.concat(F.lit("Acheteur "), (k % 10).cast("string")).alias("acheteur"), extract.siret_of(d).alias("siret"),
    )
    return canonical.dedup_keys(rows)


def _one(side: str, key: str) -> str:
    return f"(SELECT {key} AS key, max(k) AS id FROM keyed WHERE old AND {key} IS NOT NULL GROUP BY 1) {side}"


@query(f"""WITH {STORED} SELECT n.k, coalesce(a.id, b.id, c.id, d.id) AS matched_id, CASE WHEN a.id IS NOT NULL THEN 'notice_number' WHEN b.id IS NOT NULL THEN 'uuid' WHEN c.id IS NOT NULL THEN 'composite' WHEN d.id IS NOT NULL THEN 'siret_deadline' END AS strategy
FROM keyed n LEFT JOIN {_one('a', 'source_id')} ON n.notice = a.key LEFT JOIN {_one('b', 'uuid_key')} ON n.uuid_key = b.key LEFT JOIN {_one('c', 'composite_key')} ON n.composite_key = c.key LEFT JOIN {_one('d', 'siret_key')} ON n.siret_key = d.key WHERE NOT n.old""")
def four_strategies(spark, sf):
    """Odd tenders against even ones, by four keys in strict priority."""
    rows = _keyed(spark, sf)
    return dedup.match(rows.filter("k % 2 = 1"), rows.filter("k % 2 = 0"), identity="k").select("k", "matched_id", F.col("match_strategy").alias("strategy"))


@query(f"""WITH {STORED} SELECT n.k, coalesce(b.id, c.id, d.id) AS matched_id FROM keyed n LEFT JOIN {_one('b', 'uuid_key')} ON n.uuid_key = b.key LEFT JOIN {_one('c', 'composite_key')} ON n.composite_key = c.key LEFT JOIN {_one('d', 'siret_key')} ON n.siret_key = d.key WHERE NOT n.old""")
def three_strategies(spark, sf):
    """As a single record is matched: without the notice's number."""
    rows = _keyed(spark, sf)
    return dedup.match(rows.filter("k % 2 = 1"), rows.filter("k % 2 = 0"), dedup.STRATEGIES[1:], identity="k").select("k", "matched_id")


AMENDED = """
t AS (SELECT o_orderkey AS id, 'o' || o_orderkey AS source_id, o_custkey AS c, 'Buyer ' || o_custkey AS acheteur, o_orderdate AS analyzed_at, o_orderkey % 3 = 0 AS amendment, o_orderpriority || ' works' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' for the town' END AS title,
  CASE WHEN o_orderkey % 9 = 0 THEN 'o' || (o_orderkey + 1) WHEN o_orderkey % 9 = 3 THEN 'nowhere' END AS linked, CAST(o_orderkey AS VARCHAR) AS normalized_id FROM orders
), s AS (SELECT * FROM t WHERE NOT amendment), a AS (SELECT * FROM t WHERE amendment
), near AS (SELECT a.id, max({'at': s.analyzed_at, 'id': s.id}).id AS v FROM a JOIN s ON a.acheteur = s.acheteur AND a.source_id <> s.source_id AND contains(lower(s.title), lower(substr(a.title, 1, 50))) GROUP BY 1)"""


def _amended(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        k.alias("id"), F.concat(F.lit("o"), name).alias("source_id"), F.concat(F.lit("Buyer "), F.col("o_custkey").cast("string")).alias("acheteur"), F.col("o_orderdate").alias("analyzed_at"), (k % 3 == 0).alias("amendment"),
        F.concat("o_orderpriority", F.lit(" works"), F.when(k % 3 == 0, "").otherwise(" for the town")).alias("title"), F.when(k % 9 == 0, F.concat(F.lit("o"), (k + 1).cast("string"))).when(k % 9 == 3, "nowhere").alias("annonce_lie"), name.alias("normalized_id"),
    )


@query(f"WITH {AMENDED} SELECT a.source_id, coalesce(l.id, near.v) AS original_id FROM a LEFT JOIN s l ON a.linked = l.source_id LEFT JOIN near ON near.id = a.id")
def amended_originals(spark, sf):
    """Each third order amends another: by link, or by buyer and head of the title, the newest of several."""
    rows = _amended(spark, sf)
    return changes.originals(rows.filter("amendment"), rows.filter(~F.col("amendment"))).select("source_id", "original_id")


@query("""WITH s AS (SELECT o_orderkey AS id, 'o' || o_orderkey AS source_id, 'n' || o_orderkey AS norm, 'Buyer ' || o_custkey % 20 AS acheteur, o_orderpriority || ' works ' || o_orderkey % 11 || ' for the town' AS title, o_orderdate AS at FROM orders WHERE o_orderkey % 2 = 0
), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 3 THEN 'o' || (o_orderkey - 1) ELSE 'o' || o_orderkey END AS source_id, CASE WHEN o_orderkey % 8 = 1 THEN 'o' || (o_orderkey - 1) END AS linked, CASE WHEN o_orderkey % 8 = 5 THEN 'n' || (o_orderkey - 1) END AS norm,
  'Buyer ' || o_custkey % 20 AS acheteur, CASE WHEN o_orderkey % 8 = 7 THEN upper(o_orderpriority) || ' WORKS ' || o_orderkey % 11 ELSE 'Lot ' || o_orderkey || ' alone' END AS title FROM orders WHERE o_orderkey % 2 = 1
), near AS (SELECT k, max({'at': s.at, 'id': s.id}).id AS v FROM a JOIN s ON a.acheteur = s.acheteur AND a.source_id <> s.source_id AND contains(lower(s.title), lower(substr(a.title, 1, 50))) GROUP BY 1)
SELECT a.k, coalesce(l.id, i.id, near.v, n.id) AS original_id, CASE WHEN l.id IS NOT NULL THEN 'link' WHEN i.id IS NOT NULL THEN 'id' WHEN near.v IS NOT NULL THEN 'title' WHEN n.id IS NOT NULL THEN 'normalized' END AS way
FROM a LEFT JOIN s l ON a.linked = l.source_id LEFT JOIN s i ON a.source_id = i.source_id LEFT JOIN near USING (k) LEFT JOIN s n ON a.norm = n.norm""")
def originals_by_every_way(spark, sf):
    """Amendments that are found by link, by their own number, by buyer and head of the title, and by the normalised number."""
    k, say = F.col("o_orderkey"), lambda head, c: F.concat(F.lit(head), c.cast("string"))
    rows = table(spark, sf, "orders").withColumn("acheteur", say("Buyer ", F.col("o_custkey") % 20))
    stored = rows.filter(k % 2 == 0).select(k.alias("id"), say("o", k).alias("source_id"), say("n", k).alias("normalized_id"), "acheteur", F.concat("o_orderpriority", F.lit(" works "), (k % 11).cast("string"), F.lit(" for the town")).alias("title"), F.col("o_orderdate").alias("analyzed_at"))
    new = rows.filter(k % 2 == 1).select(
        k.alias("k"), F.when(k % 8 == 3, say("o", k - 1)).otherwise(say("o", k)).alias("source_id"), F.when(k % 8 == 1, say("o", k - 1)).alias("annonce_lie"), F.when(k % 8 == 5, say("n", k - 1)).alias("normalized_id"), "acheteur",
        F.when(k % 8 == 7, F.concat(F.upper("o_orderpriority"), F.lit(" WORKS "), (k % 11).cast("string"))).otherwise(F.concat(F.lit("Lot "), k.cast("string"), F.lit(" alone"))).alias("title"),
    )
    way = F.when(F.col("original_id").isNull(), None).when(k % 8 == 1, "link").when(k % 8 == 3, "id").when(k % 8 == 7, "title").otherwise("normalized")
    return changes.originals(new, stored).withColumnRenamed("k", "o_orderkey").select(k.alias("k"), "original_id", way.alias("way"))


@query("""WITH done AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'u' || o_orderkey % 1000 END AS u FROM orders WHERE o_orderkey % 8 = 0)
SELECT o_orderkey AS k, o_orderkey IN (SELECT k FROM done) OR coalesce('u' || o_orderkey % 1000 IN (SELECT u FROM done WHERE u IS NOT NULL) AND o_orderkey % 3 <> 0, false) AS known FROM orders""")
def known_by_uuid(spark, sf):
    """Tenders that are known by source and number, or else by the identifier of their procedure; rows that wait are not known."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("k"), F.lit("s").alias("source"), F.concat(F.lit("n"), k.cast("string")).alias("source_id"), F.concat(F.lit("u"), (k % 1000).cast("string")).alias("u"))
    stored = rows.filter("k % 4 = 0").select("source", "source_id", F.when(F.col("k") % 5 == 0, F.col("u")).alias("uuid_procedure"), F.when(F.col("k") % 8 == 0, "analyzed").otherwise("pending").alias("status"))
    return dedup.already_analysed(rows.withColumn("uuid_procedure", F.when(F.col("k") % 3 != 0, F.col("u"))), stored).select("k", "known")


@query("""WITH n AS (SELECT n_nationkey, count(c_custkey) AS total, count(c_custkey) FILTER (WHERE c_nationkey % 2 = 0 OR c_acctbal >= 0) AS fetched FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' AND n_nationkey % 7 <> 1 GROUP BY 1)
SELECT n_nationkey AS nation, fetched, total AS total_count, total - fetched AS missing, round(CASE WHEN total = 0 THEN 0.0 ELSE (total - fetched) / total END, 6) AS missing_ratio, CASE WHEN total > fetched THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM n""")
def completeness_by_nation(spark, sf):
    """What was read of what each source announced: all, a part, and of nothing."""
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' AND c_nationkey % 7 <> 1").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    counts = c.groupBy(F.col("nation").alias("_n")).agg(F.count(F.lit(1)).alias("_t"))
    nations = table(spark, sf, "nation")
    announced = nations.join(counts, nations["n_nationkey"] == F.col("_n"), "left").select(F.col("n_nationkey").alias("nation"), F.coalesce("_t", F.lit(0)).alias("total_count"))
    return report.completeness_by(c.filter("nation % 2 = 0 OR c_acctbal >= 0"), announced, "nation").withColumn("missing_ratio", F.round("missing_ratio", 6))


@query("SELECT o_orderkey AS k, contains(o_orderpriority, 'URGENT') OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS amended, o_orderkey % 3 = 0 AND (contains(o_orderpriority, 'URGENT') OR o_orderkey % 5 = 0) AS fresh FROM orders")
def amendments_marked(spark, sf):
    """Amendments by nature, by kind or by a link; and the exemption of substantial ones from what is known."""
    k, kind = F.col("o_orderkey"), F.replace("o_orderpriority", F.lit("URGENT"), F.lit("Rectificatif"))
    o = table(spark, sf, "orders").select("o_orderkey", changes.is_amendment(kind, F.when(k % 5 == 0, "avis RECTIFICATIF"), F.when(k % 7 == 0, "x").otherwise("")).alias("amended"), (F.contains("o_orderpriority", F.lit("URGENT")) | (k % 5 == 0)).alias("is_substantial"), F.lit("s").alias("source"), k.cast("string").alias("source_id"), F.lit(None).cast("string").alias("uuid_procedure"))
    known = o.select("source", "source_id", "uuid_procedure", F.lit("analyzed").alias("status")).filter("true")
    fresh = dedup.to_analyse(o, known).filter(k % 3 == 0).select(F.col("o_orderkey").alias("_k"))
    return o.join(fresh, k == F.col("_k"), "left").select(k.alias("k"), "amended", F.col("_k").isNotNull().alias("fresh"))


@query("""WITH log AS (SELECT CAST(user_id AS VARCHAR) AS client_id, CAST(ts AS DATE) AS since, max(ts) AS sent FROM events WHERE event_type = 'click' GROUP BY ALL),
req AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS client_id, CAST(ts AS DATE) AS since FROM events), fresh AS (SELECT CAST(user_id AS VARCHAR) AS client_id, max(ts) AS newest FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT client_id, since, CASE WHEN sent IS NULL THEN 'FULL' WHEN newest > sent THEN 'DELTA' ELSE 'CONFIRMATION' END AS mode FROM req LEFT JOIN log USING (client_id, since) LEFT JOIN fresh USING (client_id)""")
def mail_modes(spark, sf):
    """Full, delta or confirmation, by what was sent last and what is newer."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("client_id"), F.to_date("ts").alias("since"), F.lit(None).cast("date").alias("until"), "event_type", "ts")
    log = report.log_mail(spark.createDataFrame([], "client_id string, since date, until date, sent_at timestamp"), e.filter("event_type = 'click'").select("client_id", "since", "until", F.col("ts").cast("timestamp").alias("sent_at")))
    new = e.filter("event_type = 'purchase'").select("client_id", F.col("ts").cast("timestamp").alias("analyzed_at"))
    return report.mail_mode(e.select("client_id", "since", "until").distinct(), log, new).select("client_id", "since", "mode")


RULES = """rules AS (SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS client_id, lower(n_name) AS v, n_nationkey % 4 <> 0 AS active FROM nation),
p AS (SELECT s_suppkey AS k, CAST(s_suppkey % 5 AS VARCHAR) AS client_id, CASE s_suppkey % 4 WHEN 0 THEN lower(substr(n_name, 2, 4)) WHEN 1 THEN '  ' || n_name || ' supply ' ELSE s_name END AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _proposals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    rules = n.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("client_id"), F.lit("red_flag").alias("type"), F.col("n_name").alias("value"), (F.col("n_nationkey") % 4 != 0).alias("active"), F.col("n_nationkey").alias("created_at"))
    k = F.col("s_suppkey")
    value = F.when(k % 4 == 0, F.lower(F.substring("n_name", 2, 4))).when(k % 4 == 1, F.concat(F.lit("  "), "n_name", F.lit(" supply "))).otherwise(F.col("s_name"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(k.alias("k"), (k % 5).cast("string").alias("client_id"), F.lit("red_flag").alias("type"), value.alias("value")), rules


@query(f"WITH {RULES} SELECT k, min(r.id) AS duplicate_of FROM p LEFT JOIN rules r ON r.active AND p.client_id = r.client_id AND (contains(r.v, lower(trim(p.value))) OR contains(lower(trim(p.value)), r.v)) GROUP BY k")
def rule_duplicates(spark, sf):
    """Proposed rules that an active one of the client contains, or that contain it."""
    return feedback.duplicates(*_proposals(spark, sf)).select("k", "duplicate_of")


@query(f"WITH {RULES} SELECT k, min(r.id) AS duplicate_of FROM p LEFT JOIN (SELECT * FROM rules WHERE id % 3 <> 0) r ON p.client_id = r.client_id AND (contains(r.v, lower(trim(p.value))) OR contains(lower(trim(p.value)), r.v)) GROUP BY k")
def chunk_duplicates(spark, sf):
    """The same test on applied retrieval corrections."""
    proposals, rules = _proposals(spark, sf)
    applied = rules.select("id", "client_id", F.when(F.col("id") % 3 == 0, "draft").otherwise("applied").alias("status"), F.lit("rag_chunk").alias("correction_type"), F.when(F.col("id") % 2 == 0, F.col("value")).alias("correction_value"), F.col("value").alias("chunk_content"))
    return feedback.duplicate_chunks(proposals, applied).select("k", "duplicate_of")


@query("SELECT n_nationkey AS id, n_name AS value FROM nation WHERE n_nationkey % 4 <> 0 AND contains(lower(n_name), 'tion_1')")
def rules_like(spark, sf):
    """Active rules whose value has a piece, newest first."""
    return feedback.similar_rules(_proposals(spark, sf)[1], "TION_1").select("id", "value")


@query("SELECT n_nationkey AS id, n_nationkey <> 23 AS active FROM nation WHERE n_nationkey % 4 <> 0 AND n_regionkey = 2 OR n_nationkey = 23")
def rules_after_one(spark, sf):
    """One rule is switched off by a piece of its value; then the active rules of a client, and the one."""
    rules = feedback.deactivate(_proposals(spark, sf)[1], value="tion_23")
    return feedback.active_rules(rules, "2").unionByName(rules.filter("id = 23")).select("id", "active").distinct()


@query("WITH " + PRICED + """, c AS (SELECT *, doc_id % 11 = 0 AS is_cancelled, keyword_score < 40 AS skip FROM priced) SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE semantic_score IS NOT NULL AND NOT is_cancelled AND NOT skip) AS BIGINT) AS llm_calls,
CAST(count(*) FILTER (WHERE is_cancelled) AS BIGINT) AS cancelled, round(avg(keyword_score), 6) AS mean_keyword_score FROM c""")
def report_totals(spark, sf):
    rows = priced(spark, sf).withColumns({"is_cancelled": F.col("doc_id") % 11 == 0, "skip": F.col("keyword_score") < 40})
    return report.totals(rows).withColumn("mean_keyword_score", F.round("mean_keyword_score", 6))


@query("SELECT CAST(count(*) AS BIGINT) AS fetched, CAST(1000000 AS BIGINT) AS total_count, CAST(1000000 - count(*) AS BIGINT) AS missing, round((1000000 - count(*)) / 1000000.0, 6) AS missing_ratio, 'INCOMPLETE' AS status FROM documents")
def fetch_completeness(spark, sf):
    return report.completeness(table(spark, sf, "documents"), 1_000_000).withColumn("missing_ratio", F.round("missing_ratio", 6))


QUEUE = """wanted AS (SELECT DISTINCT 'c' || o_custkey % 50 AS client, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 2 = 0), held AS (SELECT DISTINCT 'c' || o_custkey % 50 AS client, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 2 = 1)"""


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("clientId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("gap").alias("reason"))
    empty = spark.createDataFrame([], schemas.RETRY_JOB)
    first = retry.schedule(empty, o.filter("o_orderkey % 2 = 1").unionByName(o.filter("o_orderkey % 2 = 1").withColumn("date", F.lit("soon"))), "1998-01-01T10:00:00Z")
    return retry.schedule(first, o.filter("o_orderkey % 2 = 0"), "1998-01-01T12:30:00Z")


@query(f"WITH {QUEUE}, q AS (SELECT client, day, '1998-01-01T11:00:00Z' AS due FROM held UNION ALL SELECT client, day, '1998-01-01T13:30:00Z' FROM wanted WHERE (client, day) NOT IN (SELECT (client, day) FROM held)) SELECT 'retry-' || client || '-' || day AS id, due AS executeAt, due <= '1998-01-01T12:00:00Z' AS ready FROM q")
def retry_jobs(spark, sf):
    """Two rounds of scheduling: a pending day is not scheduled again, and no day is no job; which are due at noon?"""
    queue = _queue(spark, sf)
    due = retry.ready(queue, "1998-01-01T12:00:00Z").select(F.col("id").alias("_id"))
    return queue.join(due, queue["id"] == due["_id"], "left").select("id", "executeAt", F.col("_id").isNotNull().alias("ready"))


@query(f"WITH {QUEUE}, q AS (SELECT client, day FROM held UNION SELECT client, day FROM wanted) SELECT CASE WHEN client = 'c7' THEN 'completed' WHEN client = 'c8' THEN 'failed' ELSE 'pending' END AS status, CAST(count(*) AS BIGINT) AS n FROM q WHERE client <> 'c9' GROUP BY 1")
def retry_outcomes(spark, sf):
    """Jobs that are done or failed, and what is kept a month later."""
    queue = _queue(spark, sf)
    jobs = queue.filter(F.col("clientId").isin("c7", "c8", "c9")).select("id", F.when(F.col("clientId") == "c8", "boom").alias("error"))
    settled = retry.settle(queue, jobs, "1998-01-02T00:00:00Z").withColumn("createdAt", F.when(F.col("clientId") == "c9", "1997-01-01T00:00:00Z").otherwise(F.col("createdAt")))
    return retry.retain(settled, "1998-01-20T00:00:00Z").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


FEEDBACK = """f AS (SELECT event_id AS id, 'd' || event_id % 500 AS source_id, CASE event_id % 3 WHEN 0 THEN 'keyword_red_flag' WHEN 1 THEN 'keyword_boost' ELSE 'rag_chunk' END AS kind, CASE WHEN event_type = 'click' THEN 'applied' ELSE 'draft' END AS status, ts, event_type FROM events)"""


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        i.alias("id"), F.concat(F.lit("d"), (i % 500).cast("string")).alias("source_id"), F.when(i % 3 == 0, "keyword_red_flag").when(i % 3 == 1, "keyword_boost").otherwise("rag_chunk").alias("correction_type"),
        F.when(F.col("event_type") == "click", "applied").otherwise("draft").alias("status"), F.col("ts").alias("created_at"), F.col("event_type").alias("feedback"), F.lit("c").alias("client_id"), F.lit(None).cast("string").alias("chunk_content"), F.col("event_type").alias("correction_value"),
    )


@query(f"WITH {FEEDBACK} SELECT id, CASE WHEN id % 4 = 0 THEN id END AS rule_id, CASE WHEN kind <> 'rag_chunk' THEN id % 4 = 0 AND id % 8 = 0 ELSE status = 'applied' END AS is_active FROM f")
def correction_history(spark, sf):
    """Corrections with their rules: is each of them active?"""
    f = _feedback(spark, sf)
    rules = f.filter("id % 4 = 0").select(F.col("id").alias("feedback_id"), "id", (F.col("id") % 8 == 0).alias("active"))
    return feedback.history(f, rules).select("id", "rule_id", "is_active")


@query(f"""WITH {FEEDBACK}, r AS (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, id DESC) AS n FROM f WHERE status = 'applied')
SELECT 'd' || doc_id AS source_id, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) FROM r WHERE n <= 3 AND r.source_id = 'd' || doc_id), '') AS last FROM documents""")
def last_corrections(spark, sf):
    """Tenders with their last three applied corrections, newest first."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"))
    return feedback.details(docs, _feedback(spark, sf)).select("source_id", F.array_join(F.transform("feedbacks", lambda x: x["id"].cast("string")), ",").alias("last"))


@query(f"""WITH {FEEDBACK}, r AS (SELECT source_id, string_agg(event_type, ' — ' ORDER BY ts, id) AS reason FROM f WHERE status = 'applied' GROUP BY 1) SELECT 'd' || doc_id AS source_id, reason FROM documents LEFT JOIN r ON r.source_id = 'd' || doc_id""")
def reverted_reasons(spark, sf):
    """A manual priority goes; the reason is made of the corrections that still apply, oldest first."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.lit("HIGH").alias("manual_priority"), F.lit("x").alias("reason"))
    return feedback.revert_manual(docs, _feedback(spark, sf)).filter(F.col("manual_priority").isNull()).select("source_id", "reason")


@query(f"WITH {FEEDBACK} SELECT f.id, substr(text, 1, 20) AS head FROM f JOIN documents ON f.source_id = 'd' || doc_id")
def enriched_corrections(spark, sf):
    """Corrections with their tender; both must exist."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.substring("text", 1, 20).alias("title"), F.lit("").alias("description"), F.lit("LOW").alias("priority"))
    return feedback.enrich(_feedback(spark, sf), docs).select("id", F.col("title").alias("head"))


@query("SELECT user_id AS id, max_by(event_type, {'t': ts, 'e': event_id}) AS status, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY 1")
def correction_states(spark, sf):
    """The state of each correction: its last event."""
    return feedback.transition(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))).select("id", "status", "events")


@query(f"WITH {FEEDBACK} SELECT 'feedback_' || id AS id, event_type AS text, 'user_feedback' AS type FROM f WHERE status = 'applied' AND kind = 'rag_chunk'")
def correction_chunks(spark, sf):
    """Applied retrieval corrections as rows for the index."""
    return feedback.chunk_vector(_feedback(spark, sf).withColumn("id", F.col("id").cast("string")))


@query("""SELECT event_id AS id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'forced' END, CASE WHEN event_id % 2 = 0 THEN 'keyword_boost' END, event_type) AS kind,
CASE WHEN event_id % 2 = 0 THEN coalesce(CASE WHEN event_id % 3 = 0 THEN 'boost' END, 'rule') ELSE coalesce(CASE WHEN event_id % 7 = 0 THEN 'flag' END, 'title') END AS term, 'A:' || event_type || ',B:autre' AS choices FROM events""")
def corrections_resolved(spark, sf):
    """Kind and term of a correction, and the lettered choices."""
    i = F.col("event_id")
    direction = F.when(i % 2 == 0, "include").otherwise("exclude")
    kind = feedback.correction_type(F.when(i % 5 == 0, "forced"), direction, F.col("event_type"))
    term = feedback.simulated_term(direction, F.when(i % 3 == 0, "boost").otherwise(""), F.when(i % 7 == 0, "flag"), F.lit("title"), F.lit("rule"))
    choices = F.array_join(F.transform(feedback.choices(F.array("event_type")), lambda c: F.concat(c["letter"], F.lit(":"), c["term"])), ",")
    return table(spark, sf, "events").select(i.alias("id"), kind.alias("kind"), term.alias("term"), choices.alias("choices"))


@query("""SELECT o_orderkey AS k, strftime(o_orderdate, '%d/%m/%Y') AS shown, ['dimanche', 'lundi', 'mardi', 'mercredi', 'jeudi', 'vendredi', 'samedi'][dayofweek(o_orderdate) + 1] AS weekday, dayofweek(o_orderdate) IN (3, 5) AS feed_day,
CASE WHEN o_orderkey % 2 = 0 THEN 'le ' || strftime(o_orderdate, '%d/%m/%Y') ELSE 'du ' || strftime(o_orderdate, '%d/%m/%Y') || ' au ' || strftime(o_orderdate + INTERVAL 3 DAY, '%d/%m/%Y') END AS range,
o_orderkey % 3 || CASE WHEN o_orderkey % 3 > 1 THEN ' jours' ELSE ' jour' END AS days, replace(format('{:,}', CAST(o_orderkey * 1000 AS BIGINT)), ',', chr(8239)) || chr(160) || '€' AS amount, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS midnight FROM orders""")
def french_texts(spark, sf):
    """Dates, weekdays, ranges, plurals and amounts as mails show them."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    written = F.when(k % 4 != 0, F.date_format(d, "yyyy-MM-dd")).otherwise("31/02/1996")
    return table(spark, sf, "orders").select(
        k.alias("k"), temporal.french_date(d).alias("shown"), temporal.french_weekday(d).alias("weekday"), temporal.reads_feed(d).alias("feed_day"), temporal.french_range(d, F.when(k % 2 == 0, d).otherwise(F.date_add(d, 3))).alias("range"),
        text.plural(k % 3, "jour", "jours").alias("days"), text.format_eur((k * 1000).cast("double")).alias("amount"), temporal.instant(written).cast("timestamp_ntz").alias("midnight"),
    )


LEXICON = [("sector", "mobility", 4, "the"), ("sector", "mobility", 4, "and"), ("sector", "energy", 2, "der"), ("expertise", "strategy", 3, "of"), ("expertise", "raison_etre", 3, "la"), ("posture", "posture", 2, "in"), ("red_flag", "red_flag", 1, "idiot"), ("reference_client", "clients", 1, "src1")]
_PLAIN = "trim(regexp_replace(strip_accents(lower(coalesce(title, '') || ' ' || coalesce(description, ''))), '[\\s\\x{00a0}]+', ' ', 'g'))"
_HAS = lambda w: f"CAST(regexp_matches(full_text, '(^|[^a-zA-Z]){w}($|[^a-zA-Z])') AS INTEGER)"
_POINTS = lambda n, weight, cap: f"CASE WHEN {n} = 0 THEN 0 ELSE least({cap}, CAST(floor(ln({n} + 1) * {weight} * 3.5 + 0.5) AS INTEGER)) END"
AXES = f"""{NOTICES}, plain AS (SELECT *, {_PLAIN} AS full_text FROM notices
), hits AS (SELECT *, {_HAS('the')} + {_HAS('and')} AS mobility, {_HAS('der')} AS energy, {_HAS('of')} AS strategy, {_HAS('la')} AS reason, {_HAS('in')} AS stance, contains(full_text, 'idiot') AS flag FROM plain
), axes AS (SELECT *, least(50, {_POINTS('mobility', 4, 15)} + {_POINTS('energy', 2, 15)}) AS sector, least(40, {_POINTS('strategy', 3, 10)} + {_POINTS('reason', 3, 10)}) AS expertise, least(15, {_POINTS('stance', 2, 15)}) AS posture,
  CAST(mobility > 0 AS INTEGER) + CAST(energy > 0 AS INTEGER) AS sectors, CAST(strategy > 0 AS INTEGER) + CAST(reason > 0 AS INTEGER) AS expertises FROM hits
), bonus AS (SELECT *, 15 * CAST(contains(full_text || ' ' || lower(acheteur), 'src1') AS INTEGER) + 10 * CAST(reason > 0 AS INTEGER) + 8 * CAST(regexp_matches(full_text, 'co(m(ex|dir))') AS INTEGER) + 5 * CAST(expertises >= 2 AS INTEGER)
  + 8 * CAST(contains(full_text, 'strategi') OR contains(full_text, 'innov') AS INTEGER) - 30 * CAST(contains(full_text, 'scum') AS INTEGER) - 30 * CAST(flag AS INTEGER) - 15 * CAST(sectors = 0 AS INTEGER) AS plus FROM axes)"""


@query(f"""WITH {AXES} SELECT doc_id, sector AS sector_score, expertise AS expertise_score, posture AS posture_score, CAST(flag AS INTEGER) AS n_flags, greatest(0, least(100, sector + expertise + posture + plus)) AS keyword_score,
CASE WHEN sectors > 0 AND expertises > 0 AND sector + expertise >= 40 OR sector >= 30 OR expertise >= 30 THEN 'HIGH' WHEN sectors > 0 AND sector >= 15 OR expertises > 0 AND expertise >= 15 OR sector + expertise >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
mobility + energy + strategy + reason + stance AS n_terms FROM bonus""")
def lexicon_scores(spark, sf):
    """The whole scoring, with keywords that do not overlap."""
    out = lexicon.score(notices(spark, sf), lexicon.Lexicon.of([(a, c, w, "keyword", t) for a, c, w, t in LEXICON]), ["scum"])
    return out.select("doc_id", "sector_score", "expertise_score", "posture_score", F.size("red_flags").alias("n_flags"), "keyword_score", "confidence", F.size("matched_terms").alias("n_terms"))


@query(f"""WITH {NOTICES}, plain AS (SELECT doc_id, {_PLAIN} AS full_text FROM notices
), cut AS (SELECT doc_id, term, string_split(full_text, term) AS pieces FROM plain, (VALUES ('and the'), ('the'), ('in')) t(term)
), piece AS (SELECT doc_id, term, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k, len(pieces) AS n FROM cut
), place AS (SELECT *, sum(length(piece)) OVER w + k * length(term) AS start, CASE WHEN piece <> '' THEN right(piece, 1) WHEN k > 0 THEN right(term, 1) ELSE '' END AS before,
  CASE WHEN lead(piece) OVER w <> '' THEN left(lead(piece) OVER w, 1) WHEN k < n - 2 THEN left(term, 1) ELSE '' END AS behind FROM piece WINDOW w AS (PARTITION BY doc_id, term ORDER BY k)
), whole AS (SELECT doc_id, term, start FROM place WHERE k < n - 1 AND NOT regexp_matches(before || behind, '[a-zA-Z]')
), longest AS (SELECT doc_id, min(start) AS a FROM whole WHERE term = 'and the' GROUP BY doc_id
), spot AS (SELECT doc_id, min(start) AS b FROM whole LEFT JOIN longest USING (doc_id) WHERE term = 'the' AND NOT coalesce(start >= a AND start + 3 <= a + 7, false) GROUP BY doc_id
), short AS (SELECT DISTINCT doc_id FROM whole WHERE term = 'in'
), part AS (SELECT doc_id, strpos(full_text, 'nd t') - 1 AS p FROM plain WHERE contains(full_text, 'nd t'))
SELECT doc_id, array_to_string(list_filter([CASE WHEN a IS NOT NULL THEN 'and the' END, CASE WHEN short.doc_id IS NOT NULL THEN 'in' END, CASE WHEN p IS NOT NULL AND NOT coalesce(p >= a AND p + 4 <= a + 7, false) THEN 'nd t' END, CASE WHEN b IS NOT NULL THEN 'the' END], lambda x: x IS NOT NULL), ',') AS terms
FROM plain LEFT JOIN longest USING (doc_id) LEFT JOIN spot USING (doc_id) LEFT JOIN short ON short.doc_id = plain.doc_id LEFT JOIN part ON part.doc_id = plain.doc_id""")
def covered_terms(spark, sf):
    """Terms within terms: a shorter one counts only outside the longer one's place, a pattern only outside both."""
    lex = lexicon.Lexicon.of([("sector", "water", 3, "keyword", "the"), ("sector", "water", 3, "keyword", "and the"), ("sector", "water", 3, "pattern", "nd t"), ("sector", "air", 3, "keyword", "in")])
    terms = F.flatten(F.transform("sector_matches", lambda m: m["terms"]))
    return lexicon.score(notices(spark, sf), lex).select("doc_id", F.array_join(F.array_sort(terms), ",").alias("terms"))


@query("""WITH r AS (SELECT p_type AS axis, p_brand AS category, CAST(p_size % 5 + 1 AS INTEGER) AS weight, p_name AS term, lower(p_name) AS body FROM part)
SELECT axis, category, weight, array_to_string(list_sort(list(DISTINCT term)), ',') AS terms FROM r WHERE regexp_matches(body, '(^|[^a-z0-9_])red($|[^a-z0-9_])') OR contains('red', body) GROUP BY ALL""")
def term_categories(spark, sf):
    """The categories that know a term, as a whole word either way: parts by type and brand."""
    rules = table(spark, sf, "part").select(F.col("p_type").alias("axis"), F.col("p_brand").alias("category"), (F.col("p_size") % 5 + 1).cast("int").alias("weight"), F.lit("keyword").alias("kind"), F.col("p_name").alias("term"))
    return lexicon.category_of_term(rules, " Réd").select("axis", "category", "weight", F.array_join("terms", ",").alias("terms"))


KNOWN = """c AS (SELECT lower(n_name) AS spelling, trim(regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name, n_nationkey AS ord, string_split(trim(regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS tokens FROM nation),
b AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN s_name || ' ' || n_name ELSE 'United ' || n_name || ' Kingdom' END AS buyer FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT buyer, trim(regexp_replace(regexp_replace(lower(buyer), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM b),
o AS (SELECT buyer, plain, spelling, name, ord, len(list_distinct(list_filter(string_split(plain, ' '), lambda t: length(t) > 2))) AS own, len(list_distinct(list_filter(tokens, lambda t: length(t) > 2))) AS other,
  len(list_intersect(list_filter(string_split(plain, ' '), lambda t: length(t) > 2), list_filter(tokens, lambda t: length(t) > 2))) AS common FROM p CROSS JOIN c),
s AS (SELECT *, CASE WHEN own = 0 OR other = 0 THEN 0.0 ELSE common * 1.0 / greatest(own, other) END AS share FROM o),
h AS (SELECT *, CASE WHEN plain = name THEN 1.0 WHEN contains(plain, name) AND length(name) > 4 THEN 0.95 WHEN share >= 0.6 THEN 0.7 + share * 0.2 END AS score, CASE WHEN plain = name THEN 'exact' WHEN contains(plain, name) AND length(name) > 4 AND 0.7 + share * 0.2 <= 0.95 THEN 'substring' ELSE 'fuzzy' END AS kind FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY buyer ORDER BY score DESC, ord) AS n FROM h WHERE score IS NOT NULL)"""


@query(f"WITH {KNOWN} SELECT p.buyer, r.spelling AS nom_normalise, r.kind AS match_type, CAST(round(r.score, 2) AS DOUBLE) AS match_score, CASE WHEN r.score > 0.9 THEN 'HIGH' WHEN r.score > 0.75 THEN 'MEDIUM' WHEN r.score IS NOT NULL THEN 'LOW' END AS match_confidence FROM p LEFT JOIN r ON r.buyer = p.buyer AND r.n = 1")
def known_buyers(spark, sf):
    """All three ways of finding a known name, and the buyers without any."""
    nation, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    clients = nation.select(F.col("n_nationkey").alias("ord"), F.lower("n_name").alias("nom_normalise"), F.array().cast("array<string>").alias("aliases"), F.lit("historical").alias("statut"))
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.concat_ws(" ", "s_name", "n_name")).otherwise(F.concat(F.lit("United "), "n_name", F.lit(" Kingdom")))
    buyers = s.join(nation, s["s_nationkey"] == nation["n_nationkey"]).select(name.alias("buyer")).distinct()
    return retrieval.known_buyer(buyers, clients).select("buyer", "nom_normalise", "match_type", "match_score", "match_confidence")


@query("""SELECT p_partkey AS k, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain,
round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / greatest(len(a), len(b)) END, 6) AS share FROM (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: length(t) > 2)) AS a,
list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: length(t) > 2)) AS b FROM part)""")
def token_overlap(spark, sf):
    """Normalised names, and the share of long tokens that two texts have in common."""
    share = text.overlap(text.long_tokens(F.col("p_name")), text.long_tokens(F.col("p_type")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.normalize_words(F.col("p_name")).alias("plain"), F.round(share, 6).alias("share"))


@query("""WITH c AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'PASS' ELSE 'REJECT' END AS wanted, toxic = 1 AS gap FROM labels), r AS (SELECT doc_id AS id, CASE WHEN n_chars >= 1000 THEN 'PASS' ELSE 'REJECT' END AS got, source AS category FROM documents WHERE source IN ('src0', 'src1'))
SELECT id, wanted = got AS decision_correct, gap AS has_gap FROM c JOIN r USING (id)""")
def judged_cases(spark, sf):
    """Cases of some categories beside their labels."""
    cases = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "PASS").otherwise("REJECT").alias("decision_expected"), F.when(F.col("toxic") == 1, "g").alias("gap"))
    got = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") >= 1000, "PASS").otherwise("REJECT").alias("actual_decision"), F.col("source").alias("category"))
    return evaluation.join_expected(cases, evaluation.select_cases(got, categories=["src0", "src1"])).select("id", "decision_correct", "has_gap")


@query("""WITH r AS (SELECT o_orderkey AS source_id, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'REJECT' END AS gate, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT source_id, gate AS decision_gate FROM r WHERE n <= 20""")
def newest_halves(spark, sf):
    """The newest twenty of each class: the sampling operator."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("REJECT").alias("decision_gate"), F.col("o_orderdate").alias("analyzed_at"))
    return evaluation.stratified(o, 40).select("source_id", "decision_gate")


@query("SELECT s_suppkey AS source_id, CASE WHEN s_acctbal < 0 THEN 'AVIS_ANNULE' ELSE 'OPEN' END AS etat, CASE WHEN s_acctbal < 0 THEN 'cancelled' ELSE 'analyzed' END AS status FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT 1000000 + n_nationkey, NULL, 'new' FROM nation")
def merged_suppliers(spark, sf):
    """Rows are cancelled by key, others deleted, and new ones appended once."""
    s = table(spark, sf, "supplier")
    base = s.select(F.col("s_suppkey").alias("source_id"), F.lit("OPEN").alias("etat"), F.lit("analyzed").alias("status"))
    out = merge.cancel(base, s.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("source_id")))
    out = merge.delete(out, base.filter("source_id % 10 = 0"), "source_id")
    new = table(spark, sf, "nation").select((F.col("n_nationkey") + 1_000_000).cast(base.schema["source_id"].dataType).alias("source_id"), F.lit("new").alias("status"))
    return merge.insert_new(merge.insert_new(out, new, ["source_id"]), new, ["source_id"])


@query("SELECT o_orderkey AS source_id, CAST(o_orderkey % 4 + CAST(o_orderkey % 3 = 0 AS INTEGER) AS INTEGER) AS rectification_count, o_orderkey % 3 = 0 OR o_orderkey % 4 > 0 AS is_rectified, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS entries FROM orders")
def amended_history(spark, sf):
    """Substantial amendments are noted in the rows that they amend."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    stored = o.select(k.alias("source_id"), F.array().cast("array<struct<at string, changes array<string>>>").alias("history"), (k % 4).cast("int").alias("rectification_count"), (k % 4 > 0).alias("is_rectified"))
    out = changes.with_history(stored, o.filter("o_orderkey % 3 = 0").select(k.alias("source_id"), F.array(F.lit("deadline")).alias("changes")), "2024-01-01")
    return out.select("source_id", "rectification_count", "is_rectified", F.size("history").alias("entries"))


@query("""SELECT r.o_orderkey AS source_id, CASE WHEN o.o_orderkey IS NOT NULL THEN CAST(o.o_totalprice AS DOUBLE) ELSE 0.0 END AS final_score, coalesce(o.o_orderpriority, 'LOW') AS priority FROM orders r LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ON o.o_orderkey = r.o_orderkey + 1 WHERE r.o_orderkey % 5 = 0""")
def minor_scores(spark, sf):
    """Minor amendments take over what their originals had."""
    o = table(spark, sf, "orders")
    stored = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("final_score"), F.col("o_orderpriority").alias("priority"))
    return routing.keep_minor(o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") + 1).alias("original_id")), stored).select("source_id", "final_score", "priority")


@query("""WITH r AS (SELECT doc_id, keyword_score % 51 / 5.0 AS a, keyword_score % 41 / 4.0 AS b, keyword_score % 16 / 1.5 AS c FROM (""" + f"WITH {NOTICES} SELECT * FROM notices" + """)), t AS (SELECT *, a * 0.35 + b * 0.35 + c * 0.20 AS total FROM r)
SELECT doc_id, round(total, 6) AS score, CASE WHEN total >= 2 THEN 'PASS' ELSE 'REJECT' END AS gate, CASE WHEN total < 2 THEN 'NON_PERTINENT' WHEN total < 4 THEN 'BASSE_PRIORITE' WHEN total < 6 THEN 'MOYENNE_PRIORITE' ELSE 'HAUTE_PRIORITE' END AS wish, CAST(0 AS INTEGER) AS n_faults FROM t""")
def analysed(spark, sf):
    """The deterministic analyst behind the plug-in interface; what it returns is valid."""
    n = F.col("keyword_score")
    rows = notices(spark, sf).select("doc_id", (n % 51).alias("sector_score"), (n % 41).alias("expertise_score"), (n % 16).alias("posture_score"))
    s = F.col("semantic")
    return routing.analyse(rows).select("doc_id", F.round(s["score_semantique_global"], 6).alias("score"), s["decision_gate"].alias("gate"), s["recommandation"].alias("wish"), F.size(analysis.faults(s)).alias("n_faults"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN NULL WHEN 2 THEN 'B' ELSE NULL END AS type FROM events""")
def reasons_validated(spark, sf):
    """Classified reasons: range, enumeration and the named term decide; what is no JSON is none."""
    i = F.col("event_id")
    answer = F.when(i % 4 == 0, '{"type": "A", "confidence": 0.5, "explanation": "x"}').when(i % 4 == 1, '{"type": "B", "confidence": 0.5, "explanation": "x"}').when(i % 4 == 2, '{"type": "B", "term": "t", "confidence": 1, "explanation": "x"}').otherwise("no json")
    return table(spark, sf, "events").select(i.alias("id"), analysis.valid_reason(answer)["type"].alias("type"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.3 * 1 END AS parsed_score, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 7 END AS INTEGER) AS n_faults, round(n_chars % 101 / 100.0 * 0.5, 6) AS stand_in FROM documents""")
def answers_parsed(spark, sf):
    """Answers with JSON inside other text, their faults, and the score that stands in when there is none."""
    i = F.col("doc_id")
    good = 'Voici : {"decision_gate": "PASS", "recommandation": "NON_PERTINENT", "score_semantique_global": 0.3, "score_secteur": 1, "score_expertise": 2, "score_posture": 3, "confidence": "LOW"} merci'
    p = analysis.parsed(F.when(i % 3 == 0, good).otherwise("rien"))
    return table(spark, sf, "documents").select("doc_id", p["score_semantique_global"].alias("parsed_score"), F.size(analysis.faults(p)).alias("n_faults"), F.round(analysis.fallback((F.col("n_chars") % 101).cast("int"))["score_semantique_global"], 6).alias("stand_in"))


@query("""SELECT doc_id, 'Titre : ' || split_part(text, chr(10), 1) || chr(10) || 'Organisme : ' || source || chr(10) || 'Description : Non disponible' || chr(10) || 'Mots-clés : ' || lang || chr(10) || 'Score : ' || n_chars % 101 || '/100, confiance LOW' || chr(10) || 'Secteurs : ' || CASE WHEN n_chars % 2 = 0 THEN 'energy, mobility' ELSE 'aucun' END || chr(10) || 'Expertises : aucune' || chr(10) || 'Exclusions : aucun' AS prompt FROM documents""")
def prompts(spark, sf):
    """The question for an analyst."""
    named = lambda *names: F.array(*(F.struct(F.lit(n).alias("category")) for n in names))
    none = F.array().cast("array<struct<category string>>")
    rows = notices(spark, sf).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", "title", "acheteur", F.lit("").alias("description"), F.array("lang").alias("keywords"), "keyword_score", F.lit("LOW").alias("confidence"), F.when(F.col("n_chars") % 2 == 0, named("energy", "mobility")).otherwise(none).alias("sector_matches"), none.alias("expertise_matches"), F.array().cast("array<string>").alias("red_flags")
    )
    return rows.select("doc_id", analysis.prompt(rows).alias("prompt"))


@query("WITH " + PRICED + """, r AS (SELECT *, row_number() OVER (ORDER BY keyword_score DESC, doc_id) AS position FROM priced) SELECT doc_id, position FROM r""")
def ranked_keywords(spark, sf):
    """All tenders by keyword score, then by id; positions come from a sort by ranges."""
    return report.ranked(priced(spark, sf), "keyword_score", "doc_id").select("doc_id", "position")


@query("WITH " + PRICED + f" SELECT doc_id, round(final_score, 6) AS final_score FROM priced WHERE priority = 'HIGH' AND (deadline IS NULL OR deadline >= '2024-03-01') ORDER BY final_score DESC, doc_id LIMIT 10")
def high_and_open(spark, sf):
    """The ten best that are still open."""
    return report.high_open(priced(spark, sf), "2024-03-01", "doc_id").select("doc_id", F.round("final_score", 6).alias("final_score"))


@query("WITH " + PRICED + """, l AS (SELECT *, CASE WHEN skip THEN 2 ELSE 1 END AS tier FROM (SELECT *, keyword_score < 40 AS skip FROM priced) WHERE priority = 'LOW'), r AS (SELECT *, row_number() OVER (ORDER BY tier, keyword_score DESC, doc_id) AS position FROM l)
SELECT CAST(position AS INTEGER) AS position, '<tr><td>' || position || '</td><td>LOW</td><td>' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') || '</td><td>' || acheteur || '</td><td>' || coalesce(deadline, 'Non précisée') || '</td><td>' || 'motif ' || lang || '</td></tr>' AS html FROM r WHERE position <= 100""")
def mail_table(spark, sf):
    """The rows of a mail: the low tier, capped, projected and written as HTML."""
    low = priced(spark, sf).filter("priority = 'LOW'")
    shown = report.capped(low, report.low_tier(F.col("keyword_score") < 40, F.lit(None).cast("string")), [F.desc("keyword_score"), F.asc("doc_id")])
    none = F.lit(None).cast("string")
    rows = shown.withColumns({"human_readable_reason": none, "semantic_reason": F.concat(F.lit("motif "), "lang"), "rejet_raison": none, "url_ao": none})
    return report.render_html(report.mail_rows(rows))


@query("""SELECT conv_id || '-' || turn AS id, 'p' || n AS part, CASE WHEN turn % 3 = 0 THEN text || ' (' || n || ')' ELSE text END AS content FROM (SELECT *, unnest(CASE WHEN turn % 3 = 0 THEN [1, 2] ELSE [0] END) AS n FROM conversations)""")
def chunks_rewritten(spark, sf):
    """Some chunks are split in two, the others pass."""
    chunk = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("p0").alias("part"), F.col("text").alias("content"), "turn")
    two = F.array(*(F.struct("id", F.lit(f"p{n}").alias("part"), F.concat("content", F.lit(f" ({n})")).alias("content")) for n in (1, 2)))
    return rewrite(chunk.drop("turn"), chunk.filter("turn % 3 = 0").select("id", two.alias("parts")))


@query("""SELECT p_partkey AS k, CAST(CAST(p_size % 2 = 0 AS INTEGER) + CAST(p_size % 3 = 0 AS INTEGER) AS INTEGER) AS n, CASE WHEN p_size % 2 = 0 THEN 'cap_eco' ELSE '' END || CASE WHEN p_size % 6 = 0 THEN ',' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'region' ELSE '' END AS fields FROM part""")
def criteria_changes(spark, sf):
    """Criteria are compared as JSON texts; a region that changes."""
    size = F.col("p_size")
    none = F.lit(None)
    side = lambda eco, region: F.struct(none.cast("double").alias("budget_max"), none.cast("string").alias("deadline"), F.get_json_object(eco, "$.CAP_ECO").alias("cap_eco"), none.cast("string").alias("cap_tech"), none.cast("string").alias("type_marche"), region.alias("region"), none.cast("string").alias("title"))
    found = changes.changes(side(F.lit('{"CAP_ECO": {"a": 1, "b": 2}}'), F.lit("Bretagne")), side(F.when(size % 2 == 0, '{"CAP_ECO": {"b": 2, "a": 1}}').otherwise('{"CAP_ECO": {"a": 1, "b": 2}}'), F.when(size % 3 == 0, "Corse").otherwise("Bretagne")))
    return table(spark, sf, "part").withColumn("found", found).select(F.col("p_partkey").alias("k"), F.size("found").alias("n"), F.array_join(F.transform("found", lambda c: c["field"]), ",").alias("fields"))


@query("""SELECT o_orderkey AS k, CASE WHEN k3 = 0 THEN NULL WHEN a >= 30 OR b >= 30 OR a + b >= 40 THEN 'HIGH' WHEN a >= 15 OR b >= 15 OR a + b >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, round(a / 5.0 * 0.35 + b / 4.0 * 0.35 + 2.0 * 0.20, 6) AS semantic, round((a + b) / 100.0 * 0.5, 6) AS stand_in
FROM (SELECT o_orderkey, 1 AS k3, 1 + o_orderkey % 50 AS a, 1 + o_orderkey % 37 AS b FROM orders)""")
def confidences(spark, sf):
    """Confidence of two axes that both have hits; the weighted score; the score that stands in."""
    a, b = 1 + F.col("o_orderkey") % 50, 1 + F.col("o_orderkey") % 37
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), scores.confidence(a, b, F.lit(True), F.lit(True)).alias("confidence"), F.round(scores.semantic_score(a / 5.0, b / 4.0, F.lit(2.0)), 6).alias("semantic"), F.round(scores.fallback_score(a + b), 6).alias("stand_in"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_orderkey WHEN 1 THEN 'b' || o_orderkey WHEN 2 THEN 'c' || o_orderkey END AS record_id FROM orders")
def record_keys(spark, sf):
    """The identifier of a raw record, under the first of three keys that it has."""
    k = F.col("o_orderkey")
    say = lambda head: F.concat(F.lit(head), k.cast("string"), F.lit('"}'))
    raw = _cases(k % 4, {0: say('{"id": "x", "boamp_id": "y", "idweb": "a'), 1: say('{"id": "x", "boamp_id": "b'), 2: say('{"id": "c'), None: F.lit("{}")})
    return table(spark, sf, "orders").select(k.alias("k"), extract.record_id(raw).alias("record_id"))


@query("WITH " + NOTICES + """, g AS (SELECT *, keyword_score < 20 OR (flagged AND greatest(0, keyword_score - 30) < 15) OR (keyword_score < 30 AND confidence = 'LOW') OR (keyword_score >= 30 AND keyword_score < 40 AND confidence = 'LOW') AS skip FROM notices)
SELECT doc_id, skip, CASE WHEN skip THEN round(keyword_score / 100.0 * 0.5, 6) END AS stand_in, CASE WHEN skip THEN 'Hors périmètre — score mots-clés insuffisant.' END AS reason FROM g""")
def second_gates(spark, sf):
    """The gate once more, right before an analyst would be asked."""
    rows = notices(spark, sf).withColumn("red_flags", F.when(F.col("flagged"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return analysis.second_gate(rows).select("doc_id", "skip", F.round(F.col("semantic.score_semantique_global"), 6).alias("stand_in"), F.col("semantic_reason").alias("reason"))


@query("SELECT CAST(len(embedding) AS INTEGER) AS size, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY 1")
def vector_sizes(spark, sf):
    return merge.array_sizes(table(spark, sf, "embeddings"), "embedding")


@query("SELECT o_orderkey AS source_id, o_orderkey - 1 AS original_id FROM orders WHERE o_orderkey % 2 = 0")
def amendments_by_date(spark, sf):
    """The view of amendments, newest first."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("source_id"), F.when(k % 2 == 0, k - 1).alias("annonce_lie"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("final_score"), F.col("o_orderdate").alias("analyzed_at"))
    return changes.amendment_view(rows, newest="analyzed_at").select("source_id", F.col("annonce_lie").alias("original_id"))


@query("WITH " + PRICED + """, c AS (SELECT source, count(*) FILTER (WHERE priority IN ('HIGH', 'MEDIUM')) AS wanted, count(*) FILTER (WHERE priority = 'LOW') AS low FROM priced GROUP BY 1), t AS (SELECT sum(wanted + low) AS total, sum(wanted) AS wanted, sum(low) AS low FROM c),
l AS (SELECT '' AS section, list_filter([total || CASE WHEN total > 1 THEN ' appels d''offres analysés' ELSE ' appel d''offres analysé' END, CASE WHEN wanted > 0 THEN wanted || CASE WHEN wanted > 1 THEN ' appels pertinents' ELSE ' appel pertinent' END || ' (HIGH/MEDIUM)' ELSE 'Aucun appel d''offres pertinent identifié' END,
  CASE WHEN low > 0 THEN low || CASE WHEN low > 1 THEN ' appels' ELSE ' appel' END || ' d''offres à faible priorité (LOW)' END], lambda x: x IS NOT NULL) AS lines FROM t
UNION ALL SELECT source, list_filter([(wanted + low) || CASE WHEN wanted + low > 1 THEN ' appels d''offres analysés' ELSE ' appel d''offres analysé' END, CASE WHEN wanted > 0 THEN wanted || CASE WHEN wanted > 1 THEN ' pertinents' ELSE ' pertinent' END END], lambda x: x IS NOT NULL) FROM c)
SELECT section, CAST(unnest(range(len(lines))) AS INTEGER) AS k, unnest(lines) AS line FROM l""")
def mail_summary(spark, sf):
    """The head of a mail and a section for each source."""
    return report.text_summary(report.by_source(priced(spark, sf)))


@query("""WITH RECURSIVE mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS until FROM events WHERE event_type IN ('error', 'purchase')
), e AS (SELECT user_id, ts, event_type = 'error' AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events, mark WHERE event_type IN ('error', 'purchase') AND ts <= until
), walk(user_id, k, due, fired, moment, word) AS (
  SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR) FROM e GROUP BY user_id
  UNION ALL SELECT w.user_id, e.k,
    CASE WHEN e.gap THEN CASE WHEN w.due > e.ts THEN w.due ELSE e.ts + INTERVAL 1 HOUR END END,
    CASE WHEN w.due <= e.ts THEN w.due END, e.ts,
    CASE WHEN e.gap AND (w.due IS NULL OR w.due <= e.ts) THEN 'gap' WHEN NOT e.gap AND w.due > e.ts THEN 'filled' END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1
), ends AS (SELECT w.user_id, w.due FROM walk w JOIN (SELECT user_id, max(k) AS k FROM walk GROUP BY user_id) m ON m.user_id = w.user_id AND m.k = w.k WHERE w.due IS NOT NULL)
SELECT CAST(user_id AS VARCHAR) AS id, moment AS "at", word AS event, CASE word WHEN 'gap' THEN 'pending' ELSE 'idle' END AS status FROM walk WHERE word IS NOT NULL
UNION ALL SELECT CAST(user_id AS VARCHAR), fired, 'retry', 'idle' FROM walk WHERE fired IS NOT NULL
UNION ALL SELECT CAST(user_id AS VARCHAR), due, 'retry', 'idle' FROM ends, mark WHERE due <= until""")
def retries_by_timer(spark, sf):
    """A gap is read again an hour later, unless it has been filled: timers over a stream that is stopped in the middle and goes on from its checkpoint."""
    events = table(spark, sf, "events").filter("event_type IN ('error', 'purchase')")
    events = events.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "gap").otherwise("filled").alias("event"))
    place = f"{shared_folder(spark)}/timers-{uuid.uuid4().hex}"
    middle = events.agg((F.min("at").cast("double") + F.max("at").cast("double")) / 2).first()[0]
    for half in (F.col("at").cast("double") <= middle, F.col("at").cast("double") > middle):
        events.filter(half).write.mode("append").parquet(f"{place}/in")
        with timers.rocksdb(spark):
            found = timers.transitions(ingest.read(spark, f"{place}/in", events.schema, 10_000), timers.RETRY)
            found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{place}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND NOT (user_id % 10 = 3)""")
def merged_by_bucket(spark, sf):
    """The last event of each user, merged batch by batch into a table of buckets; some users are deleted at last, and a batch is replayed."""
    events = table(spark, sf, "events").withColumn("turn", F.struct("ts", "event_id"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    slice_ = F.least(F.lit(2), F.floor(3 * (at - low) / (high - low + 1)))  # later events come in later batches, as they do from a source
    kept = BucketTable(spark, f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}", "user_id", 32)
    for number in (0, 1, 2, 2, 1):  # the last two are replays: their commits are there
        kept.merge(events.filter(slice_ == number), number, "turn")
    kept.merge(events.limit(0), 3, deleted=events.select("user_id").filter("user_id % 10 = 3").distinct())
    return kept.read().select("user_id", "event_id", "event_type", "value")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations
), walk(conv_id, k, chunk, size) AS (SELECT conv_id, k, 0, length(text) FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.k, CASE WHEN size + 1 + length(text) > 400 THEN chunk + 1 ELSE chunk END, CASE WHEN size + 1 + length(text) > 400 THEN length(text) ELSE size + 1 + length(text) END FROM walk JOIN t ON t.conv_id = walk.conv_id AND t.k = walk.k + 1)
SELECT CAST(conv_id AS VARCHAR) AS key, chunk, CAST(count(*) AS INTEGER) AS n_rows, CAST(min(turn) AS BIGINT) AS first_ord, CAST(max(turn) AS BIGINT) AS last_ord, md5(string_agg(text, chr(10) ORDER BY k)) AS content
FROM walk JOIN t USING (conv_id, k) GROUP BY conv_id, chunk""")
def packed_turns(spark, sf):
    """Turns of a conversation as chunks, by a table function in SQL."""
    tables.register(spark)
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("long").alias("ord"), "role", "text")
    packed = spark.sql("SELECT * FROM pack_rows(TABLE(SELECT * FROM {rows}) PARTITION BY key ORDER BY (ord, role, text), 400)", rows=rows)
    return packed.select("key", "chunk", "n_rows", "first_ord", "last_ord", F.md5(F.col("content").cast("binary")).alias("content"))


@query("WITH " + PRICED + """, c AS (SELECT source, count(*) FILTER (WHERE priority IN ('HIGH', 'MEDIUM')) AS wanted, count(*) FILTER (WHERE priority = 'LOW') AS low FROM priced GROUP BY 1
), t AS (SELECT sum(wanted + low) AS total, sum(wanted) AS wanted, sum(low) AS low FROM c
), r AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, doc_id) AS position FROM priced WHERE priority IN ('HIGH', 'MEDIUM') QUALIFY position <= 100
), l AS (SELECT *, row_number() OVER (ORDER BY keyword_score DESC, doc_id) AS position FROM priced WHERE priority = 'LOW' QUALIFY position <= 100
), f AS (SELECT greatest(0, sum(low) - 100) AS n FROM c
), s AS (
  SELECT 0 AS section, '' AS place, ['Veille Appels d''Offres - ' || '01/02/2024 au 01/03/2024'] AS lines
  UNION ALL SELECT 1, '', list_filter(['Récapitulatif', total || CASE WHEN total > 1 THEN ' appels d''offres analysés' ELSE ' appel d''offres analysé' END, CASE WHEN wanted > 0 THEN wanted || CASE WHEN wanted > 1 THEN ' appels pertinents' ELSE ' appel pertinent' END || ' (HIGH/MEDIUM)' ELSE 'Aucun appel d''offres pertinent identifié' END,
    CASE WHEN low > 0 THEN low || CASE WHEN low > 1 THEN ' appels' ELSE ' appel' END || ' d''offres à faible priorité (LOW)' END], lambda x: x IS NOT NULL) FROM t
  UNION ALL SELECT 2, source, list_filter([source, (wanted + low) || CASE WHEN wanted + low > 1 THEN ' appels d''offres analysés' ELSE ' appel d''offres analysé' END, CASE WHEN wanted > 0 THEN wanted || CASE WHEN wanted > 1 THEN ' pertinents' ELSE ' pertinent' END END], lambda x: x IS NOT NULL) FROM c
  UNION ALL SELECT 3, '', ['Appels d''Offres Pertinents'] FROM t WHERE wanted > 0
  UNION ALL SELECT 3, lpad(CAST(position AS VARCHAR), 6, '0'), list_filter([position || '. [' || priority || '] ' || title, CASE WHEN acheteur <> '' THEN '   Acheteur: ' || acheteur END, CASE WHEN deadline <> '' THEN '   Date limite: ' || strftime(CAST(deadline AS DATE), '%d/%m/%Y') END, '   Justification: motif ' || lang, '   Lien: https://a/' || doc_id], lambda x: x IS NOT NULL) FROM r
  UNION ALL SELECT 4, '', list_filter(['Appels d''Offres à Faible Priorité', CASE WHEN low > 0 THEN CASE WHEN wanted > 0 THEN 'Les appels d''offres suivants ont été analysés mais jugés moins pertinents que ceux listés ci-dessus.' ELSE 'Pourquoi aucun AO n''est pertinent ?' END END], lambda x: x IS NOT NULL) FROM t, f WHERE low > 0 OR f.n > 0
  UNION ALL SELECT 4, lpad(CAST(position AS VARCHAR), 6, '0'), ['' || position || '. [FAIBLE PRIORITÉ] ' || title || ' (' || source || ')', '   Raison: motif ' || lang, '   Lien: https://a/' || doc_id] FROM l
  UNION ALL SELECT 4, 'z', ['+ ' || n || ' AO(s) exclus par filtre mots-clés (hors périmètre métier — non analysés par l''IA)'] FROM f WHERE n > 0
  UNION ALL SELECT 5, '', ['---', 'Ce message a été généré automatiquement.'])
SELECT CAST(section AS INTEGER) AS section, place, CAST(unnest(range(len(lines))) AS INTEGER) AS k, unnest(lines) AS line FROM s""")
def mail_body(spark, sf):
    """A whole report mail as lines of its sections."""
    return mail.text_mail(*_mail(spark, sf))


def _mail(spark: SparkSession, sf: str) -> tuple:
    """Counts, relevant rows, low rows and how many low ones a mail of the last weeks leaves out."""
    rows = priced(spark, sf).withColumns({"reason": F.concat(F.lit("motif "), "lang"), "url": F.concat(F.lit("https://a/"), "doc_id"), "deadline": temporal.french_date(F.col("deadline").cast("date"))})
    wanted, low = rows.filter("priority IN ('HIGH', 'MEDIUM')"), rows.filter("priority = 'LOW'")
    first = lambda df, score: report.capped(df, F.lit(1), [F.desc(score), F.asc("doc_id")])
    return report.by_source(rows), first(wanted, "final_score"), first(low, "keyword_score"), max(0, low.count() - report.ROWS), "2024-02-01", "2024-03-01"


@query("WITH " + PRICED + """, r AS (SELECT *, row_number() OVER (ORDER BY keyword_score DESC, doc_id) AS position FROM priced QUALIFY position <= 100)
SELECT source, coalesce(string_agg(CASE WHEN priority = 'HIGH' THEN position || ':' || title END, '|' ORDER BY position), '') AS high, coalesce(string_agg(CASE WHEN priority = 'MEDIUM' THEN position || ':' || title END, '|' ORDER BY position), '') AS medium,
coalesce(string_agg(CASE WHEN priority = 'LOW' THEN position || ':' || title END, '|' ORDER BY position), '') AS low FROM r GROUP BY source""")
def rows_by_source(spark, sf):
    """The tenders of a report as lists, by source and priority."""
    shown = report.capped(priced(spark, sf), F.lit(1), [F.desc("keyword_score"), F.asc("doc_id")])
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["position"].cast("string"), F.lit(":"), x["title"])), "|").alias(c)
    return mail.lists_by_source(shown).select("source", said("high"), said("medium"), said("low"))


@query("""WITH r AS (SELECT p_type AS axis, p_brand AS category, CAST(p_size % 5 + 1 AS INTEGER) AS weight, lower(p_name) AS body FROM part
), term(word) AS (VALUES ('red'), ('gear'), ('nothing')
), f AS (SELECT DISTINCT word, axis, category, weight FROM r, term WHERE regexp_matches(body, '(^|[^a-z0-9_])' || word || '($|[^a-z0-9_])') OR contains(word, body)
), n AS (SELECT *, CASE WHEN category LIKE '%7' THEN category ELSE 'Marque ' || substr(category, 7) END AS label, CASE WHEN category LIKE '%7' THEN '' ELSE 'De ' || category || '.' END AS description FROM f
), g AS (SELECT word, string_agg(label || ' (weight: ' || weight || ')', ', ' ORDER BY axis, category, label, description, weight) FILTER (WHERE axis <> 'ECONOMY') AS listed, string_agg('"' || word || '" → ' || label || ' (weight: ' || weight || '). ' || description, chr(10) ORDER BY axis, category, label, description, weight) FILTER (WHERE axis <> 'ECONOMY') AS said,
  arg_min(description, (category, label, description, weight)) FILTER (WHERE axis = 'ECONOMY') AS flagged FROM n GROUP BY word)
SELECT word AS term, g.word IS NOT NULL AS found, '"' || term.word || '"' || CASE WHEN g.word IS NULL THEN ' n''est pas dans le lexique. Il a peut-être été trouvé par un motif, ou c''est un faux positif à examiner.' WHEN listed IS NULL THEN ' est un red flag : ' || flagged || ' Il signale que l''AO est probablement hors périmètre.'
  WHEN flagged IS NOT NULL THEN ' est classé dans ' || listed || '. Cependant, il est aussi signalé comme red flag potentiel dans certains contextes : ' || flagged ELSE substr(said, length(term.word) + 3) END AS summary FROM term LEFT JOIN g USING (word)""")
def term_summaries(spark, sf):
    """What a person is told of terms: their categories, red flags among them, or that the lexicon does not know them."""
    part = table(spark, sf, "part")
    rules = part.select(F.col("p_type").alias("axis"), F.col("p_brand").alias("category"), (F.col("p_size") % 5 + 1).cast("int").alias("weight"), F.lit("keyword").alias("kind"), F.col("p_name").alias("term"))
    labels = part.select(F.col("p_brand").alias("category")).distinct().filter("category NOT LIKE '%7'").select("category", F.concat(F.lit("Marque "), F.substring("category", 7, 9)).alias("label"), F.concat(F.lit("De "), "category", F.lit(".")).alias("description"))
    told = [lexicon.term_summary(lexicon.category_of_term(rules, term), labels, term, "ECONOMY") for term in ("red", "gear", "nothing")]
    return told[0].unionByName(told[1]).unionByName(told[2])


@query("""WITH s AS (SELECT o_orderkey AS id, 'Works ' || o_orderkey AS title, 'Buyer ' || o_custkey AS acheteur, strftime(o_orderdate, '%Y-%m-%d') AS deadline, lpad(CAST(o_orderkey AS VARCHAR), 14, '1') AS siret FROM orders WHERE o_orderkey % 2 = 0
), m AS (SELECT o_orderkey - 1 - CASE WHEN o_orderkey % 12 = 11 THEN 2 ELSE 0 END AS original_id, o_orderkey AS k, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS deadline FROM orders WHERE o_orderkey % 6 IN (3, 5)
), l AS (SELECT original_id, arg_max(deadline, (deadline, 'm' || k)) AS deadline, count(*) AS n FROM m GROUP BY 1)
SELECT id, coalesce(l.deadline, s.deadline) AS deadline, 'works ' || CASE WHEN l.n IS NULL THEN id ELSE id END || '|' || coalesce(l.deadline, s.deadline) || '|' || lower(acheteur) AS composite_key, siret || '|' || coalesce(l.deadline, s.deadline) AS siret_deadline_key, coalesce(n, 0) AS rectification_count, n IS NOT NULL AS touched FROM s LEFT JOIN l ON l.original_id = s.id""")
def minor_applied(spark, sf):
    """Minor amendments in the stored rows: a new deadline makes new keys, and of several amendments the last one counts."""
    k = F.col("o_orderkey")
    own = lambda i, day: [i.alias("_i"), F.concat(F.lit("Works "), i.cast("string")).alias("title"), F.date_format(day, "yyyy-MM-dd").alias("deadline"), F.lpad(i.cast("string"), 14, "1").alias("siret"), F.lit(None).cast("string").alias("uuid_procedure"), F.lit("x").alias("source")]
    orders = table(spark, sf, "orders").withColumn("acheteur", F.concat(F.lit("Buyer "), F.col("o_custkey").cast("string")))
    stored = canonical.dedup_keys(orders.filter(k % 2 == 0).select(*own(k, F.col("o_orderdate")), "acheteur", F.concat(F.lit("s"), k.cast("string")).alias("source_id")))
    stored = stored.withColumnRenamed("_i", "id").withColumns({"raw": F.lit("old"), "rectification_date": F.lit(None).cast("timestamp"), "rectification_count": F.lit(0)})
    original = k - 1 - F.when(k % 12 == 11, 2).otherwise(0)
    buyers = stored.select(F.col("id").alias("_i"), "acheteur")
    minor = orders.drop("acheteur").filter((k % 6).isin(3, 5)).select(*own(original, F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")), F.concat(F.lit("m"), k.cast("string")).alias("source_id"))
    minor = minor.join(buyers, "_i").withColumnsRenamed({"_i": "original_id"}).withColumns({"raw": F.lit("new"), "publication_date": F.col("deadline")})
    found = changes.apply_minor(stored, minor, "1999-01-01T00:00:00Z")
    return found.select("id", "deadline", "composite_key", "siret_deadline_key", F.col("rectification_count").cast("long").alias("rectification_count"), (F.col("rectification_date").isNotNull() & (F.col("raw") == "new")).alias("touched"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN length(trim(text)) < 30 THEN 'unknown' ELSE 'verified' END AS status,
CASE WHEN doc_id % 5 = 0 THEN '' WHEN length(trim(text)) < 30 THEN 'unknown,unknown' ELSE CASE WHEN contains(substr(text, 1, 3000), 'the') THEN 'met' ELSE 'not_met' END || ',' || CASE WHEN contains(substr(text, 1, 3000), 'der') THEN 'met' ELSE 'not_met' END END AS verdicts FROM documents""")
def conditions_verified(spark, sf):
    """Conditions of each text behind the plug-in interface: without any it is skipped, a short text is not asked about."""
    docs = table(spark, sf, "documents").select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("description"), F.when(F.col("doc_id") % 5 != 0, F.array(F.lit("the"), F.lit("der"))).otherwise(F.array().cast("array<string>")).alias("conditions"))
    found = analysis.verify_conditions(docs, lambda text, conditions: ["met" if c in text else "not_met" for c in conditions])
    return found.select("doc_id", "status", F.array_join("verdicts", ",").alias("verdicts"))


@query("""SELECT page_id AS id, length(html) AS a, length(html) - length(replace(html, 'e', '')) AS b FROM pages""")
def pages_embedded(spark, sf):
    """Vectors of texts by an embedder that is asked in batches: here their lengths and counts of a letter."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("content"))
    found = analysis.embed(pages, lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return found.select("id", F.col("vector")[0].cast("long").alias("a"), F.col("vector")[1].cast("long").alias("b"))

"""From raw feed records to canonical and flat tenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import extract, temporal, text
from quillmark.operators.small import small
from quillmark.schemas import RAW_FIELDS


def _first(c: Column) -> Column:
    """The first entry of a list that came as JSON text, or the scalar itself."""
    listed = F.from_json(c, "array<string>")
    return F.when(F.ltrim(c).startswith("["), F.get(listed, 0)).otherwise(c)


def _list(c: Column) -> Column:
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def from_bulletin(raw: DataFrame, regions: DataFrame | None = None, source: str = "BOAMP") -> DataFrame:
    """Raw records, wrapped in ``record.fields``, in ``fields`` or not at all, as one canonical struct, with uuid_origin and all market_types.

    regions: (department, region), a small table; a code that it lacks stays as it is.
    """
    chosen = F.coalesce("record.fields", "fields", F.struct(*(F.col(n) for n in RAW_FIELDS.names)))
    rows = raw.select(chosen.alias("r"))  # one column: an alias for each of its fields would multiply the optimiser's constraints
    rows = rows.withColumn("r", F.col("r").withField("donnees", F.when(F.try_parse_json("r.donnees").isNotNull(), F.col("r.donnees"))))  # broken JSON is none
    c = lambda n: F.col(f"r.{n}")
    rows = rows.withColumns({"uuid": extract.uuid_cascade(c("contractfolderid"), c("donnees"), c("objet"), c("url_avis")), "department": _first(c("code_departement"))})
    if regions is not None:
        rows = rows.join(small(regions.select("department", "region"), "the table of regions"), "department", "left")
    else:
        rows = rows.withColumn("region", F.lit(None).cast("string"))
    get = lambda path: F.get_json_object(c("donnees"), path)
    canonical = F.struct(
        F.lit(source).alias("source"), c("idweb").alias("source_id"), F.col("uuid.value").alias("uuid_procedure"),
        F.struct(c("objet").alias("title"), c("nomacheteur").alias("acheteur"), c("url_avis").alias("url"), F.coalesce("region", "department").alias("region")).alias("identity"),
        F.struct(c("etat"), c("nature_categorise").alias("nature"), c("nature_libelle").alias("nature_label"), c("annonce_lie"), c("annonces_anterieures"), c("dateparution").alias("publication_date"), c("datelimitereponse").alias("deadline")).alias("lifecycle"),
        F.struct(F.coalesce(get("$.OBJET.OBJET_COMPLET"), c("objet")).alias("description"), _list(c("descripteur_libelle")).alias("keywords")).alias("content"),
        F.struct(_first(c("type_marche")).alias("type_marche"), c("procedure_libelle").alias("procedure"), c("famille_libelle").alias("famille")).alias("classification"),
        F.struct(get("$.IDENTITE.MEL").alias("acheteur_email"), get("$.IDENTITE.TEL").alias("acheteur_tel"), get("$.IDENTITE.ADRESSE").alias("acheteur_adresse"), get("$.IDENTITE.CP").alias("acheteur_cp"), get("$.IDENTITE.VILLE").alias("acheteur_ville"), c("criteres"), c("marche_public_simplifie"), c("titulaire"), get("$.IDENTITE.CODE_IDENT_NATIONAL").alias("siret")).alias("metadata"),
    )
    return rows.select(canonical.alias("tender"), F.col("uuid.origin").alias("uuid_origin"), _list(c("type_marche")).alias("market_types"))


def from_rss(items: DataFrame, regions: DataFrame | None = None, source: str = "MARCHESONLINE") -> DataFrame:
    """Feed items as canonical structs, with the bulletin's number and the SIRET where the text has them. Unmapped departments have no region."""
    description = F.coalesce("description", F.lit(""))
    published = temporal.day(F.coalesce("dateAccepted", "date", "pubDate"))
    by_place, by_post = extract.department_of(F.col("Location"), description)
    rows = items.withColumns({"_place": by_place, "_post": by_post, "_keywords": extract.useful_categories(F.coalesce("category", F.array().cast("array<string>")))})
    if regions is not None:
        for column in ("_place", "_post"):
            rows = rows.join(small(regions.select(F.col("department").alias(column), F.col("region").alias(f"{column}_region")), "the table of regions"), column, "left")
    else:
        rows = rows.withColumns({f"{c}_region": F.lit(None).cast("string") for c in ("_place", "_post")})
    none = F.lit(None).cast("string")
    plain = text.strip_html(description)
    cancelled = extract.is_cancellation(description, F.col("title"))
    canonical = F.struct(
        F.lit(source).alias("source"), F.coalesce("guid", "link").alias("source_id"), extract.labelled_uuid(description).alias("uuid_procedure"),
        F.struct("title", F.coalesce(extract.buyer_of(description), F.col("creator")).alias("acheteur"), F.coalesce("link", "guid").alias("url"), F.coalesce("_place_region", "_post_region").alias("region")).alias("identity"),
        F.struct(F.when(cancelled, "AVIS_ANNULE").alias("etat"), none.alias("nature"), F.when(cancelled, "Avis d'annulation").alias("nature_label"), none.alias("annonce_lie"), none.alias("annonces_anterieures"), published.alias("publication_date"), none.alias("deadline")).alias("lifecycle"),
        F.struct(plain.alias("description"), F.col("_keywords").alias("keywords")).alias("content"),
        F.struct(extract.market_type(F.concat_ws(" ", "title", plain)).alias("type_marche"), none.alias("procedure"), none.alias("famille")).alias("classification"),
        F.struct(extract.email_of(description).alias("acheteur_email"), *(none.alias(c) for c in ("acheteur_tel", "acheteur_adresse", "acheteur_cp", "acheteur_ville", "criteres", "marche_public_simplifie", "titulaire")), extract.siret_of(description).alias("siret")).alias("metadata"),
    )
    return rows.select(canonical.alias("tender"), extract.notice_number(description).alias("notice_number"), extract.is_award(F.coalesce("guid", "link"), F.col("description")).alias("is_award"))


def keep_rss(items: DataFrame, since: str | None = None, until: str | None = None, type_marche: str | None = None) -> DataFrame:
    """Canonical feed items that are no awards, lie in the range (items without a date pass), and have the market type (a null one does not pass)."""
    day = F.col("tender.lifecycle.publication_date")
    out = items.filter(~F.col("is_award"))
    if since is not None:
        out = out.filter(day.isNull() | (day == since) if until is None else day.isNull() | day.between(since, until))
    return out if type_marche is None else out.filter(F.col("tender.classification.type_marche").eqNullSafe(F.lit(type_marche)))


def keep_bulletin(canonical: DataFrame, since: str, as_of: str, until: str | None = None, type_marche: str = "SERVICES", days: int = 7) -> DataFrame:
    """The remote query's conditions: publication range, kind of notice, market type, deadline far enough, not awarded."""
    c = lambda p: F.col(f"tender.{p}")
    day = c("lifecycle.publication_date")
    kind = (c("lifecycle.nature") == "appeloffre/standard") | c("lifecycle.annonce_lie").isNotNull() | c("lifecycle.annonces_anterieures").isNotNull() | (c("lifecycle.etat") == "AVIS_ANNULE")
    deadline = c("lifecycle.deadline")
    return canonical.filter((day == since) if until is None else day.between(since, until)).filter(kind).filter(F.array_contains("market_types", type_marche)).filter(deadline.isNull() | (F.to_date(temporal.instant(deadline)) >= F.date_add(F.lit(as_of).cast("date"), days))).filter(c("metadata.titulaire").isNull())


def flatten(canonical: DataFrame) -> DataFrame:
    """Flat tenders with the canonical struct as ``raw``, and is_cancelled."""
    c = lambda p: F.col(f"tender.{p}")
    lowered = lambda p: F.contains(F.lower(F.coalesce(c(p), F.lit(""))), F.lit("annulation"))
    null = F.lit(None).cast("double")
    return canonical.select(
        c("source"), c("source_id"), c("uuid_procedure"), c("identity.title"), c("content.description"), c("content.keywords"), c("identity.acheteur"), c("metadata.acheteur_email"), null.alias("budget_min"), null.alias("budget_max"),
        c("lifecycle.deadline"), c("lifecycle.publication_date"), c("classification.type_marche"), c("identity.region"), c("identity.url").alias("url_ao"), c("lifecycle.etat"), c("metadata.siret"), F.col("tender").alias("raw"),
        (lowered("lifecycle.nature_label") | lowered("lifecycle.nature") | F.coalesce(c("lifecycle.etat") == "AVIS_ANNULE", F.lit(False))).alias("is_cancelled"),
        *(F.col(x) for x in ("notice_number",) if x in canonical.columns),
    )


def dedup_keys(tenders: DataFrame, primary: str = "BOAMP") -> DataFrame:
    """Adds uuid_key, composite_key, siret_deadline_key and source_id_key. Two missing deadlines are equal in a composite key."""
    due = F.coalesce(temporal.day(F.col("deadline")), F.lit(""))
    uuid = F.nullif(F.col("uuid_procedure"), F.lit(""))
    return tenders.withColumns({
        "uuid_key": uuid,
        "composite_key": F.concat_ws("|", text.normalize_key(F.col("title")), due, text.normalize_key(F.col("acheteur"))),
        "siret_deadline_key": F.when(F.col("siret").isNotNull() & (due != ""), F.concat_ws("|", "siret", due)),
        "source_id_key": F.when(uuid.isNull() & F.col("source_id").isNotNull() & (F.col("source") == primary), F.concat(F.lit(f"{primary}:"), F.col("source_id"))),
    })


def prequalified(rows: DataFrame, buyers: DataFrame, on: tuple[str, str], at: str, since: str, until: str, kind: str, kinds: list[str], state: str, not_state: str) -> DataFrame:
    """Rows of a range of times whose state is not the excluded one and whose buyer is of one of the kinds: filters before the join, on either side."""
    own = rows.filter(F.col(at).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")) & (F.col(state) != not_state))
    fit = buyers.filter(F.col(kind).isin(*kinds))
    return own.join(fit, own[on[0]] == fit[on[1]])

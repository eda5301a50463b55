"""What is taken out of free text and JSON. A miss is null, never an empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the feeds.
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
UUID_PLAIN = r"[0-9a-f]{32}"
UUID_UNDERSCORED = r"[0-9a-f]{8}_[0-9a-f]{4}_[0-9a-f]{4}_[0-9a-f]{4}_[0-9a-f]{12}"
UUID_LABELLED = rf"(?iu)Identifiant\s+de\s+la\s+procédure\s*[:=]\s*({UUID})"
SIRET = r"(?<![0-9A-Za-z_])(\d{14})(?![0-9A-Za-z_])"
NOTICE = (r"(?iu)Annonce\s+n[°ºoO\s]\s*(\d{2}-\d+)", r"(?iu)Annonce\s+(\d{2}-\d+)", r"(?iu)Annonce[^<]*?(\d{2}-\d{4,})")
NOTICE_VALID = r"^\d{2}-\d{4,}$"
BUYER = (
    r"(?iu)Nom\s+complet\s+de\s+l'acheteur\s*:\s*([^<\n]+)",
    r"(?iu)Nom\s+officiel\s*:\s*([^<\n]+)",
    r"(?iu)1\.1\s+Acheteur[^<]*?Nom\s+officiel\s*:\s*([^<\n]+)",
    r"(?iu)(?:Acheteur|Organisme)[\s:]+([^<\n]+)",
)
EMAIL_ATTRIBUTE = r"(?i)data-email\s*=\s*[\"']([^\"']+@[^\"']+)[\"']"
EMAIL = r"([a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+\.[a-zA-Z0-9_-]+)"
LOCATION = r"^(\d{2,3})\s*-\s*"
POSTCODE = r"(?i)Code\s+Postal\s*:\s*(\d{2,3})\d{3}"
CANCELLATION = r"(?iu)avis\s+d'annulation|annulation\s+d'avis|marché\s+annulé|procédure\s+annulée"
GENERIC_CATEGORIES = ("SERVICES", "FOURNITURES", "TRAVAUX")
UUID_KEYS = ("CONTRACT_FOLDER_ID", "contractfolderid", "IDENTIFIANT_PROCEDURE", "identifiant_procedure", "CONTRACTFOLDERID")
UUID_NESTED_KEYS = ("PROCEDURE.CONTRACT_FOLDER_ID", "PROCEDURE.contractfolderid", "PROCEDURE.IDENTIFIANT", "MARCHE.CONTRACT_FOLDER_ID", "MARCHE.contractfolderid", "IDENTITE.CONTRACT_FOLDER_ID")
# End of the fixed patterns.


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match or where it is empty. The expression stands once in the plan."""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, group)), lambda x: x != ""), 0)


def uuid_of(text: Column) -> Column:
    """A UUID in any notation, as lower-case groups with dashes."""
    plain = F.lower(first_group(text, f"(?i){UUID_PLAIN}", 0))
    dashed = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.coalesce(F.lower(first_group(text, f"(?i){UUID}", 0)), dashed, F.replace(F.lower(first_group(text, f"(?i){UUID_UNDERSCORED}", 0)), F.lit("_"), F.lit("-")))


def uuid_cascade(field: Column, data: Column, description: Column, url: Column) -> Column:
    """struct(value, origin): the first of field, top keys, nested keys, the whole JSON, the description, the URL."""
    blank = lambda c: F.get(F.filter(F.array(F.trim(c)), lambda x: x != ""), 0)
    top = F.lower(F.coalesce(*(blank(F.get_json_object(data, f"$.{k}")) for k in UUID_KEYS)))
    nested = F.lower(F.coalesce(*(blank(F.get_json_object(data, f"$.{k}")) for k in UUID_NESTED_KEYS)))
    whole = uuid_of(data)
    spoken = uuid_of(F.coalesce(F.get_json_object(data, "$.OBJET.OBJET_COMPLET"), description))
    steps = (("field", blank(field)), ("key", top), ("nested", nested), ("json", whole), ("description", spoken), ("url", uuid_of(url)))
    # each step stands once in the plan: value and origin are picked together
    found = F.filter(F.array(*(F.struct(c.alias("value"), F.lit(n).alias("origin")) for n, c in steps)), lambda x: x["value"].isNotNull())
    return F.get(found, 0)


def labelled_uuid(text: Column) -> Column:
    return F.lower(F.coalesce(first_group(text, UUID_LABELLED), first_group(text, f"(?i){UUID}", 0)))


def siret_of(text: Column) -> Column:
    return first_group(text, SIRET)


def notice_number(text: Column) -> Column:
    """The bulletin's number in a notice that another platform shows."""
    found = [first_group(text, p) for p in NOTICE]
    return F.coalesce(*(F.when(c.rlike(NOTICE_VALID), c) for c in found))


def buyer_of(text: Column) -> Column:
    return F.coalesce(*(F.trim(first_group(text, p)) for p in BUYER))


def market_type(text: Column) -> Column:
    upper = F.upper(text)
    has = lambda *w: F.lit(False) if not w else F.contains(upper, F.lit(w[0])) | has(*w[1:])
    return F.when(has("SERVICE", "CONSEIL"), "SERVICES").when(has("FOURNITURE"), "FOURNITURES").when(has("TRAVAUX", "CONSTRUCTION"), "TRAVAUX")


def email_of(text: Column) -> Column:
    return F.coalesce(F.trim(first_group(text, EMAIL_ATTRIBUTE)), first_group(text, EMAIL))


def department_of(location: Column, description: Column) -> tuple[Column, Column]:
    """Department codes by location and by postcode, in the order in which they are looked up."""
    return first_group(location, LOCATION), first_group(description, POSTCODE)


def is_cancellation(description: Column, title: Column) -> Column:
    return F.coalesce(description.rlike(CANCELLATION), F.lit(False)) | F.coalesce(title.rlike(CANCELLATION), F.lit(False))


def is_award(url: Column, description: Column) -> Column:
    """Award notices are no tenders; the case of letters counts."""
    u, d = F.coalesce(url, F.lit("")), F.coalesce(description, F.lit(""))
    return F.contains(u, F.lit("/attribution/")) | F.contains(u, F.lit("/am-")) | F.contains(d, F.lit("Avis d'attribution")) | F.contains(d, F.lit("avis d'attribution")) | F.contains(d, F.lit("Attribution de marché"))


def useful_categories(categories: Column) -> Column:
    """Categories of a feed item without the generic ones, trimmed, none blank."""
    kept = F.filter(categories, lambda c: c.isNotNull() & ~F.upper(c).isin(*GENERIC_CATEGORIES))
    return F.filter(F.transform(kept, lambda c: F.trim(c)), lambda c: F.length(c) > 0)


def record_id(raw: Column) -> Column:
    """The identifier in a raw record: the first of three keys."""
    return F.coalesce(*(F.get_json_object(raw, f"$.{k}") for k in ("idweb", "boamp_id", "id")))


def json_long(raw: Column, key: str) -> Column:
    """A whole number of a JSON text, under a key of its top level; null without one."""
    return F.get_json_object(raw, f"$.{key}").try_cast("long")

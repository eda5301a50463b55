"""The daily run.

Steps are lazy chains; between them the lineage is cut, as each step's result is read by several branches of the next one, and
as the nested expressions of all steps together would be a plan that takes longer to optimise than to run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import canonical, changes, dedup, lexicon, routing
from quillmark.operators.lineage import checkpointed
from quillmark.schemas import CANONICAL


def prequalify(bulletin: DataFrame, feed: DataFrame, stored: DataFrame) -> DataFrame:
    """Flat tenders of both sources: those of the feed only where no stored analysed tender matches."""
    done = canonical.dedup_keys(stored.filter("status = 'analyzed'"))
    new = canonical.dedup_keys(canonical.flatten(feed))
    left = dedup.unmatched(dedup.match(new, done)).drop("matched_id", "match_strategy", "uuid_key", "composite_key", "siret_deadline_key", "source_id_key", "notice_number")
    return canonical.flatten(bulletin).unionByName(left)


def compared(prefix: str) -> F.Column:
    """What amendments are compared by, of the columns with a prefix."""
    c = lambda n: F.col(f"{prefix}{n}")
    criteria = c("raw")["metadata"]["criteres"]
    return F.struct(c("budget_max").alias("budget_max"), c("deadline").alias("deadline"), F.get_json_object(criteria, "$.CAP_ECO").alias("cap_eco"), F.get_json_object(criteria, "$.CAP_TECH").alias("cap_tech"), c("type_marche").alias("type_marche"), c("region").alias("region"), c("title").alias("title"))


def amendments(tenders: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds is_amendment, original_id, changes and is_substantial."""
    life = F.col("raw")["lifecycle"]
    marked = tenders.withColumns({"is_amendment": changes.is_amendment(life["nature"], life["nature_label"], life["annonce_lie"]), "annonce_lie": life["annonce_lie"], "normalized_id": F.regexp_replace("source_id", "[^0-9]", "")})
    base = stored.withColumn("normalized_id", F.regexp_replace("source_id", "[^0-9]", ""))
    found = changes.originals(marked.filter("is_amendment"), base)
    old = stored.select(*(F.col(c).alias(f"old_{c}") for c in ("id", "budget_max", "deadline", "type_marche", "region", "title", "raw")))
    both = found.join(old, found["original_id"] == old["old_id"], "left")
    diff = F.when(F.col("old_id").isNotNull(), changes.changes(compared("old_"), compared("")))
    both = both.withColumn("changes", diff).withColumn("is_substantial", F.coalesce(changes.is_substantial(F.col("changes")), F.lit(False)))
    both = both.select(*tenders.columns, "is_amendment", "original_id", "changes", "is_substantial")
    return both.unionByName(marked.filter(~F.col("is_amendment")).select(*tenders.columns, "is_amendment"), allowMissingColumns=True)


def run(bulletin: DataFrame, feed: DataFrame, stored: DataFrame, lex: lexicon.Lexicon, as_of: str, flags: list[str] | None = None, scorer: routing.Scorer = routing.rule_scorer) -> DataFrame:
    """Tenders with route, final_score and priority. Cancelled ones carry no score."""
    stored = checkpointed(stored)
    tenders = checkpointed(prequalify(checkpointed(bulletin), checkpointed(feed), stored))
    fresh = dedup.to_analyse(checkpointed(amendments(tenders, stored)), stored)
    scored = checkpointed(lexicon.score(fresh, lex, flags))
    routed = scored.withColumn("route", routing.route(F.col("original_id").isNotNull(), F.col("is_cancelled"), F.col("is_amendment"), F.col("is_substantial"), F.col("gate.skip")))
    analysed = routing.finish(routing.analyse(routing.needs_analysis(routed), scorer), as_of)
    skipped = routing.price_skipped(routed.filter("route = 'skip'"))
    minor = routing.keep_minor(routed.filter("route = 'minor'"), stored)
    rest = routed.filter(F.col("route").isin("cancelled", "context"))
    return analysed.unionByName(skipped, allowMissingColumns=True).unionByName(minor, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


__all__ = ["CANONICAL", "amendments", "prequalify", "run"]

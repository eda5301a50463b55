"""Scoring of texts against a weighted lexicon.

The lexicon is a parameter: rows (axis, category, weight, kind, term, ord) with the axes ``sector``, ``expertise``, ``posture``,
``red_flag`` and ``reference_client``, and the kinds ``keyword`` and ``pattern``. Lexica are small (hundreds of rows) and
checked to be: they are compiled once and sent to all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import scores, text
from quillmark.operators.automaton import Automaton, disjoint

MAX_ROWS = 20_000
_SPACE = re.compile(r"\s+")


def plain(value: str) -> str:
    """``functions.text.normalize`` for a term or a single text."""
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFD", value.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return _SPACE.sub(" ", folded).strip()


_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def occurrences(full: str, body: str) -> Iterator[int]:
    """Where a term begins that has no letter of a-z right before or behind it; occurrences do not overlap."""
    at = full.find(body)
    while at >= 0:
        end = at + len(body)
        if (at and full[at - 1] in _LETTERS) or full[end : end + 1] in _LETTERS:
            end = at + 1
        else:
            yield at
        at = full.find(body, max(end, at + 1))


def match(full: str, keywords: list[tuple[str, str]], patterns: list[re.Pattern], places: Callable[[str], Iterable[int]] | None = None) -> list[str]:
    """Distinct terms that a normalised text has, none of them inside another's span.

    keywords come longest first, each with its normalised spelling. Each takes its first occurrence that no span covers
    fully. A pattern's matches count where their text first occurs in the full text, unless that is covered. places gives the
    occurrences of a spelling where they are known already; without it they are sought.
    """
    places = places or (lambda body: occurrences(full, body))
    spans: list[tuple[int, int]] = []
    found: dict[str, None] = {}
    covered = lambda a, b: any(x <= a and b <= y for x, y in spans)
    for keyword, body in keywords:
        at = next((k for k in places(body) if not covered(k, k + len(body))), None)
        if at is not None:
            spans.append((at, at + len(body)))
            found[keyword] = None
    for pattern in patterns:
        seen = set()  # the same text has the same first place, which is covered from then on
        for m in pattern.finditer(full):
            if m[0] in seen:
                continue
            seen.add(m[0])
            term = plain(m[0])
            at = full.find(term)
            if at >= 0 and not covered(at, at + len(term)):
                spans.append((at, at + len(term)))
                found[m[0]] = None
    return list(found)


@dataclass
class Category:
    name: str
    weight: int
    keywords: list[tuple[str, str]] = field(default_factory=list)
    patterns: list[re.Pattern] = field(default_factory=list)


@dataclass
class Lexicon:
    """A compiled lexicon."""

    axes: dict[str, list[Category]]

    @staticmethod
    def of(rows: Iterable[tuple[str, str, int, str, str]]) -> Lexicon:
        axes: dict[str, dict[str, Category]] = {}
        for axis, category, weight, kind, term in rows:
            own = axes.setdefault(axis, {}).setdefault(category, Category(category, weight))
            if kind == "pattern":
                own.patterns.append(re.compile(term, re.IGNORECASE))
            else:
                own.keywords.append((term, plain(term)))
        for categories in axes.values():
            for c in categories.values():
                c.keywords.sort(key=lambda k: -len(k[0]))
        return Lexicon({a: list(c.values()) for a, c in axes.items()})

    @staticmethod
    def read(rules: DataFrame) -> Lexicon:
        rows = rules.orderBy("axis", "ord").select("axis", "category", "weight", "kind", "term").limit(MAX_ROWS + 1).collect()
        if len(rows) > MAX_ROWS:
            raise ValueError(f"a lexicon has at most {MAX_ROWS} rows")
        return Lexicon.of(map(tuple, rows))

    def terms(self, axis: str) -> list[str]:
        return [body for c in self.axes.get(axis, []) for _, body in c.keywords]


_HITS = "array<struct<category string, weight int, terms array<string>>>"


def matches(full: Column, lexicon: Lexicon, axis: str) -> Column:
    """array(struct(category, weight, terms)) of the categories of an axis that a normalised text hits."""
    return axis_matches(full, lexicon, (axis,))[axis]


def axis_matches(full: Column, lexicon: Lexicon, axes: tuple[str, ...], loose: tuple[str, ...] = ()) -> Column:
    """For each axis the array(struct(category, weight, terms)) of its categories that a normalised text hits; in one pass over the texts.

    loose: lists of spellings of further axes, whose terms (array<string>) are those that a text contains anywhere, inside words too.
    """
    categories = {a: lexicon.axes.get(a, []) for a in axes}
    anywhere = {a: [k for c in lexicon.axes.get(a, []) for k in c.keywords] for a in loose}
    terms = [body for own in categories.values() for c in own for _, body in c.keywords] + [body for own in anywhere.values() for _, body in own]
    automaton: Automaton | None = None
    schema = ", ".join([f"{a} {_HITS}" for a in axes] + [f"{a} array<string>" for a in loose])

    @F.pandas_udf(f"struct<{schema}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        nonlocal automaton
        automaton = automaton or Automaton(terms)  # once a worker: the terms are sent, not the table
        values = [t or "" for t in texts]
        text_of, term_of, starts, apart = automaton.hits(values)
        bounds = np.searchsorted(text_of, np.arange(len(values) + 1)).tolist()
        terms_of, starts, apart = term_of.tolist(), starts.tolist(), apart.tolist()
        out: dict[str, list] = {a: [] for a in (*axes, *loose)}
        for k, full in enumerate(values):
            whole: dict[str, list[int]] = {}
            inside: set[str] = set()
            for h in range(bounds[k], bounds[k + 1]):
                body = automaton.terms[terms_of[h]]
                inside.add(body)
                if apart[h]:
                    whole.setdefault(body, []).append(starts[h])
            places = lambda body, whole=whole: disjoint(whole.get(body, ()), len(body))
            for a, own in categories.items():
                hits = ((c, match(full, c.keywords, c.patterns, places)) for c in own if c.patterns or inside)
                out[a].append([{"category": c.name, "weight": c.weight, "terms": h} for c, h in hits if h])
            for a, own in anywhere.items():
                out[a].append([keyword for keyword, body in own if body in inside or not body])
        return pd.DataFrame(out)

    return run(full)


def red_flags(full: Column, lexicon: Lexicon, keywords: Column) -> Column:
    """Keywords that a normalised text contains, word boundaries aside (as the matcher found them), and the first match of each pattern."""
    patterns = [F.nullif(F.regexp_extract(full, f"(?i){p.pattern}", 0), F.lit("")) for c in lexicon.axes.get("red_flag", []) for p in c.patterns]
    return F.concat(keywords, F.filter(F.array(*patterns).cast("array<string>"), lambda x: x.isNotNull()))


def score(tenders: DataFrame, lexicon: Lexicon, extra_flags: list[str] | None = None, mission: str = "entreprise_mission", purpose: str = "raison_etre") -> DataFrame:
    """Adds keyword_score (0 to 100), confidence, the three axis scores, their matches, red_flags, bonuses and gate.

    Base scores look at title and description; bonuses and penalties at the buyer too. extra_flags are the values of active
    red-flag rules. ``mission`` and ``purpose`` name the categories with a higher cap and an own bonus.
    """
    joined = lambda *c: text.normalize(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in c)))
    base = tenders.withColumn("_full", joined("title", "description")).withColumn("_wide", F.trim(F.concat_ws(" ", "_full", joined("acheteur"))))
    axes = ("sector", "expertise", "posture")
    base = base.withColumn("_hits", axis_matches(F.col("_full"), lexicon, axes, ("red_flag",))).withColumns({f"{a}_matches": F.col(f"_hits.{a}") for a in axes})
    base = base.withColumn("red_flags", red_flags(F.col("_full"), lexicon, F.col("_hits.red_flag"))).drop("_hits")

    def total(axis: str, each: Column, cap: int) -> Column:
        points = F.transform(f"{axis}_matches", lambda m: scores.category_score(F.size(F.array_distinct(m["terms"])), m["weight"], F.when(m["category"] == mission, scores.MISSION_EACH).otherwise(each) if axis == "sector" else each))
        return F.least(F.aggregate(points, F.lit(0), lambda a, b: a + b), F.lit(cap))

    base = base.withColumns({
        "sector_score": total("sector", F.lit(scores.SECTOR_EACH), scores.SECTOR_CAP),
        "expertise_score": total("expertise", F.lit(scores.EXPERTISE_EACH), scores.EXPERTISE_CAP),
        "posture_score": total("posture", F.lit(scores.POSTURE_CAP), scores.POSTURE_CAP),
    })
    has = lambda axis, category: F.exists(f"{axis}_matches", lambda m: m["category"] == category)
    contains = lambda terms: F.exists(F.array(*(F.lit(plain(t)) for t in terms)).cast("array<string>"), lambda t: F.contains(F.col("_wide"), t)) if terms else F.lit(False)
    rules = [
        ("reference_client", 15, contains(lexicon.terms("reference_client"))),
        ("purpose_expertise", 10, has("expertise", purpose)),
        ("mission_sector", 5, has("sector", mission) & ~has("expertise", purpose)),
        ("executive_level", 8, F.col("_wide").rlike("co(m(ex|dir))")),
        ("several_expertises", 5, F.size("expertise_matches") >= 2),
        ("strategy_or_innovation", 8, F.contains("_wide", F.lit("strategi")) | F.contains("_wide", F.lit("innov"))),
        ("dynamic_red_flag", -30, contains(extra_flags or [])),
        ("red_flags", -30, F.size("red_flags") > 0),
        ("no_sector", -15, F.size("sector_matches") == 0),
    ]
    plus = sum((F.when(c, F.lit(n)).otherwise(0) for _, n, c in rules), F.lit(0))
    confidence = scores.confidence(F.col("sector_score"), F.col("expertise_score"), F.size("sector_matches") > 0, F.size("expertise_matches") > 0)
    base = base.withColumns({
        "base_score": F.col("sector_score") + F.col("expertise_score") + F.col("posture_score"),
        "confidence": confidence,
        "bonuses": F.filter(F.array(*(F.when(c, F.lit(n)) for n, _, c in rules)), lambda x: x.isNotNull()),
    })
    base = base.withColumn("keyword_score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("base_score") + plus)))
    base = base.withColumn("gate", scores.gate(F.col("keyword_score"), F.col("confidence"), F.size("red_flags") > 0))
    every = F.array_distinct(F.flatten(F.transform(F.concat("sector_matches", "expertise_matches", "posture_matches"), lambda m: m["terms"])))
    return base.withColumn("matched_terms", every).drop("_full", "_wide")


def _word(term: str) -> str:
    """A pattern for a term as a whole word: ends that are word characters have none beside them, other ends have one."""
    side = lambda c, before: (r"(?<![A-Za-z0-9_])" if before else r"(?![A-Za-z0-9_])") if c.isascii() and (c.isalnum() or c == "_") else (r"(?<=[A-Za-z0-9_])" if before else r"(?=[A-Za-z0-9_])")
    return side(term[0], True) + re.escape(term) + side(term[-1], False) if term else r"(?!)"


def category_of_term(rules: DataFrame, term: str) -> DataFrame:
    """The categories (axis, category, weight, terms) whose keywords are the term, hold it as a whole word or lie in it, or whose patterns match it."""
    own = plain(term)
    body = text.normalize(F.col("term"))
    keyword = (F.col("kind") == "keyword") & (body != "") & ((body == own) | body.rlike(_word(own)) | F.contains(F.lit(own), body))
    pattern = (F.col("kind") == "pattern") & F.expr("regexp_like(term_text, concat('(?i)', term))")
    return rules.withColumn("term_text", F.lit(term)).filter(keyword | pattern).groupBy("axis", "category", "weight").agg(F.array_sort(F.collect_set("term")).alias("terms"))


# Fixed texts.
UNKNOWN_TERM = " n'est pas dans le lexique. Il a peut-être été trouvé par un motif, ou c'est un faux positif à examiner."
FLAG_ONLY = (" est un red flag : ", " Il signale que l'AO est probablement hors périmètre.")
BOTH_KINDS = (" est classé dans ", ". Cependant, il est aussi signalé comme red flag potentiel dans certains contextes : ")
# End of the fixed texts.


def term_summary(found: DataFrame, labels: DataFrame, term: str, flag: str = "red_flag") -> DataFrame:
    """One row (term, found, summary): what a person is told of a term, from the rows of ``category_of_term``.

    labels: category, label, description; a category without one is named as it is. Categories come in the order of axis and name; those of the axis ``flag`` are red flags.
    """
    known = labels.select(F.col("category").alias("_c"), "label", "description")
    rows = found.join(known, found["category"] == F.col("_c"), "left")
    entry = F.struct("axis", "category", F.coalesce("label", "category").alias("label"), F.coalesce("description", F.lit("")).alias("description"), "weight")
    one = rows.agg(F.array_sort(F.collect_list(F.when(F.col("axis") != flag, entry))).alias("plus"), F.array_sort(F.collect_list(F.when(F.col("axis") == flag, entry))).alias("minus"))  # categories of a lexicon are few
    name = F.lit(f'"{term}"')
    weighted = lambda x: F.concat(x["label"], F.lit(" (weight: "), x["weight"].cast("string"), F.lit(")"))
    said = F.array_join(F.transform("plus", lambda x: F.concat(name, F.lit(" → "), weighted(x), F.lit(". "), x["description"])), "\n")
    flagged = F.get("minus", F.lit(0))["description"]
    summary = (
        F.when((F.size("plus") == 0) & (F.size("minus") == 0), F.concat(name, F.lit(UNKNOWN_TERM)))
        .when(F.size("plus") == 0, F.concat(name, F.lit(FLAG_ONLY[0]), flagged, F.lit(FLAG_ONLY[1])))
        .when(F.size("minus") > 0, F.concat(name, F.lit(BOTH_KINDS[0]), F.array_join(F.transform("plus", weighted), ", "), F.lit(BOTH_KINDS[1]), flagged))
        .otherwise(said)
    )
    return one.select(F.lit(term).alias("term"), (F.size("plus") + F.size("minus") > 0).alias("found"), summary.alias("summary"))

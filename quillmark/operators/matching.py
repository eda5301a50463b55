"""Joins on texts that are alike, by inverted indexes: no side meets all of the other.

Both are exact: an index only proposes pairs, and each pair is tested. Sides are reduced to distinct values first, so equal
rows do not multiply; callers join back. Index and asking rows meet on a hash of the key columns and a gram or token, so a hot
key is spread over its grams, and neither side is aggregated in the stage of the join, so that a hot gram can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 3
#: A key with at most so many distinct needles and texts compares each with each: fewer pairs than there are grams.
FEW_NEEDLES, FEW_TEXTS = 16, 256


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of a text of that many characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(text, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, texts: DataFrame, on: list[str] | None = None, size: int = GRAM) -> DataFrame:
    """(on..., needle, text): distinct pairs where the text contains the needle and the key columns are equal.

    needles has on and ``needle``, texts has on and ``text``. A text is found by the rarest gram of the needle: grams of the texts are counted, each
    needle is asked under one gram, and what shares it is compared. A needle with a gram that no text has is in none. Needles
    shorter than a gram are asked by grams of their own length; an empty needle is in every text of its key. Nulls, in keys too, match nothing.
    Keys with few needles and texts need no grams. Grams are many more than the size of a file tells, so no join here may be by broadcast.
    """
    on = on or []
    n = needles.select(*on, "needle").dropna().distinct()
    t = texts.select(*on, "text").dropna().distinct()
    if on:
        both = n.select(*on, F.col("needle").alias("_value"), F.lit(True).alias("_asks")).unionAll(t.select(*on, "text", F.lit(False)))
        asked, held = F.count_if("_asks"), F.count_if(~F.col("_asks"))
        keys = both.groupBy(*on).agg(((asked > 0) & (held > 0)).alias("_both"), ((asked <= FEW_NEEDLES) & (held <= FEW_TEXTS)).alias("_few")).filter("_both").drop("_both")
        dealt = both.join(keys.hint("merge"), on)
        side = lambda name, asks, few: dealt.filter((F.col("_asks") == asks) & (F.col("_few") == few)).select(*on, F.col("_value").alias(name))
        each = side("text", False, True).join(side("needle", True, True).hint("merge"), on).filter(F.contains("text", F.col("needle"))).select(*on, "needle", "text")
        return each.unionByName(_by_grams(side("needle", True, False), side("text", False, False), on, size))
    return _by_grams(n, t, on, size)


def _by_grams(n: DataFrame, t: DataFrame, on: list[str], size: int) -> DataFrame:
    """``contained`` of distinct needles and texts without nulls."""
    sizes = sorted(n.agg(F.collect_set(F.least(F.length("needle"), F.lit(size)))).first()[0])  # at most size + 1 numbers
    lengths = [k for k in sizes if k > 0]
    hashed = lambda g: F.xxhash64(*on, g)
    all_grams = F.flatten(F.array(*(_grams(F.col("text"), k) for k in lengths))) if lengths else F.array().cast("array<string>")
    index = t.select(*on, "text", F.explode(all_grams).alias("_gram")).select(*on, "text", hashed(F.col("_gram")).alias("_key"))
    counts = index.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    own = F.lit(None).cast("array<string>")
    for k in lengths:
        own = F.when(F.least(F.length("needle"), F.lit(size)) == k, _grams(F.col("needle"), k)).otherwise(own)
    asked = n.select(*on, "needle", F.explode(own).alias("_gram")).select(*on, "needle", hashed(F.col("_gram")).alias("_key"))
    rarest = asked.join(counts.hint("merge"), "_key", "left").groupBy(*on, "needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key"))).alias("_least"))
    rarest = rarest.filter("_least.n > 0").select(*(F.col(c).alias(f"_on_{c}") for c in on), "needle", F.col("_least.key").alias("_key"))
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_on_{c}"))
    pairs = index.join(rarest.hint("merge"), "_key").filter(same & F.contains("text", F.col("needle"))).select(*on, "needle", "text")
    if 0 in sizes:
        empty = n.filter("needle = ''")
        pairs = pairs.unionByName((t.join(empty, on) if on else t.withColumn("needle", F.lit(""))).select(*on, "needle", "text"))
    return pairs


def overlapping(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, share): pairs of ids whose token sets have in common at least that share of the larger set.

    left has a and ``tokens`` (distinct), right has b and ``tokens``. Tokens are ordered by how many sets have them, rarest first. Sets of m and n
    tokens need ceil(least * max(m, n)) common ones, so both have one of these among their first size - ceil(least * size) + 1; only such
    tokens are joined, sizes must be near enough, and the rest is counted. Empty sets match nothing.
    """
    ids = lambda df, key: df.select(F.col(key).alias("_id"), F.col("tokens").alias("_tokens")).filter(F.size("tokens") > 0)
    a, b = ids(left, "a"), ids(right, "b")
    tokens = lambda df: df.select("_id", F.explode("_tokens").alias("_token"))
    counts = tokens(a).select("_token").unionAll(tokens(b).select("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))

    def prefix(df: DataFrame) -> DataFrame:
        ordered = tokens(df).join(counts, "_token").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_n", "_token"))).alias("_o"))  # the tokens of one set
        m = F.size("_o")
        first = F.slice("_o", F.lit(1), m - F.ceil(F.lit(least) * m - F.lit(1e-9)).cast("int") + 1)
        return ordered.select("_id", F.transform("_o", lambda x: x["_token"]).alias("_all"), F.explode(first).alias("_p")).select("_id", "_all", F.col("_p._token").alias("_token"))

    p, q = prefix(a), prefix(b)
    q = q.select(F.col("_id").alias("_id2"), F.col("_all").alias("_all2"), "_token")
    m, n = F.size("_all"), F.size("_all2")
    near = p.join(q, "_token").filter(F.least(m, n) >= F.lit(least) * F.greatest(m, n) - F.lit(1e-9))
    # a pair shares several tokens of its prefixes: it counts under the first of them only
    need = lambda size: size - F.ceil(F.lit(least) * size - F.lit(1e-9)).cast("int") + 1
    common = F.array_intersect(F.slice("_all", F.lit(1), need(m)), F.slice("_all2", F.lit(1), need(n)))
    near = near.filter(F.element_at(common, 1) == F.col("_token"))
    share = F.size(F.array_intersect("_all", "_all2")) / F.greatest(m, n)
    return near.select(F.col("_id").alias("a"), F.col("_id2").alias("b"), share.alias("share")).filter(F.col("share") >= least)


def paired(rows: DataFrame, on: list[str], key: str, value: str, block: int = 256, each: int = 1 << 20) -> DataFrame:
    """(a, b, a_value, b_value, same): classes of equal values that meet within equal key columns, with the keys of their members as arrays a and b.

    Every pair of rows with equal ``on`` is opened from exactly one result row, in either order; where ``same`` holds, a and b are the same members, so
    each of their pairs is there both ways. Null keys and nulls in ``on`` match nothing. Rows of a group are dealt into blocks of about ``block``, blocks meet blocks, and the pairs of blocks are dealt evenly before they are
    opened, in parts of about ``each`` pairs of rows: neither a large group nor a small file makes a long task.
    """
    r = rows.select(*on, F.col(key).alias("_key"), F.col(value).alias("_value")).dropna(subset=[*on, "_key"])
    counts = r.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    pairs = counts.agg(F.coalesce(F.sum(F.col("_n").cast("double") * F.col("_n")), F.lit(0.0)) / 2).first()[0]
    parts = F.ceil(F.col("_n") / block).cast("int")
    dealt = r.join(counts.hint("merge"), on).select(*on, "_key", "_value", parts.alias("_parts"), F.pmod(F.xxhash64("_key"), parts).cast("int").alias("_block"))
    classes = dealt.groupBy(*on, "_parts", "_block", "_value").agg(F.collect_list("_key").alias("keys"))  # about BLOCK keys in all classes of a block
    blocks = classes.groupBy(*on, "_parts", "_block").agg(F.collect_list(F.struct(F.col("_value").alias("value"), "keys")).alias("_rows"))
    own = blocks.select(F.col("_rows").alias("_x"), F.col("_rows").alias("_y"), F.lit(True).alias("_own"))
    asking = blocks.filter("_block + 1 < _parts").select(*on, F.col("_rows").alias("_x"), F.explode(F.sequence(F.col("_block") + 1, F.col("_parts") - 1)).alias("_block"))
    others = asking.join(blocks.hint("merge"), [*on, "_block"]).select("_x", F.col("_rows").alias("_y"), F.lit(False))
    met = own.unionAll(others).repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(pairs // each) + 1))
    met = met.select("_own", "_y", F.posexplode("_x").alias("_i", "_a")).select("_own", "_i", "_a", F.posexplode("_y").alias("_j", "_b")).filter("NOT _own OR _i <= _j")
    return met.select(F.col("_a.keys").alias("a"), F.col("_b.keys").alias("b"), F.col("_a.value").alias("a_value"), F.col("_b.value").alias("b_value"), (F.col("_own") & (F.col("_i") == F.col("_j"))).alias("same"))

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import changes, feedback, matching, retrieval


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 3, 8])
def test_contained_equals_comparing_all(spark, size):
    r = random.Random(size)
    word = lambda most: "".join(r.choices("ab é", k=r.randrange(0, most)))
    needles = [(r.choice("xyz"), word(7)) for _ in range(80)] + [(None, "a"), ("x", None), ("x", ""), ("x", "")]
    texts = [(r.choice("xyz"), word(30)) for _ in range(80)] + [(None, "a"), ("y", None), ("x", "")]
    n, t = spark.createDataFrame(needles, "k string, needle string"), spark.createDataFrame(texts, "k string, text string")
    want = {(k, a, b) for k, a in needles for c, b in texts if k is not None and k == c and None not in (a, b) and a in b}
    got = [tuple(x) for x in matching.contained(n, t, ["k"], size).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    free = [tuple(x) for x in matching.contained(n.select("needle"), t.select("text"), size=size).collect()]
    assert len(free) == len(set(free)) and set(free) == {(a, b) for _, a in needles for _, b in texts if None not in (a, b) and a in b}


def test_contained_of_empty_tables(spark):
    n, t = spark.createDataFrame([], "needle string"), spark.createDataFrame([("a",)], "text string")
    assert matching.contained(n, t).count() == 0
    assert matching.contained(t.withColumnRenamed("text", "needle"), n.withColumnRenamed("needle", "text")).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_overlapping_equals_comparing_all(spark, least):
    r = random.Random(9)
    sets = lambda n: [(k, sorted(set(r.choices("abcdefgh", k=r.randrange(0, 7))))) for k in range(n)]
    left, right = sets(90), sets(90)
    got = [tuple(x) for x in matching.overlapping(spark.createDataFrame(left, "a int, tokens array<string>"), spark.createDataFrame(right, "b int, tokens array<string>"), least).collect()]
    share = lambda x, y: len(set(x) & set(y)) / max(len(x), len(y)) if x and y else 0
    assert sorted(got) == sorted((a, b, share(x, y)) for a, x in left for b, y in right if share(x, y) >= least)


def test_no_side_meets_all_of_the_other(spark):
    """Neither nested loops nor a Cartesian product, and names beyond any broadcast."""
    buyers = spark.range(2000).select(F.concat(F.lit("Ville de lieu"), "id").alias("buyer"))
    clients = spark.range(60_000).select(F.concat(F.lit("lieu"), "id").alias("nom_normalise"), F.array().cast("array<string>").alias("aliases"), F.lit("x").alias("statut"))
    found = retrieval.known_buyer(buyers, clients)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    row = found.filter("buyer = 'Ville de lieu1234'").first()
    assert (row["nom_normalise"], row["match_type"]) == ("lieu1", "substring")


def test_known_buyer_equals_comparing_all(spark):
    r = random.Random(5)
    pool = ["ville", "de", "lyon", "metropole", "grand", "sa", "les", "paris", "banque", "postale"]
    name = lambda: " ".join(r.choices(pool, k=r.randrange(1, 5)))
    clients = [(name(), [name() for _ in range(r.randrange(0, 3))], k) for k in range(40)]
    buyers = sorted({name() for _ in range(120)} | {"", "???"})
    got = {x["buyer"]: (x["nom_normalise"], x["match_type"], x["match_score"]) for x in retrieval.known_buyer(spark.createDataFrame([(b,) for b in buyers], "buyer string"), spark.createDataFrame([(n, a, "s", k) for n, a, k in clients], "nom_normalise string, aliases array<string>, statut string, ord int")).collect()}
    for b in buyers:
        best = (None, None, None)
        plain = " ".join("".join(c if c.isalnum() else " " for c in b).split())
        for n, aliases, _ in clients:
            for other in (n, *aliases):
                x, y = {t for t in plain.split() if len(t) > 2}, {t for t in other.split() if len(t) > 2}
                share = len(x & y) / max(len(x), len(y)) if x and y else 0
                score, kind = (1.0, "exact") if plain == other else (0.95, "substring") if other in plain and len(other) > 4 else (0.7 + share * 0.2, "fuzzy") if share >= 0.6 else (None, None)
                if score is not None and plain and (best[2] is None or score > best[2] + 1e-12):
                    best = (n, kind, score)
        assert got[b] == (*best[:2], None if best[2] is None else round(best[2] + 1e-12, 2)), b


def test_originals_by_title_equal_comparing_all(spark):
    """One buyer has most rows, titles repeat, sources repeat."""
    r = random.Random(8)
    pool = ["Marché de travaux", "travaux", "Marché", "voirie et réseaux", "Lot 1"]
    title = lambda: r.choice([None, "", " ".join(r.choices(pool, k=r.randrange(1, 4)))])
    buyer = lambda: r.choice(["hot"] * 6 + ["cold", None])
    stored = [(k, r.choice([None, f"s{r.randrange(30)}"]), buyer(), title(), r.randrange(5)) for k in range(200)]
    asked = [(f"s{r.randrange(60)}", buyer(), title()) for _ in range(80)]
    got = {x["source_id"]: x["near"] for x in changes.by_title(spark.createDataFrame(asked, "source_id string, acheteur string, title string"), spark.createDataFrame(stored, "id int, source_id string, acheteur string, title string, analyzed_at int")).collect()}
    want = {}
    for source, b, t in asked:
        fits = [(at, k) for k, s, c, u, at in stored if t and u is not None and b is not None and b == c and s is not None and s != source and t[:50].lower() in u.lower()]
        if fits:
            want[source] = max([*fits, *([want[source]] if source in want else [])])
    assert got == {s: k for s, (_, k) in want.items()} and len(got) > 10


def test_a_hot_buyer_is_spread(spark):
    """The stored titles of one buyer are dealt by their grams: no partition of the join has more than a part of them."""
    stored = spark.range(3000).select(F.lit("hot").alias("acheteur"), F.concat(F.lit("fourniture "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    asked = stored.select("acheteur", F.lower(F.substring("text", 1, 50)).alias("needle"))
    pairs = matching.contained(asked, stored, ["acheteur"])
    assert pairs.count() == 3000 and "NestedLoop" not in plan_of(pairs)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        join = matching.contained(asked, stored, ["acheteur"])
        sizes = [r["count"] for r in join.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 2 * 3000 / 4


def test_duplicates_equal_comparing_all(spark):
    r = random.Random(2)
    value = lambda: r.choice([None, "", " ", "Nettoyage", "nettoyage de vitres", "vitres", "net", "e"])
    rules = [(f"r{k:02}", r.choice("cd"), r.choice(["red_flag", "boost"]), value(), r.random() < 0.7) for k in range(30)]
    proposals = [(k, r.choice(["c", "d", None]), r.choice(["red_flag", "boost"]), value()) for k in range(60)]
    found = feedback.duplicates(spark.createDataFrame(proposals, "k int, client_id string, type string, value string"), spark.createDataFrame(rules, "id string, client_id string, type string, value string, active boolean"))
    want = {}
    for k, c, t, v in proposals:
        own = None if v is None else v.strip(" ").lower()
        fits = [i for i, rc, rt, rv, on in rules if on and rc == c and rt == t and None not in (rv, own) and (own in rv.lower() or rv.lower() in own)]
        want[k] = min(fits, default=None)
    assert {x["k"]: x["duplicate_of"] for x in found.collect()} == want


def test_originals_send_no_index_by_way_of_the_driver(spark):
    """Grams are many times the rows that a file tells of, so their joins are no broadcasts; keys with few rows ask no grams."""
    stored = spark.range(500).select("id", F.concat(F.lit("s"), "id").alias("source_id"), (F.col("id") % 50).cast("string").alias("acheteur"), F.concat(F.lit("Fourniture "), "id").alias("title"), F.col("id").alias("analyzed_at"), F.col("id").cast("string").alias("normalized_id"))
    asked = stored.select(F.concat(F.lit("a"), "id").alias("source_id"), "acheteur", "title", F.lit(None).cast("string").alias("annonce_lie"), F.lit(None).cast("string").alias("normalized_id"))
    found = changes.originals(asked, stored)
    assert "BroadcastHashJoin" not in plan_of(found) and "BroadcastExchange" not in plan_of(found)
    assert {x["source_id"]: x["original_id"] for x in found.filter("source_id IN ('a7', 'a499')").collect()} == {"a7": 7, "a499": 499}


def test_contained_of_keys_with_few_and_many_texts(spark):
    """Keys on both sides of the bound for comparing each with each, and empty needles, give the same pairs."""
    needles = [(k, f"n{j}") for k, n in (("few", 3), ("asks", matching.FEW_NEEDLES + 1), ("holds", 2)) for j in range(n)] + [("few", ""), ("holds", "")]
    texts = [(k, f"xn{j}y") for k, n in (("few", 4), ("asks", 5), ("holds", matching.FEW_TEXTS + 1)) for j in range(n)]
    got = [tuple(x) for x in matching.contained(spark.createDataFrame(needles, "k string, needle string"), spark.createDataFrame(texts, "k string, text string"), ["k"]).collect()]
    assert sorted(got) == sorted((k, a, b) for k, a in needles for c, b in texts if k == c and a in b)


def test_pairs_of_a_group_are_dealt(spark):
    """Pairs within groups equal comparing all, with a group of many blocks, repeated values, nulls and a key that occurs twice; no task opens them all."""
    r = random.Random(4)
    rows = [(k, r.choice(["hot"] * 3 + ["cold", "cool", None]), r.choice(["a", "b", "c", None])) for k in range(120)] + [(5, "hot", "a"), (None, "hot", "a")]
    df = spark.createDataFrame(rows, "k int, g string, v string")
    want = sorted((a, b, *sorted((str(u), str(v)))) for a, g, u in rows for b, h, v in rows if None not in (a, b, g) and g == h and a < b)
    for block in (7, 256):
        got = matching.paired(df, ["g"], "k", "v", block, each=200)
        assert got.rdd.getNumPartitions() > 4
        opened = [(x, y, *sorted((str(row["a_value"]), str(row["b_value"])))) for row in got.collect() for x in row["a"] for y in row["b"] if x < y or x > y and not row["same"]]
        assert sorted((min(x, y), max(x, y), u, v) for x, y, u, v in opened) == want


def test_one_large_group_makes_no_long_task(spark, tmp_path):
    from quillmark.plans import catalog

    spark.range(1500).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n"), F.col("id") % 9).alias("p_name"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size"), F.lit("t").alias("p_type")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.title_similarity(spark, str(tmp_path))
    sizes = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1500 * 1499 // 2 and max(sizes) < 0.6 * sum(sizes)

"""Neighbour joins, ranks and name matching against brute force."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.operators import neighbours as nb
from ledgerloom.operators import registry as rg
from ledgerloom.operators.ranking import global_rank
from ledgerloom.session import dealt


def amounts(spark, seed=5, n=300):
    rnd = random.Random(seed)
    values = [None, 0, 0, 0, -5, -5] + [rnd.choice([100, 100.5, 5000, rnd.uniform(90, 110), rnd.uniform(1, 9000)]) for _ in range(n)]
    rows = [(i, None if v is None else Decimal(str(round(v, 2)))) for i, v in enumerate(values)]
    return rows, spark.createDataFrame(rows, "invoice_id long, total_value decimal(15,2)")


def test_nearest_by_amount(spark):
    rows, df = amounts(spark)
    expected = set()
    for i, v in rows:
        t = v if v is not None else Decimal(0)
        near = sorted((abs(w - t), j) for j, w in rows if j != i and w is not None
                      and t - t * Decimal("0.01") <= w <= t + t * Decimal("0.01"))
        expected |= {(i, j) for _, j in near[:4]}
    assert {(r[0], r[1]) for r in nb.nearest_by_amount(df, 4).collect()} == expected


def test_within_amount(spark):
    rows, df = amounts(spark)
    known = [(i, v) for i, v in rows if v is not None]
    expected = {i: sum(1 for j, w in known if j != i and abs(w - v) < 1000) for i, v in known}
    assert {r["invoice_id"]: r["partners"] for r in nb.within_amount(df, 1000).collect()} == expected


def code_sets(kind):
    rnd = random.Random(3)
    if kind == "few hot":
        return {i: set(rnd.choices("ABCDEFGHIJKLMNOP", weights=[60, 40, 30] + [3] * 13, k=rnd.choice([1, 2, 3, 5, 8]))) for i in range(120)}
    if kind == "copies":
        return {i: set("ABCDEF") if i % 3 else {"A", f"x{i % 7}"} for i in range(90)}
    template = [f"t{j}" for j in range(14)]  # wide and nearly equal: every combination would be frequent
    made = {i: set(template) - set(rnd.sample(template, rnd.randint(0, 2))) | {f"own{i % 11}"} for i in range(60)}
    return {**made, **{100 + i: {rnd.choice(template), f"z{i}"} for i in range(20)}}


@pytest.mark.parametrize("kind", ["few hot", "copies", "template"])
def test_most_shared_codes(spark, kind):
    rnd, sets = random.Random(4), code_sets(kind)
    rows = [(i, c) for i, s in sets.items() for c in s for _ in range(rnd.choice([1, 2]))] + [(500, None)]
    items = spark.createDataFrame(rows, "invoice_id long, hsn_code string")
    expected = {}
    for i, s in sets.items():
        ranked = sorted((-len(s & t), j) for j, t in sets.items() if j != i and s & t)[:5]
        expected |= {(i, j): -n for n, j in ranked}
    got = nb.most_shared_codes(items, 5).collect()
    assert len(got) == len(expected) and {(r["invoice_id"], r["candidate_id"]): r["shared_codes"] for r in got} == expected


@pytest.mark.parametrize("kind", ["few hot", "copies", "template"])
def test_lists_are_one_row_an_invoice(spark, kind):
    items = spark.createDataFrame([(i, c) for i, s in code_sets(kind).items() for c in s], "invoice_id long, hsn_code string")
    lists = nb.shared_lists(items, 5).collect()
    assert len({r["invoice_id"] for r in lists}) == len(lists) and all(len(r["candidate_id"]) == len(r["shared_codes"]) <= 5 for r in lists)


def test_tasks_follow_the_rows(spark):
    df, few = spark.range(1000), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(df, "id", 1000, 10).rdd.getNumPartitions() == max(100, few)
    assert "RepartitionByExpression" not in dealt(df, "id", 1000)._jdf.queryExecution().logical().toString()


def test_groups_stand_for_all_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "invoice_id long, k string")
    got = sorted((r["invoice_id"], r["first_id"], r["pairs_in_group"]) for r in nb.groups_with_members(df, ["k"]).collect())
    assert got == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]


def test_global_rank_equals_window_rank(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, rnd.choice([1.0, 2.5, -3.0, 0.0, rnd.uniform(-1e6, 1e6)])) for i in range(400)], "id long, v double")
    from pyspark.sql import Window as W

    direct = {r["id"]: r["r"] for r in df.withColumn("r", F.rank().over(W.orderBy(F.desc("v")))).collect()}
    assert {r["id"]: r["r"] for r in global_rank(df, "v", "r").collect()} == direct


def test_similar_names_lose_no_pair(spark):
    rnd = random.Random(2)
    words = ["alpha", "beta", "steel", "works", "pvt", "ltd", "traders", "gamma", "delta"]
    names = [" ".join(rnd.choices(words, weights=[3, 3, 3, 3, 30, 30, 9, 1, 1], k=rnd.choice([1, 2, 3, 4, 5]))) for _ in range(80)]
    left = spark.createDataFrame([(n,) for n in names[:40]], "name string")
    right = spark.createDataFrame([(n,) for n in names[20:]] + [("",), (None,)], "name string")
    pairs = left.distinct().join(right.where("name <> ''").distinct().withColumnRenamed("name", "other"), F.lit(True))
    score = fn.name_similarity(F.col("name"), F.col("other"))
    for threshold in (0.45, 0.6, 0.7, 0.9):
        expected = {(r[0], r[1]) for r in pairs.where(score >= threshold).collect()}
        assert {(r[0], r[1]) for r in rg.similar_names(left, right, threshold).collect()} == expected


def test_name_similarity_values(spark):
    rows = spark.createDataFrame([("a b", "a b"), ("ab cd", "ab ef"), ("", "x")], "a string, b string")
    got = [r[0] for r in rows.select(fn.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 4) for x in got] == [1.0, 0.3333, 0.0]


def test_a_word_that_all_names_have_is_no_key(spark):
    """20,000 names of a word and "limited", and as many of a word and "private limited": candidates stay linear."""
    rnd = random.Random(8)
    made = sorted({"".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(5, 12))) for _ in range(20_500)})[:20_000]
    two = spark.createDataFrame([(f"{w} limited",) for w in made], "name string")
    assert rg.candidate_names(two, two, 0.6).count() == 20_000
    three = spark.createDataFrame([(f"{w} private limited",) for w in made[:4000]], "name string")
    pairs = rg.candidate_names(three, three, 0.7)
    assert pairs.count() < 40 * 4000 and rg.similar_names(three, three, 0.7).count() >= 4000


def test_kept_frames_are_compressed_columns(spark):
    """What several jobs read is written as Parquet below the shared folder, empty frames and null columns too."""
    from pathlib import Path

    from ledgerloom.session import cut_lineage, shared_dir

    frame = spark.range(1000).selectExpr("id", "array(id, 1L) AS codes", "cast(NULL AS decimal(10,2)) AS price")
    kept = cut_lineage(frame)
    assert sorted(map(tuple, kept.select("id", "price").collect())) == [(i, None) for i in range(1000)] and kept.columns == frame.columns
    assert cut_lineage(frame.where("id < 0")).count() == 0
    files = kept.inputFiles()
    assert files and all(f.endswith(".parquet") and Path(shared_dir(spark)).name in f for f in files)

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitsight.functions import ordering
from splitsight.functions.ordering import cut_slots, exact_quantiles, linear_bucket, positions, rows_at


def skewed(spark, n=3000, seed=1):
    """One group holds most rows and most of its values are equal."""
    r = random.Random(seed)
    rows = [("a" if i % 5 else "b", i, 0.5 if r.random() < 0.6 else r.random() ** 6) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id bigint, v double")


def test_positions_match_sort(spark):
    rows, df = skewed(spark)
    got = positions(linear_bucket(df, ["g"], "v"), ["g"], ["v", "id"]).collect()
    for g in "ab":
        want = [i for _, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))]
        mine = [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.pos)]
        assert mine == want


def test_cut_slots_only_ranks_where_a_cut_falls(spark):
    rows, df = skewed(spark)
    cuts = spark.createDataFrame([("a", 700, 1500), ("b", 0, 600)], "g string, c0 bigint, c1 bigint")
    got = cut_slots(linear_bucket(df, ["g"], "v"), ["g"], ["v", "id"], cuts, ["c0", "c1"]).collect()
    assert len(got) == len(rows)
    for g, c0, c1 in (("a", 700, 1500), ("b", 0, 600)):
        order = [i for _, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))]
        want = {i: (k >= c0) + (k >= c1) for k, i in enumerate(order)}
        assert {r.id: r.slot for r in got if r.g == g} == want


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_exact_quantiles_match_numpy(spark, monkeypatch, accuracy):
    """Groups counted whole, and groups of which only the brackets are."""
    monkeypatch.setattr(ordering, "ACCURACY", accuracy)
    monkeypatch.setattr(ordering, "SMALL", 4 * accuracy)
    rows, df = skewed(spark)
    probs = [0.0, 0.02, 0.1, 0.5, 0.9, 0.975, 1.0]
    for cut in (df, df.repartition(13)):
        got = {(r.g, r.prob): (r.quantile, r.n) for r in exact_quantiles(cut, ["g"], "v", probs, count="n").collect()}
        for g in "ab":
            v = np.array([r[2] for r in rows if r[0] == g])
            for p in probs:
                assert abs(got[(g, p)][0] - np.quantile(v, p)) < 1e-12 and got[(g, p)][1] == len(v)


def test_quantiles_of_many_values_and_ties(spark, monkeypatch):
    """100,000 values, half of them equal, a far-off one: brackets hold their ranks; many groups go the other way."""
    rng = np.random.default_rng(3)
    v = np.concatenate((np.full(50_000, 0.25), rng.normal(size=49_999), [1e12]))
    rng.shuffle(v)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "g": np.arange(len(v)) % 3})).repartition(9)
    monkeypatch.setattr(ordering, "ACCURACY", 500)
    monkeypatch.setattr(ordering, "SMALL", 2000)
    probs = [0.001, 0.2, 0.4, 0.5, 0.6, 0.999]
    for few in (100_000, 1):
        monkeypatch.setattr(ordering, "FEW_ROWS", few)
        got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, ["g"], "v", probs).collect()}
        assert all(abs(got[g, p] - np.quantile(v[np.arange(len(v)) % 3 == g], p)) < 1e-9 for g in range(3) for p in probs)
    assert exact_quantiles(df, [], "v", [1.0]).first().quantile == 1e12


def test_two_scans_and_few_exchanges(spark):
    """One scan is done when the query is built (the sketch is written down), one stands in the plan."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    plan = exact_quantiles(df, ["l_returnflag"], "v", [0.1, 0.5, 0.9])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") <= 6


def test_rows_at(spark):
    rows, df = skewed(spark)
    shares = [(2 * i + 1) / 12 for i in range(6)]
    got = {(r.g, r.point): r.id for r in rows_at(linear_bucket(df, ["g"], "v"), ["g"], ["v", "id"], shares).collect()}
    for g in "ab":
        order = [i for _, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))]
        for k, q in enumerate(shares):
            assert got[(g, k)] == order[int(q * (len(order) - 1))]


def test_single_value_group(spark):
    df = spark.createDataFrame([("x", 1.5)] * 7, "g string, v double")
    assert exact_quantiles(df, ["g"], "v", [0.5]).first().quantile == 1.5
    assert exact_quantiles(df.withColumn("v", F.lit(None).cast("double")), ["g"], "v", [0.5]).count() == 0


def test_far_off_values_do_not_fill_one_bucket(spark):
    rows = [(i, float(i)) for i in range(5000)] + [(5000, 1e15), (5001, -1e15)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    largest = linear_bucket(df, [], "v").groupBy("_bkt").count().agg(F.max("count")).first()[0]
    assert largest <= 10
    got = [r.id for r in positions(linear_bucket(df, [], "v"), [], ["v"]).orderBy("pos").collect()]
    assert got == [5001, *range(5000), 5000]


def test_cut_slots_meets_the_table_in_a_broadcast_join(spark):
    rows, df = skewed(spark)
    table = linear_bucket(df, ["g"], "v")
    cuts = spark.createDataFrame([("a", 700), ("b", 10)], "g string, c0 bigint")
    out = cut_slots(table, ["g"], ["v", "id"], cuts, ["c0"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    first_join = next(line for line in plan.splitlines() if "Join" in line)
    assert "BroadcastHashJoin" in first_join and out.count() == len(rows)


def test_groups_beyond_the_limit_meet_in_a_shuffled_join(spark, monkeypatch):
    rows, df = skewed(spark)
    cuts = spark.createDataFrame([("a", 700), ("b", 10)], "g string, c0 bigint")
    cut = lambda: {
        (r.id, r.slot) for r in cut_slots(linear_bucket(df, ["g"], "v"), ["g"], ["v", "id"], cuts, ["c0"]).collect()
    }
    few = cut()
    monkeypatch.setattr(ordering, "FEW_ROWS", 1)
    monkeypatch.setattr(ordering, "few_rows", lambda *a, **k: False)
    assert cut() == few


def test_cuts_at_the_ends_and_with_ties(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "id bigint, v double")
    cuts = spark.createDataFrame([(0, 10, 30, 99)], "a bigint, b bigint, c bigint, d bigint")
    got = {r.id: r.slot for r in cut_slots(linear_bucket(df, [], "v"), [], ["v", "id"], cuts, list("abcd")).collect()}
    assert got == {i: 1 if i % 3 == 0 else 2 for i in range(30)}
    empty = df.limit(0)
    assert cut_slots(linear_bucket(empty, [], "v"), [], ["v", "id"], cuts, list("abcd")).count() == 0


@pytest.mark.parametrize("parts", ["1", "7", "200"])
def test_running_totals_in_ranges(spark, parts):
    """The same sums with one task and with two hundred; a group with most rows is cut like any other."""
    rng = random.Random(4)
    rows = [(rng.choice("aaaaab"), v, rng.randrange(5), rng.randrange(3)) for v in rng.sample(range(10**6), 3000)] + [("a", None, 2, 1)]
    df = spark.createDataFrame(rows, "g string, v bigint, x bigint, y bigint")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.g, r.v): (r.sx, r.sy, r.sx_total) for r in ordering.running_totals(df, ["g"], [F.col("v").desc_nulls_last()], {"sx": "x", "sy": "y"}).collect()}
        whole = ordering.running_totals(df, [], [F.col("v").desc_nulls_last()], {"sx": "x"}).agg(F.max("sx"), F.min("sx_total")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows) and whole[0] == whole[1] == sum(r[2] for r in rows)
    for g in "ab":
        run = [0, 0]
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0)))
        for _, v, x, y in mine:
            run = [run[0] + x, run[1] + y]
            assert got[g, v] == (*run, sum(r[2] for r in mine))

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stowage.operators import skew


def rows_of(spark, n=6000):
    """One key with a third of all rows, some smaller ones, a null key, and equal rows."""
    data = [("big", i % 7) for i in range(n // 3)] + [(f"k{i % 97}", i) for i in range(n // 2)] + [(None, i) for i in range(n // 12)] + [("mid", 1)] * (n // 12)
    return data, spark.createDataFrame(data, "game string, size long").repartition(5)


def test_hash_is_sparks(spark):
    got = spark.sql("select hash('abc') h, hash('abc', 17) a, hash('abc', -3) b").first()
    import numpy as np

    assert skew.hash_int(np.array([17]), got["h"])[0] == got["a"]
    assert skew.hash_int(np.array([-3]), got["h"])[0] == got["b"]


def test_shards_land_where_planned(spark):
    data, df = rows_of(spark)
    plan = skew.plan_load(df, ["game"], tasks=8)
    assert plan.total == len(data) and ("big",) in plan.heavy and len(set(plan.heavy[("big",)])) > 1
    placed = skew.spread(df, plan).repartition(8, "game", "_salt").groupBy(F.spark_partition_id().alias("p")).count().collect()
    counts = [r["count"] for r in placed]
    assert sum(counts) == len(data) and max(counts) < 2 * len(data) / 8
    assert max(plan.loads) < 2 * plan.total / 8


def test_aggregate_is_the_plain_one(spark):
    data, df = rows_of(spark)
    want = defaultdict(lambda: [0, 0, None])
    for k, v in data:
        want[k][0] += 1
        want[k][1] += v
        want[k][2] = v if want[k][2] is None else max(want[k][2], v)
    got = skew.balanced_aggregate(df, ["game"], {"n": ("count", None), "total": ("sum", "size"), "most": ("max", "size")}, tasks=8).collect()
    assert {r["game"]: [r["n"], r["total"], r["most"]] for r in got} == dict(want)
    assert len(got) == len(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_is_the_plain_one(spark, how):
    _, df = rows_of(spark, 1200)
    right = spark.createDataFrame([("big", 1), ("big", 2), ("k1", 3), ("none", 4), (None, 5)], "game string, size int")
    got = skew.fragment_replicate_join(df, right, [("game", "game")], how, tasks=4)
    plain = df.join(right.toDF("right_game", "right_size"), F.col("game") == F.col("right_game"), how)
    assert got.columns == plain.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))


def test_clashing_names_and_empty_tables(spark):
    left = spark.createDataFrame([(1, 2, 3)], "a int, _salt int, _heavy0 int")
    right = spark.createDataFrame([(1, 7)], "a int, _right_salt int")
    assert [tuple(r) for r in skew.fragment_replicate_join(left, right, [("a", "a")], tasks=2).collect()] == [(1, 2, 3, 1, 7)]
    empty = left.where("a > 5")
    assert skew.fragment_replicate_join(empty, right, [("a", "a")]).collect() == []
    assert skew.fragment_replicate_join(left, right.where("a > 5"), [("a", "a")], "left").count() == 1
    assert skew.balanced_aggregate(empty, ["a"], {"_salt": ("count", None)}).collect() == []
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(left, right, [("a", "a")], "full_outer")


def test_spread_by_columns_is_repeatable(spark):
    _, df = rows_of(spark, 900)
    plan = skew.plan_load(df, ["game"], tasks=4)
    one = Counter(map(tuple, skew.spread(df, plan, by=["size"]).collect()))
    assert one == Counter(map(tuple, skew.spread(df.repartition(3), plan, by=["size"]).collect()))

import random

import pytest
from pyspark.sql import functions as F

from hindcast.operators import spread


def test_ranks_are_dense_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.choice([None, *range(20)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, i int").repartition(7)
    got = spread.ranked(df, "rank", "a", "b", "i").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(3000))
    assert [r["i"] for r in got] == [r[2] for r in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))]


def test_ranks_of_nothing(spark):
    df = spark.createDataFrame([], "a int")
    assert spread.ranked(df, "rank", "a").collect() == []


def test_ranking_uses_no_window_and_one_shuffle(spark):
    plan = spread.in_order(spark.range(1000).withColumn("x", F.col("id") % 7), "x", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(spread, "KEY_ROWS", 10)
    rows = [(1, i) for i in range(500)] + [(k, k) for k in range(2, 40)] + [(None, 1), (99, 5)]
    left = spark.createDataFrame(rows, "k int, v int")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(60)], "k int, name string")
    got = spread.spread_join(left, right, "k", F.col("v"), how)
    assert got.columns == ["k", "v", "name"]
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    # The hot key has fifty places.
    moved = spread.spread_join(left, right, ["k"], F.col("v"), how)._jdf.queryExecution().analyzed().toString()
    assert "_place" in moved

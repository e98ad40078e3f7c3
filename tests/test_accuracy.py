import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hindcast.functions.numeric import round_half_even
from hindcast.operators import accuracy
from hindcast.operators import median, spread
from hindcast.operators.median import grouped_medians

MATCHED = "parent_code bigint, snop_month string, actual_kl double, oldest_fc double, latest_fc double, brand string"


def frame(spark, rows):
    return spark.createDataFrame(rows, MATCHED).withColumn("snop_month", F.to_date("snop_month"))


def fa(spark, rows, vintage="oldest"):
    df = frame(spark, [(i, "2026-01-01", a, o, o, "b") for i, (a, o) in enumerate(rows)])
    row = accuracy.fa(df, ["brand"], vintage).first()
    return row.abs_err, row.denom, row.fa


def test_errors_are_summed_before_dividing(spark):
    assert fa(spark, [(100.0, 50.0), (10.0, 20.0)]) == (60.0, 110.0, (1 - 60 / 110) * 100)


def test_zero_and_negative_actuals(spark):
    assert fa(spark, [(0.0, 5.0)]) == (5.0, 0.0, -math.inf)
    assert math.isnan(fa(spark, [(0.0, 0.0)])[2])
    assert fa(spark, [(-4.0, 2.0)]) == (6.0, -4.0, 250.0)


def test_missing_forecast_adds_no_error_but_its_actual_counts(spark):
    assert fa(spark, [(10.0, None), (10.0, 5.0)]) == (5.0, 20.0, 75.0)
    assert fa(spark, [(10.0, None)]) == (0.0, 10.0, 100.0)


def test_unknown_arguments(spark):
    df = frame(spark, [])
    with pytest.raises(ValueError):
        accuracy.fa(df, ["brand"], "newest")
    with pytest.raises(ValueError):
        accuracy.heat_metric(df, "brand")


ROWS = [
    (1, "2026-01-01", 10.0, 5.0, 8.0, "B"),
    (2, "2026-01-01", 20.0, 30.0, 20.0, "A"),
    (3, "2026-02-01", 0.0, 5.0, 0.0, "A"),
    (4, "2026-02-01", 9.0, 9.0, 9.0, None),
]


def test_brand_filter(spark):
    df = frame(spark, ROWS)
    assert [r.brand for r in accuracy.brand_list(df).collect()] == ["A", "B"]

    def kept(brands):
        return sorted(r.parent_code for r in accuracy.filter_brands(df, brands).collect())

    assert kept(None) == [1, 2, 3]
    assert kept(["A"]) == [2, 3] == kept(accuracy.brand_list(df).filter("brand = 'A'"))
    assert kept([]) == []
    assert accuracy.filter_brands(df, accuracy.brand_list(df)).columns == df.columns


def test_by_month_and_by_brand(spark):
    df = accuracy.filter_brands(frame(spark, ROWS))
    months = [(str(r.snop_month), r.fa_oldest, r.fa_latest) for r in accuracy.fa_by_month(df).collect()]
    assert months[0] == ("2026-01-01", 50.0, (1 - 2 / 30) * 100)
    assert months[1][1] == -math.inf and math.isnan(months[1][2])
    table = {(r.brand, str(r.snop_month)): r for r in accuracy.fa_by_brand_month(df).collect()}
    assert set(table) == {
        (b, f"2026-0{m}-01") for b, m in [("All brands", 1), ("All brands", 2), ("A", 1), ("B", 1), ("A", 2)]
    }
    assert (table["A", "2026-01-01"].fa_oldest, table["A", "2026-01-01"].delta) == (50.0, 50.0)
    assert math.isnan(table["A", "2026-02-01"].delta)
    assert table["All brands", "2026-01-01"].delta == pytest.approx(months[0][2] - 50.0)


def test_missing_brand_is_not_the_overall_row(spark):
    got = accuracy.fa_by_brand_month(frame(spark, ROWS[3:])).collect()
    assert sorted(str(r.brand) for r in got) == ["All brands", "None"]


def test_long_form_keeps_missing_values(spark):
    df = spark.createDataFrame([("2026-01-01", None, 2.0)], "snop_month string, fa_oldest double, fa_latest double")
    assert {(r.vintage, r.fa) for r in accuracy.fa_long(df).collect()} == {("oldest", None), ("latest", 2.0)}


def test_brand_order(spark):
    rows = [(i, "2026-01-01", 10.0, 0.0, f, b) for i, (b, f) in enumerate([("C", 9.0), ("A", 9.0), ("B", 1.0)])]
    got = accuracy.brand_order(frame(spark, rows)).orderBy("position").collect()
    assert [(r.position, r.brand) for r in got] == [(0, "All brands"), (1, "B"), (2, "A"), (3, "C")]
    assert [r.position for r in accuracy.brand_order(frame(spark, [])).collect()] == [0]


def bias(spark, rows):
    return accuracy.brand_bias(frame(spark, [(i, "2026-01-01", *r, "b") for i, r in enumerate(rows)])).first()


def test_bias(spark):
    row = bias(spark, [(10.0, 5.0, 8.0), (10.0, 8.0, 5.0), (10.0, 4.0, 4.0), (10.0, 1.0, 2.0), (0.0, 9.0, 99.0)])
    assert (row.n, row.total_actual_kl, row.pct_revised_up, row.pct_revised_down) == (4, 40.0, 50.0, 25.0)
    assert (row.mean_revision_kl, row.med_oldest_over, row.med_latest_over) == (0.25, 0.45, 0.45)


def test_missing_forecast_counts_in_n_only(spark):
    row = bias(spark, [(10.0, None, 8.0), (10.0, 2.0, 4.0)])
    assert (row.n, row.pct_revised_up, row.mean_revision_kl, row.med_oldest_over, row.med_latest_over) == (2, 100.0, 2.0, 0.2, 0.6)
    row = bias(spark, [(10.0, None, None)])
    assert (row.n, row.pct_revised_up, row.med_oldest_over) == (1, None, None)


def test_halves_round_to_even(spark):
    assert bias(spark, [(10.0, 1.0, 1.125)]).mean_revision_kl == 0.12
    assert spark.range(1).select(round_half_even(F.lit(49) / F.lit(400) * 100, 1).alias("x")).first().x == 12.2


def test_top_brands_with_a_tie_at_the_cut(spark):
    rows = [(i, "2026-01-01", 5.0 if i < 30 else 50.0, 1.0, 1.0, f"b{i:02d}") for i in range(31)]
    top = accuracy.top_brands(accuracy.brand_bias(frame(spark, rows))).collect()
    assert [r.brand for r in top] == ["b30"] + [f"b{i:02d}" for i in range(24)]


def test_bias_sorted_with_missing_medians_first(spark):
    rows = [(1, "2026-01-01", 1.0, 1.0, 2.0, "x"), (2, "2026-01-01", 1.0, 1.0, 3.0, "y"), (3, "2026-01-01", 1.0, None, None, "z")]
    assert [r.brand for r in accuracy.brand_bias(frame(spark, rows)).collect()] == ["z", "y", "x"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_medians_against_brute_force(spark, seed):
    rng = random.Random(seed)
    groups = {}
    for k in [None, "a", "b", "c", "hot"]:
        n = 3000 if k == "hot" else rng.randint(1, 40)
        draw = rng.choice([lambda: rng.gauss(1, 0.2), lambda: rng.lognormvariate(0, 4), lambda: float(rng.randint(-3, 3)), lambda: 1 + rng.random() * 1e-9])
        groups[k] = [draw() for _ in range(n)]
    rows = [(k, v, -v) for k, vs in groups.items() for v in vs] + [("a", None, None), ("empty", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r.k: r for r in grouped_medians(df, ["k"], {"mv": F.col("v"), "mw": F.col("w")}).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].mv == pytest.approx(statistics.median(vs), rel=1e-12, abs=1e-300)
        assert got[k].mw == pytest.approx(-statistics.median(vs), rel=1e-12, abs=1e-300)
    built_in = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert all(got[k].mv == pytest.approx(built_in[k], rel=1e-12, abs=1e-300) for k in groups)


def test_median_of_values_close_together_is_cut_into_small_parts(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("g").alias("k"), (1 + (F.col("id") * 7919 % n - n / 2) * 1e-9).alias("v"))
    largest = median.value_ranks(df, ["k"], {"m": F.col("v")}).groupBy("k", "measure", "bucket", "part").count()
    assert largest.agg(F.max("count")).first()[0] < 200
    got = grouped_medians(df, ["k"], {"m": F.col("v")}).first().m
    assert got == pytest.approx(1 - 0.5e-9, abs=1e-15)


def test_medians_with_infinities(spark):
    inf = float("inf")
    rows = [("a", inf), ("a", inf), ("a", 1.0), ("b", -inf), ("b", 5.0), ("b", inf)]
    got = grouped_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], {"m": F.col("v")}).collect()
    assert {r.k: r.m for r in got} == {"a": inf, "b": 5.0}


def test_brand_order_counts_on_over_steps(spark):
    rows = [(i, "2026-01-01", 10.0, 1.0, float(i % 7 * 5), f"b{i:02d}") for i in range(40)]
    got = accuracy.brand_order(frame(spark, rows)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(41))
    assert [(r.fa_latest, r.brand) for r in got[1:]] == sorted((r.fa_latest, r.brand) for r in got[1:])


def test_invariants_on_random_rows(spark):
    rng = random.Random(5)
    rows = [
        (i, f"2026-{rng.randint(1, 6):02d}-01", float(rng.randint(0, 50)), float(rng.randint(0, 50)), float(rng.randint(0, 50)), rng.choice("ABC"))
        for i in range(400)
    ]
    df = frame(spark, rows)
    total = accuracy.fa(df, ["snop_month"], "latest").groupBy().agg(F.sum("abs_err"), F.sum("denom")).first()
    parts = accuracy.fa(df, ["brand", "snop_month"], "latest").groupBy().agg(F.sum("abs_err"), F.sum("denom")).first()
    assert tuple(total) == tuple(parts)
    assert all(r.pct_revised_up + r.pct_revised_down <= 100.1 for r in accuracy.brand_bias(df).collect())
    same = accuracy.fa_by_month(df.withColumn("latest_fc", F.col("oldest_fc"))).collect()
    assert all(r.fa_oldest == r.fa_latest for r in same)


def test_few_rows_are_shuffled_by_value(spark):
    """Histograms come first; of the rows only those about the middle move, and the median stays exact."""
    n = 300_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.lit("hot")).alias("k"),
        F.exp((F.col("id") * 7919 % n) / n * 4 - 2).alias("v"),
    )
    moved = median.middle_rows(df, ["k"], {"m": F.col("v")})
    assert moved.count() < n / 100
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    got = {r.k: r.m for r in grouped_medians(df, ["k"], {"m": F.col("v")}).collect()}
    built_in = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == {k: pytest.approx(v, rel=1e-12) for k, v in built_in.items()}


def test_medians_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(k, float(v)) for k in "ab" for v in range(k == "a", 50)], "k string, v double")
    assert {r.k: r.m for r in grouped_medians(df, ["k"], {"m": F.col("v")}).collect()} == {"a": 25.0, "b": 24.5}


def test_brand_order_uses_no_window(spark):
    rows = [(i, "2026-01-01", 10.0, 1.0, float(i % 7), f"b{i:02d}") for i in range(40)]
    plan = accuracy.brand_order(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hindcast.operators import quality
from hindcast.operators.exact import exact_sums


def sums(df, keys=("k",)):
    return {tuple(r[k] for k in keys): r.s for r in exact_sums(df, list(keys), F.col("v"), "s").collect()}


def test_same_bits_under_any_partitioning(spark):
    """A million values of mixed magnitudes, in three orders and numbers of partitions."""
    n = 1_000_000
    sign = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    value = sign * F.pow(F.lit(10.0), F.pmod(F.xxhash64("id"), F.lit(24)) - 8) * (1 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) / 1_000_003)
    df = spark.range(n).select((F.col("id") % 3).alias("k"), value.alias("v"), F.xxhash64("id").alias("o"))
    got = [sums(d) for d in (df, df.repartition(37, "o"), df.orderBy("v").coalesce(1))]
    assert got[0] == got[1] == got[2]
    rows = df.collect()
    for k in range(3):
        true = sum((Fraction(r.v) for r in rows if r.k == k), Fraction(0))
        assert abs(Fraction(got[0][k,]) - true) <= Fraction(math.ulp(float(true)))
    plain = {float(d.filter("k = 0").agg(F.sum("v")).first()[0]) for d in (df, df.orderBy("v").coalesce(1))}
    assert len(plain) == 2


@pytest.mark.parametrize("seed", range(3))
def test_against_fractions(spark, seed):
    rng = random.Random(seed)
    draws = [lambda: rng.gauss(0, 1), lambda: math.ldexp(rng.random() - 0.5, rng.randint(-1070, 1010)), lambda: rng.choice([5e-324, -5e-324, 2.0**53, 0.1, -0.0, 1e308])]
    rows = [(k, rng.choice(draws)()) for k in range(20) for _ in range(rng.randint(1, 60))] + [(1, None), (30, None)]
    got = sums(spark.createDataFrame(rows, "k int, v double").repartition(5))
    for (k,), s in got.items():
        true = sum((Fraction(v) for key, v in rows if key == k and v is not None), Fraction(0))
        if abs(true) < Fraction(1.7e308):
            assert abs(Fraction(s) - true) <= Fraction(math.ulp(float(true)))


def test_values_that_cancel_out_and_that_are_no_numbers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("zero", 1e300), ("zero", 1e-300), ("zero", -1e300), ("zero", -1e-300), ("nan", nan), ("nan", 1.0)]
    rows += [("inf", inf), ("inf", -5.0), ("both", inf), ("both", -inf)]
    got = {k: v for (k,), v in sums(spark.createDataFrame(rows, "k string, v double")).items()}
    assert got["zero"] == 0.0 and got["inf"] == inf and math.isnan(got["nan"]) and math.isnan(got["both"])
    assert sums(spark.createDataFrame([], "k string, v double")) == {}


def test_large_folders_reconcile(spark):
    """Plain sums of these cells are off by far more than the tolerance; the folder is good all the same."""
    n = 400_000
    cells = spark.range(n).select(
        F.lit("f").alias("file"), F.lit("2025-01").alias("snop_month"), F.when(F.col("id") % 2 == 0, 1e15 + 0.125).otherwise(-1e15).alias("qty")
    )
    total = spark.createDataFrame([("f", "2025-01", n / 2 * 0.125)], "file string, snop_month string, gt double")
    checked = quality.reconcile(cells, total)
    assert checked.collect()[0].max_abs_diff_vs_grand_total == 0.0
    off = spark.createDataFrame([("f", "2025-01", n / 2 * 0.125 + 1e-5)], "file string, snop_month string, gt double")
    assert quality.offenders(quality.reconcile(cells, off)).count() == 1

import math
import random

import pytest
from pyspark.sql import functions as F

from hindcast.functions.numeric import (
    ieee_div,
    is_non_numeric,
    lenient_double,
    round_half_even,
    sum0,
    value_bucket,
)
from hindcast.functions.text import normal_name, normal_name_col, normalise_headers, strip


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sum_of_nulls_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, None)], "k int, v double")
    assert {r.k: r.s for r in df.groupBy("k").agg(sum0(F.col("v")).alias("s")).collect()} == {1: 0.0, 2: 3.0}


@pytest.mark.parametrize(
    "a, b, expected",
    [(1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (3.0, 2.0, 1.5), (1.0, -2.0, -0.5), (None, 0.0, None), (1.0, None, None)],
)
def test_division(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(ieee_div(F.col("a"), F.col("b")).alias("x")).first().x == expected


def test_division_zero_by_zero_and_nan(spark):
    df = spark.createDataFrame([(0.0, 0.0), (math.nan, 0.0), (math.nan, 1.0)], "a double, b double")
    assert all(math.isnan(r.x) for r in df.select(ieee_div(F.col("a"), F.col("b")).alias("x")).collect())


@pytest.mark.parametrize(
    "value, digits, expected",
    [(0.25, 1, 0.2), (0.75, 1, 0.8), (12.25, 1, 12.2), (0.125, 2, 0.12), (0.375, 2, 0.38), (-0.125, 2, -0.12), (2.5, 0, 2.0)],
)
def test_half_even(spark, value, digits, expected):
    assert one(spark, round_half_even(F.lit(value), digits)) == expected


@pytest.mark.parametrize(
    "cell, value, flagged",
    [
        ("239.9954", 239.9954, False),
        ("-3", -3.0, False),
        (".5", 0.5, False),
        ("12.", 12.0, True),
        ("1e5", 1e5, True),
        (" 12 ", None, True),
        ("n/a", None, True),
        ("12d", None, True),
        ("0x1p3", None, True),
        ("", None, True),
        (None, None, False),
    ],
)
def test_cells(spark, cell, value, flagged):
    text = F.lit(cell).cast("string")
    assert one(spark, lenient_double(text)) == value
    assert one(spark, is_non_numeric(text)) is flagged


def test_bucket_keeps_order(spark):
    random.seed(3)
    values = [s * m * 10.0**e for s in (1, -1) for e in range(-300, 301, 20) for m in (1.0, random.uniform(1, 9.9))]
    values += [0.0, 5e-324, -5e-324, 1.7976931348623157e308, math.inf, -math.inf] + [random.gauss(1, 0.01) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_bucket(F.col("v"), 512).alias("b"))
    ordered = [r.b for r in sorted(df.collect(), key=lambda r: r.v)]
    assert ordered == sorted(ordered)
    assert one(spark, value_bucket(F.lit(math.nan), 512)) > max(ordered)


def test_header_names(spark):
    names = ["Parent Material Code", "Month-Year", "Sec Vol KL MTH (billwise)", "\tBrand\n"]
    expected = ["parent_material_code", "month_year", "sec_vol_kl_mth_(billwise)", "brand"]
    assert [normal_name(n) for n in names] == expected
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.x for r in df.select(normal_name_col(F.col("n")).alias("x")).collect()] == expected
    assert normalise_headers(spark.createDataFrame([(1,)], "`Month-Year` int")).columns == ["month_year"]


def test_strip_removes_any_white_space(spark):
    assert one(spark, strip(F.lit("  Apr\t\n"))) == "Apr"

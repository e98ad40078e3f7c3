import pytest
from pyspark.sql import functions as F

from hindcast.functions.months import iso_date, month_key, month_key_date, month_year_date
from hindcast.operators.grid import name_window


def window(spark, name):
    return name_window(spark.createDataFrame([(name,)], "file string")).first()


def file(span):
    return f"S&OP_grid file_{span}_circulation.xlsx"


@pytest.mark.parametrize(
    "span, keys",
    [
        ("Nov-25 to Mar-26", ["2025-11", "2025-12", "2026-01", "2026-02", "2026-03"]),
        ("Aug-25 to Aug-25", ["2025-08"]),
        ("Feb-25 to Jan-26", [f"2025-{m:02d}" for m in range(2, 13)] + ["2026-01"]),
        ("Feb-25 to Feb-26", None),
        ("Mar-26 to Nov-25", None),
        ("Foo-25 to Mar-26", None),
    ],
)
def test_window(spark, span, keys):
    row = window(spark, file(span))
    assert row.name_matches
    assert (row.window and [m.snop_month for m in row.window]) == keys


@pytest.mark.parametrize(
    "name",
    [
        "copy of " + file("Nov-25 to Mar-26"),
        file("Nov-25 to Mar-26") + ".bak",
        file("Nov-25 to Mar-26").lower(),
        file("November-25 to Mar-26"),
        file("Nov-2025 to Mar-26"),
    ],
)
def test_name_must_match_whole(spark, name):
    row = window(spark, name)
    assert not row.name_matches and row.window is None


def test_unknown_month_in_another_script_matches_the_pattern(spark):
    row = window(spark, file("Mär-25 to Apr-25"))
    assert row.name_matches and row.start_abbr == "Mär" and row.start_index is None


def value(spark, column):
    return str(spark.range(1).select(column.alias("x")).first().x)


def test_dates_and_keys(spark):
    assert value(spark, month_key_date(F.lit("2025-12"))) == "2025-12-01"
    assert value(spark, month_key(month_key_date(F.lit("2025-12")))) == "2025-12"
    assert value(spark, iso_date(F.lit("2026-02-01"))) == "2026-02-01"
    assert value(spark, month_year_date(F.lit("Apr-2024"))) == "2024-04-01"


@pytest.mark.parametrize(
    "parse, text", [(month_key_date, "2025-13"), (month_key_date, "25/1"), (iso_date, "01-02-2026"), (month_year_date, "2024-04")]
)
def test_malformed_dates_raise(spark, parse, text):
    with pytest.raises(Exception):
        spark.createDataFrame([(text,)], "t string").select(parse(F.col("t"))).collect()

"""Forecast vintages matched with actual sales and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.months import iso_date, month_year_date
from hindcast.functions.numeric import sum0
from hindcast.functions.text import normalise_headers

# Header names of the sales sheet after normalisation.
ACTUALS_HEADER = ["parent_material_code", "month_year", "sec_vol_kl_mth_(billwise)"]
# A day number below that of 0001-01-01, the first date there is.
BEFORE_ALL_DAYS = -1_000_000


def typed_forecasts(raw: DataFrame) -> DataFrame:
    """Forecast rows with ``yyyy-MM-dd`` text months turned into dates; bad text raises."""
    return raw.select(
        F.col("parent_code").cast("bigint").alias("parent_code"),
        iso_date(F.col("calculation_month")).alias("calculation_month"),
        iso_date(F.col("snop_month")).alias("snop_month"),
        F.col("fc_kl").cast("double").alias("fc_kl"),
    )


def monthly_actuals(raw: DataFrame) -> DataFrame:
    """Bill-wise sales rows summed to one volume per product and month.

    Headers are normalised first. A product-month with nothing but nulls has volume 0.
    """
    named = normalise_headers(raw).withColumnsRenamed(
        dict(zip(ACTUALS_HEADER, ["parent_code", "snop_month", "actual_kl"], strict=True))
    )
    return (
        named.select(
            F.col("parent_code").cast("bigint").alias("parent_code"),
            month_year_date(F.col("snop_month")).alias("snop_month"),
            F.col("actual_kl").cast("double").alias("actual_kl"),
        )
        .groupBy("parent_code", "snop_month")
        .agg(sum0(F.col("actual_kl")).alias("actual_kl"))
    )


def brand_of_product(raw: DataFrame) -> DataFrame:
    """One brand per product from a hierarchy that may list a product more than once.

    The row with the smallest description, then the smallest brand, is kept.
    """
    return (
        raw.select(
            F.col("material_code").cast("bigint").alias("parent_code"),
            "material_desc",
            F.col("material_group_code").alias("brand"),
        )
        .groupBy("parent_code")
        .agg(F.min_by("brand", F.struct("material_desc", "brand")).alias("brand"))
    )


def vintages(forecasts: DataFrame) -> DataFrame:
    """Oldest and latest forecast per product and target month, null values included.

    Forecasts go by (calculation month, value): a null month comes before all others, and of
    several forecasts of one month the smallest counts as the oldest and the largest as the
    latest, a null being smaller than any value. Forecasts of one month are merged first, so
    both aggregates order by a plain day number and stay hash aggregates that combine before
    they shuffle.
    """
    value = F.col("fc_kl")
    day = F.coalesce(F.unix_date("calculation_month"), F.lit(BEFORE_ALL_DAYS)).alias("day")
    merged = forecasts.groupBy("parent_code", "snop_month", day).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(value.isNull()).alias("nulls")
    )
    return merged.groupBy("parent_code", "snop_month").agg(
        F.min_by(F.when(F.col("nulls") == 0, F.col("low")), "day").alias("oldest_fc"),
        F.max_by("high", "day").alias("latest_fc"),
    )


def matched_frame(forecasts: DataFrame, actuals: DataFrame, brands: DataFrame) -> DataFrame:
    """Product-months that have an actual: volume, oldest and latest forecast, brand.

    Both sides are aggregated to one row per product-month before they meet, so the join
    is one to one, uses the partitioning of the aggregates, and no hot key reaches it.
    """
    return (
        vintages(forecasts)
        .join(actuals, ["parent_code", "snop_month"])
        .filter(F.col("actual_kl").isNotNull())
        .join(brands, "parent_code", "left")
        .select("parent_code", "snop_month", "actual_kl", "oldest_fc", "latest_fc", "brand")
    )

"""Forecast accuracy and revision bias over the matched frame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.numeric import ieee_div, round_half_even, sum0
from hindcast.operators.median import grouped_medians
from hindcast.operators.spread import ranked
from hindcast.sources.shared import settle

# The two vintages, the label of the overall rows, the metrics of the
# brand-by-month table and the number of brands a bias chart shows.
VINTAGES = ("oldest", "latest")
ALL_BRANDS = "All brands"
METRICS = ("fa_latest", "fa_oldest", "delta")
TOP_BRANDS = 25


def brand_list(matched: DataFrame) -> DataFrame:
    """Distinct brands in order; products without a brand add none."""
    return matched.select("brand").dropna().distinct().orderBy("brand")


def filter_brands(matched: DataFrame, brands: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """Rows of the chosen brands; all brands by default. Rows without a brand never pass."""
    if brands is None:
        return matched.filter(F.col("brand").isNotNull())
    if isinstance(brands, DataFrame):
        return matched.join(brands.select("brand"), "brand", "left_semi").select(*matched.columns)
    return matched.filter(F.col("brand").isin(list(brands)))


def _abs_err(vintage: str) -> Column:
    return sum0(F.abs(F.col(f"{vintage}_fc") - F.col("actual_kl")))


def _accuracy(abs_err: Column, denom: Column) -> Column:
    return (1 - ieee_div(abs_err, denom)) * 100


def fa(matched: DataFrame, groups: list[str], vintage: str) -> DataFrame:
    """Volume-weighted accuracy of one vintage: (1 - sum of errors / sum of actuals) * 100.

    Errors are taken per product-month and summed before dividing. A row without a
    forecast adds no error, yet its actual still counts.
    """
    if vintage not in VINTAGES:
        raise ValueError(f"vintage is one of {VINTAGES}")
    return (
        matched.groupBy(*groups)
        .agg(_abs_err(vintage).alias("abs_err"), sum0(F.col("actual_kl")).alias("denom"))
        .withColumn("fa", _accuracy(F.col("abs_err"), F.col("denom")))
    )


def _both_sums(matched: DataFrame, groups: list[str]) -> DataFrame:
    return matched.groupBy(*groups).agg(
        *[_abs_err(v).alias(f"err_{v}") for v in VINTAGES], sum0(F.col("actual_kl")).alias("denom")
    )


def _with_fa(sums: DataFrame) -> DataFrame:
    return sums.withColumns({f"fa_{v}": _accuracy(F.col(f"err_{v}"), F.col("denom")) for v in VINTAGES})


def fa_by_month(matched: DataFrame) -> DataFrame:
    """Accuracy of both vintages by month, from one aggregate, in no order."""
    return _with_fa(_both_sums(matched, ["snop_month"])).select("snop_month", "fa_oldest", "fa_latest")


def fa_long(by_month: DataFrame) -> DataFrame:
    """One row per month and vintage, for plotting."""
    return by_month.unpivot("snop_month", ["fa_oldest", "fa_latest"], "vintage", "fa").withColumn(
        "vintage", F.replace("vintage", F.lit("fa_"), F.lit(""))
    )


def fa_by_brand_month(matched: DataFrame) -> DataFrame:
    """Accuracy of both vintages and their difference, by brand and month and over all brands.

    Sums are taken once by brand and month; the overall rows come from those few sums, so
    the grouping sets do not double the rows of the matched frame.
    """
    sums = _both_sums(matched, ["brand", "snop_month"])
    columns = ["err_oldest", "err_latest", "denom"]
    levels = sums.groupingSets([["snop_month"], ["brand", "snop_month"]], "brand", "snop_month").agg(
        F.grouping("brand").alias("overall"), *[F.sum(c).alias(c) for c in columns]
    )
    return (
        _with_fa(levels)
        .withColumn("delta", F.col("fa_latest") - F.col("fa_oldest"))
        .select(
            F.when(F.col("overall") == 1, ALL_BRANDS).otherwise(F.col("brand")).alias("brand"),
            "snop_month",
            "fa_oldest",
            "fa_latest",
            "delta",
        )
    )


def heat_metric(by_brand_month: DataFrame, metric: str = "fa_latest") -> DataFrame:
    """The chosen metric of the brand-by-month table under the name ``metric``."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    return by_brand_month.select("brand", "snop_month", F.col(metric).alias("metric"))


def brand_order(matched: DataFrame) -> DataFrame:
    """Display order of brands: the overall row first, then by accuracy of the latest vintage.

    Equal accuracies go by name. Brands are put in order by ranges and numbered in their tasks,
    so no window sees them; sums by brand are made once and written.
    """
    rated = settle(fa(matched, ["brand"], "latest").select("brand", F.col("fa").alias("fa_latest")), "rated")
    numbered = ranked(rated, "position", F.asc_nulls_first("fa_latest"), "brand")
    numbered = numbered.select("brand", "fa_latest", F.col("position") + 1)
    overall = matched.sparkSession.range(1).select(
        F.lit(ALL_BRANDS).alias("brand"), F.lit(None).cast("double").alias("fa_latest"), F.col("id").alias("position")
    )
    return overall.unionByName(numbered.toDF("brand", "fa_latest", "position"))


def brand_bias(matched: DataFrame) -> DataFrame:
    """Per brand, over product-months with a positive actual: volume, shares of forecasts
    revised up and down, mean revision, and the median forecast-to-actual ratios.

    Reads ``matched`` four times, some columns of it, so let that be a written table.
    """
    sold = matched.filter(F.col("actual_kl") > 0)
    oldest, latest, actual = F.col("oldest_fc"), F.col("latest_fc"), F.col("actual_kl")

    def share(condition: Column) -> Column:
        return round_half_even(F.avg(condition.cast("double")) * 100, 1)

    sums = sold.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"),
        round_half_even(F.sum(actual), 1).alias("total_actual_kl"),
        share(latest > oldest).alias("pct_revised_up"),
        share(latest < oldest).alias("pct_revised_down"),
        round_half_even(F.avg(latest - oldest), 2).alias("mean_revision_kl"),
    )
    medians = grouped_medians(
        sold, ["brand"], {"med_oldest_over": F.try_divide(oldest, actual), "med_latest_over": F.try_divide(latest, actual)}
    ).select(F.col("brand").alias("_brand"), "med_oldest_over", "med_latest_over")
    return (
        sums.join(medians, F.col("brand").eqNullSafe(F.col("_brand")), "left")
        .drop("_brand")
        .withColumns({c: round_half_even(F.col(c), 2) for c in ["med_oldest_over", "med_latest_over"]})
        .orderBy(F.desc_nulls_first("med_latest_over"), "brand")
    )


def top_brands(bias: DataFrame, n: int = TOP_BRANDS) -> DataFrame:
    """The ``n`` brands with the largest volume; equal volumes go by name."""
    return bias.orderBy(F.desc_nulls_first("total_actual_kl"), "brand").limit(n)

"""Inputs to accuracy tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hindcast.operators import accuracy
from hindcast.operators.matched import matched_frame
from hindcast.sources.shared import settle
from hindcast.sources.tables import read_actuals, read_forecasts, read_hierarchy


@dataclass(frozen=True)
class AccuracyReport:
    """The tables behind the accuracy views, all from one matched frame."""

    by_month: DataFrame
    by_month_long: DataFrame
    by_brand_month: DataFrame
    brand_order: DataFrame
    bias: DataFrame
    top_brands: DataFrame

    def heat(self, metric: str = "fa_latest") -> DataFrame:
        return accuracy.heat_metric(self.by_brand_month, metric)


def report(matched: DataFrame, brands: Iterable[str] | DataFrame | None = None) -> AccuracyReport:
    """All tables for the chosen brands, every brand by default."""
    chosen = accuracy.filter_brands(matched, brands)
    by_month = accuracy.fa_by_month(chosen)
    bias = accuracy.brand_bias(chosen)
    return AccuracyReport(
        by_month.orderBy("snop_month"),
        accuracy.fa_long(by_month),
        accuracy.fa_by_brand_month(chosen),
        accuracy.brand_order(chosen),
        bias,
        accuracy.top_brands(bias),
    )


def read_matched(spark: SparkSession, forecasts: str, actuals: str, hierarchy: str) -> DataFrame:
    """Matched frame of three input folders, written once so that each view only reads it."""
    matched = matched_frame(
        read_forecasts(spark, forecasts), read_actuals(spark, actuals), read_hierarchy(spark, hierarchy)
    )
    return settle(matched, "matched")

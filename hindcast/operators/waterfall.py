"""The long forecast history: one row per parent, calculation month and target month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.numeric import sum0

WATERFALL_ORDER = ["parent_code", "snop_month", "calculation_month"]


def parent_quantities(long: DataFrame) -> DataFrame:
    """Melted quantities summed over the materials and rows of a parent."""
    return long.groupBy("parent_code", "calculation_month", "snop_month").agg(sum0(F.col("qty")).alias("qty"))


def description_votes(long: DataFrame) -> DataFrame:
    """One description per parent, by two votes.

    Within a calculation month a description wins by the number of distinct materials it
    covers; across months by the number of months won. Ties go to the smallest text.
    The winner is the minimum of (-votes, text), which combines before each shuffle;
    ranking windows would gather all descriptions of a parent in one task.
    """
    by_material = long.select("calculation_month", "parent_code", "parent_description", "material_code").distinct()
    in_month = (
        by_material.groupBy("calculation_month", "parent_code", "parent_description")
        .agg(F.count(F.lit(1)).alias("votes"))
        .groupBy("calculation_month", "parent_code")
        .agg(F.min(F.struct(-F.col("votes"), "parent_description")).alias("winner"))
    )
    return (
        in_month.groupBy("parent_code", F.col("winner.parent_description").alias("parent_description"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .groupBy("parent_code")
        .agg(F.min(F.struct(-F.col("votes"), "parent_description")).alias("winner"))
        .select("parent_code", "winner.parent_description")
    )


def waterfall(long: DataFrame) -> DataFrame:
    """Quantities with the voted description. Unordered: sort where rows are shown or written."""
    return (
        parent_quantities(long)
        .join(description_votes(long), "parent_code", "left")
        .select("calculation_month", "snop_month", "parent_code", "parent_description", "qty")
    )


def head(history: DataFrame, n: int = 500) -> DataFrame:
    """First ``n`` rows in output order, for display; takes n rows per task, not a full sort."""
    return history.orderBy(*WATERFALL_ORDER).limit(n)


def stats(history: DataFrame) -> DataFrame:
    """Rows, distinct parents (a null one counts), and the sum of quantities."""
    per_parent = history.groupBy("parent_code").agg(F.count(F.lit(1)).alias("n"), sum0(F.col("qty")).alias("qty"))
    return per_parent.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_parents"),
        sum0(F.col("qty")).alias("total_qty"),
    )

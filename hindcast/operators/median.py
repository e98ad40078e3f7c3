"""Exact medians per group, for groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.numeric import value_bucket
from hindcast.operators.spread import broadcast_small
from hindcast.sources.shared import settle

# Buckets per factor e of a value, and parts of the bucket that holds the middle.
STEPS = 512
PARTS = 1 << 16


def _middle(held: DataFrame, within: list[str], place: str, below: Column) -> DataFrame:
    """Where the middle ranks lie: the places in each of ``within`` that hold one of them.

    ``held`` counts values by place, ``below`` is how many values of the group come before
    those of ``within``. At most two places each; written, for the rows to be filtered by.
    """
    group = Window.partitionBy(*within)
    upto = group.orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("start", below + F.sum("held").over(upto) - F.col("held"))
    if "low_rank" not in held.columns:
        total = F.sum("held").over(group)
        held = held.withColumns({"low_rank": F.floor((total - 1) / 2), "high_rank": F.floor(total / 2)})
    inside = (F.col("start") <= F.col("high_rank")) & (F.col("start") + F.col("held") > F.col("low_rank"))
    names = [F.col(c).alias(f"_{c}") for c in [*within, place]]
    return settle(held.filter(inside).select(*names, F.col("start").alias("before"), "low_rank", "high_rank", "low", "high"), "middle")


def _only(rows: DataFrame, middle: DataFrame, by: list[str]) -> DataFrame:
    """Rows at the places of ``middle``. They stay where they are while that can be broadcast."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return rows.join(broadcast_small(middle), same).drop(*[f"_{c}" for c in by])


def _part() -> Column:
    """Which of the equal parts of its bucket, from ``low`` to ``high``, a value lies in."""
    along = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    finite = (F.col("high") > F.col("low")) & (F.abs(F.col("high") - F.col("low")) < float("inf"))
    return F.coalesce(F.when(finite, F.least(F.floor(along * PARTS), F.lit(PARTS - 1))), F.lit(0).cast("bigint"))


def middle_rows(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Values in the part that holds the middle of each group and measure, one row each.

    ``before`` is how many values come before the part; ``low_rank`` and ``high_rank`` are the
    middle ranks. ``df`` is read three times; its rows never move: what moves are histograms, as
    combined in the tasks.
    """
    rows = (
        df.select(
            *keys,
            F.explode(
                F.array(*[F.struct(F.lit(i).alias("measure"), v.alias("value")) for i, v in enumerate(values.values())])
            ).alias("m"),
        )
        .filter(F.col("m.value").isNotNull())
        .select(*keys, "m.*", value_bucket(F.col("m.value"), STEPS).alias("bucket"))
    )
    group, bucket = [*keys, "measure"], [*keys, "measure", "bucket"]
    held = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("held"), F.min("value").alias("low"), F.max("value").alias("high"))
    buckets = _middle(held, group, "bucket", F.lit(0))
    inside = _only(rows, buckets, bucket).withColumn("part", _part())
    same = [F.first(c).alias(c) for c in ("before", "low_rank", "high_rank", "low", "high")]
    held = inside.groupBy(*bucket, "part").agg(F.count(F.lit(1)).alias("held"), *same)
    parts = _middle(held, bucket, "part", F.col("before")).withColumnRenamed("_part", "middle")
    return _only(rows, parts, bucket).withColumn("part", _part()).filter("part = middle").drop("middle", "low", "high")


def value_ranks(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """The same values with their numbers ``n``; only these rows are shuffled by value."""
    place = [*keys, "measure", "bucket", "part"]
    return middle_rows(df, keys, values).groupBy(*place, "value", "before", "low_rank", "high_rank").agg(F.count(F.lit(1)).alias("n"))


def grouped_medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Exact median of each of ``values`` per group of ``keys``; nulls are ignored.

    The built-in median keeps all distinct values of a group in one task's memory. Here a histogram
    comes first, over order-keeping buckets and combined inside the tasks. It tells in which
    bucket the middle ranks lie; that one, 0.2 % wide, is cut into ``PARTS`` equal parts, and a
    second histogram tells the part. Both are sent back to the rows as filters, so that only the
    values of that part, a 65,536th of the bucket, are shuffled and ranked, however near to
    each other the values of a hot group lie.
    """
    names, part = list(values), [*keys, "measure", "bucket", "part"]
    found = value_ranks(df, keys, values)
    inside = Window.partitionBy(*part).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = found.withColumn("last", F.col("before") + F.sum("n").over(inside) - 1)
    ranked = ranked.withColumn("first", F.col("last") - F.col("n") + 1)
    ranked = ranked.filter((F.col("first") <= F.col("high_rank")) & (F.col("last") >= F.col("low_rank")))

    def at(rank: str, measure: int) -> Column:
        hit = (F.col("measure") == measure) & F.col(rank).between(F.col("first"), F.col("last"))
        return F.max(F.when(hit, F.col("value")))

    return ranked.groupBy(*keys).agg(
        *[(at("low_rank", i) * 0.5 + at("high_rank", i) * 0.5).alias(n) for i, n in enumerate(names)]
    )

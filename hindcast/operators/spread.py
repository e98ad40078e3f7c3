"""Joins and orders that stay in bounded tasks however the keys are distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.sources.shared import settle

# Rows that one key of a join may have in one task, at least, and how many keys may have more.
KEY_ROWS, HOT_KEYS = 2000, 100_000
# What may be broadcast, as measured in text.
BROADCAST_BYTES = 64 << 20
# Rows that a task has numbered before it are kept in the low bits of its row numbers.
_TASK_BITS = 33


def spread_join(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str], by: Column, how: str = "inner", key_rows: int | None = None
) -> DataFrame:
    """Join rows with one row for each key, where a few keys may have most rows of ``left``.

    Keys with over ``key_rows`` rows (``KEY_ROWS``, unless given) are dealt over so many places by
    ``by`` that each has about that many, and their row of ``right`` goes to each place. At most
    ``HOT_KEYS`` keys are dealt, so they can be broadcast. Null keys find nothing. ``left`` is read twice.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    key_rows = KEY_ROWS if key_rows is None else key_rows
    loads = left.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > key_rows)
    loads = settle(loads, "loads")
    total = loads.agg(F.sum("_rows")).first()[0] or 0
    if not total:
        return left.join(right, keys, how)
    most = max(key_rows, -(-total // HOT_KEYS))
    hot = loads.filter(F.col("_rows") > most).select(*keys, F.ceil(F.col("_rows") / most).cast("int").alias("_places"))
    places = F.coalesce("_places", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_place", F.pmod(F.xxhash64(by), places).cast("int"))
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), places - 1)))
    return dealt.drop("_places").join(copies.drop("_places"), [*keys, "_place"], how).drop("_place")


def is_small(table: DataFrame) -> bool:
    """Whether the values of a written table measure ``BROADCAST_BYTES`` at most."""
    return (table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def broadcast_small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it `is_small`."""
    return F.broadcast(table) if is_small(table) else table


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in global order, spread over tasks by ranges, with ``_at`` growing along it.

    Rows that are equal in all of ``order`` go to one task, in any order. The plan numbers anew
    each time it runs: write the result before it is read twice.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())


def task_of(at: Column) -> Column:
    """The task that :func:`in_order` numbered a row in; tasks are in order."""
    return F.shiftright(at, _TASK_BITS).cast("int")


def ranked(df: DataFrame, rank: str, *order: Column | str) -> DataFrame:
    """All rows with their global rank from 0 on, written to the shared folder.

    Each task numbers its range; the tasks' row counts, one number each, give the offsets. No
    window sees the rows. Rows that are equal in all of ``order`` are ranked in any order.
    """
    rows = settle(in_order(df, *order), "ranked")
    task = task_of(F.col("_at"))
    counts = rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_n")).collect()
    offsets, before = [], 0
    for row in sorted(counts):
        offsets.append((row["_task"], before))
        before += row["_n"]
    starts = df.sparkSession.createDataFrame(offsets, "_task int, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << _TASK_BITS) - 1))
    numbered = rows.withColumn("_task", task).join(F.broadcast(starts), "_task")
    return numbered.withColumn(rank, F.col("_before") + place).drop("_task", "_before", "_at")

"""Sums of doubles that are the same whatever the order and the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A double is cut into digits of so many bits. Sums of digits are whole numbers, which stay exact
# for 2^38 rows a group.
DIGIT_BITS = 24
DIGITS = 4
# The lowest place of a first digit: three more digits below it reach the smallest double.
_LOWEST = -42
_BASE = float(1 << DIGIT_BITS)


def _power(place: Column) -> Column:
    """The value of one in this place; exact, as a power of two is."""
    return F.pow(F.lit(2.0), place * DIGIT_BITS)


def _place(value: Column) -> Column:
    """Place of the first digit: the value is below the base to the place plus one, or hardly above."""
    near = F.floor(F.log2(F.abs(value)) / DIGIT_BITS).cast("int")
    return F.when(value == 0, F.lit(_LOWEST)).otherwise(F.greatest(near, F.lit(_LOWEST)))


def _digits(value: Column, place: Column) -> list[Column]:
    """Whole numbers, highest place first, that add up to the value exactly."""
    rest = value / _power(place)
    out = []
    for _ in range(DIGITS):
        # Cut towards zero, so that digits have the value's sign and no bit is lost.
        whole = F.when(rest < 0, F.ceil(rest)).otherwise(F.floor(rest))
        out.append(whole.cast("bigint"))
        rest = (rest - whole) * _BASE
    return out


def exact_sums(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``keys, name``: the sum of ``value`` by group, nulls counting as 0.

    Each value is cut into digits, which are added up as whole numbers in their places, combining in
    the tasks; a group has some ninety places at most. Carries then run from the lowest place
    up, and the digits make one double: the same bits under any order and partitioning, within a
    unit in the last place of the true sum, and 0 if the values cancel out. A NaN, or infinities of
    both signs, make the sum NaN, as in a plain sum; one infinity makes it infinite.
    """
    finite = F.abs(F.coalesce(value, F.lit(0.0)))
    finite = ~F.isnan(finite) & (finite < float("inf"))
    rows = df.select(*keys, F.coalesce(value, F.lit(0.0)).cast("double").alias("_value"), finite.alias("_finite"))
    rows = rows.withColumn("_other", F.when(F.col("_finite"), 0.0).otherwise(F.col("_value")))
    rows = rows.withColumn("_value", F.when(F.col("_finite"), F.col("_value")).otherwise(0.0)).withColumn("_place", _place(F.col("_value")))
    digits = [d.alias(f"_digit{i}") for i, d in enumerate(_digits(F.col("_value"), F.col("_place")))]
    sums = (
        rows.select(*keys, "_place", "_other", *digits)
        .groupBy(*keys, "_place")
        .agg(F.sum("_other").alias("_other"), *[F.sum(f"_digit{i}").alias(f"_digit{i}") for i in range(DIGITS)])
    )
    places = F.array(*[F.struct((F.col("_place") - i).alias("place"), F.col(f"_digit{i}").alias("digit")) for i in range(DIGITS)])
    by_place = sums.select(*keys, "_other", F.posexplode(places).alias("i", "_p"))
    by_place = by_place.groupBy(*keys, F.col("_p.place").alias("_place")).agg(
        F.sum("_p.digit").alias("_digit"), F.sum(F.when(F.col("i") == 0, F.col("_other")).otherwise(0.0)).alias("_other")
    )
    grouped = by_place.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_place", "_digit"))).alias("_digits"),
        F.min("_place").alias("_first"),
        F.max("_place").alias("_last"),
        F.sum("_other").alias("_other"),
    )
    return grouped.select(*keys, (_carried(F.col("_digits"), F.col("_first"), F.col("_last")) + F.col("_other")).alias(name))


def _carried(digits: Column, first: Column, last: Column) -> Column:
    """One double from the digits by place, lowest place first."""

    def step(done: Column, place: Column) -> Column:
        total = done["carry"] + F.coalesce(F.try_element_at(digits, place), F.lit(0).cast("bigint"))
        # Digits between minus and plus half a base: what is below a digit never outweighs it.
        carry = F.shiftright(total + (1 << (DIGIT_BITS - 1)), DIGIT_BITS)
        digit = total - carry * (1 << DIGIT_BITS)
        half = F.pow(F.lit(2.0), place * (DIGIT_BITS // 2))
        more = F.when(digit == 0, F.lit(0.0)).otherwise(digit.cast("double") * half * half)
        return F.struct(carry.alias("carry"), (done["value"] + more).alias("value"))

    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit(0.0).alias("value"))
    # Carries of sums of longs go three places up at most.
    return F.aggregate(F.sequence(first, last + 3), start, step, lambda done: done["value"])

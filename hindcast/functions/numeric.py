"""Arithmetic whose null, division and rounding rules differ from Spark's defaults."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number, as the grid check defines it, and the
# wider spelling the value conversion accepts. Both end at the end of the text: a sign for
# the end of a line would let a line break through.
PLAIN_NUMBER = r"^-?\d*\.?\d+\z"
ANY_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))\z"


def sum0(value: Column) -> Column:
    """Sum that is 0, not null, when every value of the group is null."""
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def ieee_div(numerator: Column, denominator: Column) -> Column:
    """Division that gives NaN or a signed infinity at a zero denominator."""
    at_zero = (
        F.when(F.isnan(numerator) | (numerator == 0), F.lit(float("nan")))
        .when(numerator > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(numerator.isNull() | denominator.isNull(), F.lit(None).cast("double")).when(
        denominator == 0, at_zero
    ).otherwise(F.try_divide(numerator, denominator))


def round_half_even(value: Column, digits: int) -> Column:
    """Round the binary value scaled by a power of ten, halves to the even neighbour.

    A value too large to be scaled has no digits behind the point and stays as it is.
    """
    scale = float(10**digits)
    return F.when(F.abs(value) > sys.float_info.max / scale, value).otherwise(F.rint(value * scale) / scale)


def is_number(cell: Column) -> Column:
    """Text that stands for a number: what `lenient_double` gives a value for."""
    return F.coalesce(cell.rlike(ANY_NUMBER), F.lit(False))


def lenient_double(cell: Column) -> Column:
    """Text to double; text that is no number (blanks around it included) becomes null."""
    return F.when(is_number(cell), cell.try_cast("double"))


def is_non_numeric(cell: Column) -> Column:
    """A filled cell that is not a plain decimal number."""
    return cell.isNotNull() & ~cell.rlike(PLAIN_NUMBER)


def value_bucket(value: Column, steps: int) -> Column:
    """Coarse integer code that never decreases as ``value`` grows.

    Steps are logarithmic, so the code stays fine around any magnitude. Natural
    logs of doubles lie within +-746, hence the shift that keeps both signs apart.
    """
    finite = F.least(F.abs(value), F.lit(sys.float_info.max))
    magnitude = F.floor(F.ln(finite) * steps) + 800 * steps
    return (
        F.when(F.isnan(value), F.lit(2000 * steps).cast("bigint"))
        .when(value > 0, magnitude)
        .when(value < 0, -magnitude)
        .otherwise(F.lit(0).cast("bigint"))
    )

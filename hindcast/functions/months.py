"""Month names, month keys and the month window a file name stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, in calendar order.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Fixed value: the longest window a file may cover.
MAX_WINDOW = 12


def month_names() -> Column:
    return F.expr("array('" + "', '".join(MONTHS) + "')")


def month_number(abbr: Column) -> Column:
    """1..12, or 0 for a text that is no month name."""
    return F.array_position(month_names(), abbr).cast("int")


def month_index(abbr: Column, two_digit_year: Column) -> Column:
    """Months since year 0 of the month ``abbr`` of year 2000 + yy; null when a part is invalid."""
    return (two_digit_year.try_cast("int") + 2000) * 12 + F.nullif(month_number(abbr), F.lit(0)) - 1


def month_key(day: Column) -> Column:
    """``YYYY-MM`` key of a date."""
    return F.date_format(day, "yyyy-MM")


def month_key_date(key: Column) -> Column:
    """First day of a ``YYYY-MM`` key; a malformed key raises."""
    return F.to_date(F.concat(key, F.lit("-01")), "yyyy-MM-dd")


def month_window(start: Column, end: Column) -> Column:
    """Name and ``YYYY-MM`` key of the months between two indices, both included.

    Null unless they are 1 to 12 months. The length is tested before the list is built, so
    a reversed or overlong file name gives a null to report and not a failed job.
    """
    return F.when(
        (end - start).between(0, MAX_WINDOW - 1),
        F.transform(
            F.sequence(start, end),
            lambda i: F.struct(
                F.get(month_names(), i % 12).alias("abbr"),
                F.format_string("%d-%02d", F.floor(i / 12), i % 12 + 1).alias("snop_month"),
            ),
        ),
    )


def iso_date(text: Column) -> Column:
    """``yyyy-MM-dd`` text to date; malformed text raises."""
    return F.to_date(text, "yyyy-MM-dd")


def month_year_date(text: Column) -> Column:
    """``Apr-2024`` text to the first day of the month; malformed text raises."""
    return F.to_date(F.concat(F.lit("01-"), text), "dd-MMM-yyyy")

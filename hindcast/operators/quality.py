"""Checks over whole folders: every rule is a set operation that lists all offenders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.months import month_key, month_key_date
from hindcast.functions.numeric import is_number
from hindcast.functions.text import joined_or_none
from hindcast.operators.exact import exact_sums

# Files a complete folder holds, and the tolerance of the totals check.
EXPECTED_FILES = 16
TOLERANCE = 1e-6
MONTH_KEY = r"^\d{4}-(?:0[1-9]|1[0-2])\z"


class QualityError(RuntimeError):
    """Raised when a folder breaks a rule; the message sums up all broken rules."""


def reconcile(long: DataFrame, totals: DataFrame) -> DataFrame:
    """Per file: the largest difference between a month's melted sum and its total.

    A month on one side only counts as 0 on the other. Both sides pass one exact sum, the
    totals with their sign changed, which gives the result of a full outer join without joining;
    its bits do not depend on how many rows there are in which order, so the tolerance is that of the
    sheets' own numbers at any size.
    """
    melted = long.select("file", "snop_month", F.col("qty").alias("left"))
    stated = totals.select("file", "snop_month", (-F.col("gt")).alias("left"))
    sums = exact_sums(melted.unionByName(stated), ["file", "snop_month"], F.col("left"), "left")
    return sums.groupBy("file").agg(F.max(F.abs("left")).alias("max_abs_diff_vs_grand_total"))


def offenders(checked: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Files whose largest difference is beyond the tolerance."""
    return checked.filter(F.col("max_abs_diff_vs_grand_total") > tolerance)


def month_gaps(df: DataFrame, month: str, groups: Sequence[str] = ()) -> DataFrame:
    """Neighbouring months of a series that are not one month apart; a month twice counts.

    ``month`` is a date. The window sees distinct months, never rows, so a series of
    any length in rows stays a series of a few hundred months.
    """
    order = Window.partitionBy(*groups).orderBy("next_month")
    months = df.groupBy(*groups, F.col(month).alias("next_month")).agg(F.count(F.lit(1)).alias("n"))
    steps = months.withColumn("prev_month", F.lag("next_month").over(order))
    pair = F.struct(F.col("prev_month"), F.col("next_month"))
    twice = F.struct(F.col("next_month").alias("prev_month"), F.col("next_month"))
    return steps.select(
        *groups,
        F.explode(
            F.filter(
                F.array(
                    F.when(F.add_months("prev_month", 1) != F.col("next_month"), pair),
                    F.when(F.col("n") > 1, twice),
                ),
                lambda p: p.isNotNull(),
            )
        ).alias("p"),
    ).select(*groups, "p.prev_month", "p.next_month")


def _hit(rule: str, condition: Column, detail: Column, severity: str = "fail") -> Column:
    return F.when(
        condition, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.alias("detail"))
    )


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def _file_rules() -> list[Column]:
    """Rules that the facts of one file decide."""
    reversed_or_long = F.format_string(
        "name spans %s-%s to %s-%s: backwards, or more than a year",
        "start_abbr", "start_yy", "end_abbr", "end_yy",
    )
    dated = F.col("start_index").isNotNull() & F.col("end_index").isNotNull()
    named = F.col("window").isNotNull()
    window_names = F.col("window")["abbr"]
    digits = F.col("start_yy").try_cast("int").isNotNull() & F.col("end_yy").try_cast("int").isNotNull()
    found = F.col("data_start").isNotNull()
    unmapped = F.array_except("sheet_months", window_names)
    return [
        _hit("R1", F.col("name_matches") & digits & ~dated, F.format_string("unknown month in %s to %s", "start_abbr", "end_abbr")),
        _hit("R2", dated & ~named, reversed_or_long),
        _hit(
            "R3",
            ~found,
            F.format_string("no header: month row %s, names row %s", _text("anchor_row"), _text("names_row")),
        ),
        _hit("R4", ~F.col("name_matches"), F.lit("not named like a grid file")),
        _hit("R5", F.col("name_matches") & ~digits, F.lit("name has a year that is no number")),
        _hit(
            "R6",
            found & named & (F.col("sheet_months") != window_names),
            F.format_string(
                "sheet months %s do not match the file name's %s",
                F.array_join("sheet_months", " "),
                F.array_join(window_names, " "),
            ),
        ),
        _hit("R7", found & named & (F.size(unmapped) > 0), F.format_string("months without a key: %s", F.array_join(unmapped, " "))),
        _hit("R8", F.col("bad_parents") > 0, F.format_string("%s row(s) with a parent code that is no integer", _text("bad_parents"))),
        _hit("R9", F.col("months").isNotNull() & (F.col("grand_total_rows") != 1), F.format_string("expected 1 Grand Total row, found %s", _text("grand_total_rows"))),
        _hit("V1", F.col("non_numeric_cells") > 0, F.format_string("%s non-numeric cell(s)", _text("non_numeric_cells")), "warn"),
        _hit("V2", F.col("split_materials") > 0, F.format_string("%s material(s) on several rows", _text("split_materials")), "warn"),
    ]


def _total_rules() -> Column:
    """Rules on each Grand Total cell of a file that has one such row."""
    return F.transform(
        F.when(F.col("grand_total_rows") == 1, F.col("total_cells")),
        lambda c: F.coalesce(
            _hit("R10", c["cell"].isNull(), F.concat(F.lit("blank Grand Total for "), c["abbr"])),
            _hit(
                "R11",
                ~is_number(c["cell"]),
                F.concat(F.lit("Grand Total for "), c["abbr"], F.lit(" is not numeric: "), c["cell"]),
            ),
        ),
    )


def _difference_rule(tolerance: float) -> Column:
    """The reconciliation, for a file whose Grand Total row can be used."""
    readable = (F.col("grand_total_rows") == 1) & F.forall("total_cells", lambda c: is_number(c["cell"]))
    return _hit(
        "R15",
        readable & (F.col("max_abs_diff_vs_grand_total") > tolerance),
        F.format_string("melted sums differ from the Grand Total by %s", _text("max_abs_diff_vs_grand_total")),
    )


def violations(
    facts: DataFrame,
    checked: DataFrame,
    expected_files: int = EXPECTED_FILES,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """All rule violations as (file, rule, severity, detail).

    ``checked`` is the reconciliation. A file whose totals row cannot be used is reported
    for that, not for its difference as well. Rules on the folder have no file.
    """
    no_file = F.lit(None).cast("string").alias("file")
    hits = F.concat(
        F.array(*_file_rules(), _difference_rule(tolerance)),
        F.coalesce(_total_rules(), F.array().cast("array<struct<rule:string,severity:string,detail:string>>")),
    )
    per_file = facts.join(checked, "file", "left").select(
        "file", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")
    )
    count = (
        facts.agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") != expected_files)
        .select(
            no_file,
            _hit("R12", F.lit(True), F.format_string(f"expected {expected_files} files, found %s", _text("n"))).alias("h"),
        )
    )
    series = facts.filter(F.col("calc_month").isNotNull()).select(month_key_date(F.col("calc_month")).alias("month"))
    step = F.format_string("%s → %s", month_key(F.col("prev_month")), month_key(F.col("next_month")))
    gaps = month_gaps(series, "month").select(
        no_file, _hit("R14", F.lit(True), F.concat(F.lit("months do not follow on: "), step)).alias("h")
    )
    return per_file.unionByName(count).unionByName(gaps).select("file", "h.*")


def month_key_violations(history: DataFrame) -> DataFrame:
    """Rule R13 on a history that is read back: month keys that are no ``YYYY-MM``."""
    key = F.explode(F.array("calculation_month", "snop_month")).alias("key")
    wrong = ~F.coalesce(F.col("key").rlike(MONTH_KEY), F.lit(False))
    found = history.select(key).filter(wrong).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    told = F.format_string("%s row(s) with the month key %s", _text("n"), _text("key"))
    return found.select(
        F.lit(None).cast("string").alias("file"), F.lit("R13").alias("rule"), F.lit("fail").alias("severity"), told.alias("detail")
    )


def summary(found: DataFrame) -> DataFrame:
    """Violations counted by rule, with the first of each as an example."""
    return found.groupBy("rule", "severity").agg(
        F.count(F.lit(1)).alias("violations"), F.min(F.struct("file", "detail")).alias("example")
    )


def enforce(found: DataFrame) -> None:
    """Raise once for all failing rules. One row per rule reaches the driver."""
    broken = summary(found.filter(F.col("severity") == "fail")).orderBy("rule").collect()
    if broken:
        lines = [f"{r.rule}: {r.violations} (e.g. {r.example.file or 'folder'}: {r.example.detail})" for r in broken]
        raise QualityError("grid folder breaks these rules\n" + "\n".join(lines))


def validation(facts: DataFrame, checked: DataFrame) -> DataFrame:
    """Per-file report of the totals check; a file without any month differs by 0."""
    return facts.join(checked, "file", "left").select(
        "file",
        "leaf_rows",
        "total_rows_dropped",
        F.coalesce("max_abs_diff_vs_grand_total", F.lit(0.0)).alias("max_abs_diff_vs_grand_total"),
        joined_or_none(F.col("issues")).alias("issues"),
    )

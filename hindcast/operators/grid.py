"""Planning grids: find the header, bind month columns, melt, read the totals.

Every file has its own layout. Grids come as chunks that carry their header (bound in
place, without a shuffle) or as single rows (joined to a layout with one row per file).
The operators below work on rows bound either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.months import month_index, month_number, month_window
from hindcast.functions.numeric import is_non_numeric, is_number, lenient_double
from hindcast.functions.text import joined_or_none, let, strip
from hindcast.operators.spread import spread_join

# The label of the totals row, the name of the code column, the two layout
# labels and the file-name format.
GRAND_TOTAL = "Grand Total"
CODE_COLUMN = "parent_code"
MERGED = "merged names+months row"
SEPARATE = "separate header rows"
FILE_NAME = r"(?U)^S&OP_grid file_(\w{3})-(\d{2}) to (\w{3})-(\d{2})_circulation\.(?:xlsx|csv)\z"
# Rows of one file under one join key, or a 100,000th of all rows if that is more.
TASK_ROWS = 100


def header_of(head: Column) -> Column:
    """The month row, the names row, the first data row and the month columns of a sheet.

    The month row is the first with two or more month names; the names row the first
    that names the code column.
    """

    def marks(row: Column) -> Column:
        return let(
            F.transform(row["cells"], strip),
            lambda labels: F.struct(
                row["row_idx"].alias("row_idx"),
                F.filter(
                    F.transform(
                        labels, lambda c, i: F.when(month_number(c) > 0, F.struct(i.alias("pos"), c.alias("abbr")))
                    ),
                    lambda m: m.isNotNull(),
                ).alias("months"),
                F.exists(labels, lambda c: c.eqNullSafe(CODE_COLUMN)).alias("has_names"),
            ),
        )

    def first(marked: Column, keep: Callable[[Column], Column]) -> Column:
        return F.get(F.filter(marked, keep), F.lit(0))

    def places(found: Column) -> Column:
        anchor, names = found["anchor"]["row_idx"], found["names"]["row_idx"]
        return F.struct(
            anchor.alias("anchor_row"),
            names.alias("names_row"),
            F.when(anchor.isNotNull() & names.isNotNull(), F.greatest(anchor, names) + 1).alias("data_start"),
            F.when(anchor == names, MERGED).when(anchor != names, SEPARATE).alias("layout"),
            found["anchor"]["months"].alias("month_cells"),
        )

    return let(
        F.transform(head, marks),
        lambda marked: let(
            F.struct(
                first(marked, lambda m: F.size(m["months"]) >= 2).alias("anchor"),
                first(marked, lambda m: m["has_names"]).alias("names"),
            ),
            places,
        ),
    )


def window_of(file: Column) -> Column:
    """What a file name says: first and last month and the months between.

    ``window`` is null when the name does not match, a month is unknown, or the months are
    reversed or more than twelve; the parts stay for the rule that reports it.
    """
    parts = ["start_abbr", "start_yy", "end_abbr", "end_yy"]
    texts = [F.nullif(F.regexp_extract(file, FILE_NAME, i), F.lit("")).alias(p) for i, p in enumerate(parts, 1)]

    def indices(t: Column) -> Column:
        return F.struct(
            month_index(t["start_abbr"], t["start_yy"]).alias("start"), month_index(t["end_abbr"], t["end_yy"]).alias("end")
        )

    return let(
        F.struct(*texts),
        lambda t: let(
            indices(t),
            lambda i: F.struct(
                file.rlike(FILE_NAME).alias("name_matches"),
                *[t[p].alias(p) for p in parts],
                i["start"].alias("start_index"),
                i["end"].alias("end_index"),
                month_window(i["start"], i["end"]).alias("window"),
            ),
        ),
    )


def layout_of(file: Column, head: Column) -> Column:
    """Header places and name window of a sheet, and its month columns bound to each other.

    ``months`` holds position, name and ``YYYY-MM`` key of each month column. It is null
    unless the sheet shows exactly the months of the file name, in order; the first of them
    is the calculation month.
    """
    places = ["anchor_row", "names_row", "data_start", "layout"]
    named = ["name_matches", "start_abbr", "start_yy", "end_abbr", "end_yy", "start_index", "end_index", "window"]

    def bound(h: Column, w: Column) -> Column:
        months = F.transform(
            h["month_cells"],
            lambda m, i: F.struct(
                m["pos"].alias("pos"), m["abbr"].alias("abbr"), F.get(w["window"], i)["snop_month"].alias("snop_month")
            ),
        )
        shown = F.transform(h["month_cells"], lambda m: m["abbr"])
        return F.struct(
            *[h[p].alias(p) for p in places],
            *[w[n].alias(n) for n in named],
            shown.alias("sheet_months"),
            F.get(w["window"], F.lit(0))["snop_month"].alias("calc_month"),
            F.when(h["data_start"].isNotNull() & (shown == w["window"]["abbr"]), months).alias("months"),
        )

    return let(header_of(head), lambda h: let(window_of(file), lambda w: bound(h, w)))


def _spread(df: DataFrame, value: Column, *others: str) -> DataFrame:
    """Fields of the struct ``value`` as columns beside ``others``.

    The generator keeps the optimizer from copying ``value`` into every use of a field.
    """
    return df.select(*others, F.explode_outer(F.array(value)).alias("_v")).select(*others, "_v.*")


def name_window(files: DataFrame) -> DataFrame:
    """File names with the fields of `window_of`."""
    return _spread(files, window_of(F.col("file")), "file")


def grid_layout(heads: DataFrame) -> DataFrame:
    """One row per file, from (file, head): the fields of `layout_of`."""
    return _spread(heads, layout_of(F.col("file"), F.col("head")), "file")


def bound_chunks(chunks: DataFrame) -> DataFrame:
    """Rows of chunks with the layout of their file; files whose months are not bound have none.

    The layout is worked out in each chunk, from the header the chunk carries.
    """
    bound = _spread(chunks, layout_of(F.col("file"), F.col("head")), "file", "rows")
    return (
        bound.filter(F.col("months").isNotNull())
        .select("file", "calc_month", "data_start", "months", F.explode("rows").alias("row"))
        .select("file", "calc_month", "data_start", "months", "row.row_idx", "row.cells")
    )


def bound_rows(rows: DataFrame, layout: DataFrame, small: bool = False) -> DataFrame:
    """Single sheet rows joined to the layout of their file.

    A layout that is known to be ``small`` is broadcast, and rows stay where they are. Otherwise
    rows are counted by file first. A file with over ``TASK_ROWS`` rows is dealt over as many join
    keys as leave each about that many (or a 100,000th of all rows), and its one layout row goes to
    each, so no file makes a large task. That join is not hinted: adaptive execution broadcasts the layout when its
    measured size allows.
    """
    bound = layout.filter(F.col("months").isNotNull()).select("file", "calc_month", "data_start", "months")
    cells = rows.select("file", "row_idx", "cells")
    if small:
        joined = cells.join(F.broadcast(bound), "file")
    else:
        joined = spread_join(cells, bound, "file", F.struct("row_idx", "cells"), key_rows=TASK_ROWS)
    return joined.select("file", "calc_month", "data_start", "months", "row_idx", "cells")


def data_rows(bound: DataFrame) -> DataFrame:
    """Rows below the header."""
    return bound.filter(F.col("row_idx") >= F.col("data_start"))


def _code_columns() -> list[Column]:
    return [
        F.get("cells", F.lit(1)).alias("parent_code"),
        F.get("cells", F.lit(2)).alias("parent_description"),
        F.get("cells", F.lit(3)).alias("material_code"),
    ]


def leaf_rows(bound: DataFrame) -> DataFrame:
    """Material rows as text columns; totals rows, which have no parent code, are left out."""
    return (
        data_rows(bound)
        .filter(F.get("cells", F.lit(1)).isNotNull())
        .select("file", F.col("calc_month").alias("calculation_month"), *_code_columns(), "months", "cells")
    )


def whole_number(text: Column) -> Column:
    """Text to BIGINT, null for text that is no plain whole number."""
    return F.when(text.rlike(r"^[+-]?\d+\z"), text.try_cast("bigint"))


def melt(bound: DataFrame, strict: bool = True) -> DataFrame:
    """One row per filled month cell of a material row.

    Empty and non-numeric cells are no forecast and give no row. A parent code that is
    no integer raises, or is null when ``strict`` is off and the rules report it.
    """
    code = F.col("parent_code")
    cell = F.get("cells", F.col("month.pos"))
    return (
        leaf_rows(bound)
        .select("*", F.explode("months").alias("month"))
        .filter(is_number(cell))
        .select(
            "file",
            "calculation_month",
            F.col("month.snop_month").alias("snop_month"),
            (code.cast("bigint") if strict else whole_number(code)).alias("parent_code"),
            "parent_description",
            "material_code",
            cell.cast("double").alias("qty"),
        )
    )


def non_numeric_cells(bound: DataFrame) -> DataFrame:
    """Per file: filled month cells that are no plain number, and the filled cells in all."""
    cell = F.get("cells", F.col("month.pos"))
    return (
        leaf_rows(bound)
        .select("file", "cells", F.explode("months").alias("month"))
        .groupBy("file")
        .agg(
            F.count(cell).alias("filled_cells"),
            F.count_if(is_non_numeric(cell)).alias("non_numeric_cells"),
        )
    )


def grand_totals(bound: DataFrame) -> DataFrame:
    """File, month and value of every cell of the Grand Total row, text kept beside the number."""
    return (
        bound.filter(F.get("cells", F.lit(0)) == GRAND_TOTAL)
        .select("file", "cells", F.explode("months").alias("month"))
        .select(
            "file",
            F.col("month.snop_month").alias("snop_month"),
            F.col("month.abbr").alias("abbr"),
            F.get("cells", F.col("month.pos")).alias("cell"),
        )
        .withColumn("gt", lenient_double(F.col("cell")))
    )


def material_counts(bound: DataFrame) -> DataFrame:
    """Row and cell counts by (file, parent, material), with Grand Total rows on the way.

    Grouping by material first spreads a file with many rows over all tasks; what
    remains per file afterwards is a sum of counts. The cells of a Grand Total row, wherever it
    stands, are a key of their own (``total``, null for all others), so that they move with the
    counts and the aggregate stays one over hashes. Such a row with a parent code counts among
    those of its material as well.
    """
    month_cells = F.transform("months", lambda m: F.get("cells", m["pos"]))
    parent = F.get("cells", F.lit(1))
    below = F.col("row_idx") >= F.col("data_start")
    stated = F.coalesce(F.get("cells", F.lit(0)) == GRAND_TOTAL, F.lit(False))
    leaf = parent.isNotNull()
    no_code = leaf & whole_number(parent).isNull()
    none = F.lit(None).cast("array<string>")
    keys = F.when(stated & leaf, F.array(none, "cells")).otherwise(F.array(F.when(stated, F.col("cells"))))
    rows = bound.filter(below | stated).select("*", F.explode(keys).alias("total"))
    counted = below & (F.col("total").isNull() | ~leaf)
    return (
        rows.select(
            "file",
            parent.alias("parent_code"),
            F.get("cells", F.lit(3)).alias("material_code"),
            "total",
            counted.alias("counted"),
            F.when(counted & leaf, F.size(F.filter(month_cells, is_non_numeric))).otherwise(0).alias("bad_cells"),
            (counted & no_code & F.exists(month_cells, is_number)).alias("bad_parent"),
        )
        .groupBy("file", "parent_code", "material_code", "total")
        .agg(
            F.count_if("counted").alias("n_rows"),
            F.count_if(F.col("total").isNotNull()).alias("n_totals"),
            F.sum("bad_cells").alias("bad_cells"),
            F.count_if("bad_parent").alias("bad_parents"),
        )
    )


def multi_row_materials(counts: DataFrame) -> DataFrame:
    """Materials that stand on more than one row of a file."""
    return counts.filter(F.col("parent_code").isNotNull() & (F.col("n_rows") > 1)).select(
        "file", "parent_code", "material_code", "n_rows"
    )


def file_facts(bound: DataFrame, layout: DataFrame) -> DataFrame:
    """One row per file: its layout with row counts, flagged cells and the Grand Total row.

    ``total_cells`` holds the month cells of that row, at most twelve. Rows are read once and moved
    once, as counts that carry the Grand Total rows along.
    """
    leaf = F.col("parent_code").isNotNull()
    several = leaf & (F.col("n_rows") > 1)
    per_file = material_counts(bound).groupBy("file").agg(
        F.sum(F.when(leaf, F.col("n_rows")).otherwise(0)).alias("leaf_rows"),
        F.sum(F.when(leaf, F.lit(0)).otherwise(F.col("n_rows"))).alias("total_rows_dropped"),
        F.sum("bad_cells").alias("non_numeric_cells"),
        F.sum("bad_parents").alias("bad_parents"),
        F.count_if(several).alias("split_materials"),
        F.min(F.when(several, F.struct("parent_code", "material_code"))).alias("split_example"),
        F.sum("n_totals").alias("grand_total_rows"),
        F.min("total").alias("cells"),
    )
    total_cells = F.transform(
        "months",
        lambda m: F.struct(
            m["abbr"].alias("abbr"), m["snop_month"].alias("snop_month"), F.get("cells", m["pos"]).alias("cell")
        ),
    )
    zero = {
        c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
        for c in ["leaf_rows", "total_rows_dropped", "non_numeric_cells", "bad_parents", "split_materials", "grand_total_rows"]
    }
    return (
        layout.join(per_file, "file", "left")
        .withColumns({**zero, "total_cells": total_cells, "issues": _issues()})
        .drop("cells")
    )


def _issues() -> Column:
    """Warnings of a file, as texts. Their wording is part of the report."""
    example = F.concat(
        F.coalesce("split_example.parent_code", F.lit("None")),
        F.lit("/"),
        F.coalesce("split_example.material_code", F.lit("None")),
    )
    return F.filter(
        F.array(
            F.when(
                F.col("non_numeric_cells") > 0,
                F.concat(F.col("non_numeric_cells").cast("string"), F.lit(" non-numeric qty cell(s) set to null")),
            ),
            F.when(
                F.col("split_materials") > 0,
                F.concat(
                    F.col("split_materials").cast("string"),
                    F.lit(" material(s) split across multiple rows/types (e.g. "),
                    example,
                    F.lit(")"),
                ),
            ),
        ),
        lambda issue: issue.isNotNull(),
    )


def profile(facts: DataFrame) -> DataFrame:
    """The per-file report: months, layout, row counts and issues."""
    return facts.select(
        "file",
        "calc_month",
        F.array_join("sheet_months", " → ").alias("snop_months"),
        "layout",
        "leaf_rows",
        "total_rows_dropped",
        joined_or_none(F.col("issues")).alias("issues"),
    )


def profile_totals(facts: DataFrame) -> DataFrame:
    """One row over all files: files, material rows, dropped rows, files with issues."""
    return facts.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("leaf_rows").alias("leaf_rows"),
        F.sum("total_rows_dropped").alias("total_rows_dropped"),
        F.count_if(F.size("issues") > 0).alias("files_with_issues"),
    )

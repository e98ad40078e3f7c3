"""

Every query runs the library's operators over inputs that `hindcast.fixtures` derives from
the given tables; every oracle states the same result in SQL over the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import fixtures as fx
from hindcast.operators import accuracy, grid, matched, quality, waterfall
from hindcast.plans.history import GridFolder, write_history
from hindcast.sources.history import read_history_csv, write_history_csv
from hindcast.sources.shared import new_folder, settle
from hindcast.sources.sheets import named_columns, read_csv_sheets
from hindcast.sources.tables import ACTUALS_HEADER_ROW, HIERARCHY_HEADER, HIERARCHY_HEADER_ROW, read_forecasts

SMALL = "/root/testdata/sf0.001"
DROPPED_BRAND = "NATION_3"
DROPPED_PARENT = 3


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched.matched_frame(
        matched.typed_forecasts(fx.forecasts_text(spark, sf_dir)),
        matched.monthly_actuals(fx.actuals_raw(spark, sf_dir)),
        matched.brand_of_product(fx.hierarchy_raw(spark, sf_dir)),
    )


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.filter_brands(_matched(spark, sf_dir))


def _folder(spark: SparkSession, sf_dir: str, settled: bool = False, text: bool = False) -> GridFolder:
    """Parsed grids; settled where a query reads the rows or the melt more than once."""
    if text:
        rows = fx.grid_rows(fx.grid_months(spark, sf_dir), fx.grid_lines(spark, sf_dir), text)
    else:
        months, wide = fx.grid_tables(spark, sf_dir)
        rows = fx.grid_rows(months, wide=wide)
    return GridFolder(rows=rows, settled=settled)


def _faulty(spark: SparkSession, sf_dir: str) -> GridFolder:
    months, wide = fx.grid_tables(spark, sf_dir)
    rows = fx.faulty_grid_rows(months, wide=wide)
    return GridFolder(rows=rows, settled=True)


def _corpus() -> tuple[dict, dict]:
    """Queries and oracles of the training-data operators, if these are installed."""
    try:
        import corpus_pipeline
        from hindcast.llm import oracles
        from hindcast.llm import queries as corpus
    except ModuleNotFoundError as error:
        if error.name not in ("corpus_pipeline", "hindcast.llm"):
            raise
        return {}, {}
    sql = oracles.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return corpus.QUERIES | {"pipeline": corpus_pipeline.run}, sql


def _bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.brand_bias(settle(_chosen(spark, sf_dir), "matched"))


def entry(spark: SparkSession) -> DataFrame:
    """Accuracy of the oldest and the latest forecast by month."""
    return accuracy.fa_by_month(_chosen(spark, SMALL)).orderBy("snop_month")


def _brand_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand of the hierarchy but one."""
    brands = accuracy.brand_list(matched.brand_of_product(fx.hierarchy_raw(spark, sf_dir)))
    return accuracy.filter_brands(_matched(spark, sf_dir), brands.filter(F.col("brand") != DROPPED_BRAND))


def _vintage_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched.vintages(matched.typed_forecasts(fx.forecasts_by_line(spark, sf_dir)))


def _chunked(spark: SparkSession, sf_dir: str, settled: bool = True) -> GridFolder:
    """Grids as chunks; the melt alone reads them once, so they are not written for it."""
    months, wide = fx.grid_tables(spark, sf_dir)
    return GridFolder(chunks=fx.chunks_of(fx.grid_rows(months, wide=wide)), settled=settled)


def _actuals_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = fx.sheet_of(fx.actuals_raw(spark, sf_dir), ACTUALS_HEADER_ROW)
    return matched.monthly_actuals(named_columns(sheet, ACTUALS_HEADER_ROW, matched.ACTUALS_HEADER).drop("file"))


def _actuals_csv_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from CSV files with line breaks and quotes in the header and in cells."""
    raw, folder = fx.actuals_raw(spark, sf_dir), new_folder(spark, "sales")
    title = 'Sales, "all bills"\n' * 2
    note = F.concat(F.lit('see\nbill "'), F.monotonically_increasing_id().cast("string"), F.lit('", paid'))
    titled = raw.withColumn("note", note).withColumnRenamed("Month-Year", "MONTH year").withColumnRenamed("note", title + "note")
    titled.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    sheets = read_csv_sheets(spark, folder, "part-*.csv")
    return matched.monthly_actuals(named_columns(sheets, 0, matched.ACTUALS_HEADER).drop("file"))


def _hierarchy_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = fx.sheet_of(fx.hierarchy_raw(spark, sf_dir), HIERARCHY_HEADER_ROW)
    return matched.brand_of_product(named_columns(sheet, HIERARCHY_HEADER_ROW, HIERARCHY_HEADER).drop("file"))


def _gated_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked as a whole folder, written by month, read back."""
    months, wide = fx.grid_tables(spark, sf_dir)
    rows = fx.grid_rows(months, wide=wide, filled=True)
    return write_history(GridFolder(rows=rows, settled=True), new_folder(spark, "gated"), months.count(), form="parquet")


def _forecasts_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "common")
    fx.forecasts_text(spark, sf_dir).write.option("header", True).csv(f"{folder}/forecasts")
    return read_forecasts(spark, f"{folder}/forec*", "*.csv")


def _waterfall_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "waterfall")
    write_history_csv(_folder(spark, sf_dir, settled=True).history(), folder)
    return read_history_csv(spark, folder)


def _grid_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.leaf_rows(_folder(spark, sf_dir).bound).drop("months", "cells")


def _grid_non_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.non_numeric_cells(_folder(spark, sf_dir, text=True).bound)


def _grid_text_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = grid.melt(_folder(spark, sf_dir, text=True).bound)
    return long.groupBy("file", "snop_month").agg(F.count("qty").alias("cells"), F.sum("qty").alias("qty"))


def _grand_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, sf_dir, settled=True)
    return quality.reconcile(folder.long.filter(F.col("parent_code") != DROPPED_PARENT), folder.totals)


def _multi_row_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.multi_row_materials(grid.material_counts(_folder(spark, sf_dir).bound))


def _month_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1 to 14 months, from names made of the order months; an unknown month every 13th."""
    month = F.add_months(F.trunc("o_orderdate", "month"), 12 * fx.YEARS_AHEAD)
    index = F.year("cm") * 12 + F.month("cm")
    name = fx.file_name(F.col("cm"), F.add_months("cm", index % 14))
    names = (
        fx.table(spark, sf_dir, "orders")
        .select(month.alias("cm"))
        .distinct()
        .select(F.when(index % 13 == 0, F.regexp_replace(name, "file_...", "file_Foo")).otherwise(name).alias("file"))
    )
    window = grid.name_window(names)
    return window.select(
        "file",
        F.when(F.col("window").isNotNull(), F.size("window")).cast("bigint").alias("n_months"),
        F.array_join(F.col("window")["snop_month"], " ").alias("months"),
    )


def _layout_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folder(spark, sf_dir).layout.select(
        "file",
        *[F.col(c).cast("bigint").alias(c) for c in ("anchor_row", "names_row", "data_start")],
        "layout",
        F.array_join("sheet_months", " ").alias("sheet_months"),
        "calc_month",
        F.array_join(F.col("months")["snop_month"], " ").alias("snop_months"),
    )


def _month_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecasts = matched.typed_forecasts(fx.forecasts_text(spark, sf_dir))
    vintages = forecasts.select("parent_code", "calculation_month").distinct()
    return quality.month_gaps(vintages, "calculation_month", ["parent_code"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query: name to a function of (session, table folder)."""
    return _corpus()[0] | {
        "forecasts_typed": lambda s, d: matched.typed_forecasts(fx.forecasts_text(s, d)),
        "forecasts_csv_scan": _forecasts_csv_scan,
        "actuals_monthly": lambda s, d: matched.monthly_actuals(fx.actuals_raw(s, d)),
        "hierarchy_unique": lambda s, d: matched.brand_of_product(fx.hierarchy_raw(s, d)),
        "matched_frame": _matched,
        "vintage_ties": _vintage_ties,
        "fa_generic": lambda s, d: accuracy.fa(_chosen(s, d), ["brand"], "oldest"),
        "fa_by_month": lambda s, d: accuracy.fa_by_month(_chosen(s, d)).orderBy("snop_month"),
        "fa_long": lambda s, d: accuracy.fa_long(accuracy.fa_by_month(_chosen(s, d))),
        "fa_by_brand_month": lambda s, d: accuracy.fa_by_brand_month(_chosen(s, d)),
        "heat_metric": lambda s, d: accuracy.heat_metric(accuracy.fa_by_brand_month(_chosen(s, d)), "delta"),
        "brand_order": lambda s, d: accuracy.brand_order(_chosen(s, d)),
        "brand_list": lambda s, d: accuracy.brand_list(_matched(s, d)),
        "brand_filter": _brand_filter,
        "brand_bias": _bias,
        "top_brands": lambda s, d: accuracy.top_brands(_bias(s, d), 5),
        "grid_leaf": _grid_leaf,
        "grid_melt": lambda s, d: _folder(s, d).long,
        "grid_text_melt": _grid_text_melt,
        "grid_non_numeric": _grid_non_numeric,
        "grand_totals": lambda s, d: _folder(s, d).totals,
        "grand_total_check": _grand_total_check,
        "multi_row_materials": _multi_row_materials,
        "grid_profile": lambda s, d: _folder(s, d, settled=True).profile(),
        "grid_profile_totals": lambda s, d: grid.profile_totals(_folder(s, d, settled=True).facts),
        "validation": lambda s, d: _folder(s, d, settled=True).validation(),
        "description_vote": lambda s, d: waterfall.description_votes(_folder(s, d).long),
        "waterfall": lambda s, d: _folder(s, d, settled=True).history(),
        "waterfall_head": lambda s, d: waterfall.head(_folder(s, d, settled=True).history()),
        "waterfall_stats": lambda s, d: waterfall.stats(_folder(s, d, settled=True).history()),
        "waterfall_roundtrip": _waterfall_roundtrip,
        "chunk_melt": lambda s, d: _chunked(s, d, settled=False).long,
        "chunk_profile": lambda s, d: _chunked(s, d).profile(),
        "chunk_waterfall": lambda s, d: _chunked(s, d).history(),
        "actuals_sheet": _actuals_sheet,
        "actuals_csv_sheets": _actuals_csv_sheets,
        "hierarchy_sheet": _hierarchy_sheet,
        "gated_history": _gated_history,
        "month_window": _month_window,
        "layout_detect": _layout_detect,
        "month_gaps": _month_gaps,
        "dq_report": lambda s, d: quality.summary(_faulty(s, d).violations()).drop("example"),
    }


# --- oracles -------------------------------------------------------------------------

_MATCHED = """
WITH forecasts AS (
  SELECT l_suppkey AS parent_code,
         cast(date_trunc('month', o_orderdate) AS date) AS calculation_month,
         cast(date_trunc('month', l_shipdate) AS date) AS snop_month,
         sum(l_quantity) AS fc_kl
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_linestatus = 'O' GROUP BY 1, 2, 3),
actuals AS (
  SELECT l_suppkey AS parent_code, cast(date_trunc('month', l_shipdate) AS date) AS snop_month,
         coalesce(sum(l_quantity), 0.0) AS actual_kl
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
hierarchy_raw AS (
  SELECT s_suppkey AS material_code, s_name AS material_desc, n_name AS brand
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 9
  UNION ALL
  SELECT s_suppkey, s_name || ' (old)', n_name
  FROM supplier JOIN nation ON (s_nationkey + 1) % 25 = n_nationkey WHERE s_suppkey % 10 < 3),
hierarchy AS (
  SELECT material_code AS parent_code, brand FROM hierarchy_raw
  QUALIFY row_number() OVER (PARTITION BY material_code ORDER BY material_desc, brand) = 1),
vintages AS (
  SELECT parent_code, snop_month,
         arg_min_null(fc_kl, calculation_month) AS oldest_fc,
         arg_max_null(fc_kl, calculation_month) AS latest_fc
  FROM forecasts GROUP BY 1, 2),
matched AS (
  SELECT v.parent_code, v.snop_month, a.actual_kl, v.oldest_fc, v.latest_fc, h.brand
  FROM vintages v
  JOIN actuals a ON v.parent_code = a.parent_code AND v.snop_month = a.snop_month
  LEFT JOIN hierarchy h ON v.parent_code = h.parent_code),
m AS (SELECT * FROM matched WHERE brand IS NOT NULL),
by_month AS (
  SELECT snop_month,
         (1 - sum(abs(oldest_fc - actual_kl)) / sum(actual_kl)) * 100 AS fa_oldest,
         (1 - sum(abs(latest_fc - actual_kl)) / sum(actual_kl)) * 100 AS fa_latest
  FROM m GROUP BY 1),
by_brand_month AS (
  SELECT brand, snop_month, fa_oldest, fa_latest, fa_latest - fa_oldest AS delta
  FROM (SELECT brand, snop_month,
               (1 - sum(abs(oldest_fc - actual_kl)) / sum(actual_kl)) * 100 AS fa_oldest,
               (1 - sum(abs(latest_fc - actual_kl)) / sum(actual_kl)) * 100 AS fa_latest
        FROM m GROUP BY 1, 2)
  UNION ALL
  SELECT 'All brands', snop_month, fa_oldest, fa_latest, fa_latest - fa_oldest FROM by_month),
bias AS (
  SELECT brand, count(*) AS n,
         round_even(sum(actual_kl), 1) AS total_actual_kl,
         round_even(avg(CASE WHEN latest_fc > oldest_fc THEN 1.0::double ELSE 0.0::double END) * 100, 1) AS pct_revised_up,
         round_even(avg(CASE WHEN latest_fc < oldest_fc THEN 1.0::double ELSE 0.0::double END) * 100, 1) AS pct_revised_down,
         round_even(avg(latest_fc - oldest_fc), 2) AS mean_revision_kl,
         round_even(median(oldest_fc / actual_kl), 2) AS med_oldest_over,
         round_even(median(latest_fc / actual_kl), 2) AS med_latest_over
  FROM m WHERE actual_kl > 0 GROUP BY 1)
"""

_FILE = """'S&OP_grid file_' || strftime(cm, '%b-%y') || ' to '
         || strftime(cm + INTERVAL 4 MONTH, '%b-%y') || '_circulation.xlsx'"""

_GRID = f"""
WITH lines AS (
  SELECT cast(date_trunc('month', o_orderdate) + INTERVAL 20 YEAR AS date) AS cm, r_name AS batch,
         cast(s_nationkey AS bigint) AS pc, p_type AS pd, 'M' || cast(l_suppkey AS varchar) AS mc,
         l_linestatus AS ty, l_quantity, l_linenumber,
         (((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate)) % 5 + 5) % 5 AS off
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
base AS (SELECT * FROM lines),
files AS (
  SELECT DISTINCT cm, {_FILE} AS file, strftime(cm, '%Y-%m') AS calc_month,
         (year(cm) * 12 + month(cm)) % 14 AS kind
  FROM base),
leaf AS (SELECT cm, batch, pc, pd, mc, ty FROM base GROUP BY ALL),
cells AS (
  SELECT cm, batch, pc, pd, mc, ty, off, sum(l_quantity) AS qty FROM base GROUP BY ALL),
long AS (
  SELECT file, calc_month AS calculation_month,
         strftime(cm + to_months(cast(off AS integer)), '%Y-%m') AS snop_month,
         pc AS parent_code, pd AS parent_description, mc AS material_code, qty
  FROM cells JOIN files USING (cm)),
totals AS (
  SELECT f.cm, f.kind, f.file, o.off,
         strftime(f.cm + to_months(cast(o.off AS integer)), '%Y-%m') AS snop_month,
         strftime(f.cm + to_months(cast(o.off AS integer)), '%b') AS abbr, t.gt
  FROM files f CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS off) o
  LEFT JOIN (SELECT cm, off, sum(l_quantity) AS gt FROM base GROUP BY ALL) t
    ON t.cm = f.cm AND t.off = o.off),
split AS (
  SELECT file, cm, pc, mc, count(*) AS n_rows FROM leaf JOIN files USING (cm) GROUP BY ALL HAVING count(*) > 1),
counts AS (
  SELECT file, cm, calc_month, leaf_rows, total_rows_dropped, coalesce(n_split, 0) AS n_split, example
  FROM files
  JOIN (SELECT cm, count(*) AS leaf_rows, count(DISTINCT batch) + 1 AS total_rows_dropped FROM leaf GROUP BY 1) USING (cm)
  LEFT JOIN (SELECT cm, count(*) AS n_split,
                    min({{'a': cast(pc AS varchar), 'b': mc}}) AS example FROM split GROUP BY 1) USING (cm)),
facts AS (
  SELECT file, cm, calc_month, leaf_rows, total_rows_dropped,
         CASE WHEN n_split > 0 THEN n_split || ' material(s) split across multiple rows/types (e.g. '
              || example.a || '/' || example.b || ')' ELSE 'none' END AS issues
  FROM counts),
quantities AS (
  SELECT parent_code, calculation_month, snop_month, sum(qty) AS qty FROM long GROUP BY ALL),
voted AS (
  SELECT calculation_month, parent_code, parent_description FROM (
    SELECT calculation_month, parent_code, parent_description,
           row_number() OVER (PARTITION BY calculation_month, parent_code
                              ORDER BY count(DISTINCT material_code) DESC, parent_description) AS r
    FROM long GROUP BY 1, 2, 3) WHERE r = 1),
votes AS (
  SELECT parent_code, parent_description FROM (
    SELECT parent_code, parent_description,
           row_number() OVER (PARTITION BY parent_code ORDER BY count(*) DESC, parent_description) AS r
    FROM voted GROUP BY 1, 2) WHERE r = 1),
history AS (
  SELECT calculation_month, snop_month, parent_code, parent_description, qty
  FROM quantities LEFT JOIN votes USING (parent_code))
"""

_TEXT = """
, texts AS (
  SELECT file, strftime(cm + to_months(cast(off AS integer)), '%Y-%m') AS snop_month,
         CASE l_linenumber WHEN 7 THEN 'n/a' WHEN 6 THEN '1e5'
              WHEN 5 THEN cast(cast(l_quantity AS bigint) AS varchar) || chr(10)
              ELSE cast(cast(l_quantity AS bigint) AS varchar) END AS cell
  FROM base JOIN files USING (cm))
"""

_RULES = """
, usable AS (SELECT * FROM totals WHERE kind IN (0, 7, 8, 9, 10, 11, 12)),
blank AS (SELECT * FROM usable WHERE (gt IS NULL AND NOT (kind = 7 AND off = 0)) OR (kind = 11 AND off = 1)),
named AS (SELECT cm, lag(cm) OVER (ORDER BY cm) AS prev FROM files WHERE kind NOT IN (1, 2, 3, 13)),
hits AS (
  SELECT 'R1' AS rule, 'fail' AS severity, count(*) AS violations FROM files WHERE kind = 3
  UNION ALL SELECT 'R2', 'fail', count(*) FROM files WHERE kind = 2
  UNION ALL SELECT 'R3', 'fail', count(*) FROM files WHERE kind = 4
  UNION ALL SELECT 'R4', 'fail', count(*) FROM files WHERE kind = 1
  UNION ALL SELECT 'R5', 'fail', count(*) FROM files WHERE kind = 13
  UNION ALL SELECT 'R6', 'fail', count(*) FROM files WHERE kind = 5
  UNION ALL SELECT 'R7', 'fail', count(*) FROM files WHERE kind = 5
  UNION ALL SELECT 'R8', 'fail', count(DISTINCT cm) FROM leaf JOIN files USING (cm) WHERE kind = 8 AND pc = 3
  UNION ALL SELECT 'R9', 'fail', count(*) FROM files WHERE kind = 6
  UNION ALL SELECT 'R10', 'fail', count(*) FROM blank
  UNION ALL SELECT 'R11', 'fail', count(*) FROM files WHERE kind = 7
  UNION ALL SELECT 'R12', 'fail', 1 FROM files HAVING count(*) <> 16
  UNION ALL SELECT 'R14', 'fail', count(*) FROM named WHERE prev + INTERVAL 1 MONTH <> cm
  UNION ALL SELECT 'R15', 'fail', count(DISTINCT cm) FROM leaf JOIN files USING (cm)
            WHERE kind = 9 AND pc = 3 AND cm NOT IN (SELECT cm FROM blank)
  UNION ALL SELECT 'V1', 'warn', count(DISTINCT cm) FROM leaf JOIN files USING (cm)
            WHERE kind = 12 AND pc = 2 AND NOT EXISTS (
              SELECT 1 FROM cells c WHERE c.off = 0 AND c.cm = leaf.cm AND c.batch = leaf.batch AND c.pc = leaf.pc
                                    AND c.pd = leaf.pd AND c.mc = leaf.mc AND c.ty = leaf.ty)
  UNION ALL SELECT 'V2', 'warn', count(DISTINCT cm) FROM split JOIN files USING (cm)
            WHERE kind IN (0, 6, 7, 8, 10, 11, 12) OR (kind = 9 AND pc <> 3))
"""

_LONG_NAMES = "array_to_string([strftime(cm + to_months(cast(i AS integer)), '%b') FOR i IN range(0, 5)], '{0}')"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query."""
    forecasts = _MATCHED + "SELECT * FROM forecasts"
    history = _GRID + "SELECT * FROM history"
    profile = (
        _GRID
        + f"""SELECT file, calc_month, {_LONG_NAMES.format(' → ')} AS snop_months,
                    CASE WHEN month(cm) % 2 = 0 THEN 'separate header rows' ELSE 'merged names+months row' END AS layout,
                    leaf_rows, total_rows_dropped, issues FROM facts"""
    )
    return _corpus()[1] | {
        "forecasts_typed": forecasts,
        "forecasts_csv_scan": forecasts,
        "actuals_monthly": _MATCHED + "SELECT * FROM actuals",
        "hierarchy_unique": _MATCHED + "SELECT * FROM hierarchy",
        "matched_frame": _MATCHED + "SELECT * FROM matched",
        "fa_generic": _MATCHED
        + """SELECT brand, abs_err, denom, (1 - abs_err / denom) * 100 AS fa FROM (
               SELECT brand, coalesce(sum(abs(oldest_fc - actual_kl)), 0.0) AS abs_err,
                      coalesce(sum(actual_kl), 0.0) AS denom FROM m GROUP BY 1)""",
        "fa_by_month": _MATCHED + "SELECT * FROM by_month",
        "fa_long": _MATCHED
        + """SELECT snop_month, 'oldest' AS vintage, fa_oldest AS fa FROM by_month
             UNION ALL SELECT snop_month, 'latest', fa_latest FROM by_month""",
        "fa_by_brand_month": _MATCHED + "SELECT * FROM by_brand_month",
        "heat_metric": _MATCHED + "SELECT brand, snop_month, delta AS metric FROM by_brand_month",
        "brand_order": _MATCHED
        + """SELECT 'All brands' AS brand, NULL::double AS fa_latest, 0::bigint AS position
             UNION ALL
             SELECT brand, fa, row_number() OVER (ORDER BY fa NULLS FIRST, brand) FROM (
               SELECT brand, (1 - sum(abs(latest_fc - actual_kl)) / sum(actual_kl)) * 100 AS fa FROM m GROUP BY 1)""",
        "brand_list": _MATCHED + "SELECT DISTINCT brand FROM m",
        "brand_filter": _MATCHED + f"SELECT * FROM m WHERE brand <> '{DROPPED_BRAND}'",
        "brand_bias": _MATCHED + "SELECT * FROM bias",
        "top_brands": _MATCHED + "SELECT * FROM bias ORDER BY total_actual_kl DESC, brand LIMIT 5",
        "grid_leaf": _GRID
        + """SELECT file, calc_month AS calculation_month, cast(pc AS varchar) AS parent_code,
                    pd AS parent_description, mc AS material_code FROM leaf JOIN files USING (cm)""",
        "grid_melt": _GRID + "SELECT * FROM long",
        "grid_text_melt": _GRID + _TEXT
        + """SELECT file, snop_month, count(*) AS cells, sum(try_cast(cell AS double)) AS qty
             FROM texts WHERE cell <> 'n/a' AND NOT contains(cell, chr(10)) GROUP BY 1, 2""",
        "grid_non_numeric": _GRID + _TEXT
        + r"""SELECT file, count(cell) AS filled_cells,
                     count(*) FILTER (NOT regexp_full_match(cell, '-?\d*\.?\d+')) AS non_numeric_cells
              FROM texts GROUP BY 1""",
        "grand_totals": _GRID
        + "SELECT file, snop_month, abbr, cast(cast(gt AS bigint) AS varchar) AS cell, gt FROM totals",
        "grand_total_check": _GRID
        + f"""SELECT file, max(abs(coalesce(s, 0) - coalesce(gt, 0))) AS max_abs_diff_vs_grand_total
             FROM (SELECT file, snop_month, sum(qty) AS s FROM long
                   WHERE parent_code <> {DROPPED_PARENT} GROUP BY 1, 2)
             FULL JOIN (SELECT file, snop_month, gt FROM totals) USING (file, snop_month) GROUP BY 1""",
        "multi_row_materials": _GRID
        + "SELECT file, cast(pc AS varchar) AS parent_code, mc AS material_code, n_rows FROM split",
        "grid_profile": profile,
        "grid_profile_totals": _GRID
        + """SELECT count(*) AS files, cast(sum(leaf_rows) AS bigint) AS leaf_rows,
                    cast(sum(total_rows_dropped) AS bigint) AS total_rows_dropped,
                    count(*) FILTER (issues <> 'none') AS files_with_issues FROM facts""",
        "validation": _GRID
        + """SELECT file, leaf_rows, total_rows_dropped, 0.0::double AS max_abs_diff_vs_grand_total, issues FROM facts""",
        "description_vote": _GRID + "SELECT * FROM votes",
        "waterfall": history,
        "waterfall_head": history + " ORDER BY parent_code, snop_month, calculation_month LIMIT 500",
        "waterfall_stats": _GRID
        + """SELECT count(*) AS n_rows, count(DISTINCT parent_code) AS n_parents, sum(qty) AS total_qty FROM history""",
        "waterfall_roundtrip": history,
        "vintage_ties": """
            WITH lines AS (
              SELECT l_suppkey AS parent_code, cast(date_trunc('month', l_shipdate) AS date) AS snop_month,
                     date_trunc('month', o_orderdate) AS calculation_month,
                     CASE WHEN l_linenumber <> 4 THEN l_quantity END AS fc
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O')
            SELECT parent_code, snop_month, max(fc) FILTER (oldest = 1) AS oldest_fc, max(fc) FILTER (latest = 1) AS latest_fc
            FROM (SELECT *,
                    row_number() OVER (PARTITION BY parent_code, snop_month ORDER BY calculation_month, fc NULLS FIRST) AS oldest,
                    row_number() OVER (PARTITION BY parent_code, snop_month
                                       ORDER BY calculation_month DESC, fc DESC NULLS LAST) AS latest
                  FROM lines)
            GROUP BY ALL""",
        "chunk_melt": _GRID + "SELECT * FROM long",
        "chunk_profile": profile,
        "chunk_waterfall": history,
        "actuals_sheet": _MATCHED + "SELECT * FROM actuals",
        "actuals_csv_sheets": _MATCHED + "SELECT * FROM actuals",
        "hierarchy_sheet": _MATCHED + "SELECT * FROM hierarchy",
        "gated_history": history,
        "month_window": f"""
            WITH o AS (SELECT DISTINCT cast(date_trunc('month', o_orderdate) + INTERVAL 20 YEAR AS date) AS cm FROM orders),
            k AS (SELECT cm, year(cm) * 12 + month(cm) AS i FROM o),
            n AS (SELECT *, cast(i % 14 AS integer) AS span, i % 13 <> 0 AND i % 14 < 12 AS good FROM k)
            SELECT 'S&OP_grid file_' || CASE WHEN i % 13 = 0 THEN 'Foo' ELSE strftime(cm, '%b') END
                   || strftime(cm, '-%y') || ' to ' || strftime(cm + to_months(span), '%b-%y') || '_circulation.xlsx' AS file,
                   CASE WHEN good THEN cast(span + 1 AS bigint) END AS n_months,
                   CASE WHEN good THEN array_to_string([strftime(cm + to_months(cast(j AS integer)), '%Y-%m')
                                                        FOR j IN range(0, span + 1)], ' ') END AS months
            FROM n""",
        "layout_detect": _GRID
        + f"""SELECT file, 2::bigint AS anchor_row,
                    CASE WHEN month(cm) % 2 = 0 THEN 3 ELSE 2 END::bigint AS names_row,
                    CASE WHEN month(cm) % 2 = 0 THEN 4 ELSE 3 END::bigint AS data_start,
                    CASE WHEN month(cm) % 2 = 0 THEN 'separate header rows' ELSE 'merged names+months row' END AS layout,
                    {_LONG_NAMES.format(' ')} AS sheet_months, calc_month,
                    array_to_string([strftime(cm + to_months(cast(i AS integer)), '%Y-%m') FOR i IN range(0, 5)], ' ') AS snop_months
             FROM files""",
        "month_gaps": _MATCHED
        + """SELECT parent_code, prev_month, next_month FROM (
               SELECT parent_code, calculation_month AS next_month,
                      lag(calculation_month) OVER (PARTITION BY parent_code ORDER BY calculation_month) AS prev_month
               FROM (SELECT DISTINCT parent_code, calculation_month FROM forecasts))
             WHERE prev_month + INTERVAL 1 MONTH <> next_month""",
        "dq_report": _GRID + _RULES + "SELECT * FROM hits WHERE violations > 0",
    }

"""The library's inputs, derived from the generated order tables.

An open line is a forecast, made in its order month for its ship month; a finished line is
an actual sale. A product is a supplier and its brand the supplier's nation. A planning
grid file is an order month; its rows are pivoted lines with the total rows a pivot adds.
File names count years from 2000, so grid dates are moved forward by twenty years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators.spread import BROADCAST_BYTES, broadcast_small
from hindcast.sources.shared import settle
from hindcast.sources.sheets import HEADER_ROWS, heads_of_rows

YEARS_AHEAD = 20
WINDOW = 5
MONTHS = [f"m{i}" for i in range(WINDOW)]
LEAF_KEYS = ["cm", "batch", "pc", "pd", "mc", "ty"]
# An order's key and months, as text.
ORDER_BYTES = 56


# Column types of the generated tables. Given, so no file is opened to infer them.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def forecasts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts as a forecast CSV holds them, months as ``yyyy-MM-dd`` text."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "O")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("l_suppkey").alias("parent_code"),
            F.trunc("o_orderdate", "month").alias("calculation_month"),
            F.trunc("l_shipdate", "month").alias("snop_month"),
        )
        .agg(F.sum("l_quantity").alias("fc_kl"))
        .withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ["calculation_month", "snop_month"]})
    )


def forecasts_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts line by line: several of one month, and some without a value."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "O")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("parent_code"),
        F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("calculation_month"),
        F.date_format(F.trunc("l_shipdate", "month"), "yyyy-MM-dd").alias("snop_month"),
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("fc_kl"),
    )


def actuals_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill-wise sales with the header names and text months of the sales sheet."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_linestatus") == "F")
        .select(
            F.col("l_suppkey").cast("string").alias("Parent Material Code"),
            F.date_format("l_shipdate", "MMM-yyyy").alias("Month-Year"),
            F.col("l_quantity").alias("Sec Vol KL MTH (billwise)"),
        )
    )


def hierarchy_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product hierarchy in which one product of ten is missing and three are listed twice."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")

    def rows(suppliers: DataFrame, suffix: str, nation_key: Column) -> DataFrame:
        return suppliers.join(nation, nation_key == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("material_code"),
            F.concat("s_name", F.lit(suffix)).alias("material_desc"),
            F.col("n_name").alias("material_group_code"),
        )

    key = F.col("s_nationkey")
    return rows(supplier.filter(F.col("s_suppkey") % 10 != 9), "", key).unionByName(
        rows(supplier.filter(F.col("s_suppkey") % 10 < 3), " (old)", (key + 1) % 25)
    )


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with its grid file month ``cm`` and month column ``off``.

    The months from order to shipment, modulo the width of a sheet, name the column. Dates become
    months before the join, so that narrow rows move. Where orders are too many to broadcast, each
    task hashes its orders: sorting lines for them would spill.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    shipped = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("shipped")
    dated = orders.select(
        "o_orderkey",
        F.add_months(F.trunc("o_orderdate", "month"), 12 * YEARS_AHEAD).alias("cm"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("ordered"),
    )
    if orders.count() * ORDER_BYTES > BROADCAST_BYTES:
        dated = dated.hint("shuffle_hash")
    return (
        lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus", shipped)
        .join(dated, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("off", F.pmod(F.col("shipped") - F.col("ordered"), F.lit(WINDOW)))
    )


def grid_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months that have a grid file; written, as every read of a folder needs them."""
    return settle(ordered_lines(spark, sf_dir).select("cm").distinct(), "grid-months")


def makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch, parent and material of each supplier, written; ``copies`` counts rows that are listed several times."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    listed = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .filter(F.col("s_suppkey").isNotNull())
        .groupBy("s_suppkey", "s_nationkey", "r_name")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return settle(
        listed.select(
            "s_suppkey",
            F.col("r_name").alias("batch"),
            F.col("s_nationkey").cast("string").alias("pc"),
            F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("mc"),
            "copies",
        ),
        "grid-makers",
    )


def grid_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`grid_months` and the `grid_wide` of `grid_lines`, from one pass over the lines.

    Lines are pivoted by their narrow keys, and what a supplier stands for is joined to the sums. Lines
    without a part or a supplier are no row but have a month, so both joins keep them, and the months are those of
    the sums.
    """
    part = broadcast_small(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("pd")))
    typed = ordered_lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    found = F.col("p_partkey").isNotNull() & F.col("l_suppkey").isNotNull()
    sums = _pivoted(
        typed.select(
            "cm",
            F.when(found, F.col("l_suppkey")).alias("maker"),
            F.when(found, F.col("pd")).alias("pd"),
            F.when(found, F.col("l_linestatus")).alias("ty"),
            "off",
            "l_quantity",
        ),
        ["cm", "maker", "pd", "ty"],
    )
    named = sums.join(broadcast_small(makers(spark, sf_dir)), F.col("maker") == F.col("s_suppkey"), "left").select(
        "cm", "batch", "pc", "pd", "mc", "ty", *[(F.col(m) * F.col("copies")).alias(m) for m in MONTHS]
    )
    stored = settle(named, "grid-leaves")
    months = settle(stored.select("cm").distinct(), "grid-months")
    return months, _with_totals(stored.filter(F.col("mc").isNotNull()))


def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ordered_lines` with the batch, parent, description, material and type they belong to."""
    supplier, part, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "part", "nation", "region"))
    return (
        ordered_lines(spark, sf_dir)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "cm",
            F.col("r_name").alias("batch"),
            F.col("s_nationkey").cast("string").alias("pc"),
            F.col("p_type").alias("pd"),
            F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("mc"),
            F.col("l_linestatus").alias("ty"),
            "off",
            "l_quantity",
            "l_linenumber",
        )
    )


def _pivoted(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the lines by ``keys``, a column for each month of a sheet."""
    return lines.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("off") == i, F.col("l_quantity"))).alias(m) for i, m in enumerate(MONTHS)]
    )


def _with_totals(leaf: DataFrame) -> DataFrame:
    """Written leaf rows with a total row per batch and a Grand Total row per file, written too."""
    label = F.when(F.grouping("batch") == 1, "Grand Total").otherwise(F.concat("batch", F.lit(" Total")))
    sums = leaf.groupingSets([["cm", "batch"], ["cm"]], "cm", "batch").agg(
        label.alias("label"), *[F.sum(m).alias(m) for m in MONTHS]
    )
    none = F.lit(None).cast("string")
    names = LEAF_KEYS[2:]
    totals = settle(sums.select("cm", "label", *[none.alias(c) for c in names], *MONTHS), "grid-totals")
    return leaf.select("cm", F.col("batch").alias("label"), *names, *MONTHS).unionByName(totals)


def grid_wide(lines: DataFrame) -> DataFrame:
    """Pivoted leaf rows with a total row per batch and a Grand Total row per file.

    Leaf rows and total rows are written: a grid is a stored sheet, which is read as often as a
    query needs it without joining the lines again, and leaf rows move once, as total rows
    are sums over the written ones.
    """
    return _with_totals(settle(_pivoted(lines, LEAF_KEYS), "grid-leaves"))


def quantity_text(value: Column) -> Column:
    """A quantity as a sheet cell holds it: whole, without a point."""
    return value.cast("bigint").cast("string")


def body_rows(wide: DataFrame, months: DataFrame, file: Column) -> DataFrame:
    """Sheet rows below the header. Any index past the header will do, so no row is numbered.

    File names are made once for each of ``months`` and broadcast; making them for every row at every read
    takes longer than reading it.
    """
    names = months.select("cm").distinct().select(F.col("cm").alias("named_cm"), file.alias("name"))
    cells = [F.col("label"), *[F.col(c) for c in ("pc", "pd", "mc", "ty")]]
    return wide.join(F.broadcast(names), F.col("cm").eqNullSafe(F.col("named_cm")), "left").select(
        F.coalesce("name", file).alias("file"),
        F.lit(HEADER_ROWS).alias("row_idx"),
        F.array(*cells, *[F.col(f"m{i}") for i in range(WINDOW)]).alias("cells"),
    )


def header_rows(months: DataFrame, file: Column, first: Column, named: Column) -> DataFrame:
    """Header rows of each file month: names below the month row in even months, on it in odd ones.

    ``first`` is the month of the first column. Without ``named`` the code column has no name.
    """
    layouts = F.expr(
        """CASE WHEN month(cm) % 2 = 0 THEN array(
             array('Sum of qty', null, null, null, null, 'fy_month_no', 'date', null, null, null),
             concat(array_repeat(cast(null AS string), 5), fiscal),
             concat(array_repeat(cast(null AS string), 5), transform(abbr, a -> concat(' ', a))),
             concat(names, array_repeat(cast(null AS string), 5)))
           ELSE array(
             array('Sum of qty', null, null, null, null, 'fy_month_no', 'date', null, null, null),
             concat(array_repeat(cast(null AS string), 5), fiscal),
             concat(names, abbr)) END"""
    )
    return (
        months.select("cm", file.alias("file"), first.alias("first"), named.alias("named"))
        .select(
            "cm",
            "file",
            F.expr("transform(sequence(0, 4), i -> date_format(add_months(first, i), 'MMM'))").alias("abbr"),
            F.expr("transform(sequence(0, 4), i -> format_string('%02d', month(add_months(first, i - 3))))").alias("fiscal"),
            F.expr(
                "array('batch', if(named, 'parent_code', null), 'parent_description', 'material_code', 'type')"
            ).alias("names"),
        )
        .select("file", F.posexplode(layouts).alias("row_idx", "cells"))
    )


def file_name(first: Column, last: Column, ending: str = "") -> Column:
    return F.concat(
        F.lit("S&OP_grid file_"),
        F.date_format(first, "MMM-yy"),
        F.lit(" to "),
        F.date_format(last, "MMM-yy"),
        F.lit(f"_circulation{ending}.xlsx"),
    )


def plain_name() -> Column:
    return file_name(F.col("cm"), F.add_months("cm", WINDOW - 1))


def grid_rows(
    months: DataFrame, lines: DataFrame | None = None, text: bool = False, filled: bool = False, wide: DataFrame | None = None
) -> DataFrame:
    """A folder of well-formed grids as sheet rows, one file per order month.

    They come from ``lines``, or from a grid that is ``wide`` already.
    With ``text`` every line is a row of its own whose cell may hold text that is no number.
    With ``filled`` a Grand Total row shows 0 for a month without lines.
    """
    if text:
        cell = (
            F.when(F.col("l_linenumber") == 7, "n/a")
            .when(F.col("l_linenumber") == 6, "1e5")
            .when(F.col("l_linenumber") == 5, F.concat(quantity_text(F.col("l_quantity")), F.lit("\n")))
            .otherwise(quantity_text(F.col("l_quantity")))
        )
        wide = lines.withColumn("label", F.col("batch")).withColumns(
            {f"m{i}": F.when(F.col("off") == i, cell) for i in range(WINDOW)}
        )
    else:
        wide = grid_wide(lines) if wide is None else wide
        wide = wide.withColumns({f"m{i}": quantity_text(F.col(f"m{i}")) for i in range(WINDOW)})
    if filled:
        total = F.col("label") == "Grand Total"
        wide = wide.withColumns({f"m{i}": F.coalesce(f"m{i}", F.when(total, F.lit("0"))) for i in range(WINDOW)})
    return header_rows(months, plain_name(), F.col("cm"), F.lit(True)).unionByName(body_rows(wide, months, plain_name()))


def faulty_grid_rows(months: DataFrame, lines: DataFrame | None = None, wide: DataFrame | None = None) -> DataFrame:
    """The same folder with one kind of fault in most files, by file month modulo 14.

    1 name with an ending; 2 reversed window; 3 unknown month name; 4 no code column;
    5 sheet months one late; 6 Grand Total row twice; 7 text in a Grand Total cell;
    8 parent 3 with a code that is no number; 9 parent 3 missing; 11 a blank Grand Total cell;
    12 text in empty cells of parent 2; 13 a year in digits that are no ASCII; 0 and 10 none.
    """
    kind = (F.year("cm") * 12 + F.month("cm")) % 14
    last = F.add_months("cm", WINDOW - 1)
    name = (
        F.when(kind == 1, file_name(F.col("cm"), last, " (1)"))
        .when(kind == 2, file_name(last, F.col("cm")))
        .when(kind == 3, F.regexp_replace(plain_name(), "file_...", "file_Foo"))
        .when(kind == 13, F.translate(plain_name(), "0123456789", "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669"))
        .otherwise(plain_name())
    )
    wide = grid_wide(lines) if wide is None else wide
    total = F.col("label") == "Grand Total"
    faulty = (
        wide.filter(~((kind == 9) & F.coalesce(F.col("pc") == "3", F.lit(False))))
        .withColumn("pc", F.when((kind == 8) & (F.col("pc") == "3"), "x3").otherwise(F.col("pc")))
        .withColumns({f"m{i}": quantity_text(F.col(f"m{i}")) for i in range(WINDOW)})
        .withColumn("m0", F.when((kind == 7) & total, "n/a").otherwise(F.col("m0")))
        .withColumn("m0", F.when((kind == 12) & (F.col("pc") == "2") & F.col("m0").isNull(), "n/a").otherwise(F.col("m0")))
        .withColumn("m1", F.when(~((kind == 11) & total), F.col("m1")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when((kind == 6) & total, 2).otherwise(1))))
    )
    first = F.add_months("cm", F.when(kind == 5, 1).otherwise(0))
    return header_rows(months, name, first, kind != 4).unionByName(body_rows(faulty, months, name))


def _spread(rows: DataFrame, per_chunk: int) -> DataFrame:
    """Rows with a chunk number from 1, by their hash, so that chunks are of like size.

    Files are counted first. The counts are broadcast while they measure little, so that rows stay where they are.
    """
    total = settle(rows.groupBy("file").agg(F.count(F.lit(1)).alias("in_file")), "grid-counts")
    numbered = rows.join(broadcast_small(total), "file")
    return numbered.withColumn(
        "chunk", (F.pmod(F.xxhash64("cells"), F.ceil(F.col("in_file") / per_chunk)) + 1).cast("int")
    )


def chunks_of(rows: DataFrame, per_chunk: int = 200) -> DataFrame:
    """Sheet rows as bounded chunks that carry their header; chunk 0 holds the header alone.

    Rows move once, to their chunk; headers come to the chunks while they measure little.
    """
    heads = settle(heads_of_rows(rows), "grid-heads")
    row = F.struct("row_idx", "cells")
    body = _spread(rows.filter(F.col("row_idx") >= HEADER_ROWS), per_chunk)
    body = body.groupBy("file", "chunk").agg(F.collect_list(row).alias("rows"))
    first = heads.select("file", F.lit(0).alias("chunk"), "head", F.col("head").alias("rows"))
    return first.unionByName(body.join(broadcast_small(heads), "file").select("file", "chunk", "head", "rows"))


def sheet_of(table_: DataFrame, header_row: int, per_chunk: int = 200) -> DataFrame:
    """A table as chunks of one sheet with a header row below ``header_row`` rows of title."""
    title = [F.struct(F.lit(i).alias("row_idx"), F.array(F.lit("title")).alias("cells")) for i in range(header_row)]
    names = F.struct(F.lit(header_row).alias("row_idx"), F.array(*map(F.lit, table_.columns)).alias("cells"))
    rows = table_.select(
        F.lit("sheet").alias("file"),
        F.lit(header_row + 1).alias("row_idx"),
        F.array(*[F.col(c).cast("string") for c in table_.columns]).alias("cells"),
    )
    body = _spread(rows, per_chunk).groupBy("file", "chunk").agg(F.collect_list(F.struct("row_idx", "cells")).alias("rows"))
    return body.select("file", "chunk", F.array(*title, names).alias("head"), "rows")

import pytest
from pyspark.sql import functions as F
from workbooks import grid_folder, merged_header, separate_header

from hindcast.operators import grid

A = "S&OP_grid file_Nov-25 to Jan-26_circulation.xlsx"
B = "S&OP_grid file_Dec-25 to Feb-26_circulation.xlsx"
BODY_A = [
    ["b1", 11, "eleven", "m1", "co", 1, None, 239.9954],
    ["b1", 11, "eleven", "m1", "non co", 2, 3, None],
    ["b1", 12, "twelve", "m2", "co", None, None, None],
    ["b1 Total", None, None, None, None, 3, 3, 239.9954],
    ["Grand Total", None, None, None, None, 3, 3, 239.9954],
]
BODY_B = [
    ["b1", 11, "eleven!", "m1", "co", ".5", "1e5", "n/a"],
    ["Grand Total", None, None, None, None, 0.5, 100000, 0],
]


@pytest.fixture(scope="module", params=["rows", "chunks"])
def folder(request, spark):
    files = {
        A: separate_header(["Nov", "Dec", "Jan"]) + BODY_A,
        B: merged_header(["Dec", "Jan", "Feb"]) + BODY_B,
    }
    return grid_folder(spark, files, request.param, settled=True)


def test_layouts(folder):
    got = {r.file: r for r in folder.layout.collect()}
    a, b = got[A], got[B]
    assert (a.anchor_row, a.names_row, a.data_start, a.layout) == (2, 3, 4, "separate header rows")
    assert (b.anchor_row, b.names_row, b.data_start, b.layout) == (2, 2, 3, "merged names+months row")
    assert a.calc_month == "2025-11" and b.calc_month == "2025-12"
    assert [tuple(m) for m in a.months] == [(5, "Nov", "2025-11"), (6, "Dec", "2025-12"), (7, "Jan", "2026-01")]


def test_header_below_the_sixth_row_is_not_found(spark):
    rows = [[None, "x"]] * 4 + separate_header(["Nov", "Dec", "Jan"]) + BODY_A
    got = grid_folder(spark, {A: rows}).layout.first()
    assert got.data_start is None and got.months is None and got.layout is None


def test_one_month_name_is_no_month_row(spark):
    rows = [["Nov", "parent_code"], [None, "Nov", "Dec", "Jan"]]
    got = grid_folder(spark, {A: rows}).layout.first()
    assert (got.anchor_row, got.names_row, got.data_start) == (1, 0, 2)


def test_blanks_between_month_columns(spark):
    rows = [["batch", "parent_code", None, None, "Nov", None, "Dec", "x", "Jan"], ["b", 1, "d", "m", 1, 9, 2, 9, 3]]
    got = grid.melt(grid_folder(spark, {A: rows}, "chunks").bound).orderBy("snop_month").collect()
    assert [(r.snop_month, r.qty) for r in got] == [("2025-11", 1.0), ("2025-12", 2.0), ("2026-01", 3.0)]


def test_melt_drops_totals_and_empty_cells(folder):
    got = sorted((r.calculation_month, r.snop_month, r.parent_code, r.material_code, r.qty) for r in folder.long.collect())
    assert got == [
        ("2025-11", "2025-11", 11, "m1", 1.0),
        ("2025-11", "2025-11", 11, "m1", 2.0),
        ("2025-11", "2025-12", 11, "m1", 3.0),
        ("2025-11", "2026-01", 11, "m1", 239.9954),
        ("2025-12", "2025-12", 11, "m1", 0.5),
        ("2025-12", "2026-01", 11, "m1", 100000.0),
    ]
    assert dict(folder.long.dtypes)["parent_code"] == "bigint"


def test_short_rows_are_padded_with_nothing(spark):
    rows = merged_header(["Nov", "Dec", "Jan"]) + [["b", 1, "d"], ["b", 1, "d", "m", "t", 4], []]
    got = grid.melt(grid_folder(spark, {A: rows}).bound).collect()
    assert [(r.snop_month, r.qty) for r in got] == [("2025-11", 4.0)]


def test_parent_code_that_is_no_integer(spark):
    head = merged_header(["Nov", "Dec", "Jan"])
    empty = grid_folder(spark, {A: head + [["b", "x1", "d", "m", "t"], ["b", 1, "d", "m", "t", 4]]})
    assert grid.melt(empty.bound).count() == 1
    assert empty.facts.first().bad_parents == 0
    filled = grid_folder(spark, {A: head + [["b", "x1", "d", "m", "t", 4], ["b", "1.0", "d", "m", "t", 4]]})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        grid.melt(filled.bound).collect()
    assert filled.facts.first().bad_parents == 2
    assert [r.parent_code for r in filled.long.collect()] == [None, None]


def test_profile(folder):
    got = {r.file: r for r in folder.profile().collect()}
    assert got[A].snop_months == "Nov → Dec → Jan"
    assert (got[A].leaf_rows, got[A].total_rows_dropped) == (3, 2)
    assert got[A].issues == "1 material(s) split across multiple rows/types (e.g. 11/m1)"
    assert (got[B].leaf_rows, got[B].total_rows_dropped) == (1, 1)
    assert got[B].issues == "2 non-numeric qty cell(s) set to null"
    assert tuple(grid.profile_totals(folder.facts).first()) == (2, 4, 3, 2)


def test_profile_without_issues(spark):
    sheet = grid_folder(spark, {A: merged_header(["Nov", "Dec", "Jan"]) + [["b", 1, "d", "m", "t", 4]]})
    assert sheet.profile().first().issues == "none"


def test_non_numeric_cells_by_file(spark, folder):
    got = {r.file: (r.filled_cells, r.non_numeric_cells) for r in grid.non_numeric_cells(folder.bound).collect()}
    assert got == {A: (4, 0), B: (3, 2)}


def test_grand_totals(folder):
    got = {(r.file == A, r.abbr): (r.cell, r.gt) for r in folder.totals.collect()}
    assert got[(True, "Jan")] == ("239.9954", 239.9954) and got[(False, "Jan")] == ("100000", 100000.0)


def test_multi_row_materials(folder):
    counts = grid.material_counts(folder.bound)
    assert [tuple(r) for r in grid.multi_row_materials(counts).collect()] == [(A, "11", "m1", 2)]


def test_validation(folder):
    got = {r.file: r.max_abs_diff_vs_grand_total for r in folder.validation().collect()}
    assert got == {A: 0.0, B: 0.0}


def test_file_without_months_has_difference_zero(spark):
    sheet = grid_folder(spark, {"x.xlsx": [["a", "b"]]})
    assert sheet.validation().first().max_abs_diff_vs_grand_total == 0.0
    assert sheet.long.select(F.count("*")).first()[0] == 0


def test_rows_of_one_file_are_spread_over_partitions(spark):
    body = [["b", i % 7, "d", f"m{i}", "t", 1, 2, 3] for i in range(200)]
    folder = grid_folder(spark, {A: merged_header(["Nov", "Dec", "Jan"]) + body})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert folder.bound.filter("row_idx >= data_start").select(F.spark_partition_id()).distinct().count() > 1
        assert folder.long.count() == 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_chunks_bind_without_a_shuffle(spark):
    folder = grid_folder(spark, {A: merged_header(["Nov", "Dec", "Jan"])}, "chunks")
    plan = folder.long._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_grand_total_rows_anywhere_are_counted_on_the_way(spark):
    """Above the data, with a parent code, and several of them, against the rows themselves."""
    name = "S&OP_grid file_Nov-25 to Dec-25_circulation.xlsx"
    rows = [["Grand Total", None, None, None, None, 5, 6], *merged_header(["Nov", "Dec"])]
    rows += [["b", 11, "d", "m", "t", 1, 2], ["Grand Total", 11, "d", "m", "t", 3, 4], ["Grand Total", None, None, None, None, 1, 2]]
    folder = grid_folder(spark, {name: rows}, "rows")
    facts = folder.facts.first()
    assert (facts.leaf_rows, facts.total_rows_dropped, facts.grand_total_rows, facts.split_materials) == (2, 1, 3, 1)


def test_a_file_with_most_rows_is_dealt_over_counted_tasks(spark, monkeypatch):
    from hindcast.operators import grid

    monkeypatch.setattr(grid, "TASK_ROWS", 50)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("f"), F.col("id") % 100)).otherwise("hot").alias("file"),
        F.col("id").cast("int").alias("row_idx"),
        F.array(F.lit("x"), F.col("id").cast("string")).alias("cells"),
    )
    layout = rows.select("file").distinct().select("file", F.lit("2025-01").alias("calc_month"), F.lit(0).alias("data_start"), F.array(F.lit(1)).alias("months"))
    bound = grid.bound_rows(rows, layout)
    assert bound.count() == 3000 and bound.select("row_idx").distinct().count() == 3000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in grid.bound_rows(rows, layout).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert sum(sizes) == 3000 and max(sizes) < 300

"""Grids derived from tables: what is written once is not made again at each read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hindcast import fixtures as fx
from hindcast.plans.history import GridFolder

N = 40


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of three months; a fourth month has only lines whose part is missing."""
    folder = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(1995, 1, 15)
    ordered = [day, day.replace(month=2), day.replace(month=3), day.replace(month=4)]
    rows = {
        "region": [(1, "NORTH"), (2, "SOUTH")],
        "nation": [(i, f"N{i}", 1 + i % 2) for i in range(4)],
        "supplier": [(i, f"S{i}", i % 4, 0.0) for i in range(8)],
        "part": [(i, "p", "b", f"T{i % 3}", 1, 1.0) for i in range(5)],
        "orders": [(i, 1, "O", 1.0, ordered[i % 4], "x") for i in range(N)],
        "lineitem": [
            (i, 99 if i % 4 == 3 else i % 5, i % 8, 1 + k, float(i + k), 1.0, 0.0, 0.0, "N", "O", day.replace(month=4 + k), )
            for i in range(N)
            for k in range(3)
        ],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, fx.TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return folder


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grid_rows_are_a_stored_table(spark, tables):
    rows = fx.grid_rows(fx.grid_months(spark, tables), fx.grid_lines(spark, tables))
    assert "o_orderkey" not in plan(rows) and "grid" in rows.inputFiles()[0]
    faulty = fx.faulty_grid_rows(fx.grid_months(spark, tables), fx.grid_lines(spark, tables))
    assert "o_orderkey" not in plan(faulty)


def test_total_rows_are_sums_of_the_lines(spark, tables):
    wide = fx.grid_wide(fx.grid_lines(spark, tables))
    lines = fx.grid_lines(spark, tables)
    by_label = {r.label: r.q for r in wide.groupBy("label").agg(F.sum(sum(F.coalesce(f"m{i}", F.lit(0.0)) for i in range(fx.WINDOW))).alias("q")).collect()}
    by_batch = {r.batch: r.q for r in lines.groupBy("batch").agg(F.sum("l_quantity").alias("q")).collect()}
    assert by_label == by_batch | {f"{b} Total": q for b, q in by_batch.items()} | {"Grand Total": sum(by_batch.values())}


def test_months_without_rows_have_a_sheet(spark, tables):
    rows = fx.grid_rows(fx.grid_months(spark, tables), fx.grid_lines(spark, tables))
    by_file = {r.file: r.n for r in rows.groupBy("file").agg(F.count_if(F.col("row_idx") >= fx.HEADER_ROWS).alias("n")).collect()}
    assert len(by_file) == 4 and [f for f, n in by_file.items() if n == 0] == ["S&OP_grid file_Apr-15 to Aug-15_circulation.xlsx"]


def test_names_of_months_that_are_not_listed(spark, tables):
    """Rows keep their file, a missing month included, whatever months are given."""
    lines = fx.grid_lines(spark, tables)
    some = fx.grid_months(spark, tables).filter(F.month("cm") == 1)
    lines = lines.withColumn("cm", F.when(F.month("cm") != 3, F.col("cm")))
    rows = fx.grid_rows(some, lines).filter(F.col("row_idx") >= fx.HEADER_ROWS)
    assert {(r.file or "")[:22] for r in rows.select("file").distinct().collect()} == {"S&OP_grid file_Jan-15 ", "S&OP_grid file_Feb-15 ", ""}


def test_rows_meet_a_small_layout_where_they_are(spark, tables, monkeypatch):
    from hindcast.operators import spread

    rows = fx.grid_rows(fx.grid_months(spark, tables), fx.grid_lines(spark, tables))
    found = sorted(map(str, GridFolder(rows=rows).long.collect()))
    text = plan(GridFolder(rows=rows).long)
    assert "_place" not in text and text.count("strategy=broadcast") >= 1
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    assert found and sorted(map(str, GridFolder(rows=rows).long.collect())) == found


def test_chunks_meet_their_header_where_they_are(spark, tables, monkeypatch):
    from hindcast.operators import spread

    rows = fx.grid_rows(fx.grid_months(spark, tables), fx.grid_lines(spark, tables))
    chunks = fx.chunks_of(rows, 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        physical = chunks._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in physical and "hashpartitioning(file#" in physical and "chunk#" in physical
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    found = sorted(map(str, GridFolder(chunks=chunks).long.collect()))
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    assert found and sorted(map(str, GridFolder(chunks=fx.chunks_of(rows, 5)).long.collect())) == found


def test_one_pass_gives_the_rows_of_the_lines(spark, tables, tmp_path):
    """Suppliers, nations and parts listed twice multiply lines; missing and null keys leave a month without rows."""
    again = {"supplier": "s_suppkey = 3", "nation": "n_nationkey = 1", "part": "p_partkey = 2"}
    for name, types in fx.TABLES.items():
        df = spark.read.parquet(f"{tables}/{name}.parquet")
        if name in again:
            df = df.unionByName(df.filter(again[name]))
        if name == "supplier":
            df = df.unionByName(df.filter("s_suppkey = 5").withColumn("s_nationkey", F.lit(2)))
        if name == "lineitem":
            df = df.withColumn("l_suppkey", F.expr("if(l_linenumber = 2, null, if(l_orderkey = 5, 77, l_suppkey))"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    months, wide = fx.grid_tables(spark, str(tmp_path))
    old = fx.grid_wide(fx.grid_lines(spark, str(tmp_path)))
    assert sorted(map(str, wide.select(*old.columns).collect())) == sorted(map(str, old.collect()))
    assert sorted(r.cm for r in months.collect()) == sorted(r.cm for r in fx.grid_months(spark, str(tmp_path)).collect())
    assert months.count() == 4


def test_lines_meet_orders_once(spark, tables, monkeypatch):
    """Months and rows come from one pass, in which suppliers are joined to sums."""
    made = []
    keep = fx.settle
    monkeypatch.setattr(fx, "settle", lambda df, name: (made.append((name, plan(df))), keep(df, name))[1])
    fx.grid_tables(spark, tables)
    assert [name for name, text in made if "o_orderkey" in text] == ["grid-leaves"]
    leaves = dict(made)["grid-leaves"]
    assert leaves.index("Join LeftOuter, (maker") < leaves.index("Aggregate [cm#")


def test_melt_of_chunks_is_not_written_on_the_way(spark, tables):
    import __spark_entry__ as entry

    files = entry.queries()["chunk_melt"](spark, tables).inputFiles()
    assert files and not [f for f in files if "grid-long" in f or "grid-source" in f]


def test_lines_meet_their_orders_without_a_sort(spark, tables, monkeypatch):
    """Too many to broadcast, orders are hashed; else Spark picks the join."""
    few = fx.ordered_lines(spark, tables)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(fx, "BROADCAST_BYTES", N * fx.ORDER_BYTES - 1)
    many = fx.ordered_lines(spark, tables)
    physical = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in physical and "Sort" not in physical
    assert many.exceptAll(few).count() == few.exceptAll(many).count() == 0 and many.count() == 3 * N

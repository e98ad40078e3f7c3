"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest
from oracle import connection, differences

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no generated tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


def own(names) -> list[str]:
    """Without the training-data operators, which have tests of their own."""
    return sorted(n for n in names if n != "pipeline" and not n.startswith("op"))


@pytest.mark.parametrize("name", own(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    rows, diff = differences(df, con, sql)
    assert rows > 0 and not diff


def test_entry(spark):
    assert entry.entry(spark).columns == ["snop_month", "fa_oldest", "fa_latest"]


def test_every_oracle_has_a_query():
    assert own(entry.oracle_sql()) == own(entry.queries())


def test_sums_agree_along_the_grid_path(spark):
    from pyspark.sql import functions as F

    from hindcast import fixtures as fx
    from hindcast.plans.history import GridFolder

    rows = fx.grid_rows(fx.grid_months(spark, SF_DIR), fx.grid_lines(spark, SF_DIR))
    folder = GridFolder(rows=rows, settled=True)
    sums = {
        folder.long.agg(F.sum("qty")).first()[0],
        folder.totals.agg(F.sum("gt")).first()[0],
        folder.history().agg(F.sum("qty")).first()[0],
        fx.ordered_lines(spark, SF_DIR).agg(F.sum("l_quantity")).first()[0],
    }
    assert len(sums) == 1


def test_every_line_is_in_the_grids(spark):
    from hindcast import fixtures as fx

    assert fx.ordered_lines(spark, SF_DIR).count() == fx.table(spark, SF_DIR, "lineitem").count()


def test_file_facts_move_rows_once(spark, tmp_path):
    """Rows are read once and move once, as counts by material."""
    import re

    from hindcast.operators import grid
    from hindcast.plans.history import GridFolder

    name = "S&OP_grid file_Nov-25 to Dec-25_circulation.xlsx"
    spark.createDataFrame([(name, 0, ["a"])], "file string, row_idx int, cells array<string>").write.parquet(str(tmp_path / "rows"))
    folder = GridFolder(rows=spark.read.parquet(str(tmp_path / "rows")))
    folder.layout.write.parquet(str(tmp_path / "layout"))
    layout = spark.read.parquet(str(tmp_path / "layout"))
    facts = grid.file_facts(grid.bound_rows(folder.source, layout), layout)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[file#\d+, \w+#\d+, \w+#\d+, \w+#\d+\]", plan)) == 1
    assert len(re.findall(r"Relation \[file#\d+,row_idx", plan)) == 1


def test_matched_rows_are_unique(spark):
    df = entry.queries()["matched_frame"](spark, SF_DIR)
    assert df.groupBy("parent_code", "snop_month").count().filter("count > 1").count() == 0

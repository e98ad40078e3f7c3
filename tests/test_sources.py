import pytest
from workbooks import write_workbook

from hindcast.plans.accuracy import read_matched, report
from hindcast.sources.history import read_history_csv, write_history_csv, write_history_parquet
from hindcast.sources.sheets import list_files, named_columns, read_csv_sheets, read_workbooks
from hindcast.sources.tables import read_actuals, read_forecasts, read_hierarchy

NAME = "S&OP_grid file_Aug-25 to Sep-25_circulation"


def rows_of(df):
    chunks = df.orderBy("file", "chunk").collect()
    for r in chunks:
        assert [tuple(h) for h in r.head] == [tuple(w) for c in chunks for w in c.rows if c.file == r.file and w.row_idx < 6]
    return [(r.file, w.row_idx, w.cells) for r in chunks for w in r.rows]


def test_inventory_sorted_with_sizes(spark, tmp_path):
    for name, size in [("b.xlsx", 2304), ("a 1+2.xlsx", 100), ("c.txt", 5)]:
        (tmp_path / name).write_bytes(b"x" * size)
    found = list_files(spark, str(tmp_path)).collect()
    assert [(r.file, r.size_kb) for r in found] == [("a 1+2.xlsx", 0.1), ("b.xlsx", 2.2)]
    assert all(r.modified is not None for r in found)


@pytest.mark.parametrize("inline", [False, True])
def test_workbook_cells_become_text(spark, tmp_path, inline):
    sheet = [
        [None] * 5,
        ["Sum of qty", None, None, 7, True],
        [None] * 5,
        ["a & <b>", None, 239.9954, 1e-7, -3.0],
    ]
    write_workbook(tmp_path / f"{NAME}.xlsx", {"other": [["no"]], "full_s&op": sheet}, inline)
    got = rows_of(read_workbooks(spark, str(tmp_path)))
    assert got == [
        (f"{NAME}.xlsx", 0, ["Sum of qty", None, "7", "true"]),
        (f"{NAME}.xlsx", 1, ["a & <b>", "239.9954", "0.0000001", "-3"]),
    ]


def test_sheet_numbers_kept_when_asked(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", {"s": [["t"], [None], [None, "x"]]})
    got = rows_of(read_workbooks(spark, str(tmp_path), sheet=None, drop_empty=False))
    assert got == [("a.xlsx", 0, ["t", None]), ("a.xlsx", 2, [None, "x"])]


def test_missing_or_empty_sheet_leaves_a_trace(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", {"s": [["x"]]})
    write_workbook(tmp_path / "b.xlsx", {"full_s&op": [[None]]})
    got = read_workbooks(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r.file, r.chunk, r.head, r.rows) for r in got] == [("a.xlsx", 0, [], []), ("b.xlsx", 0, [], [])]


def test_long_sheet_comes_in_chunks(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", {"full_s&op": [[i, f"t{i}"] for i in range(4500)]})
    got = read_workbooks(spark, str(tmp_path))
    assert [(r.chunk, len(r.rows)) for r in got.orderBy("chunk").collect()] == [(0, 1000), (1, 1000), (2, 1000), (3, 1000), (4, 500)]
    assert [i for _, i, _ in rows_of(got)] == list(range(4500))


def test_csv_sheet_quotes_commas_and_breaks(spark, tmp_path):
    text = 'a,"b, ""c""",\r\n,,\r\n"line\nbreak",,3\n\n"' + "x" * 50000 + '",1,2\n'
    (tmp_path / "S&OP +1.csv").write_bytes(text.encode())
    assert rows_of(read_csv_sheets(spark, str(tmp_path))) == [
        ("S&OP +1.csv", 0, ["a", 'b, "c"', None]),
        ("S&OP +1.csv", 1, ["line\nbreak", None, "3"]),
        ("S&OP +1.csv", 2, ["x" * 50000, "1", "2"]),
    ]


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of some two hundred bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def as_csv(rows, end):
    def cell(c):
        return "" if c is None else '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c

    return "".join(",".join(map(cell, row)) + end for row in rows)


@pytest.mark.parametrize("broadcast", [True, False])
def test_csv_sheets_over_many_ranges(spark, tmp_path, monkeypatch, small_ranges, broadcast):
    """Cells with quotes and line breaks, some longer than several ranges, against Python's own reader."""
    import csv
    import io
    import random

    from hindcast.operators import spread
    from hindcast.sources import sheets

    if not broadcast:
        monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(sheets, "ROWS_PER_CHUNK", 4)
    expected = {}
    for file in range(4):
        rng = random.Random(file)
        plain = ["x", "plain", "7", "a,b", 'say "hi"', "line\nbreak", "é😀", "y" * 150]
        rows = [[rng.choice([None, *plain]) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(30, 90))]
        rows[10] = ["long", "\n".join(f'row {i}, "quoted"' for i in range(60))]
        if file == 3:
            rows[0] = ["\n" * 500 + "first", "1"]
        text = as_csv(rows, "\r\n" if file % 2 else "\n")
        (tmp_path / f"f{file}.csv").write_bytes(text.encode())
        read = [[c or None for c in row] for row in csv.reader(io.StringIO(text, newline=""))]
        kept = [row for row in read if any(c and c.strip() for c in row)]
        expected |= {(f"f{file}.csv", i): row for i, row in enumerate(kept)}
    (tmp_path / "empty.csv").write_text("\n,,\n")
    chunks = read_csv_sheets(spark, str(tmp_path))
    assert {(f, i): cells for f, i, cells in rows_of(chunks)} == expected
    got = chunks.orderBy("file", "chunk").collect()
    for name in {r.file for r in got}:
        own = [r for r in got if r.file == name]
        assert own[0].chunk == 0 and len({r.chunk for r in own}) == len(own)
        assert all(r.head == own[0].head and len(r.rows) <= 4 for r in own)
        assert [r.row_idx for r in own[0].head] == list(range(min(6, sum(len(r.rows) for r in own))))
    assert [len(r.rows) for r in got if r.file == "empty.csv"] == [0]
    assert len(got) > 60


def test_a_quote_that_is_never_closed_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="never closed"):
        read_csv_sheets(spark, str(tmp_path))


def test_named_columns_follow_each_header(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", {"s": [["title"], ["Key", "My-Value"], ["k1", 1]]})
    write_workbook(tmp_path / "b.xlsx", {"s": [["title"], ["My Value", "x", "KEY"], [2, "-", "k2"]]})
    rows = read_workbooks(spark, str(tmp_path), sheet=None, drop_empty=False)
    got = named_columns(rows, 1, ["key", "my_value"]).orderBy("file").collect()
    assert [tuple(r) for r in got] == [("a.xlsx", "k1", "1"), ("b.xlsx", "k2", "2")]
    with pytest.raises(Exception, match="no header row with a column absent"):
        named_columns(rows, 1, ["absent"]).collect()


def forecasts_csv(folder):
    folder.mkdir()
    (folder / "forecast_a.csv").write_text(
        "parent_code,calculation_month,snop_month,fc_kl\n702082,2026-03-01,2026-04-01,5.0\n702082,2026-02-01,2027-03-01,5.0\n"
    )
    (folder / "forecast_b.csv").write_text("parent_code,calculation_month,snop_month,fc_kl\n702082,2026-02-01,2026-04-01,4\n")
    (folder / "other.csv").write_text("a,b\n1,2\n")
    return str(folder)


def test_forecasts_of_a_folder(spark, tmp_path):
    got = read_forecasts(spark, forecasts_csv(tmp_path / "common"), "forec*")
    assert dict(got.dtypes) == {"parent_code": "bigint", "calculation_month": "date", "snop_month": "date", "fc_kl": "double"}
    assert sorted((str(r.calculation_month), str(r.snop_month), r.fc_kl) for r in got.collect()) == [
        ("2026-02-01", "2026-04-01", 4.0),
        ("2026-02-01", "2027-03-01", 5.0),
        ("2026-03-01", "2026-04-01", 5.0),
    ]


@pytest.mark.parametrize("line", ["702082,2026/03/01,2026-04-01,5.0", "x,2026-03-01,2026-04-01,5.0"])
def test_bad_forecast_raises(spark, tmp_path, line):
    (tmp_path / "forecast.csv").write_text(f"parent_code,calculation_month,snop_month,fc_kl\n{line}\n")
    with pytest.raises(Exception):
        read_forecasts(spark, str(tmp_path)).collect()


def sales_and_hierarchy(tmp_path):
    sales, tree = tmp_path / "sales", tmp_path / "ph"
    sales.mkdir()
    tree.mkdir()
    head = ["Parent Material Code", "Month-Year", "Sec Vol KL MTH (billwise)"]
    body = [["702082", "Apr-2026", 0.25], ["702082", "Apr-2026", 3.75], ["702082", "May-2026", None]]
    write_workbook(sales / "sales.xlsx", {"x": [["title"], [None], ["a"], ["b"], ["c"], head, *body]})
    write_workbook(
        tree / "ph.xlsx",
        {"x": [["material_code", "material_desc", "material_group_code"], [702082, "B", "late"], [702082, "A", "early"]]},
    )
    return str(sales), str(tree)


def test_sales_header_on_sixth_row(spark, tmp_path):
    sales, _ = sales_and_hierarchy(tmp_path)
    got = {str(r.snop_month): (r.parent_code, r.actual_kl) for r in read_actuals(spark, sales).collect()}
    assert got == {"2026-04-01": (702082, 4.0), "2026-05-01": (702082, 0.0)}


def test_hierarchy_header_on_first_row(spark, tmp_path):
    _, tree = sales_and_hierarchy(tmp_path)
    assert [tuple(r) for r in read_hierarchy(spark, tree).collect()] == [(702082, "early")]


def test_three_folders_to_report(spark, tmp_path):
    sales, tree = sales_and_hierarchy(tmp_path)
    folder = forecasts_csv(tmp_path / "common")
    (tmp_path / "common" / "other.csv").unlink()
    matched = read_matched(spark, folder, sales, tree)
    assert [tuple(map(str, r)) for r in matched.collect()] == [("702082", "2026-04-01", "4.0", "4.0", "5.0", "early")]
    tables = report(matched)
    assert [(r.fa_oldest, r.fa_latest) for r in tables.by_month.collect()] == [(100.0, 75.0)]
    assert {r.vintage: r.fa for r in tables.by_month_long.collect()} == {"oldest": 100.0, "latest": 75.0}
    assert list(tables.by_month_long.toPandas().columns) == ["snop_month", "vintage", "fa"]
    assert {r.brand: r.metric for r in tables.heat("delta").collect()} == {"All brands": -25.0, "early": -25.0}
    assert [r.brand for r in tables.brand_order.orderBy("position").collect()] == ["All brands", "early"]
    assert tables.bias.first().pct_revised_up == 100.0
    assert tables.top_brands.count() == 1
    assert report(matched, ["other"]).by_month.count() == 0


def test_history_round_trip(spark, tmp_path):
    schema = "calculation_month string, snop_month string, parent_code bigint, parent_description string, qty double"
    rows = [
        ("2025-08", "2025-09", 2, 'a "b", c', 239.9954),
        ("2025-08", "2025-08", 1, None, 0.1 + 0.2),
        ("2025-09", "2025-09", 1, "x", 5e-9),
    ]
    history = spark.createDataFrame(rows, schema)
    write_history_csv(history, str(tmp_path / "deep" / "csv"))
    back = [tuple(r) for r in read_history_csv(spark, str(tmp_path / "deep" / "csv")).collect()]
    assert sorted(back) == sorted(rows)
    lines = [
        line
        for part in sorted((tmp_path / "deep" / "csv").glob("part-*.csv"))
        for line in part.read_text().splitlines()
        if not line.startswith("calculation_month")
    ]
    assert [line[:17] for line in lines] == ["2025-08,2025-08,1", "2025-09,2025-09,1", "2025-08,2025-09,2"]
    write_history_parquet(history, str(tmp_path / "pq"))
    parquet = spark.read.parquet(str(tmp_path / "pq")).filter("calculation_month = '2025-09'")
    assert parquet.count() == 1
    assert "PartitionFilters: [isnotnull(calculation_month" in parquet._jdf.queryExecution().toString()


def test_number_formats_of_dates(tmp_path):
    import io
    import zipfile

    from hindcast.sources.workbook import sheet_rows

    path = tmp_path / "dated.xlsx"
    write_workbook(path, {"s": [[45992, 45992.5, 7], [45992, 1, 45992]]})
    styles = (
        '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="2">'
        '<numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts>'
        '<cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(path) as book, zipfile.ZipFile(out, "w") as copy:
        for name in book.namelist():
            text = book.read(name).decode()
            for cell, style in (("A1", 1), ("B1", 2), ("A2", 3)):
                text = text.replace(f'r="{cell}"', f'r="{cell}" s="{style}"')
            copy.writestr(name, text)
        copy.writestr("xl/styles.xml", styles)
    assert [c for _, c in sheet_rows(out.getvalue(), "s", True)] == [["2025-12-01", "2025-12-01T12:00:00", "7"], ["45992", "1", "45992"]]


def test_each_history_has_a_folder_of_its_own(spark, tmp_path):
    from workbooks import grid_folder, merged_header

    from hindcast.operators import quality
    from hindcast.plans.history import write_history

    name = "S&OP_grid file_Nov-25 to Dec-25_circulation.xlsx"
    rows = merged_header(["Nov", "Dec"]) + [["b", 11, "d", "m", "t", 1, 2], ["Grand Total", None, None, None, None, 1, 2]]
    folder = grid_folder(spark, {name: rows}, "chunks")
    for form in ("csv", "parquet"):
        read = write_history(folder, str(tmp_path / form), 1, form=form)
        again = write_history(folder, str(tmp_path / form), 1, form=form)
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, again.collect()))
        assert len(list((tmp_path / form).iterdir())) == 2
    with pytest.raises(ValueError):
        write_history(folder, str(tmp_path), 1, form="xml")
    with pytest.raises(quality.QualityError):
        write_history(folder, str(tmp_path / "none"), 2)
    assert not (tmp_path / "none").exists()


def test_a_history_that_breaks_rule_13_is_never_seen(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from workbooks import grid_folder, merged_header

    from hindcast.operators import quality
    from hindcast.plans.history import GridFolder, write_history

    name = "S&OP_grid file_Nov-25 to Dec-25_circulation.xlsx"
    rows = merged_header(["Nov", "Dec"]) + [["b", 11, "d", "m", "t", 1, 2], ["Grand Total", None, None, None, None, 1, 2]]
    folder = grid_folder(spark, {name: rows}, "chunks")
    good = write_history(folder, str(tmp_path), 1)
    history = GridFolder.history
    monkeypatch.setattr(GridFolder, "history", lambda self: history(self).withColumn("snop_month", F.lit("2026-13")))
    for form in ("csv", "parquet"):
        with pytest.raises(quality.QualityError, match="R13"):
            write_history(folder, str(tmp_path), 1, form=form)
    assert len(list(tmp_path.iterdir())) == 1 and good.count() == 2


def test_malformed_month_keys_are_rule_13(spark):
    from hindcast.operators import quality

    rows = [("2026-01", "2026-02", 1, "d", 1.0), ("2026-13", "2026-02", 1, "d", 1.0), (None, "2026-2", 1, "d", 1.0)]
    history = spark.createDataFrame(rows, "calculation_month string, snop_month string, parent_code long, parent_description string, qty double")
    found = quality.month_key_violations(history).collect()
    assert {r.detail for r in found} == {f"1 row(s) with the month key {k}" for k in ("2026-13", "None", "2026-2")}
    assert {r.rule for r in found} == {"R13"}


def test_passing_tables_go(spark):
    import os

    from hindcast.sources.shared import passing_tables, settle, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    kept = settle(spark.range(3), "kept")
    before = set(os.listdir(folder))
    with passing_tables(spark):
        assert settle(spark.range(5), "passing").count() == 5
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before and kept.count() == 3

import pytest
from pyspark.sql import functions as F
from workbooks import grid_folder, merged_header, separate_header, write_workbook

from hindcast.functions.months import MONTHS
from hindcast.operators import quality
from hindcast.plans.history import build_history

SPAN = ["Nov", "Dec", "Jan"]


def name(first="Nov-25", last="Jan-26"):
    return f"S&OP_grid file_{first} to {last}_circulation.xlsx"


def sheet(months=SPAN, leaf=(1, 2, 3), total=(1, 2, 3), code=11, totals=1, head=merged_header):
    rows = head(list(months)) + [["b", code, "d", "m", "t", *leaf]]
    return rows + [["Grand Total", None, None, None, None, *total]] * totals


def found(spark, files, expected=None):
    folder = grid_folder(spark, files, "chunks")
    rows = folder.violations(len(files) if expected is None else expected).collect()
    return sorted((r.rule, r.severity, r.file) for r in rows), {r.rule: r.detail for r in rows}


def test_good_file_has_no_violation(spark):
    assert found(spark, {name(): sheet()})[0] == []
    assert found(spark, {name(): sheet(head=separate_header)})[0] == []


@pytest.mark.parametrize(
    "file, rows, rules",
    [
        (name("Foo-25"), sheet(), ["R1"]),
        (name("Jan-25", "Jan-26"), sheet(), ["R2"]),
        (name("Jan-26", "Nov-25"), sheet(), ["R2"]),
        (name(), [["nothing"]], ["R3"]),
        (name(), sheet()[3:], ["R3"]),
        ("x " + name(), sheet(), ["R4"]),
        (name(), sheet(["Dec", "Nov", "Jan"]), ["R6"]),
        (name(), sheet(["Nov", "Dec"], (1, 2), (1, 2)), ["R6"]),
        (name(), sheet(["Nov", "Dec", "Feb"]), ["R6", "R7"]),
        (name(), sheet(code="1x"), ["R8"]),
        (name(), sheet(code="1x", leaf=(None, None, None), total=(0, 0, 0)), []),
        (name(), sheet(totals=0), ["R9"]),
        (name(), sheet(totals=2), ["R9"]),
        (name(), sheet(total=(1, None, 3)), ["R10"]),
        (name(), sheet(total=(None, None, 3)), ["R10", "R10"]),
        (name(), sheet(total=(1, "n/a", 3)), ["R11"]),
        (name(), sheet(total=(1, 2, 3 + 2e-6)), ["R15"]),
        (name(), sheet(total=(1, 2, 3 + 5e-7)), []),
        (name(), sheet(leaf=(None, None, None), total=(0, 0, 1)), ["R15"]),
        (name(), sheet(leaf=("n/a", 2, 3), total=(0, 2, 3)), ["V1"]),
        (name(), sheet()[:4] + sheet(total=(2, 4, 6))[3:], ["V2"]),
    ],
)
def test_rule(spark, file, rows, rules):
    assert [r for r, _, _ in found(spark, {file: rows})[0]] == rules


def test_texts(spark):
    _, detail = found(spark, {name(): sheet(["Nov", "Dec", "Feb"], code="1x")}, expected=16)
    assert detail["R12"] == "expected 16 files, found 1"
    assert detail["R6"] == "sheet months Nov Dec Feb do not match the file name's Nov Dec Jan"
    assert detail["R7"] == "months without a key: Feb"


def series(spark, starts):
    files = {}
    for i, start in enumerate(starts):
        abbr, yy = start.split("-")
        after = MONTHS[(MONTHS.index(abbr) + 1) % 12]
        last = f"{after}-{int(yy) + (abbr == 'Dec')}"
        files[name(start, last)] = sheet([abbr, after], (1, 2), (1, 2))
    return files


def test_series_across_a_year_end(spark):
    assert found(spark, series(spark, ["Nov-25", "Dec-25", "Jan-26", "Feb-26"]))[0] == []


def test_gap_in_series(spark):
    hits, detail = found(spark, series(spark, ["Nov-25", "Dec-25", "Feb-26"]))
    assert hits == [("R14", "fail", None)]
    assert detail["R14"].endswith("2025-12 → 2026-02")


def test_month_twice_in_series(spark):
    files = series(spark, ["Nov-25"]) | {name("Nov-25", "Jan-26"): sheet()}
    hits, detail = found(spark, files)
    assert hits == [("R14", "fail", None)] and detail["R14"].endswith("2025-11 → 2025-11")


def test_month_gaps_by_group(spark):
    rows = [(1, "2025-12-01"), (1, "2026-01-01"), (2, "2025-01-01"), (2, "2025-03-01"), (2, "2025-03-01")]
    df = spark.createDataFrame(rows, "k int, m string").withColumn("m", F.to_date("m"))
    got = sorted(tuple(map(str, r)) for r in quality.month_gaps(df, "m", ["k"]).collect())
    assert got == [("2", "2025-01-01", "2025-03-01"), ("2", "2025-03-01", "2025-03-01")]


def test_reconcile_counts_a_side_that_is_missing_as_zero(spark):
    long = spark.createDataFrame([("f", "2025-01", 2.0), ("f", "2025-01", -5.0)], "file string, snop_month string, qty double")
    totals = spark.createDataFrame([("f", "2025-02", 1.0), ("g", "2025-02", 0.0)], "file string, snop_month string, gt double")
    got = {r.file: r.max_abs_diff_vs_grand_total for r in quality.reconcile(long, totals).collect()}
    assert got == {"f": 3.0, "g": 0.0}


def test_all_offenders_in_one_error(spark):
    folder = grid_folder(spark, {name(): sheet(totals=0), name("Foo-25"): sheet()})
    with pytest.raises(quality.QualityError) as error:
        quality.enforce(folder.violations(16))
    text = str(error.value)
    assert all(f"{rule}: 1 " in text for rule in ("R1", "R9", "R12")) and "Foo-25" in text


def test_warnings_do_not_raise(spark):
    folder = grid_folder(spark, {name(): sheet(leaf=("n/a", 2, 3), total=(0, 2, 3))})
    quality.enforce(folder.violations(1))


def folder_of_workbooks(path, bad=False):
    for i, start in enumerate(["Nov-25", "Dec-25", "Jan-26"]):
        abbr, yy = start.split("-")
        months = [MONTHS[(MONTHS.index(abbr) + k) % 12] for k in range(3)]
        last = f"{months[-1]}-{26}"
        total = (1.5, 2, 3 + (1 if bad and i == 1 else 0))
        head = separate_header if i == 0 else merged_header
        write_workbook(path / name(start, last), {"full_s&op": sheet(months, (1.5, 2, 3), total, head=head)})


def test_workbooks_to_history(spark, tmp_path):
    folder_of_workbooks(tmp_path)
    got = build_history(spark, str(tmp_path), str(tmp_path / "out" / "csv"), expected_files=3).collect()
    assert sorted((r.calculation_month, r.snop_month, r.parent_code, r.parent_description, r.qty) for r in got) == [
        (c, s, 11, "d", q)
        for c, months in [
            ("2025-11", ["2025-11", "2025-12", "2026-01"]),
            ("2025-12", ["2025-12", "2026-01", "2026-02"]),
            ("2026-01", ["2026-01", "2026-02", "2026-03"]),
        ]
        for s, q in zip(months, (1.5, 2.0, 3.0))
    ]


@pytest.mark.parametrize("bad, expected_files", [(True, 3), (False, 16)])
def test_nothing_is_written_when_a_rule_fails(spark, tmp_path, bad, expected_files):
    folder_of_workbooks(tmp_path, bad)
    with pytest.raises(quality.QualityError):
        build_history(spark, str(tmp_path), str(tmp_path / "out"), expected_files)
    assert not (tmp_path / "out").exists()

from hindcast.operators import waterfall

LONG = "calculation_month string, snop_month string, parent_code bigint, parent_description string, material_code string, qty double"


def long(spark, rows):
    return spark.createDataFrame(rows, LONG)


def votes(spark, rows):
    df = long(spark, [(cm, "s", p, d, m, 1.0) for cm, p, d, m in rows])
    return {r.parent_code: r.parent_description for r in waterfall.description_votes(df).collect()}


def test_materials_decide_within_a_month(spark):
    rows = [("1", 7, "b", "m1"), ("1", 7, "b", "m2"), ("1", 7, "a", "m3"), ("1", 7, "a", "m3"), ("1", 7, "a", "m3")]
    assert votes(spark, rows) == {7: "b"}


def test_months_decide_across(spark):
    big = [("1", 7, "old", f"m{i}") for i in range(9)]
    assert votes(spark, big + [("2", 7, "new", "m"), ("3", 7, "new", "m")]) == {7: "new"}


def test_ties_go_to_the_smallest_text(spark):
    assert votes(spark, [("1", 7, "b", "m1"), ("1", 7, "a", "m2")]) == {7: "a"}
    assert votes(spark, [("1", 7, "b", "m"), ("2", 7, "a", "m"), ("1", 8, "Z", "m"), ("2", 8, "a", "m")]) == {7: "a", 8: "Z"}


def test_missing_description_sorts_first_and_missing_material_counts_once(spark):
    assert votes(spark, [("1", 7, None, "m1"), ("1", 7, "a", "m2")]) == {7: None}
    assert votes(spark, [("1", 7, None, None), ("1", 7, None, None), ("1", 7, "a", "m1"), ("1", 7, "a", None)]) == {7: "a"}


def test_split_rows_sum_once_and_drift_gets_one_description(spark):
    rows = [
        ("2025-01", "2025-02", 7, "x", "m", 1.0),
        ("2025-01", "2025-02", 7, "x", "m", 2.5),
        ("2025-02", "2025-02", 7, "y", "m", 4.0),
        ("2025-03", "2025-02", 7, "y", "m", 8.0),
    ]
    history = waterfall.waterfall(long(spark, rows))
    assert history.columns == ["calculation_month", "snop_month", "parent_code", "parent_description", "qty"]
    assert sorted(tuple(r) for r in history.collect()) == [
        ("2025-01", "2025-02", 7, "y", 3.5),
        ("2025-02", "2025-02", 7, "y", 4.0),
        ("2025-03", "2025-02", 7, "y", 8.0),
    ]


def test_head_and_stats(spark):
    rows = [(f"2025-{c:02d}", f"2025-{s:02d}", p, "d", "m", 1.0) for p in (2, 1) for s in (2, 1) for c in (2, 1)]
    history = waterfall.waterfall(long(spark, rows))
    first = [(r.parent_code, r.snop_month, r.calculation_month) for r in waterfall.head(history, 3).collect()]
    assert first == [(1, "2025-01", "2025-01"), (1, "2025-01", "2025-02"), (1, "2025-02", "2025-01")]
    assert tuple(waterfall.stats(history).first()) == (8, 2, 8.0)
    assert tuple(waterfall.stats(history.filter("qty < 0")).first()) == (0, 0, 0.0)

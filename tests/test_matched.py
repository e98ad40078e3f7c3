import pytest

from hindcast.operators import matched

FC = "parent_code bigint, calculation_month string, snop_month string, fc_kl double"


def forecasts(spark, rows):
    return matched.typed_forecasts(spark.createDataFrame(rows, FC))


def sales(spark, rows):
    return matched.monthly_actuals(
        spark.createDataFrame(rows, "`Parent Material Code` string, `Month-Year` string, `Sec Vol KL MTH (billwise)` double")
    )


def brands(spark, rows):
    return matched.brand_of_product(
        spark.createDataFrame(rows, "material_code bigint, material_desc string, material_group_code string")
    )


def vintages(spark, rows):
    df = forecasts(spark, [(1, c, "2026-04-01", q) for c, q in rows])
    return [(r.oldest_fc, r.latest_fc) for r in matched.vintages(df).collect()]


def test_one_and_three_vintages(spark):
    assert vintages(spark, [("2026-01-01", 5.0)]) == [(5.0, 5.0)]
    assert vintages(spark, [("2026-02-01", 9.0), ("2025-12-01", 7.0), ("2026-01-01", 1.0)]) == [(7.0, 9.0)]


def test_missing_value_of_a_vintage_is_kept(spark):
    assert vintages(spark, [("2026-01-01", None), ("2026-02-01", 3.0)]) == [(None, 3.0)]
    assert vintages(spark, [("2026-01-01", 3.0), ("2026-02-01", None)]) == [(3.0, None)]


def test_missing_vintage_month_comes_first(spark):
    assert vintages(spark, [("2026-01-01", 3.0), (None, 8.0)]) == [(8.0, 3.0)]


def test_pick_among_equal_vintages_does_not_depend_on_row_order(spark):
    rows = [(1, "2026-01-01", "2026-04-01", float(q)) for q in range(40)] + [(1, "1950-01-01", "2026-05-01", 1.0)]
    picks = set()
    for parts in (1, 3, 7):
        for order in (rows, rows[::-1]):
            df = forecasts(spark, order).repartition(parts)
            picks.add(tuple(sorted((str(r.snop_month), r.oldest_fc, r.latest_fc) for r in matched.vintages(df).collect())))
    assert len(picks) == 1


def test_dates_before_1970_keep_their_order(spark):
    assert vintages(spark, [("1969-12-01", 1.0), ("1970-01-01", 2.0), ("1969-11-01", 3.0)]) == [(3.0, 2.0)]


def test_sales_rows_sum_by_product_and_month(spark):
    rows = [("007", "Apr-2024", 0.25), ("7", "Apr-2024", 0.5), ("7", "May-2024", None), ("7", "May-2024", None)]
    got = {str(r.snop_month): (r.parent_code, r.actual_kl) for r in sales(spark, rows).collect()}
    assert got == {"2024-04-01": (7, 0.75), "2024-05-01": (7, 0.0)}


@pytest.mark.parametrize("row", [("7a", "Apr-2024", 1.0), ("7", "2024-04", 1.0), ("7", "Foo-2024", 1.0)])
def test_bad_sales_row_raises(spark, row):
    with pytest.raises(Exception):
        sales(spark, [row]).collect()


def test_hierarchy_keeps_one_row(spark):
    rows = [(1, "b", "X"), (1, "a", "Z"), (1, "a", "Y"), (2, "c", None)]
    assert {r.parent_code: r.brand for r in brands(spark, rows).collect()} == {1: "Y", 2: None}


def test_frame(spark):
    fc = forecasts(
        spark,
        [
            (1, "2026-01-01", "2026-04-01", 5.0),
            (1, "2026-02-01", "2026-04-01", 6.0),
            (1, "2026-02-01", "2027-03-01", 5.0),
            (2, "2026-02-01", "2026-04-01", 1.0),
            (3, "2026-02-01", "2026-05-01", 2.0),
            (None, "2026-02-01", "2026-05-01", 2.0),
        ],
    )
    actual = sales(spark, [("1", "Apr-2026", 4.0), ("1", "Apr-2026", 3.0), ("3", "May-2026", None), (None, "May-2026", 1.0)])
    got = matched.matched_frame(fc, actual, brands(spark, [(1, "a", "X"), (1, "b", "Q")]))
    assert got.columns == ["parent_code", "snop_month", "actual_kl", "oldest_fc", "latest_fc", "brand"]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == [
        ("1", "2026-04-01", "7.0", "5.0", "6.0", "X"),
        ("3", "2026-05-01", "0.0", "2.0", "2.0", "None"),
    ]


def test_vintages_stay_a_hash_aggregate_and_the_join_reuses_their_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fc = forecasts(spark, [(1, "2026-01-01", "2026-04-01", 5.0)])
        plan = matched.matched_frame(fc, sales(spark, [("1", "Apr-2026", 4.0)]), brands(spark, [(1, "a", "X")]))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    assert any("HashAggregate" in line and "partial_min_by(" in line for line in lines)
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert "SortAggregate" not in "".join(x for x in lines if "min_by" in x and "material" not in x and "brand" not in x)
    # Forecasts by product, target and calculation month, then by product and target month;
    # sales by product and month; brands by product; and the brand join by product.
    assert text.count("Exchange hashpartitioning(parent_code") == 5


@pytest.mark.parametrize("order", [1, -1])
def test_forecasts_of_one_month_go_by_value(spark, order):
    # The pair of values has one 32-bit hash.
    rows = [(1, "2026-01-01", "2026-04-01", v) for v in (9.0, 5.0, 7.0)]
    rows += [(2, "2026-01-01", "2026-04-01", v) for v in (3259.0, 275413.875)]
    rows += [(3, "2026-01-01", "2026-04-01", v) for v in (4.0, None, 6.0)]
    rows += [(4, "2026-01-01", "2026-04-01", 1.0), (4, "2026-02-01", "2026-04-01", None)]
    rows += [(5, None, "2026-04-01", 2.0), (5, "2026-02-01", "2026-04-01", 8.0), (5, "2026-02-01", "2026-04-01", 3.0)]
    got = matched.vintages(forecasts(spark, rows[::order])).collect()
    assert {r.parent_code: (r.oldest_fc, r.latest_fc) for r in got} == {
        1: (5.0, 9.0),
        2: (3259.0, 275413.875),
        3: (None, 6.0),
        4: (1.0, None),
        5: (2.0, 8.0),
    }

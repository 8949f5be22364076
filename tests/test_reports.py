import json

import pytest
from pyspark.sql import functions as F

from helpers import ORDER_SCHEMA, as_rows, order_line, plan_of
from dockside.functions import checks
from dockside.operators import reports
from dockside.schema import DIMENSIONS, require_columns


@pytest.fixture
def with_nulls(lines):
    rows = [order_line(i) for i in range(3)]
    rows += [order_line(10 + i, **{name: None}) for i, name in enumerate(DIMENSIONS)]
    return lines(*rows)


@pytest.mark.parametrize("dimension", DIMENSIONS)
def test_risk_leaves_out_null_keys(with_nulls, dimension):
    report = reports.delivery_risk(with_nulls, dimension)
    assert [row.total_orders for row in report.collect()] == [8]


def test_overviews_keep_null_keys(with_nulls):
    assert {row.market for row in reports.market_volume(with_nulls).collect()} == {None, "Europe"}
    assert {row.shipping_mode for row in reports.mode_late(with_nulls).collect()} == {
        None,
        "First Class",
    }
    assert reports.segment_economics(with_nulls).count() == 2


def test_risk_values_ties_and_limit(lines):
    df = lines(
        order_line(1, category_name="b"),
        order_line(2, category_name="a"),
        order_line(3, category_name="a", delivery_status="Late delivery", sales=50.25),
        order_line(4, category_name="c", delivery_status=None, days_for_shipping_real=None),
    )
    report = reports.delivery_risk(df, "category_name", limit=2)
    assert as_rows(report) == [
        ("a", 2, 100.0, 2.0, 10.0, 150.0),
        ("b", 1, 100.0, 2.0, 10.0, 100.0),
    ]
    assert "TakeOrderedAndProject" in plan_of(report)
    last = reports.delivery_risk(df, "category_name").collect()[-1]
    assert (last.dimension, last.late_rate_pct, last.avg_delay_days) == ("c", 0.0, None)


def test_risk_in_one_market(lines):
    df = lines(order_line(1), order_line(2, market="Africa"))
    report = reports.delivery_risk(df, "category_name", market="Africa")
    assert report.first().total_orders == 1
    assert reports.delivery_risk(df, "category_name", market="").first().total_orders == 2


def test_arguments(lines):
    df = lines(order_line())
    with pytest.raises(ValueError, match="category_name.*shipping_mode"):
        reports.delivery_risk(df, "sales")
    with pytest.raises(ValueError, match="unknown market"):
        reports.delivery_risk(df, "market", market="x' OR '1'='1")
    assert [checks.clamp_limit(n) for n in (None, 0, 5, 20, 21)] == [10, 10, 5, 20, 20]
    with pytest.raises(ValueError):
        checks.clamp_limit(-1)
    assert [checks.clamp_k(n) for n in (1, 10, 11)] == [1, 10, 10]
    with pytest.raises(ValueError):
        checks.clamp_k(0)
    with pytest.raises(ValueError, match="sales"):
        require_columns(df.drop("sales"))


def test_json_report(lines):
    df = lines(order_line(1, sales=12345678.0), order_line(2, market="Africa", delivery_status="x"))
    report = json.loads(reports.risk_json(df, "market").first().report)
    assert report["grouped_by"] == "market" and report["market_filter"] == "all markets"
    assert [line["dimension"] for line in report["results"]] == ["Europe", "Africa"]
    assert report["results"][0]["total_revenue_usd"] == 12345678
    assert "E7" not in reports.risk_json(df, "market").first().report


def test_shipping_delay_is_difference_of_rounded_means(lines):
    df = lines(
        order_line(1, days_for_shipping_real=1, days_for_shipment_scheduled=1),
        order_line(2, days_for_shipping_real=1, days_for_shipment_scheduled=0),
        order_line(3, days_for_shipping_real=2, days_for_shipment_scheduled=0),
    )
    row = reports.shipping_analysis(df).first()
    assert (row.avg_actual, row.avg_scheduled, row.avg_delay) == (1.3, 0.3, 1.0)


def test_distinct_counts(lines):
    df = lines(
        order_line(1),
        order_line(2, category_name="x", shipping_mode=None),
        order_line(3, category_name=None, shipping_mode="Same Day"),
        order_line(4, market=None),
    )
    row = reports.market_report(df).first()
    assert (row.total_orders, row.num_categories, row.num_ship_modes) == (3, 2, 2)
    kpi = reports.kpi_header(df).first()
    assert (kpi.orders, kpi.markets, kpi.categories) == (4, 1, 2)


def test_money_sums_are_exact(lines):
    values = [0.1, 0.2, 0.3, -0.6, 1e9 + 0.07, -1e9 - 0.02]
    df = lines(*[order_line(i, order_profit_per_order=v) for i, v in enumerate(values)])
    row = reports.segment_profile(df).first()
    assert row.avg_profit == round(0.05 / 6, 2)
    split = df.repartition(5)
    assert as_rows(reports.revenue_summary(split)) == as_rows(reports.revenue_summary(df.coalesce(1)))


def test_empty_table(spark):
    df = spark.createDataFrame([], ORDER_SCHEMA)
    for report in (
        reports.delivery_risk(df, "market"),
        reports.market_report(df),
        reports.category_profile(df),
        reports.shipping_analysis(df),
        reports.segment_profile(df),
        reports.status_share(df),
        reports.canceled_by_market(df),
    ):
        assert report.count() == 0
    assert as_rows(reports.kpi_header(df)) == [(0, 0, 0, None, None)]
    assert as_rows(reports.revenue_summary(df)) == [(None, None, None, None)]
    assert as_rows(reports.canceled_in_market(df, "Europe")) == [(0,)]


def test_shares_and_counts_add_up(with_nulls):
    share = reports.status_share(with_nulls).agg(F.sum("pct"), F.sum("n")).first()
    assert (share[0], share[1]) == (100.0, 9)
    risk = reports.delivery_risk(with_nulls, "market").agg(F.sum("total_orders")).first()[0]
    nulls = with_nulls.where("market IS NULL").count()
    assert risk + nulls == with_nulls.count()


def test_reports_run_no_python(with_nulls):
    for report in (reports.market_report(with_nulls), reports.kpi_header(with_nulls)):
        assert "Python" not in plan_of(report) and "Pandas" not in plan_of(report)


def test_json_keeps_missing_measures(lines):
    import json

    df = lines(order_line(order_profit_per_order=None, days_for_shipping_real=None))
    text = reports.risk_json(df, "market").first().report
    (row,) = json.loads(text)["results"]
    assert row["avg_profit_usd"] is None and row["avg_delay_days"] is None
    assert row["total_orders"] == 1


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), 1e300])
def test_amounts_that_are_no_amounts_stop(lines, odd):
    with pytest.raises(Exception, match="not a finite amount"):
        reports.revenue_summary(lines(order_line(sales=odd))).collect()

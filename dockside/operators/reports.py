"""Delivery-risk, market, category, shipping, segment and revenue reports.

Rows are order lines: ``total_orders`` and ``orders`` count lines. The ranked
and profile reports leave out rows whose key is NULL; the overview reports
(``status_share``, ``market_volume``, ``mode_late``, ``segment_economics``)
keep a row for NULL.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockside.functions.checks import clamp_limit, validate_dimension, validate_market
from dockside.functions.metrics import (
    add_sums,
    amount,
    late_pct,
    line_sums,
    mean_amount,
    mean_of,
    mean_share,
    total_of,
)
from dockside.schema import CANCELED, MARKETS

PROFIT = ("profit_units", "profit_millionths", "profit_n")
SALES = ("sales_units", "sales_millionths", "sales_n")
RISK_SUMS = ("orders_n", "late_n", "delay_sum", "delay_n", *PROFIT, *SALES)
MARKET_SUMS = ("orders_n", "late_n", *PROFIT, *SALES)
CATEGORY_SUMS = (
    "orders_n", "late_n", "margin_units", "margin_millionths", "margin_n", *SALES, *PROFIT,
)
SHIPPING_SUMS = (
    "orders_n", "actual_sum", "actual_n", "planned_sum", "planned_n",
    "late_n", *PROFIT,
)
SEGMENT_SUMS = ("orders_n", *PROFIT, *SALES, "late_n")


def _present(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def delivery_risk(df: DataFrame, group_by: str, market=None, limit=10, markets=MARKETS) -> DataFrame:
    """Late rate, delay, profit and revenue per value of one dimension.

    Worst late rate first; equal rates go by dimension, so the cut at ``limit``
    is the same in every run. ``market`` keeps one of the allowed ``markets``.
    """
    validate_dimension(group_by)
    market = validate_market(market, markets)
    limit = clamp_limit(limit)
    rows = _present(df, group_by)
    if market:
        rows = rows.where(F.col("market") == F.lit(market))
    sums = rows.groupBy(F.col(group_by).alias("dimension")).agg(*line_sums(*RISK_SUMS))
    report = sums.select(
        "dimension",
        F.col("orders_n").alias("total_orders"),
        late_pct().alias("late_rate_pct"),
        mean_of("delay", 1).alias("avg_delay_days"),
        mean_amount("profit").alias("avg_profit_usd"),
        total_of("sales").alias("total_revenue_usd"),
    )
    return report.orderBy(F.desc("late_rate_pct"), F.asc("dimension")).limit(limit)


def risk_json(df: DataFrame, group_by: str, market=None, limit=10, markets=MARKETS) -> DataFrame:
    """The risk report as one JSON text; numbers are written without exponents."""
    report = delivery_risk(df, group_by, market, limit, markets)
    line = F.struct(
        "dimension",
        "total_orders",
        F.col("late_rate_pct").cast("decimal(5,1)").alias("late_rate_pct"),
        F.col("avg_delay_days").cast("decimal(12,1)").alias("avg_delay_days"),
        F.col("avg_profit_usd").cast("decimal(20,2)").alias("avg_profit_usd"),
        F.col("total_revenue_usd").cast("decimal(28,0)").alias("total_revenue_usd"),
    )
    # At most 20 rows reach this aggregate.
    ranked = report.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("late_rate_pct")).alias("order"), "dimension", line.alias("line")
                )
            )
        ).alias("ranked")
    )
    body = F.struct(
        F.lit(group_by).alias("grouped_by"),
        F.lit(validate_market(market, markets) or "all markets").alias("market_filter"),
        F.col("ranked.line").alias("results"),
    )
    return ranked.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def finish_market() -> list:
    return [
        F.col("orders_n").alias("total_orders"),
        late_pct().alias("late_pct"),
        mean_amount("profit").alias("avg_profit"),
        total_of("sales").alias("total_sales"),
    ]


def market_report(df: DataFrame) -> DataFrame:
    """Per market: volume, lateness, profit, sales and how many categories and modes.

    Lines are first added up per market, category and mode; the distinct counts
    then run over that small result instead of over every line.
    """
    fine = (
        _present(df, "market")
        .groupBy("market", "category_name", "shipping_mode")
        .agg(*line_sums(*MARKET_SUMS))
    )
    sums = fine.groupBy("market").agg(
        *add_sums(*MARKET_SUMS),
        F.count_distinct("category_name").alias("num_categories"),
        F.count_distinct("shipping_mode").alias("num_ship_modes"),
    )
    return sums.select("market", *finish_market(), "num_categories", "num_ship_modes")


def finish_category() -> list:
    return [
        F.col("orders_n").alias("orders"),
        late_pct().alias("late_pct"),
        mean_share("margin").alias("margin_pct"),
        total_of("sales").alias("revenue"),
        mean_amount("profit").alias("avg_profit"),
    ]


def category_profile(df: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` categories with most order lines; equal counts go by name."""
    sums = _present(df, "category_name").groupBy("category_name").agg(*line_sums(*CATEGORY_SUMS))
    profile = sums.select("category_name", *finish_category())
    return profile.orderBy(F.desc("orders"), F.asc("category_name")).limit(n)


def finish_shipping() -> list:
    """Here the delay is the difference of two rounded means."""
    actual, planned = mean_of("actual", 1), mean_of("planned", 1)
    return [
        F.col("orders_n").alias("orders"),
        actual.alias("avg_actual"),
        planned.alias("avg_scheduled"),
        F.round(actual - planned, 1).alias("avg_delay"),
        late_pct().alias("late_pct"),
        mean_amount("profit").alias("avg_profit"),
    ]


def shipping_analysis(df: DataFrame) -> DataFrame:
    sums = _present(df, "shipping_mode").groupBy("shipping_mode").agg(*line_sums(*SHIPPING_SUMS))
    return sums.select("shipping_mode", *finish_shipping())


def finish_segment() -> list:
    return [
        F.col("orders_n").alias("orders"),
        mean_amount("profit").alias("avg_profit"),
        total_of("sales").alias("total_sales"),
        late_pct().alias("late_pct"),
    ]


def segment_profile(df: DataFrame) -> DataFrame:
    keyed = _present(df, "customer_segment").groupBy("customer_segment")
    return keyed.agg(*line_sums(*SEGMENT_SUMS)).select("customer_segment", *finish_segment())


def kpi_header(df: DataFrame) -> DataFrame:
    """One row of headline figures.

    As in :func:`market_report`, the distinct counts run over the lines added up
    per market and category.
    """
    names = ("orders_n", "late_n", *SALES)
    fine = df.groupBy("market", "category_name").agg(*line_sums(*names))
    sums = fine.agg(
        *add_sums(*names),
        F.count_distinct("market").alias("markets"),
        F.count_distinct("category_name").alias("categories"),
    )
    revenue = F.round(amount("sales").cast("double") / 1e6, 1)
    return sums.select(
        F.coalesce("orders_n", F.lit(0)).alias("orders"),
        "markets",
        "categories",
        late_pct().alias("late_pct"),
        revenue.alias("revenue_musd"),
    )


def status_share(df: DataFrame) -> DataFrame:
    """Lines per delivery status and their share of all lines in percent."""
    counts = df.groupBy("delivery_status").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    share = F.round(F.col("n") * 100.0 / total, 1).alias("pct")
    return counts.select("delivery_status", "n", share).orderBy(
        F.desc("n"), F.asc_nulls_last("delivery_status")
    )


def market_volume(df: DataFrame) -> DataFrame:
    sums = df.groupBy("market").agg(*line_sums("orders_n", *SALES))
    volume = sums.select("market", F.col("orders_n").alias("n"), total_of("sales").alias("revenue"))
    return volume.orderBy(F.desc("n"), F.asc_nulls_last("market"))


def mode_late(df: DataFrame) -> DataFrame:
    sums = df.groupBy("shipping_mode").agg(*line_sums("orders_n", "late_n"))
    rates = sums.select("shipping_mode", F.col("orders_n").alias("n"), late_pct().alias("late_pct"))
    return rates.orderBy(F.desc("n"), F.asc_nulls_last("shipping_mode"))


def segment_economics(df: DataFrame) -> DataFrame:
    names = ("orders_n", *PROFIT, *SALES)
    sums = df.groupBy("customer_segment").agg(*line_sums(*names))
    economics = sums.select(
        "customer_segment",
        F.col("orders_n").alias("n"),
        mean_amount("profit").alias("avg_profit"),
        total_of("sales").alias("revenue"),
    )
    return economics.orderBy(F.desc("n"), F.asc_nulls_last("customer_segment"))


def revenue_summary(df: DataFrame) -> DataFrame:
    sums = df.agg(*line_sums(*SALES, *PROFIT))
    return sums.select(
        total_of("sales").alias("total_revenue"),
        mean_amount("sales").alias("avg_sale"),
        total_of("profit").alias("total_profit"),
        mean_amount("profit").alias("avg_profit"),
    )


def canceled_in_market(df: DataFrame, market: str, markets=MARKETS) -> DataFrame:
    """One count: canceled lines of one market."""
    market = validate_market(market, markets)
    rows = df.where((F.col("market") == F.lit(market)) & (F.col("delivery_status") == CANCELED))
    return rows.agg(F.count(F.lit(1)).alias("canceled"))


def canceled_by_market(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("delivery_status") == CANCELED)
    return rows.groupBy("market").agg(F.count(F.lit(1)).alias("canceled"))

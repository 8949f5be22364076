"""Measures of the order table, split into additive sums and final ratios.

Every report first adds up plain sums and counts and divides at the end. The
sums can be added again, so a report may pre-aggregate at a finer grain and
still give the same value.

Money is added as two integers, whole units and millionths. Integer sums do not
depend on how the rows were partitioned or in which order tasks finished, and
they stay in generated code, which sums of wide decimals do not.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockside.schema import LATE


def is_late() -> Column:
    return F.col("delivery_status") == LATE


def delay_days() -> Column:
    return F.col("days_for_shipping_real") - F.col("days_for_shipment_scheduled")


def finite_amount(column: str) -> Column:
    """An amount as it is; one that integers cannot hold stops the job."""
    value = F.col(column)
    odd = F.isnan(value) | (F.abs(value) > 9e15)
    message = F.lit(f"{column} is not a finite amount")
    return F.when(odd, F.raise_error(message).cast("double")).otherwise(value)


def units(column: str) -> Column:
    """Whole units of an amount, rounded down."""
    return F.floor(finite_amount(column))


def millionths(column: str) -> Column:
    """What :func:`units` leaves over, in millionths."""
    return F.rint((F.col(column) - F.floor(column)) * 1e6).cast("bigint")


def amount_sums(prefix: str, column: str) -> dict:
    return {
        f"{prefix}_units": lambda: F.sum(units(column)),
        f"{prefix}_millionths": lambda: F.sum(millionths(column)),
        f"{prefix}_n": lambda: F.count(column),
    }


def amount(prefix: str) -> Column:
    """The exact total of an amount, as DECIMAL."""
    parts = [F.col(f"{prefix}_{part}").cast("decimal(20,0)") for part in ("units", "millionths")]
    return (parts[0] + parts[1] / F.lit(1000000)).cast("decimal(27,6)")


# name of the sum -> aggregate over order lines
_SUMS: dict[str, Callable[[], Column]] = {
    "orders_n": lambda: F.count(F.lit(1)),
    "late_n": lambda: F.count_if(is_late()),
    "delay_sum": lambda: F.sum(delay_days()),
    "delay_n": lambda: F.count(delay_days()),
    "actual_sum": lambda: F.sum("days_for_shipping_real"),
    "actual_n": lambda: F.count("days_for_shipping_real"),
    "planned_sum": lambda: F.sum("days_for_shipment_scheduled"),
    "planned_n": lambda: F.count("days_for_shipment_scheduled"),
    **amount_sums("profit", "order_profit_per_order"),
    **amount_sums("sales", "sales"),
    **amount_sums("margin", "order_item_profit_ratio"),
}


def line_sums(*names) -> list[Column]:
    """Aggregates over order lines, each under its own name."""
    return [_SUMS[name]().alias(name) for name in names]


def add_sums(*names) -> list[Column]:
    """Aggregates that add up the columns made by :func:`line_sums`."""
    return [F.sum(name).alias(name) for name in names]


def mean_of(prefix: str, digits: int, factor: float = 1.0) -> Column:
    """Rounded mean from ``<prefix>_sum`` and ``<prefix>_n``; NULL when empty."""
    mean = F.try_divide(F.col(f"{prefix}_sum").cast("double"), F.col(f"{prefix}_n"))
    return F.round(mean * factor if factor != 1.0 else mean, digits)


def late_pct() -> Column:
    rate = F.try_divide(F.col("late_n").cast("double"), F.col("orders_n"))
    return F.round(rate * 100, 1)


def mean_amount(prefix: str) -> Column:
    """Mean of an amount to two places; NULL when empty."""
    return F.round(F.try_divide(amount(prefix).cast("double"), F.col(f"{prefix}_n")), 2)


def mean_share(prefix: str) -> Column:
    """Mean of a ratio in percent to one place; NULL when empty."""
    mean = F.try_divide(amount(prefix).cast("double"), F.col(f"{prefix}_n"))
    return F.round(mean * 100, 1)


def total_of(prefix: str) -> Column:
    """Total of an amount, rounded to whole units."""
    return F.round(amount(prefix), 0).cast("double")

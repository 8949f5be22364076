"""Rows and looks at results that the tests share."""

ORDER_SCHEMA = (
    "order_id long, market string, category_name string, shipping_mode string,"
    " department_name string, order_region string, customer_segment string,"
    " delivery_status string, order_status string, days_for_shipping_real int,"
    " days_for_shipment_scheduled int, sales double, order_profit_per_order double,"
    " order_item_profit_ratio double"
)


def order_line(order_id=1, **changes):
    row = {
        "order_id": order_id,
        "market": "Europe",
        "category_name": "Cleats",
        "shipping_mode": "First Class",
        "department_name": "Apparel",
        "order_region": "Western Europe",
        "customer_segment": "Consumer",
        "delivery_status": "Late delivery",
        "order_status": "COMPLETE",
        "days_for_shipping_real": 4,
        "days_for_shipment_scheduled": 2,
        "sales": 100.0,
        "order_profit_per_order": 10.0,
        "order_item_profit_ratio": 0.1,
    }
    row.update(changes)
    return tuple(row.values())


def as_rows(df):
    return [tuple(row) for row in df.collect()]


def plan_of(df):
    """The plan to run, or the final one after the frame was used."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

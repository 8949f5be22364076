"""Column types, allow-lists and other fixed values of the order table."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The dimensions a delivery-risk report may group by.
DIMENSIONS = (
    "category_name",
    "market",
    "shipping_mode",
    "department_name",
    "order_region",
    "customer_segment",
)

# Market names of the published order dataset.
MARKETS = ("LATAM", "Europe", "Pacific Asia", "USCA", "Africa")

# Delivery states used by the reports.
LATE = "Late delivery"
CANCELED = "Shipping canceled"

# Columns that cleaning removes.
PII_COLUMNS = (
    "customer_email",
    "customer_fname",
    "customer_lname",
    "customer_password",
    "customer_street",
)
SPARSE_COLUMNS = ("product_description", "product_image", "order_zipcode")

# Columns the quality check looks at for usefulness.
USEFULNESS_COLUMNS = ("product_description", "product_image", "product_status")

# Columns whose value frequencies the exploration prints.
FREQUENCY_COLUMNS = (
    "delivery_status",
    "market",
    "shipping_mode",
    "customer_segment",
)

# Type of each known order column, by normalised name. A column
# that is not listed stays a string.
ORDER_TYPES = {
    "order_id": T.LongType(),
    "days_for_shipping_real": T.IntegerType(),
    "days_for_shipment_scheduled": T.IntegerType(),
    "late_delivery_risk": T.IntegerType(),
    "customer_zipcode": T.IntegerType(),
    "order_zipcode": T.IntegerType(),
    "order_item_quantity": T.IntegerType(),
    "product_status": T.IntegerType(),
    "product_price": T.DoubleType(),
    "sales": T.DoubleType(),
    "order_item_total": T.DoubleType(),
    "order_item_discount": T.DoubleType(),
    "order_item_discount_rate": T.DoubleType(),
    "order_item_profit_ratio": T.DoubleType(),
    "order_profit_per_order": T.DoubleType(),
    "benefit_per_order": T.DoubleType(),
    "sales_per_customer": T.DoubleType(),
}
DATE_COLUMNS = ("order_date_dateorders", "shipping_date_dateorders")

# Columns every report set relies on; loading stops early when one is missing.
REQUIRED_COLUMNS = (
    "market",
    "category_name",
    "shipping_mode",
    "department_name",
    "order_region",
    "customer_segment",
    "delivery_status",
    "order_status",
    "days_for_shipping_real",
    "days_for_shipment_scheduled",
    "sales",
    "order_profit_per_order",
    "order_item_profit_ratio",
)

KNOWLEDGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("market", T.StringType()),
    ]
)


def require_columns(df: DataFrame, names=REQUIRED_COLUMNS) -> DataFrame:
    """Return ``df``, or raise when it lacks one of ``names``."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df

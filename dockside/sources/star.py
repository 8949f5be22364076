"""The wide order table built from a star schema of order, line and part tables.

``lineitem`` is the fact and gives one row per order line. Every other table is
looked up by its unique key with a left join, so a lookup never changes the row
count (:func:`require_unique_keys` makes sure) and only the lookups that the wanted
columns need are part of the plan. Customers and places are looked up per order,
before the orders meet the lines, so lines move once for orders and once for parts.
No side carries a broadcast hint: the session's size threshold decides, and AQE
splits hot keys of the joins it shuffles.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the tables. With a known schema a read needs no job
# that opens file footers first.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
        " props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# lookup -> (key in the row so far, key of the table, lookups it builds on)
_LOOKUPS = {
    "orders": ("l_orderkey", "o_orderkey", ()),
    "customer": ("o_custkey", "c_custkey", ("orders",)),
    "nation": ("c_nationkey", "n_nationkey", ("orders", "customer")),
    "region": ("n_regionkey", "r_regionkey", ("orders", "customer", "nation")),
    "part": ("l_partkey", "p_partkey", ()),
}


def _cents(column: str) -> Column:
    return F.rint(F.col(column) * 100)


def _to_cents(hundredths: Column) -> Column:
    """Hundredths of a cent to an amount in full cents, halves away from zero.

    All steps work on whole numbers, so no double is rounded near a tie.
    """
    return F.signum(hundredths) * F.floor(F.abs(hundredths) / 100 + 0.5) / 100


def _net() -> Column:
    return _cents("l_extendedprice") * (100 - _cents("l_discount"))


def _profit() -> Column:
    return _to_cents(_net() - F.col("l_quantity") * _cents("p_retailprice") * 100)


def _status() -> Column:
    canceled = (F.col("o_orderstatus") == "P") & (F.col("l_returnflag") == "R")
    return (
        F.when(canceled, "Shipping canceled")
        .when(F.col("_real") > F.col("_planned"), "Late delivery")
        .when(F.col("_real") == F.col("_planned"), "Shipping on time")
        .when(F.col("_real") < F.col("_planned"), "Advance shipping")
    )


# Values that several columns share, in the order they build on each other. Each
# is computed once per row; those no wanted column reads are pruned.
_SHARED = (
    {
        "_real": lambda: F.pmod(F.datediff("l_shipdate", "o_orderdate"), F.lit(7)).cast("int"),
        # The priority starts with its number.
        "_planned": lambda: F.ascii("o_orderpriority") - 48,
    },
    {"_status": _status, "_profit": _profit},
)
_SHARED_LOOKUPS = {"_real": "orders", "_planned": "orders", "_status": "orders", "_profit": "part"}

# column -> (deepest lookups it reads, expression)
_COLUMNS = {
    "order_id": (("orders",), lambda: F.col("o_orderkey")),
    "order_status": (("orders",), lambda: F.col("o_orderstatus")),
    "order_date_dateorders": (("orders",), lambda: F.col("o_orderdate")),
    "shipping_date_dateorders": ((), lambda: F.col("l_shipdate")),
    "delivery_status": (("orders",), lambda: F.col("_status")),
    "days_for_shipping_real": (("orders",), lambda: F.col("_real")),
    "days_for_shipment_scheduled": (("orders",), lambda: F.col("_planned")),
    "late_delivery_risk": (
        ("orders",),
        lambda: F.when(F.col("_status") == "Late delivery", 1).otherwise(0),
    ),
    "shipping_mode": (
        ("orders",),
        lambda: F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")),
    ),
    "market": (("region",), lambda: F.col("r_name")),
    "order_region": (("nation",), lambda: F.col("n_name")),
    "customer_segment": (("customer",), lambda: F.col("c_mktsegment")),
    "customer_zipcode": (
        ("customer",),
        lambda: F.nullif((F.col("c_custkey") % 100).cast("int"), F.lit(0)),
    ),
    "category_name": (("part",), lambda: F.col("p_name")),
    "department_name": (("part",), lambda: F.col("p_type")),
    "product_name": (("part",), lambda: F.col("p_name")),
    "product_price": (("part",), lambda: F.col("p_retailprice")),
    "sales": ((), lambda: F.col("l_extendedprice")),
    "order_item_quantity": ((), lambda: F.col("l_quantity").cast("int")),
    "order_item_discount_rate": ((), lambda: F.col("l_discount")),
    "order_item_discount": (
        (),
        lambda: _to_cents(_cents("l_extendedprice") * _cents("l_discount")),
    ),
    "order_item_total": (
        (),
        lambda: _to_cents(_net()),
    ),
    "order_profit_per_order": (("part",), lambda: F.col("_profit")),
    "order_item_profit_ratio": (
        ("part",),
        lambda: F.try_divide(F.col("_profit"), F.col("l_extendedprice")),
    ),
}

# Columns only the uncleaned table has; the values stand in for private data.
_RAW_COLUMNS = {
    "customer_email": (
        ("customer",),
        lambda: F.concat(F.lower("c_name"), F.lit("@example.org")),
    ),
    "customer_fname": (("customer",), lambda: F.col("c_name")),
    "customer_lname": (("customer",), lambda: F.col("c_name")),
    "customer_password": ((), lambda: F.lit("XXXXXXXXX")),
    "customer_street": (
        ("customer",),
        lambda: F.concat(F.lit("Street "), F.col("c_custkey").cast("string")),
    ),
    "product_description": ((), lambda: F.lit(None).cast("string")),
    "product_image": (
        ("part",),
        lambda: F.concat(F.lit("http://images.example.org/"), F.col("p_partkey")),
    ),
    "product_status": ((), lambda: F.lit(0)),
    "order_zipcode": (
        ("orders",),
        lambda: F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") % 90000).cast("int")),
    ),
}

CLEAN_COLUMNS = tuple(_COLUMNS)
RAW_COLUMNS = (*_COLUMNS, *_RAW_COLUMNS)


def read_star(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def _look_up(df: DataFrame, spark: SparkSession, folder: str, table: str) -> DataFrame:
    left, right, _ = _LOOKUPS[table]
    return df.join(read_star(spark, folder, table), F.col(left) == F.col(right), "left")


def lookup_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, different keys and NULL keys of every lookup table; a good table has no surplus."""
    found = None
    for table, (_, key, _) in _LOOKUPS.items():
        counts = read_star(spark, folder, table).groupBy(F.col(key).alias("k")).agg(
            F.count(F.lit(1)).alias("n")
        )
        line = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count("k").alias("n_keys"),
            F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
        ).select(F.lit(table).alias("table_name"), "*")
        found = line if found is None else found.unionByName(line)
    return found


def require_unique_keys(spark: SparkSession, folder: str) -> None:
    """Raise ``ValueError`` if a lookup table has a key twice, which would repeat order lines."""
    rows = lookup_keys(spark, folder).where("n_rows - n_nulls > n_keys").collect()
    if rows:
        raise ValueError(f"repeated keys in: {', '.join(sorted(r.table_name for r in rows))}")


def sales_orders(spark: SparkSession, folder: str, columns=CLEAN_COLUMNS) -> DataFrame:
    """Order lines with the named columns; a missing lookup row gives NULLs."""
    known = {**_COLUMNS, **_RAW_COLUMNS}
    needed = set()
    for name in columns:
        for lookup in known[name][0]:
            needed |= {lookup, *_LOOKUPS[lookup][2]}
    df = read_star(spark, folder, "lineitem")
    # Parts first: they add fewer columns to the lines that are shuffled again for the orders.
    if "part" in needed:
        df = _look_up(df, spark, folder, "part")
    if "orders" in needed:
        side = read_star(spark, folder, "orders")
        for table in ("customer", "nation", "region"):
            if table in needed:
                side = _look_up(side, spark, folder, table)
        df = df.join(side, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    for stage in _SHARED:
        usable = {name: make() for name, make in stage.items() if _SHARED_LOOKUPS[name] in needed}
        df = df.withColumns(usable) if usable else df
    return df.select(*[known[name][1]().alias(name) for name in columns])

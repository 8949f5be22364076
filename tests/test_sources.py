import os
import pathlib
import re
import subprocess
import sys
import time

import pytest
from pyspark.errors import PySparkException

from helpers import as_rows, order_line
from dockside.plans.ingest import run_ingest
from dockside.session import is_local, shared_dir
from dockside.sources.csv_orders import normalize_columns, normalize_name, read_orders_csv
from dockside.sources.star import CLEAN_COLUMNS, RAW_COLUMNS, require_unique_keys, sales_orders
from dockside.sources.tables import load_orders, load_knowledge, write_table

HEADER = (
    "Order Id,Market,Category Name,Shipping Mode,Department Name,Order Region,"
    "Customer Segment,Delivery Status,Order Status,Days for shipping (real),"
    "Days for shipment (scheduled),Sales,Order Profit Per Order,Order Item Profit Ratio,"
    "Customer Email,Customer Zipcode,Order City,order date (DateOrders)"
)
LINE = (
    "{},Europe,Cleats,First Class,Apparel,Western Europe,Consumer,Late delivery,COMPLETE,"
    "4,2,100.5,10.25,0.1,a@x,{},{},1/31/2018 22:56"
)


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "orders.csv"
    lines = [HEADER, LINE.format(1, "", "São Paulo"), LINE.format(2, "725", '"Nice, ""Côte"""')]
    lines.append(LINE.format(3, "NA", "N/A"))
    path.write_bytes("\n".join(lines).encode("latin-1"))
    return str(path)


@pytest.mark.parametrize(
    "raw, name",
    [
        (" Days for shipping (real) ", "days_for_shipping_real"),
        ("order date (DateOrders)", "order_date_dateorders"),
        ("Late_delivery_risk", "late_delivery_risk"),
        ("A - B", "a__b"),
    ],
)
def test_names(raw, name):
    assert normalize_name(raw) == name


def test_names_may_not_collide(spark):
    with pytest.raises(ValueError, match="a_b"):
        normalize_columns(spark.sql("SELECT 1 AS `A B`, 2 AS `a_b!`"))


def test_csv(spark, csv):
    df = read_orders_csv(spark, csv)
    types = dict(df.dtypes)
    assert (types["order_id"], types["sales"], types["days_for_shipping_real"]) == (
        "bigint",
        "double",
        "int",
    )
    assert types["order_date_dateorders"] == "timestamp_ntz"
    rows = df.orderBy("order_id").collect()
    assert [row.order_city for row in rows] == ["São Paulo", 'Nice, "Côte"', None]
    assert [row.customer_zipcode for row in rows] == [None, 725, None]
    assert str(rows[0].order_date_dateorders) == "2018-01-31 22:56:00"


def test_csv_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing.csv"):
        read_orders_csv(spark, str(tmp_path / "nothing.csv"))


def test_csv_stops_at_a_bad_value(spark, csv, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text(HEADER + "\n" + LINE.format("x", 1, "y"), encoding="latin-1")
    with pytest.raises(PySparkException):
        read_orders_csv(spark, str(bad)).collect()


def test_table_round_trip(spark, lines, tmp_path):
    path = str(tmp_path / "orders")
    write_table(lines(order_line(1), order_line(2)), path, partition_by="market")
    write_table(lines(order_line(3)), path, partition_by="market")
    df = load_orders(spark, path)
    assert spark.sql("SELECT order_id FROM orders").first()[0] == 3
    plan = df.where("market = 'Europe'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(market" in plan
    with pytest.raises(FileNotFoundError):
        load_orders(spark, str(tmp_path / "none"))


def test_ingest(spark, csv, tmp_path):
    paths = run_ingest(spark, csv, str(tmp_path / "out"))
    orders = load_orders(spark, paths["orders"])
    assert orders.count() == 3 and "customer_email" not in orders.columns
    assert sorted(row.customer_zipcode for row in orders.collect()) == [0, 0, 725]
    docs = load_knowledge(spark, paths["knowledge"])
    assert sorted(row.id for row in docs.collect()) == [
        "cat_Cleats",
        "market_Europe",
        "seg_Consumer",
        "ship_First_Class",
    ]
    assert docs.columns == ["id", "text", "source", "market", "embedding"]


def test_star_reads_only_what_is_needed(spark):
    folder = "/root/testdata/sf0.001"
    few = sales_orders(spark, folder, ("sales",))
    assert few._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    whole = sales_orders(spark, folder, RAW_COLUMNS)
    assert whole.columns == list(RAW_COLUMNS) and set(CLEAN_COLUMNS) < set(RAW_COLUMNS)
    assert whole.count() == few.count()
    assert as_rows(whole.selectExpr("count(order_id)", "count(market)")) == [(few.count(),) * 2]


def test_lines_meet_parts_before_orders(spark):
    """Of both sides the parts have fewer columns, and lines with them are shuffled again."""
    whole = sales_orders(spark, "/root/testdata/sf0.001", RAW_COLUMNS)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    # The outer join is written first.
    keys = re.findall(r"Join LeftOuter, \((\w+)", plan)
    assert [key for key in keys if key.startswith("l_")] == ["l_orderkey", "l_partkey"]


def test_shared_folder_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_files_with_columns_in_another_order_are_refused(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text("Market,Category Name\nEurope,Cleats\n")
    (folder / "b.csv").write_text("Category Name,Market\nCleats,Europe\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_orders_csv(spark, str(folder)).collect()
    (folder / "b.csv").write_text("Market,Category Name\nAfrica,Shoes\n")
    got = {tuple(r) for r in read_orders_csv(spark, str(folder)).collect()}
    assert got == {("Europe", "Cleats"), ("Africa", "Shoes")}


def test_lookup_keys_must_be_unique(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    require_unique_keys(spark, source)
    for table in ("orders", "customer", "nation", "region", "part"):
        df = spark.read.parquet(f"{source}/{table}.parquet")
        df = df.union(df.limit(1)) if table == "part" else df
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    with pytest.raises(ValueError, match="part"):
        require_unique_keys(spark, str(tmp_path))


@pytest.mark.parametrize(
    "master, local",
    [
        ("local", True),
        ("local[4]", True),
        ("local[*]", True),
        ("local[2,3]", True),
        ("local-cluster[2,1,1024]", False),
        ("spark://host:7077", False),
        ("yarn", False),
    ],
)
def test_which_masters_are_local(master, local):
    assert is_local(master) is local


def test_own_folder_goes_with_the_application(tmp_path):
    code = (
        "from dockside.session import local_session, new_shared_path, shared_dir, store\n"
        "spark = local_session(1)\n"
        "store(spark.range(3), 'x')\n"
        "import os; assert os.listdir(shared_dir(spark))\n"
        "spark.stop()\n"
    )
    root = pathlib.Path(__file__).resolve().parent.parent
    setting = f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"
    subprocess.run(
        [sys.executable, "-c", code],
        cwd=root,
        check=True,
        timeout=300,
        env={**os.environ, "PYSPARK_SUBMIT_ARGS": setting},
    )
    for _ in range(100):
        if not list(tmp_path.glob("dockside-*")):
            break
        time.sleep(0.1)  # the JVM ends after the driver's Python
    assert not list(tmp_path.glob("dockside-*"))

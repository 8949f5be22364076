"""Plans and results that must hold whatever the sizes of the tables are."""

import pytest
from pyspark.sql import functions as F

from helpers import as_rows, plan_of
from dockside.operators import knowledge, reports
from dockside.plans.catalog import CORPUS, QUERIES, TEST_MARKETS
from dockside.sources.star import sales_orders

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def without_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_shuffled_joins_give_the_same(spark, without_broadcast):
    names = ("risk_by_category", "knowledge_corpus", "duplicate_profile", "knn_l2_relevance")
    shuffled = {name: sorted(as_rows(QUERIES[name](spark, FOLDER)), key=str) for name in names}
    assert "SortMergeJoin" in plan_of(QUERIES["risk_by_category"](spark, FOLDER))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    for name in names:
        assert sorted(as_rows(QUERIES[name](spark, FOLDER)), key=str) == shuffled[name]


def test_corpus_scans_the_lines_once(spark):
    corpus = knowledge.knowledge_corpus(sales_orders(spark, FOLDER, CORPUS))
    corpus.collect()
    plan = plan_of(corpus)
    assert plan.count("ReusedExchange") == 1
    assert plan.count("lineitem.parquet") == 1


def test_market_filter_and_columns_reach_the_scan(spark, tmp_path):
    orders = sales_orders(spark, FOLDER)
    orders.write.parquet(str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    plan = plan_of(reports.delivery_risk(stored, "category_name", "EUROPE", markets=TEST_MARKETS))
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "EqualTo(market,EUROPE)" in scan and "IsNotNull(category_name)" in scan
    assert "product_name" not in scan and "order_status" not in scan


def test_hot_order_and_category(spark, tmp_path):
    """A third of the lines belong to one order and one part."""
    folder = tmp_path / "tables"
    for table in ("orders", "customer", "nation", "region", "part"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").write.parquet(f"{folder}/{table}.parquet")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    hot = F.rand(1) < 1 / 3
    lines = lines.withColumns(
        {
            "l_orderkey": F.when(hot, F.lit(5)).otherwise(F.col("l_orderkey")),
            "l_partkey": F.when(hot, F.lit(7)).otherwise(F.col("l_partkey")),
        }
    ).repartition(6)
    lines.write.parquet(f"{folder}/lineitem.parquet")
    df = sales_orders(spark, str(folder))
    assert df.count() == lines.count()
    counts = reports.market_report(df).agg(F.sum("total_orders")).first()[0]
    assert counts == df.where("market IS NOT NULL").count()
    direct = df.where("market IS NOT NULL").groupBy("market").agg(
        F.count("*"), F.round(F.sum(F.col("sales").cast("decimal(18,6)")), 0).cast("double")
    )
    mine = reports.market_report(df).select("market", "total_orders", "total_sales")
    assert sorted(as_rows(mine)) == sorted(as_rows(direct))


def exchanged_lines(df):
    """Shuffles that rows of the fact table pass."""
    plan = plan_of(df)
    depth, count, stack = 0, 0, []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        stack = [(d, e) for d, e in stack if d < depth] + [(depth, "Exchange hash" in line)]
        if "lineitem.parquet" in line:
            count = sum(e for _, e in stack)
    return count


def test_lines_move_once_for_orders_and_once_for_parts(spark, without_broadcast):
    df = sales_orders(spark, FOLDER, ("market", "category_name", "sales"))
    assert 1 <= exchanged_lines(df) <= 2
    df = sales_orders(spark, FOLDER, ("market", "customer_segment", "sales"))
    assert exchanged_lines(df) == 1


def test_search_moves_no_text_before_the_hits(spark, without_broadcast):
    df = QUERIES["knn_l2_relevance"](spark, FOLDER)
    plan = plan_of(df)
    scans = [line for line in plan.split("\n") if "documents.parquet" in line]
    assert sum("text" in line.split("ReadSchema")[-1] for line in scans) == 1
    assert plan.count("embeddings.parquet") == 1

"""Registered queries: every operator applied to the star-schema test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockside.functions.text import strip_marks
from dockside.operators import (
    asof,
    cells,
    cleaning,
    codes,
    guarded_sql,
    intervals,
    knowledge,
    ordered,
    profiling,
    reports,
    requests,
    sketches,
    vectors,
)
from dockside.schema import FREQUENCY_COLUMNS, ORDER_TYPES, PII_COLUMNS, USEFULNESS_COLUMNS
from dockside.session import materialize, new_shared_path, remove, shuffles_freed
from dockside.plans.ingest import run_ingest
from dockside.sources.csv_orders import normalize_columns, read_orders_csv, split_orders_csv
from dockside.sources.star import (
    CLEAN_COLUMNS,
    RAW_COLUMNS,
    lookup_keys,
    read_star,
    sales_orders,
)
from dockside.sources.tables import (
    load_knowledge,
    load_orders,
    load_stored,
    write_knowledge,
    write_table,
)
from dockside.streaming.corrections import count_to_tables
from dockside.streaming.throttle import over_limit, run_to_table, throttle_counts

# Fixed values of the test tables.
TEST_MARKETS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

SYSTEM_PROMPT = "Answer questions about orders and deliveries."

# Some fact columns under the kind of header a CSV brings.
MESSY_HEADERS = {
    "order_id": " Order Id ",
    "days_for_shipping_real": "Days for shipping (real)",
    "days_for_shipment_scheduled": "Days for shipment (scheduled)",
    "delivery_status": "Delivery Status",
    "order_date_dateorders": "order date (DateOrders)",
    "sales": "Sales",
}

GUARDED_SQL = """
SELECT category_name, market, COUNT(*) AS n
FROM orders
WHERE delivery_status = 'Shipping canceled'
GROUP BY category_name, market
ORDER BY n DESC, category_name, market
"""


# Columns the reports read. The wide table is joined from its parts here, so a
# query names what it reads and joins only those parts.
PROFIT = ("order_profit_per_order",)
DAYS = ("days_for_shipping_real", "days_for_shipment_scheduled")
STATUS = ("delivery_status",)
RISK = (*STATUS, *DAYS, *PROFIT, "sales")
MARKET = ("market", "category_name", "shipping_mode", *STATUS, *PROFIT, "sales")
CATEGORY = ("category_name", *STATUS, "order_item_profit_ratio", *PROFIT, "sales")
SHIPPING = ("shipping_mode", *STATUS, *DAYS, *PROFIT)
SEGMENT = ("customer_segment", *STATUS, *PROFIT, "sales")
CORPUS = tuple(dict.fromkeys((*MARKET, *CATEGORY, *SHIPPING, *SEGMENT)))


def _on_orders(operator: Callable[[DataFrame], DataFrame], columns=CLEAN_COLUMNS):
    return lambda spark, folder: operator(sales_orders(spark, folder, columns))


def _risk(dimension, market=None):
    return _on_orders(
        lambda df: reports.delivery_risk(df, dimension, market, 20, markets=TEST_MARKETS),
        tuple(dict.fromkeys((dimension, *RISK, *(("market",) if market else ())))),
    )


def _clean_report(spark, folder):
    raw = sales_orders(spark, folder, RAW_COLUMNS)
    return cleaning.clean_report(raw, cleaning.clean_orders(raw))


def _messy(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(name).alias(header) for name, header in MESSY_HEADERS.items()])


def _label_vectors(spark, folder) -> DataFrame:
    vecs = read_star(spark, folder, "embeddings")
    return vectors.mean_vectors(vecs, "label", "embedding")


def _base_vectors(spark, folder) -> DataFrame:
    return read_star(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _knn_cosine(spark, folder):
    hits = vectors.knn(_label_vectors(spark, folder), _base_vectors(spark, folder), 10)
    return hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _knn_many(spark, folder):
    """More hits than a search tool gives, in more blocks than one."""
    hits = vectors.knn(
        _label_vectors(spark, folder), _base_vectors(spark, folder), 25, "l2sq", per_block=3
    )
    return hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _knn_cells(spark, folder):
    path = new_shared_path(spark, "cells")
    cells.build_cells(_base_vectors(spark, folder), path, n_cells=16)
    hits = cells.knn_cells(_label_vectors(spark, folder), spark, path, 10)
    return hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _knn_codes(spark, folder):
    """Approximate search against the exact one: hits, and whether nine of ten were found."""
    path = new_shared_path(spark, "codes")
    base, queries = _base_vectors(spark, folder), _label_vectors(spark, folder)
    codes.build_codes(base, path, n_cells=16)
    found = codes.knn_codes(queries, spark, path, 25, n_probe=13)
    measured = codes.recall(found, vectors.knn(queries, base, 25, "l2sq"))
    return measured.select("queries", "exact_hits", (F.col("recall") >= 0.9).alias("nine_of_ten"))


def _document_hits(spark, folder, k):
    docs = read_star(spark, folder, "documents").select("doc_id", "text", "source")
    # Vectors that have a document; only ids meet here.
    base = _base_vectors(spark, folder).join(docs.select("doc_id"), "doc_id", "left_semi")
    return vectors.search(_label_vectors(spark, folder), base, docs, k)


def _knn_l2_relevance(spark, folder):
    hits = _document_hits(spark, folder, 4)
    return hits.withColumn("rank", F.col("rank").cast("long"))


def _knn_context(spark, folder):
    return vectors.search_context(_document_hits(spark, folder, 4))


def _corpus(spark, folder) -> DataFrame:
    return materialize(knowledge.knowledge_corpus(sales_orders(spark, folder, CORPUS)))


def _corpus_vectors(spark, folder):
    docs = _corpus(spark, folder)
    embedded = vectors.embed_corpus(docs, vectors.fit_vectorizer(docs))
    places = F.transform(
        "embedding", lambda x, i: x.cast("double") * (i + 1)
    )
    total = F.aggregate(places, F.lit(0.0), lambda acc, x: acc + x)
    return embedded.select(
        "id",
        "source",
        F.size("embedding").cast("long").alias("dims"),
        F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("used"),
        F.round(total, 2).alias("weighted_sum"),
    )


def _search_corpus(spark, folder):
    docs = _corpus(spark, folder)
    model = vectors.fit_vectorizer(docs)
    names = profiling.distinct_values(sales_orders(spark, folder, ("category_name",)), "category_name")
    asked = names.select(
        F.col("category_name").alias("query_id"),
        F.concat(F.lit("revenue and margin of the category "), F.col("category_name")).alias("text"),
    )
    queries = vectors.embed_corpus(asked, model).select("query_id", "embedding")
    docs = docs.withColumnRenamed("id", "doc_id")
    hits = vectors.search(queries, vectors.embed_corpus(docs, model), docs, 4)
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "source", "relevance_score"
    )


def _guarded_select(spark, folder):
    views = {"orders": lambda child: sales_orders(child, folder)}
    return guarded_sql.guarded_select(spark, GUARDED_SQL, views).frame


def _statement_outcomes(spark, folder):
    """What the guard makes of one statement of each kind."""
    kinds = _statements(spark, folder).join(
        read_star(spark, folder, "events").select("event_id", "event_type"), "event_id"
    )
    # One row per kind of event, and one that puts a name together.
    event = F.concat(F.lit("SELECT * FROM IDENTIFIER('global_temp.' || 'event"), F.min("event_id"), F.lit("')"))
    firsts = kinds.groupBy("event_type").agg(F.min("statement").alias("statement")).unionByName(
        kinds.agg(F.lit("identifier").alias("event_type"), event.alias("statement"))
    ).collect()
    views = {"orders": lambda child: sales_orders(child, folder)}
    outcomes = []
    for row in firsts:
        try:
            found = guarded_sql.guarded_select(spark, row.statement, views).collect()
            outcome = f"{found['row_count']} row: {found['rows'][0]}"
        except guarded_sql.GuardError as error:
            outcome = str(error)
        outcomes.append((row.event_type, outcome))
    return spark.createDataFrame(outcomes, "event_type string, outcome string")


def _statements(spark, folder) -> DataFrame:
    kind = F.col("event_type")
    value = F.col("user_id").cast("string")
    statement = (
        F.when(kind == "click", F.concat(F.lit("SELECT COUNT(*) FROM orders WHERE order_id = "), value))
        .when(kind == "error", F.concat(F.lit("  select sales from orders -- "), F.col("props")))
        .when(kind == "purchase", F.concat(F.lit("DELETE FROM orders WHERE order_id = "), value))
        .when(kind == "signup", F.concat(F.lit("WITH t AS (SELECT 1) SELECT * FROM t, u"), value))
        .otherwise(F.concat(F.lit("Select 'Updated' AS created_at FROM orders; -- "), value))
    )
    events = read_star(spark, folder, "events")
    return events.select("event_id", statement.alias("statement"))


def _sql_audit(spark, folder):
    return guarded_sql.sql_audit(_statements(spark, folder), "statement")


def _sql_audit_counts(spark, folder):
    return guarded_sql.audit_counts(_sql_audit(spark, folder))


def _text_guard(spark, folder):
    docs = read_star(spark, folder, "documents").select("doc_id", "text")
    return requests.validate_text(docs).drop("text")


def _text_guard_counts(spark, folder):
    docs = read_star(spark, folder, "documents").select("text")
    return requests.verdict_counts(requests.validate_text(docs))


def _user_turns(spark, folder):
    turns = read_star(spark, folder, "conversations").where("role = 'user'")
    marked = turns.select("conv_id", "turn", F.concat(F.lit("📦 "), "text").alias("text"))
    cleaned = marked.withColumn("text", strip_marks(F.col("text")))
    return requests.validate_text(cleaned).drop("text")


def _conversation_history(spark, folder):
    history = requests.conversation_history(read_star(spark, folder, "conversations"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return history.select(
        "conv_id",
        "page",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(lines, "\n").alias("transcript"),
    )


def _ensure_system_turn(spark, folder):
    return requests.ensure_system_turn(read_star(spark, folder, "conversations"), SYSTEM_PROMPT)


def _throttle_audit(spark, folder):
    events = read_star(spark, folder, "events")
    return requests.throttle_audit(events, "user_id", "ts", limit=1, window="1 hour")


def _throttle_stream(spark, folder):
    events = (
        spark.readStream.schema(read_star(spark, folder, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )
    path = new_shared_path(spark, "throttle")
    found = run_to_table(
        throttle_counts(events, "user_id", "ts", window="1 hour"), f"{path}/table", f"{path}/checkpoint"
    )
    found = over_limit(found, "user_id", limit=1)
    bounds = [F.col(name).cast("timestamp_ntz").alias(name) for name in ("window_start", "window_end")]
    return found.select("user_id", *bounds, "n", "over")


def _throttle_late(spark, folder):
    """Events in two files, the later one with older rows: windows over the limit, and what came too late."""
    path = new_shared_path(spark, "late")
    events = read_star(spark, folder, "events").select("event_id", "user_id", "ts")
    for rest in (1, 0):
        events.where(F.col("event_id") % 2 == rest).coalesce(1).write.parquet(f"{path}/in/{rest}")
    counts = late = None
    for rest in (1, 0):
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in/{rest}")
        counts, late = count_to_tables(
            stream, "user_id", "ts", f"{path}/out", f"{path}/checkpoint-{rest}", "1 hour", 10 * 86_400, name=str(rest)
        )
    over = over_limit(counts, "user_id", limit=1).select(
        F.lit("over").alias("kind"), "user_id", F.col("window_start").cast("timestamp_ntz"), "n"
    )
    missed = late.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("late").alias("kind"), "user_id", F.lit(None).cast("timestamp_ntz").alias("window_start"), "n"
    )
    return over.unionByName(missed)


def _usage_counts(spark, folder):
    events = read_star(spark, folder, "events")
    return requests.usage_counts(events, "user_id", "event_type", EVENT_TYPES)


def _active_users(spark, folder):
    """Users per kind of event from sketches by day, added in two steps: exact, and whether the estimate holds."""
    events = read_star(spark, folder, "events").select("event_type", "user_id", "ts")
    path = new_shared_path(spark, "sketches")
    early = F.dayofmonth("ts") <= 10
    for part in (early, ~early):
        sketches.add_days(events.where(part), path, F.col("ts"), ["event_type"], "user_id")
    estimated = sketches.approx_distinct(spark, path, ["event_type"])
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("estimate") - F.col("users")) <= F.col("users") * sketches.error_bound()
    return exact.join(estimated, "event_type").select("event_type", "users", "n", near.alias("within_bound"))


def _first_use_sequence(spark, folder):
    events = read_star(spark, folder, "events")
    uses = requests.first_use_sequence(events, "user_id", "event_type", "ts", EVENT_TYPES)
    return uses.select("user_id", F.array_join("sequence", ",").alias("sequence"))


# How the wide export is packed. A packed file is read whole by one task, so files are kept small.
PACKED = {"compression": "gzip", "zlib.compress.level": "FOUR", "maxRecordsPerFile": 100_000}


def _write_csv(raw: DataFrame, path: str, **options) -> None:
    """Latin-1 files with headers as an export has them, written by every task.

    The shuffles of ``raw`` go as soon as the files stand.
    """
    headers = [f" {name.replace('_', ' ').title()} " for name in raw.columns]
    writer = raw.toDF(*headers).write.options(
        header=True,
        encoding="ISO-8859-1",
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        timestampNTZFormat="M/d/yyyy H:mm",
        **options,
    )
    with shuffles_freed(raw.sparkSession):
        writer.csv(path)


def _csv_round_trip(spark, folder):
    """The raw order table through CSV files, cleaning and storing."""
    path = new_shared_path(spark, "round-trip")
    _write_csv(sales_orders(spark, folder, RAW_COLUMNS), f"{path}/csv", **PACKED)
    types = {**ORDER_TYPES, "product_status": "int"}
    read = read_orders_csv(spark, f"{path}/csv", types)
    write_table(cleaning.clean_orders(read), f"{path}/orders")
    remove(spark, f"{path}/csv")
    return load_orders(spark, f"{path}/orders", view=None)


def _csv_quarantine(spark, folder):
    """CSV files with planted bad lines: the good ones by market, the bad ones by reason."""
    path = new_shared_path(spark, "quarantine")
    names = ("order_id", "market", "sales", "order_date_dateorders")
    number, text = F.col("order_id"), sales_orders(spark, folder, names)
    planted = text.select(
        "order_id",
        F.when(number % 101 == 0, F.concat("market", F.lit(",x"))).otherwise(F.col("market")).alias("market"),
        F.when(number % 97 == 0, F.lit("much")).otherwise(F.col("sales").cast("string")).alias("sales"),
        F.when(number % 89 == 0, F.lit("soon"))
        .otherwise(F.date_format("order_date_dateorders", "M/d/yyyy H:mm"))
        .alias("order_date_dateorders"),
    )
    # Without quotes, a comma in a field is one field more.
    _write_csv(planted, f"{path}/csv", quote="")
    good, bad = split_orders_csv(spark, f"{path}/csv")
    write_table(good, f"{path}/good")
    write_table(bad, f"{path}/bad")
    counted = load_stored(spark, f"{path}/good").groupBy(F.col("market").alias("outcome"))
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("sales") * 100)), 0).alias("cents"))
    reasons = load_stored(spark, f"{path}/bad").groupBy(F.col("reason").alias("outcome"))
    return counted.unionByName(reasons.agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("cents")))


def _ingest(spark, folder):
    """The whole load from CSV files, run twice over the same target: rows of what it stored."""
    path = new_shared_path(spark, "ingest")
    _write_csv(sales_orders(spark, folder, RAW_COLUMNS), f"{path}/csv", **PACKED)
    for _ in range(2):
        paths = run_ingest(spark, f"{path}/csv", f"{path}/out", keep_bad=True)
    remove(spark, f"{path}/csv")
    stored = load_knowledge(spark, paths["knowledge"])
    found = stored.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    for name in ("orders", "rejected"):
        rows = load_stored(spark, paths[name]).agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(rows.select(F.lit(name).alias("source"), "n"))
    return found


def _knowledge_round_trip(spark, folder):
    """Stored documents by source, and how many of them are their own nearest one."""
    path = new_shared_path(spark, "knowledge")
    docs = _corpus(spark, folder)
    write_knowledge(vectors.embed_corpus(docs, vectors.fit_vectorizer(docs)), path)
    stored = load_knowledge(spark, path)
    base = stored.select(F.col("id").alias("doc_id"), "embedding")
    hits = vectors.knn(base.withColumnRenamed("doc_id", "query_id"), base, 1)
    own = hits.where("query_id = doc_id").select(F.col("query_id").alias("id"), F.lit(1).alias("own"))
    return (
        stored.join(own, "id", "left")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.count("own").alias("found"))
    )


def _previous_purchase(spark, folder):
    """Every event with the user's last purchase before it."""
    events = read_star(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.where("event_type = 'purchase'")
    return asof.asof_join(
        events.select("event_id", "user_id", "ts"), bought, "user_id", "ts", ["event_id", "value"], "event_id"
    ).select("event_id", "user_id", "prev_event_id", "prev_value")


def _orders_in_shipping(spark, folder):
    """How many earlier orders of the customer had not been shipped in full when an order came."""
    orders = read_star(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ordered")
    )
    shipped = read_star(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.unix_seconds(F.max("l_shipdate").cast("timestamp")).alias("shipped")
    )
    spans = orders.join(shipped, "o_orderkey")
    pairs = intervals.interval_join(orders, spans, "ordered", "ordered", "shipped", 30 * 86400, key="o_custkey")
    others = pairs.where("p.o_orderkey <> i.o_orderkey")
    return others.groupBy(F.col("p.o_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("open_orders"), F.min("i.o_orderkey").alias("first_open")
    )


def _running_revenue(spark, folder):
    """Revenue of a market up to each of its orders, in cents."""
    lines = sales_orders(spark, folder, ("market", "order_id", "order_date_dateorders", "sales"))
    cents = F.round(F.col("sales") * 100).cast("long")
    orders = lines.groupBy("market", "order_id", "order_date_dateorders").agg(F.sum(cents).alias("cents"))
    month = F.date_trunc("month", F.col("order_date_dateorders").cast("timestamp"))
    return ordered.running_total(
        orders, "market", ["order_date_dateorders", "order_id"], "cents", month
    ).select("market", "order_id", "cents", "running")


def _sales_rank(spark, folder):
    """Place of every order line by sales, the largest first."""
    lines = read_star(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return ordered.global_rank(lines, order)


def _sales_percentiles(spark, folder):
    lines = sales_orders(spark, folder, ("sales",))
    found = ordered.exact_percentiles(lines, "sales", [0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])
    return found.select("share", F.round("value", 4).alias("value"))


def _duplicates(spark, folder):
    return profiling.duplicate_profile(read_star(spark, folder, "documents").select("text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "risk_by_market": _risk("market"),
    "risk_by_category": _risk("category_name"),
    "risk_by_shipping_mode": _risk("shipping_mode"),
    "risk_by_department": _risk("department_name"),
    "risk_by_region": _risk("order_region"),
    "risk_by_segment": _risk("customer_segment"),
    "risk_category_in_market": _risk("category_name", "EUROPE"),
    "risk_report_json": _on_orders(
        lambda df: reports.risk_json(df, "shipping_mode"), ("shipping_mode", *RISK)
    ),
    "market_report": _on_orders(reports.market_report, MARKET),
    "category_profile": _on_orders(reports.category_profile, CATEGORY),
    "shipping_analysis": _on_orders(reports.shipping_analysis, SHIPPING),
    "segment_profile": _on_orders(reports.segment_profile, SEGMENT),
    "kpi_header": _on_orders(
        reports.kpi_header, ("market", "category_name", *STATUS, "sales")
    ),
    "status_share": _on_orders(reports.status_share, STATUS),
    "market_volume": _on_orders(reports.market_volume, ("market", "sales")),
    "mode_late": _on_orders(reports.mode_late, ("shipping_mode", *STATUS)),
    "segment_economics": _on_orders(
        reports.segment_economics, ("customer_segment", *PROFIT, "sales")
    ),
    "revenue_summary": _on_orders(reports.revenue_summary, (*PROFIT, "sales")),
    "canceled_in_market": _on_orders(
        lambda df: reports.canceled_in_market(df, "EUROPE", TEST_MARKETS), ("market", *STATUS)
    ),
    "canceled_by_market": _on_orders(reports.canceled_by_market, ("market", *STATUS)),
    "schema_listing": _on_orders(profiling.describe_schema, RAW_COLUMNS),
    "table_shape": _on_orders(profiling.table_shape, RAW_COLUMNS),
    "normalize_columns": _on_orders(
        lambda df: normalize_columns(_messy(df)), tuple(MESSY_HEADERS)
    ),
    "null_profile": _on_orders(profiling.null_profile, RAW_COLUMNS),
    "duplicate_profile": _duplicates,
    "duplicate_order_rows": _on_orders(profiling.duplicate_profile),
    "lookup_keys": lookup_keys,
    "csv_round_trip": _csv_round_trip,
    "csv_quarantine": _csv_quarantine,
    "ingest": _ingest,
    "knowledge_round_trip": _knowledge_round_trip,
    "pii_presence": _on_orders(profiling.pii_sample, PII_COLUMNS),
    "non_null_counts": _on_orders(profiling.non_null_counts, USEFULNESS_COLUMNS),
    "delivery_status_counts": _on_orders(
        lambda df: profiling.value_counts(df, "delivery_status"), STATUS
    ),
    "order_status_counts": _on_orders(
        lambda df: profiling.value_counts(df, "order_status", order=True), ("order_status",)
    ),
    "column_samples": _on_orders(profiling.column_samples, RAW_COLUMNS),
    "category_frequencies": _on_orders(profiling.category_frequencies, FREQUENCY_COLUMNS),
    "top_categories": _on_orders(
        lambda df: profiling.top_values(df, "category_name", 10), ("category_name",)
    ),
    "top_modes_with_null": _on_orders(
        lambda df: profiling.top_values(df, "shipping_mode", 10, dropna=False), ("shipping_mode",)
    ),
    "distinct_markets": _on_orders(
        lambda df: profiling.distinct_values(df, "market"), ("market",)
    ),
    "previous_purchase": _previous_purchase,
    "orders_in_shipping": _orders_in_shipping,
    "running_revenue": _running_revenue,
    "sales_rank": _sales_rank,
    "sales_percentiles": _sales_percentiles,
    "clean_orders": _on_orders(cleaning.clean_orders, RAW_COLUMNS),
    "clean_report": _clean_report,
    "remaining_nulls": _on_orders(
        lambda df: cleaning.remaining_nulls(cleaning.clean_orders(df)), RAW_COLUMNS
    ),
    "docs_market": _on_orders(knowledge.market_docs, MARKET),
    "docs_category": _on_orders(knowledge.category_docs, CATEGORY),
    "docs_shipping": _on_orders(knowledge.shipping_docs, SHIPPING),
    "docs_segment": _on_orders(knowledge.segment_docs, SEGMENT),
    "knowledge_corpus": _on_orders(knowledge.knowledge_corpus, CORPUS),
    "corpus_by_source": _on_orders(
        lambda df: knowledge.corpus_by_source(knowledge.knowledge_corpus(df)), CORPUS
    ),
    "corpus_samples": _on_orders(
        lambda df: knowledge.corpus_samples(knowledge.knowledge_corpus(df)), CORPUS
    ),
    "knn_cosine": _knn_cosine,
    "knn_many": _knn_many,
    "knn_l2_relevance": _knn_l2_relevance,
    "knn_context": _knn_context,
    "knn_cells": _knn_cells,
    "knn_codes": _knn_codes,
    "corpus_vectors": _corpus_vectors,
    "search_corpus": _search_corpus,
    "guarded_select": _guarded_select,
    "statement_outcomes": _statement_outcomes,
    "sql_audit": _sql_audit,
    "sql_audit_counts": _sql_audit_counts,
    "text_guard": _text_guard,
    "text_guard_counts": _text_guard_counts,
    "user_turn_guard": _user_turns,
    "conversation_history": _conversation_history,
    "ensure_system_turn": _ensure_system_turn,
    "throttle_audit": _throttle_audit,
    "throttle_stream": _throttle_stream,
    "throttle_late": _throttle_late,
    "usage_counts": _usage_counts,
    "first_use_sequence": _first_use_sequence,
    "active_users": _active_users,
}

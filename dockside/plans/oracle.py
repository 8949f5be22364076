"""The same queries as ANSI SQL over the star-schema test tables, for checking."""

from dockside.functions.text import BLANK_CODES, LEADING_MARKS
from dockside.operators.guarded_sql import BLOCKED_WORD, NOT_SELECT
from dockside.operators.requests import EMPTY_MESSAGE, LONG_MESSAGE, MAX_CHARS
from dockside.plans.catalog import (
    EVENT_TYPES,
    GUARDED_SQL,
    MESSY_HEADERS,
    SYSTEM_PROMPT,
)
from dockside.schema import (
    FREQUENCY_COLUMNS,
    PII_COLUMNS,
    SPARSE_COLUMNS,
    USEFULNESS_COLUMNS,
)
from dockside.sources.csv_orders import normalize_name
from dockside.sources.star import CLEAN_COLUMNS, RAW_COLUMNS

SALES = """
base AS (
  SELECT *,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS pr,
    CAST(l_discount AS DECIMAL(3,2)) AS di,
    CAST(((date_diff('day', o_orderdate, l_shipdate) % 7) + 7) % 7 AS INTEGER) AS days_real,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS days_planned
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
),
priced AS (
  SELECT *,
    CASE WHEN o_orderstatus = 'P' AND l_returnflag = 'R' THEN 'Shipping canceled'
         WHEN days_real > days_planned THEN 'Late delivery'
         WHEN days_real = days_planned THEN 'Shipping on time'
         WHEN days_real < days_planned THEN 'Advance shipping' END AS status,
    CAST(round(pr * (1 - di) - CAST(l_quantity AS DECIMAL(6,0))
         * CAST(p_retailprice AS DECIMAL(10,2)), 2) AS DOUBLE) AS profit
  FROM base
),
sales_orders AS (
  SELECT
    o_orderkey AS order_id,
    o_orderstatus AS order_status,
    o_orderdate AS order_date_dateorders,
    l_shipdate AS shipping_date_dateorders,
    status AS delivery_status,
    days_real AS days_for_shipping_real,
    days_planned AS days_for_shipment_scheduled,
    CASE WHEN status = 'Late delivery' THEN 1 ELSE 0 END AS late_delivery_risk,
    NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS shipping_mode,
    r_name AS market,
    n_name AS order_region,
    c_mktsegment AS customer_segment,
    CAST(NULLIF(c_custkey % 100, 0) AS INTEGER) AS customer_zipcode,
    p_name AS category_name,
    p_type AS department_name,
    p_name AS product_name,
    p_retailprice AS product_price,
    l_extendedprice AS sales,
    CAST(l_quantity AS INTEGER) AS order_item_quantity,
    l_discount AS order_item_discount_rate,
    CAST(round(pr * di, 2) AS DOUBLE) AS order_item_discount,
    CAST(round(pr * (1 - di), 2) AS DOUBLE) AS order_item_total,
    profit AS order_profit_per_order,
    profit / NULLIF(l_extendedprice, 0) AS order_item_profit_ratio,
    lower(c_name) || '@example.org' AS customer_email,
    c_name AS customer_fname,
    c_name AS customer_lname,
    'XXXXXXXXX' AS customer_password,
    'Street ' || CAST(c_custkey AS VARCHAR) AS customer_street,
    CAST(NULL AS VARCHAR) AS product_description,
    'http://images.example.org/' || CAST(p_partkey AS VARCHAR) AS product_image,
    0 AS product_status,
    CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 90000 AS INTEGER) END AS order_zipcode
  FROM priced
)
"""

LATE_PCT = "ROUND(AVG(CASE WHEN delivery_status = 'Late delivery' THEN 1.0 ELSE 0.0 END) * 100, 1)"
PROFIT = (
    "ROUND(CAST(SUM(CAST(order_profit_per_order AS DECIMAL(18,6))) AS DOUBLE)"
    " / COUNT(order_profit_per_order), 2)"
)
REVENUE = "CAST(ROUND(SUM(CAST(sales AS DECIMAL(18,6))), 0) AS DOUBLE)"


def _orders(body: str) -> str:
    return f"WITH {SALES} {body}"


def _risk(dimension: str, where: str = "", limit: int = 20) -> str:
    return f"""
      SELECT {dimension} AS dimension, COUNT(*) AS total_orders,
        {LATE_PCT} AS late_rate_pct,
        ROUND(AVG(days_for_shipping_real - days_for_shipment_scheduled), 1) + 0.0
          AS avg_delay_days,
        {PROFIT} AS avg_profit_usd,
        {REVENUE} AS total_revenue_usd
      FROM sales_orders WHERE {dimension} IS NOT NULL {where}
      GROUP BY {dimension} ORDER BY late_rate_pct DESC, dimension LIMIT {limit}"""


MARKET_REPORT = f"""
  SELECT market, COUNT(*) AS total_orders, {LATE_PCT} AS late_pct, {PROFIT} AS avg_profit,
    {REVENUE} AS total_sales, COUNT(DISTINCT category_name) AS num_categories,
    COUNT(DISTINCT shipping_mode) AS num_ship_modes
  FROM sales_orders WHERE market IS NOT NULL GROUP BY market"""

CATEGORY_PROFILE = f"""
  SELECT category_name, COUNT(*) AS orders, {LATE_PCT} AS late_pct,
    ROUND(AVG(order_item_profit_ratio) * 100, 1) + 0.0 AS margin_pct,
    {REVENUE} AS revenue, {PROFIT} AS avg_profit
  FROM sales_orders WHERE category_name IS NOT NULL
  GROUP BY category_name ORDER BY orders DESC, category_name LIMIT 25"""

SHIPPING_ANALYSIS = f"""
  SELECT shipping_mode, orders, avg_actual, avg_scheduled,
    ROUND(avg_actual - avg_scheduled, 1) + 0.0 AS avg_delay, late_pct, avg_profit
  FROM (
    SELECT shipping_mode, COUNT(*) AS orders,
      ROUND(AVG(days_for_shipping_real), 1) AS avg_actual,
      ROUND(AVG(days_for_shipment_scheduled), 1) AS avg_scheduled,
      {LATE_PCT} AS late_pct, {PROFIT} AS avg_profit
    FROM sales_orders WHERE shipping_mode IS NOT NULL GROUP BY shipping_mode)"""

SEGMENT_PROFILE = f"""
  SELECT customer_segment, COUNT(*) AS orders, {PROFIT} AS avg_profit,
    {REVENUE} AS total_sales, {LATE_PCT} AS late_pct
  FROM sales_orders WHERE customer_segment IS NOT NULL GROUP BY customer_segment"""


def _whole(name: str) -> str:
    return f"format('{{:,}}', CAST({name} AS BIGINT))"


def _fixed(name: str, digits: int) -> str:
    return f"CAST(CAST({name} AS DECIMAL(28,{digits})) AS VARCHAR)"


MARKET_DOCS = f"""
  SELECT 'market_' || replace(market, ' ', '_') AS id,
    market || ' market: ' || {_whole("total_orders")} || ' order lines, '
    || {_fixed("late_pct", 1)} || '% of them late. Sales reach $' || {_whole("total_sales")}
    || ' with $' || {_fixed("avg_profit", 2)}
    || ' profit on an average line. Customers choose from '
    || num_categories || ' categories and ' || num_ship_modes || ' ways of shipping.' AS text,
    'market_report' AS source, market
  FROM ({MARKET_REPORT})"""

CATEGORY_DOCS = f"""
  SELECT 'cat_' || replace(replace(category_name, ' ', '_'), '/', '_') AS id,
    category_name || ' category: ' || {_whole("orders")} || ' order lines bring $'
    || {_whole("revenue")} || ' revenue. Margin is ' || {_fixed("margin_pct", 1)}
    || '%, profit on an average line $' || {_fixed("avg_profit", 2)} || ', and '
    || {_fixed("late_pct", 1)} || '% of lines come late.' AS text,
    'category_profile' AS source, CAST(NULL AS VARCHAR) AS market
  FROM ({CATEGORY_PROFILE})"""

SHIPPING_DOCS = f"""
  SELECT 'ship_' || replace(shipping_mode, ' ', '_') AS id,
    shipping_mode || ' shipping: chosen for ' || {_whole("orders")}
    || ' order lines. It takes ' || {_fixed("avg_actual", 1)} || ' days where '
    || {_fixed("avg_scheduled", 1)} || ' are planned, a difference of '
    || {_fixed("avg_delay", 1)} || ' days; ' || {_fixed("late_pct", 1)}
    || '% of lines come late and an average line earns $' || {_fixed("avg_profit", 2)}
    || '.' AS text,
    'shipping_analysis' AS source, CAST(NULL AS VARCHAR) AS market
  FROM ({SHIPPING_ANALYSIS})"""

SEGMENT_DOCS = f"""
  SELECT 'seg_' || replace(customer_segment, ' ', '_') AS id,
    customer_segment || ' customers: ' || {_whole("orders")} || ' order lines worth $'
    || {_whole("total_sales")} || '. An average line earns $' || {_fixed("avg_profit", 2)}
    || ' and ' || {_fixed("late_pct", 1)} || '% of lines come late.' AS text,
    'segment_profile' AS source, CAST(NULL AS VARCHAR) AS market
  FROM ({SEGMENT_PROFILE})"""

CORPUS = f"""corpus AS (
  SELECT * FROM ({MARKET_DOCS}) UNION ALL SELECT * FROM ({CATEGORY_DOCS})
  UNION ALL SELECT * FROM ({SHIPPING_DOCS}) UNION ALL SELECT * FROM ({SEGMENT_DOCS}))"""


def _corpus(body: str) -> str:
    return f"WITH {SALES}, {CORPUS} {body}"


def _per_column(columns, measure: str, value: str, table="sales_orders", extra="") -> str:
    """One row per column, from ``measure`` with the column's name put in."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {measure.format(name)} AS {value} {extra} FROM {table}"
        for name in columns
    )


# Spark type names of the order columns that are not strings.
_BIGINT = ("order_id",)
_TIMES = ("order_date_dateorders", "shipping_date_dateorders")
_INTS = (
    "days_for_shipping_real", "days_for_shipment_scheduled", "late_delivery_risk",
    "customer_zipcode", "order_item_quantity", "product_status", "order_zipcode",
)
_DOUBLES = (
    "product_price", "sales", "order_item_discount_rate", "order_item_discount",
    "order_item_total", "order_profit_per_order", "order_item_profit_ratio",
)


def _type(name: str) -> str:
    groups = {"bigint": _BIGINT, "timestamp_ntz": _TIMES, "int": _INTS, "double": _DOUBLES}
    return next((kind for kind, names in groups.items() if name in names), "string")


SCHEMA_LISTING = " UNION ALL ".join(
    f"SELECT {place} AS position, '{name}' AS column_name, '{_type(name)}' AS column_type,"
    f" COUNT({name}) AS non_nulls FROM sales_orders"
    for place, name in enumerate(RAW_COLUMNS)
)
COLUMN_SAMPLES = " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, '{_type(name)}' AS column_type,"
    f" COALESCE(CAST(MIN({name}) AS VARCHAR), 'N/A') AS sample FROM sales_orders"
    for name in RAW_COLUMNS
)

# Lookup tables and their keys.
LOOKUP_KEYS = {
    "orders": "o_orderkey",
    "customer": "c_custkey",
    "nation": "n_nationkey",
    "region": "r_regionkey",
    "part": "p_partkey",
}

_DROPPED = (*PII_COLUMNS, *SPARSE_COLUMNS)
_KEPT = [name for name in RAW_COLUMNS if name not in _DROPPED]
CLEANED = (
    "cleaned AS (SELECT "
    + ", ".join(
        "COALESCE(customer_zipcode, 0) AS customer_zipcode" if name == "customer_zipcode" else name
        for name in _KEPT
    )
    + " FROM sales_orders)"
)

CENTROIDS = """
  parts AS (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
    FROM embeddings),
  means AS (
    SELECT label AS query_id, pos, AVG(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY label, pos),
  sized AS (SELECT query_id, SQRT(SUM(m * m)) AS size FROM means GROUP BY query_id),
  questions AS (
    SELECT query_id, list(m / size ORDER BY pos) AS q
    FROM means JOIN sized USING (query_id) GROUP BY query_id)
"""

KNN_COSINE = f"""
  WITH {CENTROIDS},
  pairs AS (
    SELECT query_id, vec_id AS doc_id,
      ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 10) AS closeness
    FROM questions CROSS JOIN embeddings),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, doc_id) AS rank
    FROM pairs)
  SELECT query_id, doc_id, ROUND(closeness, 4) + 0.0 AS score, rank FROM ranked WHERE rank <= 10"""

KNN_CELLS = f"""
  WITH {CENTROIDS},
  pairs AS (
    SELECT query_id, vec_id AS doc_id,
      ROUND(pow(list_distance(CAST(embedding AS DOUBLE[]), q), 2), 10) AS distance
    FROM questions CROSS JOIN embeddings),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
    FROM pairs)
  SELECT query_id, doc_id, ROUND(distance, 4) + 0.0 AS score, rank FROM ranked WHERE rank <= 10"""

KNN_MANY = KNN_CELLS.replace("rank <= 10", "rank <= 25")

DOCUMENT_HITS = f"""
  {CENTROIDS},
  pairs AS (
    SELECT query_id, vec_id AS doc_id, text, source,
      ROUND(pow(list_distance(CAST(embedding AS DOUBLE[]), q), 2), 10) AS distance
    FROM questions CROSS JOIN embeddings JOIN documents ON doc_id = vec_id),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
    FROM pairs),
  hits AS (
    SELECT query_id, rank, doc_id, text, COALESCE(source, 'unknown') AS source,
      ROUND(1 - distance, 3) + 0.0 AS relevance_score
    FROM ranked WHERE rank <= 4)
"""

# Hashed TF-IDF of the corpus and of one question per category.
TEXT_VECTORS = """
  asked AS (
    SELECT DISTINCT category_name AS query_id,
      'revenue and margin of the category ' || category_name AS text
    FROM sales_orders WHERE category_name IS NOT NULL),
  doc_words AS (
    SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM corpus),
  ask_words AS (
    SELECT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM asked),
  doc_tf AS (
    SELECT id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 384 AS bucket, COUNT(*) AS tf
    FROM doc_words GROUP BY ALL),
  ask_tf AS (
    SELECT query_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 384 AS bucket,
      COUNT(*) AS tf
    FROM ask_words GROUP BY ALL),
  doc_count AS (SELECT COUNT(*) AS m FROM corpus),
  idf AS (
    SELECT bucket, ln((any_value(m) + 1.0) / (COUNT(*) + 1.0)) AS idf
    FROM doc_tf CROSS JOIN doc_count GROUP BY bucket),
  doc_w AS (SELECT id, bucket, tf * idf AS w FROM doc_tf JOIN idf USING (bucket)),
  ask_w AS (
    SELECT query_id, bucket, tf * COALESCE(idf, ln(m + 1.0)) AS w
    FROM ask_tf LEFT JOIN idf USING (bucket) CROSS JOIN doc_count),
  doc_unit AS (
    SELECT id, bucket, CAST(CAST(w / SQRT(SUM(w * w) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE)
      AS w FROM doc_w),
  ask_unit AS (
    SELECT query_id, bucket,
      CAST(CAST(w / SQRT(SUM(w * w) OVER (PARTITION BY query_id)) AS FLOAT) AS DOUBLE) AS w
    FROM ask_w)
"""

CORPUS_VECTORS = f""", {TEXT_VECTORS}
  SELECT corpus.id, any_value(source) AS source, CAST(384 AS BIGINT) AS dims,
    COUNT(*) FILTER (w > 0) AS used, ROUND(SUM(w * (bucket + 1)), 2) AS weighted_sum
  FROM corpus LEFT JOIN doc_unit ON corpus.id = doc_unit.id GROUP BY corpus.id"""

SEARCH_CORPUS = f""", {TEXT_VECTORS},
  dots AS (
    SELECT query_id, id, SUM(a.w * d.w) AS dot
    FROM ask_unit a JOIN doc_unit d USING (bucket) GROUP BY query_id, id),
  doc_sq AS (SELECT id, SUM(w * w) AS sq FROM doc_unit GROUP BY id),
  ask_sq AS (SELECT query_id, SUM(w * w) AS sq FROM ask_unit GROUP BY query_id),
  pairs AS (
    SELECT asked.query_id, corpus.id AS doc_id, source,
      ROUND(ask_sq.sq + doc_sq.sq - 2 * COALESCE(dot, 0.0), 10) AS distance
    FROM asked CROSS JOIN corpus
    JOIN doc_sq ON doc_sq.id = corpus.id
    JOIN ask_sq ON ask_sq.query_id = asked.query_id
    LEFT JOIN dots ON dots.query_id = asked.query_id AND dots.id = corpus.id),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
    FROM pairs)
  SELECT query_id, rank, doc_id, source, ROUND(1 - distance, 3) + 0.0 AS relevance_score
  FROM ranked WHERE rank <= 4"""

STATEMENTS = """
  statements AS (
    SELECT event_id, CASE event_type
      WHEN 'click' THEN 'SELECT COUNT(*) FROM orders WHERE order_id = ' || user_id
      WHEN 'error' THEN '  select sales from orders -- ' || props
      WHEN 'purchase' THEN 'DELETE FROM orders WHERE order_id = ' || user_id
      WHEN 'signup' THEN 'WITH t AS (SELECT 1) SELECT * FROM t, u' || user_id
      ELSE 'Select ''Updated'' AS created_at FROM orders; -- ' || user_id END AS statement
    FROM events),
  searched AS (
    SELECT *, regexp_matches(statement, '(?i)^\\s*SELECT\\b') AS is_select,
      CASE WHEN contains(lower(statement), 'drop') THEN 'drop'
           WHEN contains(lower(statement), 'delete') THEN 'delete'
           WHEN contains(lower(statement), 'insert') THEN 'insert'
           WHEN contains(lower(statement), 'update') THEN 'update'
           WHEN contains(lower(statement), 'create') THEN 'create'
           WHEN contains(lower(statement), 'alter') THEN 'alter'
           WHEN contains(lower(statement), 'truncate') THEN 'truncate'
           WHEN contains(lower(statement), 'exec') THEN 'exec'
           WHEN contains(lower(statement), 'execute') THEN 'execute'
           WHEN contains(lower(statement), '--') THEN '--'
           WHEN contains(lower(statement), ';') THEN ';' END AS found
    FROM statements),
  audited AS (
    SELECT event_id, statement,
      CASE WHEN NOT is_select THEN 'not_select' WHEN found IS NOT NULL THEN 'blocked'
           ELSE 'ok' END AS verdict,
      CASE WHEN is_select THEN found END AS blocked_by
    FROM searched)
"""

_BLANKS = " || ".join(f"chr({code})" for code in BLANK_CODES)


def _checked(table: str) -> str:
    trimmed = f"trim(text, {_BLANKS})"
    return f"""
  judged AS (
    SELECT *, {trimmed} AS trimmed,
      CASE WHEN text IS NULL OR length({trimmed}) = 0 THEN 'empty'
           WHEN length(text) > {MAX_CHARS} THEN 'too_long' ELSE 'ok' END AS verdict
    FROM {table}),
  checked AS (
    SELECT *, CASE verdict WHEN 'empty' THEN '{EMPTY_MESSAGE}'
        WHEN 'too_long' THEN '{LONG_MESSAGE.format(MAX_CHARS)}' ELSE '' END AS reason,
      CASE WHEN verdict = 'ok' THEN trimmed ELSE '' END AS sanitized
    FROM judged)"""


HOURLY = """
  hourly AS (
    SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, COUNT(*) AS n
    FROM events GROUP BY ALL),
  busy AS (
    SELECT user_id, window_start, window_start + INTERVAL '1 hour' AS window_end, n, n - 1 AS over
    FROM hourly WHERE n > 1)
"""

ORACLE_SQL: dict[str, str] = {
    "risk_by_market": _orders(_risk("market")),
    "risk_by_category": _orders(_risk("category_name")),
    "risk_by_shipping_mode": _orders(_risk("shipping_mode")),
    "risk_by_department": _orders(_risk("department_name")),
    "risk_by_region": _orders(_risk("order_region")),
    "risk_by_segment": _orders(_risk("customer_segment")),
    "risk_category_in_market": _orders(_risk("category_name", "AND market = 'EUROPE'")),
    "risk_report_json": _orders(f"""
      SELECT '{{"grouped_by":"shipping_mode","market_filter":"all markets","results":['
        || string_agg('{{"dimension":"' || dimension || '","total_orders":' || total_orders
          || ',"late_rate_pct":' || {_fixed("late_rate_pct", 1)}
          || ',"avg_delay_days":' || {_fixed("avg_delay_days", 1)}
          || ',"avg_profit_usd":' || {_fixed("avg_profit_usd", 2)}
          || ',"total_revenue_usd":' || CAST(total_revenue_usd AS BIGINT) || '}}',
          ',' ORDER BY late_rate_pct DESC, dimension)
        || ']}}' AS report
      FROM ({_risk("shipping_mode", limit=10)})"""),
    "market_report": _orders(MARKET_REPORT),
    "category_profile": _orders(CATEGORY_PROFILE),
    "shipping_analysis": _orders(SHIPPING_ANALYSIS),
    "segment_profile": _orders(SEGMENT_PROFILE),
    "kpi_header": _orders(f"""
      SELECT COUNT(*) AS orders, COUNT(DISTINCT market) AS markets,
        COUNT(DISTINCT category_name) AS categories, {LATE_PCT} AS late_pct,
        ROUND(CAST(SUM(CAST(sales AS DECIMAL(18,6))) AS DOUBLE) / 1000000, 1) AS revenue_musd
      FROM sales_orders"""),
    "status_share": _orders("""
      SELECT delivery_status, COUNT(*) AS n,
        ROUND(CAST(COUNT(*) * 100.0 AS DOUBLE) / (SELECT COUNT(*) FROM sales_orders), 1) AS pct
      FROM sales_orders GROUP BY delivery_status"""),
    "market_volume": _orders(
        f"SELECT market, COUNT(*) AS n, {REVENUE} AS revenue FROM sales_orders GROUP BY market"
    ),
    "mode_late": _orders(f"""
      SELECT shipping_mode, COUNT(*) AS n, {LATE_PCT} AS late_pct
      FROM sales_orders GROUP BY shipping_mode"""),
    "segment_economics": _orders(f"""
      SELECT customer_segment, COUNT(*) AS n, {PROFIT} AS avg_profit, {REVENUE} AS revenue
      FROM sales_orders GROUP BY customer_segment"""),
    "revenue_summary": _orders(f"""
      SELECT {REVENUE} AS total_revenue,
        ROUND(CAST(SUM(CAST(sales AS DECIMAL(18,6))) AS DOUBLE) / COUNT(sales), 2) AS avg_sale,
        CAST(ROUND(SUM(CAST(order_profit_per_order AS DECIMAL(18,6))), 0) AS DOUBLE)
          AS total_profit,
        {PROFIT} AS avg_profit
      FROM sales_orders"""),
    "canceled_in_market": _orders("""
      SELECT COUNT(*) AS canceled FROM sales_orders
      WHERE market = 'EUROPE' AND delivery_status = 'Shipping canceled'"""),
    "canceled_by_market": _orders("""
      SELECT market, COUNT(*) AS canceled FROM sales_orders
      WHERE delivery_status = 'Shipping canceled' GROUP BY market"""),
    "schema_listing": _orders(SCHEMA_LISTING),
    "table_shape": _orders(
        f"SELECT COUNT(*) AS n_rows, {len(RAW_COLUMNS)} AS n_columns FROM sales_orders"
    ),
    "normalize_columns": _orders(
        "SELECT "
        + ", ".join(f"{name} AS {normalize_name(header)}" for name, header in MESSY_HEADERS.items())
        + " FROM sales_orders"
    ),
    "null_profile": _orders(
        "SELECT * FROM ("
        + _per_column(RAW_COLUMNS, "COUNT(*) FILTER ({} IS NULL)", "nulls")
        + ") WHERE nulls > 0"
    ),
    "duplicate_profile": """
      SELECT COUNT(*) AS total_rows,
        (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS distinct_rows,
        COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang FROM documents))
          AS duplicate_rows
      FROM documents""",
    "duplicate_order_rows": _orders("""
      SELECT COUNT(*) AS total_rows,
        (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM sales_clean)) AS distinct_rows,
        COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM sales_clean)) AS duplicate_rows
      FROM sales_clean""".replace(
        "sales_clean", f"(SELECT {', '.join(CLEAN_COLUMNS)} FROM sales_orders)"
    )),
    "lookup_keys": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, COUNT(*) AS n_rows, COUNT(DISTINCT {key}) AS n_keys,"
        f" COUNT(*) - COUNT({key}) AS n_nulls FROM {table}"
        for table, key in LOOKUP_KEYS.items()
    ),
    "csv_round_trip": f"WITH {SALES}, {CLEANED} SELECT * FROM cleaned",
    "knowledge_round_trip": _corpus(
        "SELECT source, COUNT(*) AS n, COUNT(*) AS found FROM corpus GROUP BY source"
    ),
    "top_modes_with_null": _orders("""
      SELECT shipping_mode, COUNT(*) AS n FROM sales_orders GROUP BY shipping_mode
      ORDER BY n DESC, shipping_mode NULLS LAST LIMIT 10"""),
    "pii_presence": _orders(
        _per_column(PII_COLUMNS, "COALESCE(substr(MIN({}), 1, 1) || '***', 'empty')", "sample")
    ),
    "non_null_counts": _orders(_per_column(USEFULNESS_COLUMNS, "COUNT({})", "non_nulls")),
    "delivery_status_counts": _orders(
        "SELECT delivery_status, COUNT(*) AS n FROM sales_orders GROUP BY delivery_status"
    ),
    "order_status_counts": _orders(
        "SELECT order_status, COUNT(*) AS n FROM sales_orders GROUP BY order_status"
    ),
    "column_samples": _orders(COLUMN_SAMPLES),
    "category_frequencies": _orders(
        " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, {name} AS value, COUNT(*) AS n"
            f" FROM sales_orders WHERE {name} IS NOT NULL GROUP BY {name}"
            for name in FREQUENCY_COLUMNS
        )
    ),
    "top_categories": _orders("""
      SELECT category_name, COUNT(*) AS n FROM sales_orders WHERE category_name IS NOT NULL
      GROUP BY category_name ORDER BY n DESC, category_name LIMIT 10"""),
    "distinct_markets": _orders(
        "SELECT DISTINCT market FROM sales_orders WHERE market IS NOT NULL"
    ),
    "clean_orders": f"WITH {SALES}, {CLEANED} SELECT * FROM cleaned",
    "clean_report": f"""WITH {SALES}, {CLEANED}
      SELECT b.n AS rows_before, {len(RAW_COLUMNS)} AS columns_before, a.n AS rows_after,
        {len(_KEPT)} AS columns_after, {len(RAW_COLUMNS) - len(_KEPT)} AS columns_removed,
        b.n = a.n AS rows_unchanged
      FROM (SELECT COUNT(*) AS n FROM sales_orders) b
      CROSS JOIN (SELECT COUNT(*) AS n FROM cleaned) a""",
    "remaining_nulls": f"WITH {SALES}, {CLEANED} SELECT * FROM ("
    + _per_column(_KEPT, "COUNT(*) FILTER ({} IS NULL)", "nulls", "cleaned")
    + ") WHERE nulls > 0",
    "docs_market": _orders(MARKET_DOCS),
    "docs_category": _orders(CATEGORY_DOCS),
    "docs_shipping": _orders(SHIPPING_DOCS),
    "docs_segment": _orders(SEGMENT_DOCS),
    "knowledge_corpus": _corpus("SELECT * FROM corpus"),
    "corpus_by_source": _corpus("SELECT source, COUNT(*) AS n FROM corpus GROUP BY source"),
    "corpus_samples": _corpus("""
      SELECT source, id, substr(text, 1, 200) || '...' AS sample FROM corpus
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) = 1"""),
    "knn_cosine": KNN_COSINE,
    "knn_many": KNN_MANY,
    "csv_quarantine": _orders("""
      SELECT CASE WHEN order_id % 101 = 0 THEN 'malformed line' WHEN order_id % 97 = 0 THEN 'sales does not fit'
          WHEN order_id % 89 = 0 THEN 'order_date_dateorders does not fit' ELSE market END AS outcome,
        COUNT(*) AS n,
        CAST(SUM(CASE WHEN order_id % 101 = 0 OR order_id % 97 = 0 OR order_id % 89 = 0 THEN 0
          ELSE ROUND(sales * 100) END) AS DOUBLE) AS cents
      FROM sales_orders GROUP BY 1"""),
    "ingest": _corpus("""
      SELECT source, COUNT(*) AS n FROM corpus GROUP BY source
      UNION ALL SELECT 'orders', COUNT(*) FROM lineitem UNION ALL SELECT 'rejected', 0"""),
    "previous_purchase": """
      WITH bought AS (SELECT * FROM events WHERE event_type = 'purchase'),
      found AS (
        SELECT e.event_id, MAX({'ts': b.ts, 'id': b.event_id, 'value': b.value}) AS f
        FROM events e JOIN bought b ON e.user_id = b.user_id AND b.ts < e.ts GROUP BY e.event_id)
      SELECT e.event_id, e.user_id, f.f.id AS prev_event_id, f.f.value AS prev_value
      FROM events e LEFT JOIN found f USING (event_id)""",
    "orders_in_shipping": """
      WITH spans AS (
        SELECT o_orderkey, o_custkey, any_value(o_orderdate) AS ordered, MAX(l_shipdate) AS shipped
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)
      SELECT o.o_orderkey, COUNT(*) AS open_orders, MIN(s.o_orderkey) AS first_open
      FROM orders o JOIN spans s ON o.o_custkey = s.o_custkey AND o.o_orderkey <> s.o_orderkey
        AND s.ordered <= o.o_orderdate AND o.o_orderdate < s.shipped
      GROUP BY o.o_orderkey""",
    "running_revenue": _orders("""
      SELECT market, order_id, cents, CAST(SUM(cents) OVER (
        PARTITION BY market ORDER BY order_date_dateorders, order_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
      FROM (
        SELECT market, order_id, order_date_dateorders, CAST(SUM(CAST(ROUND(sales * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM sales_orders GROUP BY ALL)"""),
    "sales_rank": """
      SELECT l_orderkey, l_linenumber, l_extendedprice,
        row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place
      FROM lineitem""",
    "sales_percentiles": _orders("""
      SELECT share, ROUND((SELECT quantile_cont(sales, [0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) FROM sales_orders)[i], 4)
        AS value
      FROM (SELECT unnest([0.01::DOUBLE, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) AS share,
        unnest(range(1, 8)) AS i)"""),
    "knn_cells": KNN_CELLS,
    "knn_codes": """
      SELECT COUNT(DISTINCT label) AS queries,
        COUNT(DISTINCT label) * LEAST(25, COUNT(*)) AS exact_hits, TRUE AS nine_of_ten
      FROM embeddings""",
    "knn_l2_relevance": f"WITH {DOCUMENT_HITS} SELECT * FROM hits",
    "knn_context": f"""WITH {DOCUMENT_HITS}
      SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
      FROM hits GROUP BY query_id""",
    "corpus_vectors": _corpus(CORPUS_VECTORS),
    "search_corpus": _corpus(SEARCH_CORPUS),
    "guarded_select": _orders(f"""
      SELECT *, LEAST(COUNT(*) OVER (), 50) AS row_count, COUNT(*) OVER () > 50 AS truncated
      FROM ({GUARDED_SQL.replace("FROM orders", "FROM sales_orders")})
      ORDER BY n DESC, category_name, market LIMIT 50"""),
    "statement_outcomes": f"""
      WITH {SALES}, {STATEMENTS},
      first_ones AS (
        SELECT event_type, MIN(statement) AS statement FROM audited JOIN events USING (event_id)
        GROUP BY event_type)
      SELECT event_type, CASE event_type
        WHEN 'click' THEN '1 row: [' || (
          SELECT COUNT(*) FROM sales_orders
          WHERE order_id = TRY_CAST(regexp_extract(statement, '[0-9]+$') AS BIGINT)) || ']'
        WHEN 'error' THEN '{BLOCKED_WORD.format("--").replace("'", "''")}'
        WHEN 'view' THEN '{BLOCKED_WORD.format("update").replace("'", "''")}'
        ELSE '{NOT_SELECT}' END AS outcome
      FROM first_ones
      UNION ALL
      SELECT 'identifier', 'only the given views may be read, not ' || chr(39) || 'global_temp.event'
        || MIN(event_id) || chr(39)
      FROM events""",
    "sql_audit": f"WITH {STATEMENTS} SELECT * FROM audited",
    "sql_audit_counts": f"""WITH {STATEMENTS}
      SELECT verdict, blocked_by, COUNT(*) AS n FROM audited GROUP BY verdict, blocked_by""",
    "text_guard": f"""WITH {_checked("documents")}
      SELECT doc_id, verdict, reason, sanitized FROM checked""",
    "text_guard_counts": f"""WITH {_checked("documents")}
      SELECT verdict, COUNT(*) AS n FROM checked GROUP BY verdict""",
    "user_turn_guard": f"""
      WITH turns AS (
        SELECT conv_id, turn, trim(ltrim('📦 ' || text, '{LEADING_MARKS}'), {_BLANKS}) AS text
        FROM conversations WHERE role = 'user'), {_checked("turns")}
      SELECT conv_id, turn, verdict, reason, sanitized FROM checked""",
    "conversation_history": """
      SELECT conv_id, CAST(floor((place - 1) / 1000) AS BIGINT) AS page, COUNT(*) AS n_turns,
        string_agg(role || ': ' || text, chr(10) ORDER BY place) AS transcript
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST) AS place FROM conversations)
      GROUP BY 1, 2""",
    "ensure_system_turn": f"""
      SELECT conv_id, turn, role, text FROM conversations
      UNION ALL
      SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), 'system', '{SYSTEM_PROMPT}'
      FROM conversations
      WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
    "throttle_audit": f"WITH {HOURLY} SELECT * FROM busy",
    "throttle_stream": f"WITH {HOURLY} SELECT * FROM busy",
    "throttle_late": """
      WITH late AS (
        SELECT event_id, user_id FROM events
        WHERE event_id % 2 = 0 AND ts < (SELECT MAX(ts) FROM events WHERE event_id % 2 = 1) - INTERVAL 10 DAY),
      counted AS (
        SELECT user_id, date_trunc('hour', ts) AS window_start, COUNT(*) AS n
        FROM events WHERE event_id NOT IN (SELECT event_id FROM late) GROUP BY ALL)
      SELECT 'over' AS kind, user_id, window_start, n FROM counted WHERE n > 1
      UNION ALL SELECT 'late', user_id, NULL, COUNT(*) FROM late GROUP BY user_id""",
    "active_users": """
      SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(user_id) AS n, TRUE AS within_bound
      FROM events GROUP BY event_type""",
    "usage_counts": "SELECT user_id, "
    + ", ".join(f"COUNT(*) FILTER (event_type = '{kind}') AS {kind}" for kind in EVENT_TYPES)
    + " FROM events GROUP BY user_id",
    "first_use_sequence": """
      SELECT user_id, string_agg(event_type, ',' ORDER BY first_ts, event_type) AS sequence
      FROM (SELECT user_id, event_type, MIN(ts) AS first_ts FROM events GROUP BY ALL)
      GROUP BY user_id""",
}


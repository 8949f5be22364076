"""Short text documents made from the reports, and overviews of the collection."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockside.functions.metrics import add_sums, line_sums
from dockside.functions.text import fixed, slug, whole
from dockside.operators.reports import (
    CATEGORY_SUMS,
    MARKET_SUMS,
    SEGMENT_SUMS,
    SHIPPING_SUMS,
    category_profile,
    finish_category,
    finish_market,
    finish_segment,
    finish_shipping,
    market_report,
    segment_profile,
    shipping_analysis,
)

KEYS = ("market", "category_name", "shipping_mode", "customer_segment")
CORPUS_SUMS = tuple(dict.fromkeys(MARKET_SUMS + CATEGORY_SUMS + SHIPPING_SUMS + SEGMENT_SUMS))


def _join(*parts) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _market_text(get) -> Column:
    return _join(
        get("market"), " market: ", whole(get("total_orders")), " order lines, ",
        fixed(get("late_pct"), 1), "% of them late. Sales reach $", whole(get("total_sales")),
        " with $", fixed(get("avg_profit"), 2), " profit on an average line. Customers choose from ",
        get("num_categories").cast("string"), " categories and ",
        get("num_ship_modes").cast("string"), " ways of shipping.",
    )


def _category_text(get) -> Column:
    return _join(
        get("category_name"), " category: ", whole(get("orders")), " order lines bring $",
        whole(get("revenue")), " revenue. Margin is ", fixed(get("margin_pct"), 1),
        "%, profit on an average line $", fixed(get("avg_profit"), 2), ", and ",
        fixed(get("late_pct"), 1), "% of lines come late.",
    )


def _shipping_text(get) -> Column:
    return _join(
        get("shipping_mode"), " shipping: chosen for ", whole(get("orders")),
        " order lines. It takes ", fixed(get("avg_actual"), 1), " days where ",
        fixed(get("avg_scheduled"), 1), " are planned, a difference of ",
        fixed(get("avg_delay"), 1), " days; ", fixed(get("late_pct"), 1),
        "% of lines come late and an average line earns $", fixed(get("avg_profit"), 2), ".",
    )


def _segment_text(get) -> Column:
    return _join(
        get("customer_segment"), " customers: ", whole(get("orders")), " order lines worth $",
        whole(get("total_sales")), ". An average line earns $", fixed(get("avg_profit"), 2),
        " and ", fixed(get("late_pct"), 1), "% of lines come late.",
    )


# source -> (key column, id prefix, characters besides the space to replace, text)
_KINDS = {
    "market_report": ("market", "market_", "", _market_text),
    "category_profile": ("category_name", "cat_", "/", _category_text),
    "shipping_analysis": ("shipping_mode", "ship_", "", _shipping_text),
    "segment_profile": ("customer_segment", "seg_", "", _segment_text),
}


def _documents(report: DataFrame, source: str) -> DataFrame:
    key, prefix, also, text = _KINDS[source]
    market = F.col("market") if key == "market" else F.lit(None).cast("string")
    return report.select(
        F.concat(F.lit(prefix), slug(F.col(key), also)).alias("id"),
        text(F.col).alias("text"),
        F.lit(source).alias("source"),
        market.alias("market"),
    )


def market_docs(df: DataFrame) -> DataFrame:
    return _documents(market_report(df), "market_report")


def category_docs(df: DataFrame, n: int = 25) -> DataFrame:
    return _documents(category_profile(df, n), "category_profile")


def shipping_docs(df: DataFrame) -> DataFrame:
    return _documents(shipping_analysis(df), "shipping_analysis")


def segment_docs(df: DataFrame) -> DataFrame:
    return _documents(segment_profile(df), "segment_profile")


def knowledge_corpus(df: DataFrame, n: int = 25) -> DataFrame:
    """All four kinds of documents from one pass over the order lines.

    Lines are added up once per combination of the four keys. Grouping sets over
    that summary give every kind of report, so the order table is scanned and
    shuffled once, not once per kind.
    """
    summary = df.groupBy(*KEYS).agg(*line_sums(*CORPUS_SUMS))
    summary = summary.withColumns(
        {"a_category": F.col("category_name"), "a_mode": F.col("shipping_mode")}
    )
    sets = summary.groupingSets([[key] for key in KEYS], *KEYS).agg(
        *add_sums(*CORPUS_SUMS),
        F.count_distinct("a_category").alias("num_categories"),
        F.count_distinct("a_mode").alias("num_ship_modes"),
    )
    reports = {
        "market_report": (*finish_market(), "num_categories", "num_ship_modes"),
        "category_profile": finish_category(),
        "shipping_analysis": finish_shipping(),
        "segment_profile": finish_segment(),
    }
    kind = F.lit(None).cast("string")
    structs = []
    for source, columns in reports.items():
        key = _KINDS[source][0]
        # A row belongs to the one set whose key it still has; a NULL key is none.
        kind = F.coalesce(F.when(F.col(key).isNotNull(), F.lit(source)), kind)
        structs.append(F.struct(key, *columns).alias(f"r_{source}"))
    rows = sets.select(kind.alias("source"), "orders_n", *structs).where("source IS NOT NULL")

    doc_id = text = rank_key = market = F.lit(None).cast("string")
    for source, (key, prefix, also, sentence) in _KINDS.items():

        def get(name, report=f"r_{source}"):
            return F.col(report).getField(name)

        here = F.col("source") == source
        doc_id = F.when(here, F.concat(F.lit(prefix), slug(get(key), also))).otherwise(doc_id)
        text = F.when(here, sentence(get)).otherwise(text)
        rank_key = F.when(here, get(key)).otherwise(rank_key)
        if key == "market":
            market = F.when(here, get(key)).otherwise(market)
    docs = rows.select(
        doc_id.alias("id"),
        text.alias("text"),
        "source",
        market.alias("market"),
        "orders_n",
        rank_key.alias("rank_key"),
    )
    fields = ("id", "text", "source", "market")
    profiles = docs.where(F.col("source") == "category_profile")
    top = profiles.orderBy(F.desc("orders_n"), F.asc("rank_key")).limit(n)
    rest = docs.where(F.col("source") != "category_profile")
    return rest.select(*fields).unionByName(top.select(*fields))


def corpus_by_source(docs: DataFrame) -> DataFrame:
    """Document count per source; a missing source counts as "unknown"."""
    source = F.coalesce("source", F.lit("unknown")).alias("source")
    return docs.groupBy(source).agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def corpus_samples(docs: DataFrame, length: int = 200) -> DataFrame:
    """The start of the first document, by id, of each source."""
    source = F.coalesce("source", F.lit("unknown")).alias("source")
    first = docs.groupBy(source).agg(
        F.min("id").alias("id"), F.min_by("text", "id").alias("text")
    )
    sample = F.concat(F.substring("text", 1, length), F.lit("..."))
    return first.select("source", "id", sample.alias("sample"))

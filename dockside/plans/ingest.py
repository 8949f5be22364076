"""End-to-end load: CSV, cleaning, order table, documents, vectors."""

from pyspark.sql import SparkSession

from dockside.operators.cleaning import clean_orders
from dockside.operators.knowledge import knowledge_corpus
from dockside.operators.vectors import embed_corpus, fit_vectorizer
from dockside.session import materialize, new_shared_path, remove
from dockside.sources.csv_orders import read_orders_csv, split_orders_csv
from dockside.sources.tables import load_orders, write_knowledge, write_table


def run_ingest(
    spark: SparkSession, source: str, target: str, top_categories: int = 25, keep_bad: bool = False
) -> dict:
    """Build ``orders``, ``knowledge`` and ``vectorizer`` under ``target``.

    Tables are replaced in one step each. With ``keep_bad`` lines that cannot be read go to ``rejected``
    with the reason, instead of stopping the load.

    Documents are made from the cleaned table that was just written, so the CSV
    is parsed once and private columns never reach the documents. The parsed lines that
    ``keep_bad`` holds in between go as soon as both tables are written.
    """
    paths = {name: f"{target}/{name}" for name in ("orders", "knowledge", "vectorizer")}
    held = new_shared_path(spark, "lines")
    try:
        if keep_bad:
            lines, rejected = split_orders_csv(spark, source, held_at=held)
            paths["rejected"] = f"{target}/rejected"
            write_table(rejected, paths["rejected"])
        else:
            lines = read_orders_csv(spark, source)
        write_table(clean_orders(lines), paths["orders"])
    finally:
        remove(spark, held)
    orders = load_orders(spark, paths["orders"], view=None)
    docs = materialize(knowledge_corpus(orders, top_categories))
    vectorizer = fit_vectorizer(docs)
    write_knowledge(embed_corpus(docs, vectorizer), paths["knowledge"])
    vectorizer.write().overwrite().save(paths["vectorizer"])
    return paths

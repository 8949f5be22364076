"""Stored tables: orders and the knowledge collection."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockside.schema import KNOWLEDGE_SCHEMA, require_columns
from dockside.sources.versions import readable_folder, replace_table


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace the table at ``path`` in one step: readers see the old rows or the new ones.

    ``df`` may be read from the table itself. ``partition_by="market"`` lets one-market reports skip the other folders;
    each task writes its own files, so a hot market is still written by many.
    """
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    replace_table(df.sparkSession, path, writer.parquet)


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    """The current version of a table; a folder without versions is read as it is."""
    try:
        return spark.read.parquet(readable_folder(spark, path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{what} not found: {path}") from error
        raise


def load_stored(spark: SparkSession, path: str) -> DataFrame:
    """Any table that :func:`write_table` wrote."""
    return _read(spark, path, "table")


def load_orders(spark: SparkSession, path: str, view: str | None = "orders") -> DataFrame:
    """Stored orders, also registered as a temporary view."""
    df = require_columns(_read(spark, path, "order table"))
    if view:
        df.createOrReplaceTempView(view)
    return df


def write_knowledge(df: DataFrame, path: str) -> None:
    """Replace the knowledge collection in one step; ids must be unique."""
    require_columns(df, [*KNOWLEDGE_SCHEMA.fieldNames(), "embedding"])
    repeated = df.groupBy("id").count().where(F.col("count") > 1).select("id").take(3)
    if repeated:
        raise ValueError(f"repeated document ids: {[row.id for row in repeated]}")
    replace_table(df.sparkSession, path, df.write.parquet)


def load_knowledge(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "knowledge collection")

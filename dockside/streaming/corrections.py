"""Counts per window of a stream whose rows come late.

Each batch adds the counts of its own rows to a table, windows that were written before included,
so a late row corrects its window and nothing waits for a watermark. A window's count is
the sum over the batches; a batch that is written again replaces what it wrote. Rows that are older
than the newest time of all earlier batches by more than is allowed go to a table of their own.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockside.operators.requests import WINDOW, window_bounds

# Seconds that a row may be behind.
ALLOWED = 7 * 86_400

SEEN = "seconds double"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches of a table; an empty frame before the first one."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    try:
        return spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def add_batch(
    batch: DataFrame, number: int, key: str, ts: str, path: str, window: str, allowed: int, name: str = "0"
) -> None:
    """Write the counts, the late rows and the newest time of one batch, each in a folder of the batch."""
    spark = batch.sparkSession
    mark = f"{name}-{number:012d}"
    batch = batch.persist()
    try:
        at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
        earlier = _read(spark, f"{path}/seen", SEEN).where(F.col("batch") != mark)
        newest = earlier.agg(F.max("seconds")).first()[0]
        # Without a time a row is in no window, and it is not late.
        is_late = F.coalesce(at < newest - allowed, F.lit(False)) if newest is not None else F.lit(False)
        timed = batch.where(~is_late).withColumn(ts, F.col(ts).cast("timestamp"))
        counts = timed.groupBy(key, F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"))
        tables = {
            "counts": counts.select(key, *window_bounds(), "n"),
            "late": batch.where(is_late),
            "seen": batch.agg(F.max(at).alias("seconds")),
        }
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{path}/{table}/batch={mark}")
    finally:
        batch.unpersist()


def batch_tables(spark: SparkSession, path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """``key, window_start, window_end, n`` over all batches, and the rows that came too late."""
    kind = f"{schema[key].dataType.simpleString()}"
    counted = _read(spark, f"{path}/counts", f"`{key}` {kind}, window_start timestamp, window_end timestamp, n long")
    counts = counted.groupBy(key, "window_start", "window_end").agg(F.sum("n").alias("n"))
    return counts, _read(spark, f"{path}/late", schema).drop("batch")


def count_to_tables(
    stream: DataFrame,
    key: str,
    ts: str,
    path: str,
    checkpoint: str,
    window: str = WINDOW,
    allowed: int = ALLOWED,
    name: str = "0",
) -> tuple[DataFrame, DataFrame]:
    """Process all data that is available now; the tables of :func:`batch_tables` after it.

    ``name`` tells streams apart that write to one ``path``. NULL keys are a key; rows without time
    are in no window and never late.
    """

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, key, ts, path, window, allowed, name)

    query = (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return batch_tables(stream.sparkSession, path, stream.schema, key)

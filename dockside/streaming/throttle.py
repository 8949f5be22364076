"""Over-limit requests on a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockside.operators.requests import REQUESTS_PER_WINDOW, WINDOW, window_bounds


def throttle_counts(
    stream: DataFrame, key: str, ts: str, window: str = WINDOW, delay: str = "5 minutes"
) -> DataFrame:
    """Requests per client and window: ``key, window_start, window_end, n``.

    For update mode: a window comes out whenever its count has changed, and its state
    is dropped once the watermark has passed its end. Rows later than ``delay`` are
    ignored. Times without a zone are read in the session's zone.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counts = timed.groupBy(key, F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, *window_bounds(), "n")


def throttle_stream(
    stream: DataFrame,
    key: str,
    ts: str,
    limit: int = REQUESTS_PER_WINDOW,
    window: str = WINDOW,
    delay: str = "5 minutes",
) -> DataFrame:
    """Windows in which a client sent more than ``limit`` requests, for append or update mode.

    In append mode a window comes out once, when the watermark has passed its end.
    """
    return _over(throttle_counts(stream, key, ts, window, delay), key, limit)


def over_limit(counts: DataFrame, key: str, limit: int = REQUESTS_PER_WINDOW) -> DataFrame:
    """Over-limit windows in a table of counts that :func:`run_to_table` wrote.

    Counts only grow, so the last one of a window is the largest; a batch that was
    written again after a failure changes nothing.
    """
    last = counts.groupBy(key, "window_start", "window_end").agg(F.max("n").alias("n"))
    return _over(last, key, limit)


def _over(counts: DataFrame, key: str, limit: int) -> DataFrame:
    return counts.where(F.col("n") > limit).select(
        key, "window_start", "window_end", "n", (F.col("n") - limit).alias("over")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all data that is available now in update mode, then stop.

    Every batch adds the windows it changed to the Parquet table at ``path``, open
    ones included, so nothing waits for a watermark that a bounded run never reaches.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(path)

    query = (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

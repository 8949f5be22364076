"""Approximate distinct counts from sketches that are kept per day and key.

A day's rows are read once, into one sketch of some kilobytes per key. Sketches of any days
are merged on reading, so new days need no look at old ones, and a count over a
year reads a year's sketches, not its rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Buckets of a sketch, as a power of two.
LG_BUCKETS = 12


def error_bound(lg_buckets: int = LG_BUCKETS) -> float:
    """Three standard errors of a sketch, as a share of the count: 0.0488 for 4,096 buckets."""
    return 3 * 1.04 / 2 ** (lg_buckets / 2)


def add_days(
    df: DataFrame, path: str, day: Column, keys: list[str], value: str, lg_buckets: int = LG_BUCKETS
) -> None:
    """Store sketches of the values of every day and key in ``df``; days that were there are replaced.

    ``df`` has whole days. NULL values are not counted; a NULL key is a key; rows without day are
    kept as a day of their own. Rows are added up before they are shuffled.
    """
    sketched = df.groupBy(day.cast("date").alias("day"), *keys).agg(
        F.hll_sketch_agg(value, F.lit(lg_buckets)).alias("sketch"), F.count(value).alias("n")
    )
    # Few rows a day: a file for each.
    writer = sketched.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def approx_distinct(spark: SparkSession, path: str, keys: list[str], days: tuple | None = None) -> DataFrame:
    """``keys``, ``estimate`` and ``n`` (values counted) over stored days; ``days`` is a first and a last one.

    Off by more than :func:`error_bound` in fewer than one of a hundred cases. Folders of other days
    are not read.
    """
    held = spark.read.parquet(path)
    if days:
        held = held.where(F.col("day").between(*[F.lit(d).cast("date") for d in days]))
    return held.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.sum("n").alias("n")
    )

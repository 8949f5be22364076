"""Range join: points and the intervals that hold them, without comparing all with all.

An interval is stored at the level whose buckets are at least as long as it is, so it
touches at most two of them, however long it is. A point looks into one bucket of each level
that occurs, and there are few: levels double. Points and intervals that share a bucket
(and a key) are joined by equality, and the exact bounds are checked on those pairs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Buckets double from level to level, so that no more levels than these can occur.
MOST_LEVELS = 64


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    start: str,
    end: str,
    width: int,
    key: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """Rows of ``points`` with the rows of ``intervals`` where ``start <= point < end`` (and keys are equal).

    Points and bounds are whole numbers (times: in seconds, say); ``width`` is the shortest bucket,
    best about the common length of an interval. The result has a struct ``p`` of the point's row and
    ``i`` of the interval's. NULLs and empty intervals match nothing; ``how="left"`` keeps points
    without interval, with a NULL ``i``. Repeated rows give repeated pairs.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if width < 1:
        raise ValueError("width must be at least 1")
    length = F.col(end) - F.col(start)
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / width))).cast("int")
    kept = intervals.where(length > 0)
    placed = kept.select(
        F.struct(*[F.col(f"`{c}`") for c in intervals.columns]).alias("i"),
        level.alias("level"),
        *([F.col(key).alias("key")] if key else []),
    )
    # At most MOST_LEVELS rows.
    levels = sorted(r.level for r in placed.select("level").distinct().collect())
    first, last = _bucket(F.col(f"i.{start}"), width), _bucket(F.col(f"i.{end}") - 1, width)
    placed = placed.withColumn("bucket", F.explode(F.sequence(first, last)))
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    looked = points.select(
        row.alias("p"),
        F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level"),
        *([F.col(key).alias("key")] if key else []),
    ).withColumn("bucket", _bucket(F.col(f"p.{point}"), width))
    on = ["level", "bucket", *(["key"] if key else [])]
    inside = (F.col(f"p.{point}") >= F.col(f"i.{start}")) & (F.col(f"p.{point}") < F.col(f"i.{end}"))
    pairs = looked.join(placed, on).where(inside).select("p", "i")
    if how == "inner":
        return pairs
    lone = points.select(row.alias("p"))
    found = pairs.select(F.col("p").alias("q")).distinct()
    missing = lone.join(found, F.col("p").eqNullSafe(F.col("q")), "left_anti")
    return pairs.unionByName(missing.withColumn("i", F.lit(None).cast(pairs.schema["i"].dataType)))


def _bucket(place: Column, width: int) -> Column:
    """Bucket of a place at the row's level."""
    return F.floor(place / (F.lit(width) * F.pow(F.lit(2), F.col("level")))).cast("long")

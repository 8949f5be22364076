"""As-of join: to each row the last earlier row of the other side with the same key.

Both sides are put together and cut by key and stretch of time, so a key that holds much of
a table is the work of many tasks. Within a stretch the last earlier row is carried along by a
window; what a stretch begins with comes from a small second pass over one row per key and
stretch.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ts: str,
    columns: list[str],
    tie: str,
    stretch: int = 86_400,
    or_equal: bool = False,
    prefix: str = "prev_",
) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` before it (``or_equal``: not after it).

    Both sides have ``key`` and ``ts``; of right rows at one time the one with the greatest ``tie`` counts. New
    columns bear ``prefix`` and are NULL where there is no earlier row, and for left rows
    without key or time. Right rows without key or time are never found; repeated left rows
    stay. ``stretch``, in seconds for times and in units for numbers, should hold what one task can
    sort of the largest key.
    """
    names = [f"{prefix}{c}" for c in columns]
    clash = set(names) & set(left.columns)
    if clash:
        raise ValueError(f"left has these columns already: {', '.join(sorted(clash))}")
    found = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), *[F.col(c).alias(n) for c, n in zip(columns, names)])
    usable = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    can_match = F.col(key).isNotNull() & F.col(ts).isNotNull()
    at = _stretch(left, ts, stretch).alias("_at")
    mine = left.where(can_match).select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), at, row.alias("_row"))
    mine = mine.withColumn("_found", F.lit(None).cast(usable.select(found.alias("f")).schema["f"].dataType))
    at = _stretch(right, ts, stretch).alias("_at")
    other = usable.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), at, found.alias("_found"))
    both = mine.withColumn("_side", F.lit(1 if or_equal else 0)).unionByName(
        other.withColumn("_side", F.lit(0 if or_equal else 1)), allowMissingColumns=True
    )
    # Of left rows and right rows at one time, those that may not see the others come first.
    within = (
        Window.partitionBy("_key", "_at")
        .orderBy("_ts", "_side", F.col("_found.tie").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = both.withColumn("_last", F.last("_found", ignorenulls=True).over(within)).where("_row IS NOT NULL")
    # One row per key and stretch of either side.
    ends = other.groupBy("_key", "_at").agg(F.max("_found").alias("_end"))
    stops = mine.select("_key", "_at").distinct().join(ends, ["_key", "_at"], "full")
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    begins = stops.select("_key", "_at", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    joined = seen.join(begins.where("_begin IS NOT NULL"), ["_key", "_at"], "left")
    best = F.coalesce("_last", "_begin")
    matched = joined.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in left.columns], *[best[n].alias(n) for n in names]
    )
    # Rows that cannot match take no part in the sorting.
    lone = left.where(~can_match)
    kinds = {n: matched.schema[n].dataType for n in names}
    return matched.unionByName(lone.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()}))


def _stretch(df: DataFrame, ts: str, width: int) -> Column:
    place = F.col(ts)
    if not isinstance(df.schema[ts].dataType, T.NumericType):
        place = F.unix_seconds(place.cast("timestamp"))
    return F.floor(place / width)

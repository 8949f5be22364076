"""Running totals, ranks and percentiles over whole tables and hot keys, without one task for all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockside.session import store


def running_total(
    df: DataFrame, key: str, order: list[str], value: str, stretch: Column, name: str = "running"
) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row of its ``key``, in two levels.

    ``stretch`` cuts a key's rows into parts that one task can sort; it must grow with ``order``. Totals
    per key and stretch give what each stretch begins with, and a window adds up inside. Only these
    totals, one row per key and stretch, meet in one task. A NULL key is a key; NULL
    values add nothing, a NULL ``stretch`` comes first. Of rows that are equal in ``order`` any is first.
    """
    parted = df.withColumn("_stretch", stretch)
    totals = parted.groupBy(F.col(key).alias("_key"), F.col("_stretch").alias("_at")).agg(
        F.coalesce(F.sum(value), F.lit(0)).alias("_total")
    )
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("_key", "_at", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    added = parted.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_stretch").eqNullSafe(F.col("_at"))
    return added.join(begins, same).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_begin") + F.col("_inside")).alias(name)
    )


def global_rank(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of every row in the order of the whole table, from 1, without gaps.

    Rows are dealt to ranges of the order, sorted there and stored; the ranges' sizes, one small row for
    each, give the place a range begins with. Rows equal in ``order`` come in any order; many of them
    fall into one range, so a last column that tells rows apart keeps ranges even.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # A row's number: its range, shifted by 33 bits, and its place there.
    placed = store(ranged.withColumn("_number", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_number", 33).cast("int")
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    begins, total = {}, 0
    for row in sorted(sizes):
        begins[row.part], total = total, total + row.n
    # A row per range.
    told = spark.createDataFrame(list(begins.items()) or [(0, 0)], "_part int, _begin long")
    inside = F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(told), part == F.col("_part"))
        .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_begin") + inside + 1).alias(name))
    )


def exact_percentiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """``share, value``: exact percentiles of a column, between two values in proportion.

    NULL and NaN values are left out; without values the percentiles are NULL.
    """
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must be from 0 to 1")
    known = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    # The number keeps equal values apart, so a hot value is dealt to many ranges.
    ranked = global_rank(known, [F.col("v"), F.monotonically_increasing_id()])
    n = ranked.count()
    asked = [(s, int(s * (n - 1)) + 1, s * (n - 1) - int(s * (n - 1))) for s in dict.fromkeys(shares)]
    wanted = sorted({p for _, place, _ in asked for p in (place, place + 1)})
    # At most two rows per share.
    at = {r.place: r.v for r in ranked.where(F.col("place").isin(wanted)).collect()}
    rows = []
    for share, place, rest in asked:
        low = at.get(place)
        high = at.get(place + 1, low)
        rows.append((share, None if low is None else low + (high - low) * rest))
    return df.sparkSession.createDataFrame(rows, "share double, value double")

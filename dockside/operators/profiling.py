"""Data-quality profiles, each in one pass over the table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockside.schema import FREQUENCY_COLUMNS, PII_COLUMNS, USEFULNESS_COLUMNS


def _per_column(df: DataFrame, measures: dict[str, Column], name, value) -> DataFrame:
    """Turn one aggregate per column into one row per column."""
    wide = df.agg(*[measure.alias(column) for column, measure in measures.items()])
    return wide.unpivot([], list(measures), name, value)


def schema_fields(df: DataFrame) -> list[tuple[int, str, str]]:
    """Position, name and type of every column; metadata only, no job."""
    return [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]


def describe_schema(df: DataFrame) -> DataFrame:
    """Position, name, type and non-NULL count of every column."""
    counts = non_null_counts(df, df.columns)
    fields = F.create_map(
        *[
            item
            for place, name, kind in schema_fields(df)
            for item in (F.lit(name), F.struct(F.lit(place), F.lit(kind)))
        ]
    )
    info = F.element_at(fields, F.col("column_name"))
    return counts.select(
        info.getField("col1").alias("position"),
        "column_name",
        info.getField("col2").alias("column_type"),
        "non_nulls",
    )


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count of each column that has any."""
    rows = F.count(F.lit(1))
    measures = {name: rows - F.count(F.col(name)) for name in df.columns}
    return _per_column(df, measures, "column_name", "nulls").where("nulls > 0")


def non_null_counts(df: DataFrame, columns=USEFULNESS_COLUMNS) -> DataFrame:
    measures = {name: F.count(F.col(name)) for name in columns}
    return _per_column(df, measures, "column_name", "non_nulls")


def masked(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 1), F.lit("***"))


def pii_sample(df: DataFrame, columns=PII_COLUMNS) -> DataFrame:
    """Whether each private column holds data: its least value, masked, or "empty"."""
    measures = {
        name: F.coalesce(masked(F.min(F.col(name).cast("string"))), F.lit("empty"))
        for name in columns
    }
    return _per_column(df, measures, "column_name", "sample")


def column_samples(df: DataFrame) -> DataFrame:
    """Type and least non-NULL value, as text, of every column."""
    measures = {
        name: F.coalesce(F.min(F.col(name)).cast("string"), F.lit("N/A")) for name in df.columns
    }
    samples = _per_column(df, measures, "column_name", "sample")
    types = F.create_map(
        *[
            F.lit(text)
            for field in df.schema.fields
            for text in (field.name, field.dataType.simpleString())
        ]
    )
    return samples.select(
        "column_name",
        F.element_at(types, F.col("column_name")).alias("column_type"),
        "sample",
    )


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Total, distinct and surplus rows, NULLs comparing equal.

    Only a hash of each row is shuffled first. A row whose hash is alone has no
    copy; the full rows are grouped exactly for the hashes that occur again, so
    a collision cannot change the result. Copies of a hot row collapse in the
    map-side half of each aggregate.
    """
    columns = list(df.columns)
    hashed = df.withColumn("row_hash", F.xxhash64(*columns))
    per_hash = hashed.groupBy("row_hash").agg(F.count(F.lit(1)).alias("n"))
    alone = per_hash.where("n = 1").agg(F.count(F.lit(1)).alias("total"))
    repeated = hashed.join(per_hash.where("n > 1").select("row_hash"), "row_hash", "left_semi")
    groups = repeated.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    parts = alone.select("total", F.col("total").alias("distinct_rows")).unionByName(
        groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.count(F.lit(1)).alias("distinct_rows"),
        )
    )
    sums = parts.agg(F.sum("total").alias("total"), F.sum("distinct_rows").alias("distinct_rows"))
    return sums.select(
        F.col("total").alias("total_rows"),
        "distinct_rows",
        (F.col("total") - F.col("distinct_rows")).alias("duplicate_rows"),
    )


def value_counts(df: DataFrame, column: str, dropna=False, order=False) -> DataFrame:
    """Rows per value of ``column``, by default with a row for NULL."""
    if dropna:
        df = df.where(F.col(column).isNotNull())
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last(column)) if order else counts


def category_frequencies(df: DataFrame, columns=FREQUENCY_COLUMNS) -> DataFrame:
    """Value frequencies of several columns at once, NULLs left out."""
    long = df.select(*columns).unpivot([], list(columns), "column_name", "value")
    counts = long.where("value IS NOT NULL").groupBy("column_name", "value")
    return counts.agg(F.count(F.lit(1)).alias("n")).orderBy("column_name", F.desc("n"), "value")


def top_values(df: DataFrame, column: str, n: int = 10, dropna: bool = True) -> DataFrame:
    """The ``n`` most frequent values; equal counts go by value, NULL last if it counts."""
    return value_counts(df, column, dropna=dropna, order=True).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct()

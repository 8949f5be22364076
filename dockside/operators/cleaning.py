"""Cleaning of the order table: private and sparse columns, missing zip codes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockside.operators.profiling import null_profile
from dockside.schema import PII_COLUMNS, SPARSE_COLUMNS


def drop_pii(df: DataFrame, columns=PII_COLUMNS) -> DataFrame:
    """Drop private columns; names that are absent are skipped."""
    return df.drop(*columns)


def drop_sparse(df: DataFrame, columns=SPARSE_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def fill_zip(df: DataFrame) -> DataFrame:
    """Missing customer zip codes become 0."""
    return df.fillna({"customer_zipcode": 0})


def clean_orders(df: DataFrame) -> DataFrame:
    return fill_zip(drop_sparse(drop_pii(df)))


def clean_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and columns on both sides and whether all rows stayed."""

    def counted(df, is_after):
        return df.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(is_after).alias("is_after"))

    both = counted(before, False).unionByName(counted(after, True))
    widths = len(before.columns), len(after.columns)
    rows = both.agg(
        F.max(F.when(~F.col("is_after"), F.col("n"))).alias("rows_before"),
        F.max(F.when(F.col("is_after"), F.col("n"))).alias("rows_after"),
    )
    return rows.select(
        "rows_before",
        F.lit(widths[0]).alias("columns_before"),
        "rows_after",
        F.lit(widths[1]).alias("columns_after"),
        F.lit(widths[0] - widths[1]).alias("columns_removed"),
        (F.col("rows_before") == F.col("rows_after")).alias("rows_unchanged"),
    )


def remaining_nulls(cleaned: DataFrame) -> DataFrame:
    """Columns that still hold NULLs after cleaning."""
    return null_profile(cleaned)

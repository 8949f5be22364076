"""Order lines from a header CSV, and the rule for column names."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockside.schema import DATE_COLUMNS, ORDER_TYPES
from dockside.session import store, store_at

# Texts read as NULL, besides the empty field.
NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def normalize_name(name: str) -> str:
    """Strip, lower, blanks to underscores, then drop every other non-word sign."""
    return re.sub(r"[^\w]", "", name.strip().lower().replace(" ", "_"))


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename all columns by :func:`normalize_name`; one projection, no job."""
    names = [normalize_name(name) for name in df.columns]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"columns share a normalised name: {', '.join(repeated)}")
    return df.toDF(*names)


def _typed(name: str, types: dict, date_pattern: str | None) -> Column:
    raw = F.when(~F.col(name).isin(*NULL_TOKENS), F.col(name))
    if name in DATE_COLUMNS and date_pattern:
        return F.to_timestamp_ntz(raw, F.lit(date_pattern)).alias(name)
    return raw.cast(types.get(name, "string")).alias(name)


def read_orders_csv(
    spark: SparkSession,
    path: str,
    types: dict | None = None,
    encoding: str = "ISO-8859-1",
    date_pattern: str | None = "M/d/yyyy H:mm",
    mode: str = "FAILFAST",
    multi_line: bool = False,
) -> DataFrame:
    """Order lines with normalised names and known types.

    The file is read once: names come from the header, types from ``types`` by
    normalised name, so there is no inference pass over the data. A value that
    does not fit its type, or a file with another header, stops the read. ``multi_line`` allows line breaks in
    quoted fields, but such files cannot be split between tasks.
    """
    raw = _raw_lines(spark, path, encoding, mode, multi_line)
    raw = normalize_columns(raw)
    known = ORDER_TYPES if types is None else types
    return raw.select(*[_typed(name, known, date_pattern) for name in raw.columns])


def _raw_lines(
    spark: SparkSession, path: str, encoding: str, mode: str, multi_line: bool, corrupt: str | None = None
) -> DataFrame:
    """All columns as text, by the names of the header; ``corrupt`` names a column for lines that do not fit."""
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("mode", mode)
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    try:
        # The header of one file is held against that of every other one: files whose
        # columns stand in another order stop the read instead of being mixed up.
        schema = reader.csv(path).schema
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"order file not found: {path}") from error
        raise
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.option("enforceSchema", False).schema(schema).csv(path)


# Column of a line that has too few or too many fields.
CORRUPT = "_corrupt_line"


def _tried(name: str, kind, date_pattern: str | None) -> Column:
    """A text as its type, NULL where it does not fit."""
    if name in DATE_COLUMNS and date_pattern:
        # Read in UTC and put on a clock without zone, whatever the session's zone is.
        at = F.try_to_timestamp(F.concat(F.col(name), F.lit(" +00:00")), F.lit(f"{date_pattern} xxx"))
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return start + F.unix_seconds(at) * F.expr("INTERVAL '1' SECOND")
    return F.col(name).try_cast(kind)


def split_orders_csv(
    spark: SparkSession,
    path: str,
    types: dict | None = None,
    encoding: str = "ISO-8859-1",
    date_pattern: str | None = "M/d/yyyy H:mm",
    multi_line: bool = False,
    held_at: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Order lines that can be read, and the others with the reason: together all lines.

    The good ones are as :func:`read_orders_csv` gives them. A bad one has ``reason`` (``malformed
    line`` for too few or too many fields, else the first column whose value does not fit its type),
    ``file`` and ``split`` (where its part of the file begins) and ``record``, the line or its
    fields as JSON. The files are parsed once and stored in between; a file with another header
    still stops the read. What is stored goes with the application, or stands at ``held_at`` for the
    caller to remove once both frames are used.
    """
    raw = _raw_lines(spark, path, encoding, "PERMISSIVE", multi_line, CORRUPT)
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    names = [normalize_name(c) for c in raw.columns[:-1]]
    raw = normalize_columns(raw.select("*", *place))
    known = ORDER_TYPES if types is None else types
    kinds = {name: known.get(name, "string") for name in names}
    # Texts and faults of all columns go through arrays: an expression for each column makes
    # a method so long that the JVM never compiles it. No header has names with a "#".
    place = (CORRUPT, "_file", "_split")
    cleared = F.transform(F.array(*names), lambda text: F.when(~text.isin(*NULL_TOKENS), text))
    texts = raw.select(*place, cleared.alias("#texts")).select(
        *place, *[F.col("#texts")[i].alias(name) for i, name in enumerate(names)]
    )
    # A text always fits a text.
    typed = {
        name: f"#{name}" for name, kind in kinds.items()
        if kind not in ("string", T.StringType()) or (name in DATE_COLUMNS and date_pattern)
    }
    tried = texts.select(
        "*", *[_tried(name, kinds[name], date_pattern).alias(value) for name, value in typed.items()]
    )
    faults = [
        F.when(F.col(name).isNotNull() & F.col(value).isNull(), f"{name} does not fit")
        for name, value in typed.items()
    ]
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed line")
    if faults:
        reason = F.coalesce(reason, F.get(F.array_compact(F.array(*faults)), F.lit(0)))
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*names)))
    judged = tried.select(
        *[F.col(typed.get(name, name)).alias(name) for name in names],
        F.struct(
            reason.alias("reason"), F.col("_file").alias("file"), F.col("_split").alias("split"),
            F.when(reason.isNotNull(), record).alias("record"),
        ).alias("_fault"),
    )
    held = store_at(judged, held_at) if held_at else store(judged, "lines")
    good = held.where("_fault.reason IS NULL").select(*names)
    return good, held.where("_fault.reason IS NOT NULL").select("_fault.*")

"""Small helpers that the operators of this package share."""

import ctypes
import gc
import sys
import types

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockside.session import store

__all__ = [
    "LOWER_BYTES", "WORD_BYTES", "give_back", "in_files", "numbered", "partitions_for", "record_batch",
    "row_numbers", "store", "text_bytes", "tidy", "words_of", "worker_memo",
]

# Lower-cased letters and digits of ASCII, and every byte of other characters,
# stay; all else becomes a blank. After it, bytes.split() gives the words.
WORD_BYTES = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)

# Only A-Z change.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; NULL counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(bytearray()))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of letters, digits and non-ASCII characters, A-Z lowered."""
    return text.translate(WORD_BYTES).split()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a text ``name`` that tells its rows apart and is the same at every reading.

    Of a stored Parquet table it is file and row; any other frame is stored first.
    """
    try:
        row = F.concat_ws(":", F.md5(F.col("_metadata.file_path").cast("binary")), "_metadata.row_index")
        found = df.withColumn(name, row)
        found.schema  # fails where the frame is no file
        return found
    except AnalysisException:
        row = F.monotonically_increasing_id().cast("string")
        return store(df.withColumn(name, row), "numbered")


def row_numbers(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a struct ``name`` (``file``, ``number``) that tells its rows apart at every reading.

    Of a stored Parquet table it is a hash of the file's path, and the row in the file;
    any other frame is stored first. Two files of one hash stop the job.
    """
    df = in_files(df)
    path = F.col("_metadata.file_path")
    row = F.struct(F.xxhash64(path).alias("file"), F.col("_metadata.row_index").alias("number"))
    files = df.inputFiles()
    if len({xxhash.xxh64_intdigest(f.encode(), 42) for f in files}) < len(files):
        raise ValueError("two files have one hash; store the table under another path")
    return df.withColumn(name, row)


def in_files(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a stored table whose rows know their file, else a stored copy."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema  # fails where the frame is no file
    except AnalysisException:
        return store(df, "numbered")
    return df


def partitions_for(df: DataFrame, rows: int, per_task: int) -> int:
    """Shuffle partitions, more of them where a task would get over ``per_task`` rows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // per_task))


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def worker_memo(name: str) -> dict:
    """A dict of the Python worker for values that are costly to make.

    A worker serves many tasks, of many operators; it keeps one such dict at a time
    and gives memory back when another one is asked for.
    """
    held = sys.modules.setdefault("_dockside_worker", types.ModuleType("_dockside_worker")).__dict__
    memos = held.setdefault("memos", {})
    if name not in memos:
        memos.clear()
        give_back()
        memos[name] = {}
    return memos[name]


def give_back() -> None:
    """Return memory that this Python process no longer needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(step):
    """A step over batches that gives memory back when it ends; workers live on after it."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return run

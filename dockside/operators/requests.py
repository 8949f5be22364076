"""Checks and summaries of request and conversation tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockside.functions.text import strip_blanks
from dockside.operators.ordered import global_rank

# Limits of a request.
MAX_CHARS = 1500
REQUESTS_PER_WINDOW = 10
WINDOW = "1 minute"

# Reasons given with a refused request.
EMPTY_MESSAGE = "Please type a message."
LONG_MESSAGE = "Query too long. Max {} characters."


def validate_text(df: DataFrame, column: str = "text", max_len: int = MAX_CHARS) -> DataFrame:
    """``df`` with ``verdict``, ``reason`` and the trimmed ``sanitized`` text.

    The length counts before trimming. A refused text has an empty ``sanitized``.
    """
    text = F.col(column)
    trimmed = strip_blanks(text)
    verdict = (
        F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, "empty")
        .when(F.length(text) > max_len, "too_long")
        .otherwise("ok")
    )
    reason = (
        F.when(F.col("verdict") == "empty", EMPTY_MESSAGE)
        .when(F.col("verdict") == "too_long", LONG_MESSAGE.format(max_len))
        .otherwise("")
    )
    sanitized = F.when(F.col("verdict") == "ok", trimmed).otherwise("")
    return df.withColumn("verdict", verdict).withColumns({"reason": reason, "sanitized": sanitized})


def verdict_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def conversation_history(df: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Rows of each conversation in order, as lists of at most ``page_rows`` messages: ``conv_id, page, turns``.

    Rows go by turn, NULL last, then by role and hash of the text. A conversation shorter than a
    page is one row; a longer one goes on in the next pages. Places are counted over the whole
    sorted table, so a conversation that holds most of it, or one turn number that repeats
    without end, is sorted and assembled by many tasks, and no list is longer than a page.
    """
    rows = df.select("conv_id", "turn", "role", "text")
    order = [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.xxhash64("text").asc()]
    ranked = global_rank(rows, [*order, F.monotonically_increasing_id().asc()], "_place")
    first = ranked.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_place").alias("_first"))
    placed = ranked.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")))
    page = F.floor((F.col("_place") - F.col("_first")) / page_rows).alias("page")
    held = F.array_sort(F.collect_list(F.struct("_place", "turn", "role", "text")))
    turns = F.transform(held, lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
    return placed.groupBy("conv_id", page).agg(turns.alias("turns"))


def ensure_system_turn(df: DataFrame, prompt: str) -> DataFrame:
    """All turns, plus a system turn numbered -1 where a conversation has none."""
    is_system = F.coalesce(F.col("role") == "system", F.lit(False))
    has_one = df.groupBy("conv_id").agg(F.bool_or(is_system).alias("has_one"))
    added = has_one.where(~F.col("has_one")).select(
        "conv_id",
        F.lit(-1).cast(df.schema["turn"].dataType).alias("turn"),
        F.lit("system").alias("role"),
        F.lit(prompt).alias("text"),
    )
    return df.select("conv_id", "turn", "role", "text").unionByName(added)


def window_bounds(window: Column | str = "window") -> list[Column]:
    window = F.col(window) if isinstance(window, str) else window
    return [window["start"].alias("window_start"), window["end"].alias("window_end")]


def throttle_audit(
    df: DataFrame,
    key: str,
    ts: str,
    limit: int = REQUESTS_PER_WINDOW,
    window: str = WINDOW,
) -> DataFrame:
    """Windows in which a client sent more than ``limit`` requests."""
    counts = df.groupBy(key, F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > limit).select(
        key, *window_bounds(), "n", (F.col("n") - limit).alias("over")
    )


def usage_counts(df: DataFrame, key: str, kind: str, kinds) -> DataFrame:
    """Uses per key, one column for each of the given kinds; 0 where unused."""
    return df.groupBy(key).agg(*[F.count_if(F.col(kind) == name).alias(name) for name in kinds])


def first_use_sequence(df: DataFrame, key: str, kind: str, ts: str, kinds) -> DataFrame:
    """The given kinds in the order of their first use per key, without repeats.

    First uses are found as one minimum per kind, so no list of events is built.
    Equal times go by name.
    """
    firsts = df.groupBy(key).agg(
        *[F.min(F.when(F.col(kind) == name, F.col(ts))).alias(f"first_{place}") for place, name in enumerate(kinds)]
    )
    uses = F.array(
        *[F.struct(F.col(f"first_{place}").alias("ts"), F.lit(name).alias("kind")) for place, name in enumerate(kinds)]
    )
    used = F.array_sort(F.filter(uses, lambda use: use["ts"].isNotNull()))
    return firsts.select(key, F.transform(used, lambda use: use["kind"]).alias("sequence"))

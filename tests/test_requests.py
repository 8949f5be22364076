import datetime as dt
import time

import pytest

from pyspark.sql import functions as F

from helpers import as_rows, plan_of
from dockside.functions.text import strip_marks
from dockside.operators import requests
from dockside.streaming.throttle import over_limit, run_to_table, throttle_counts, throttle_stream
from dockside.streaming.corrections import add_batch, batch_tables, count_to_tables


def verdicts(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [tuple(row)[2:] for row in requests.validate_text(df).orderBy("id").collect()]


def test_text_check(spark):
    assert [v[0] for v in verdicts(spark, "", "  \t　 ", None, "ok")] == [
        "empty",
        "empty",
        "empty",
        "ok",
    ]
    full, long, padded = "x" * 1500, "x" * 1501, "x" * 1500 + " "
    assert [v[0] for v in verdicts(spark, full, long, padded)] == ["ok", "too_long", "too_long"]
    assert verdicts(spark, "\n hi  ")[0] == ("ok", "", "hi")
    assert verdicts(spark, long)[0][1:] == ("Query too long. Max 1500 characters.", "")


def test_blanks_are_those_of_python(spark):
    from dockside.functions.text import BLANKS

    assert set(BLANKS) == {chr(c) for c in range(0x11000) if chr(c).isspace()}


def test_marks(spark):
    df = spark.createDataFrame([("📦 🚚 where is it? ",), ("plain",)], "text string")
    assert [row[0] for row in df.select(strip_marks(df.text)).collect()] == ["where is it?", "plain"]


TURNS = [
    (1, 1, "assistant", "b"),
    (1, 0, "user", "a"),
    (2, 0, "system", "s"),
    (2, 1, "user", "c"),
    (3, 0, "user", "d"),
    (3, 1, "system", "late"),
]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")


def test_history_order_and_pages(spark, turns):
    history = {row.conv_id: row for row in requests.conversation_history(turns).collect()}
    assert [t.text for t in history[1].turns] == ["a", "b"] and history[1].page == 0
    one = spark.range(2500).selectExpr(
        "7 AS conv_id", "id AS turn", "'user' AS role", "string(id) AS text"
    )
    pages = requests.conversation_history(one, page_rows=1000).orderBy("page").collect()
    assert [len(row.turns) for row in pages] == [1000, 1000, 500]
    assert [t.turn for row in pages for t in row.turns] == list(range(2500))


def test_history_of_one_turn_without_end(spark):
    """50,000 rows of one turn, and as many without turn: no list is longer than a page."""
    rows = spark.range(100_000).selectExpr(
        "3L AS conv_id", "IF(id < 50000, 5L, NULL) AS turn", "'user' AS role", "IF(id % 2 = 0, 'same', string(id)) AS text"
    )
    few = spark.createDataFrame([(None, 2, "user", "b"), (None, 1, "user", None), (4, None, None, "c")], "conv_id long, turn long, role string, text string")
    history = requests.conversation_history(rows.unionByName(few))
    sizes = history.selectExpr("conv_id", "page", "size(turns) AS n", "turns")
    assert sizes.where("conv_id = 3").agg(F.max("n"), F.sum("n"), F.count("n")).first()[:] == (1000, 100_000, 100)
    assert sizes.where("conv_id = 3 AND page < 50 AND exists(turns, t -> t.turn IS NULL)").count() == 0
    (none,) = sizes.where("conv_id IS NULL").collect()
    assert [t.text for t in none.turns] == [None, "b"]
    assert requests.conversation_history(few.limit(0)).collect() == []


def test_system_turn(turns):
    rows = as_rows(requests.ensure_system_turn(turns, "hello"))
    assert len(rows) == len(TURNS) + 1
    assert [row for row in rows if row[1] == -1] == [(1, -1, "system", "hello")]


def moments(*seconds):
    start = dt.datetime(2024, 1, 1)
    return [(1, start + dt.timedelta(seconds=s)) for s in seconds]


def test_throttle(spark):
    schema = "client long, ts timestamp_ntz"
    ten = spark.createDataFrame(moments(*range(0, 60, 6)), schema)
    eleven = spark.createDataFrame(moments(*range(0, 55, 5)), schema)
    border = spark.createDataFrame(moments(*range(35, 85, 5)), schema)
    assert requests.throttle_audit(ten, "client", "ts").count() == 0
    assert requests.throttle_audit(border, "client", "ts").count() == 0
    row = requests.throttle_audit(eleven, "client", "ts").first()
    assert (row.n, row.over, row.window_start) == (11, 1, dt.datetime(2024, 1, 1))


def test_throttle_stream_over_several_files(spark, tmp_path):
    schema = "client long, ts timestamp_ntz"
    source = str(tmp_path / "in")
    first = moments(*range(0, 60, 5))
    second = moments(*range(60, 80, 2), 1200, 1201)
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    counts = run_to_table(throttle_counts(stream, "client", "ts"), out, checkpoint)
    got = as_rows(over_limit(counts, "client").selectExpr("client", "n", "over"))
    batch = requests.throttle_audit(spark.read.parquet(source), "client", "ts")
    # Windows still open at the end are there, too; late rows within the delay count.
    assert sorted(got) == sorted(as_rows(batch.selectExpr("client", "n", "over")))
    # A second run starts from the checkpoint and repeats nothing.
    rows = counts.count()
    assert run_to_table(throttle_counts(stream, "client", "ts"), out, checkpoint).count() == rows


def test_late_rows_correct_windows_or_are_kept_apart(spark, tmp_path):
    """Two files out of order: windows already written are corrected, what is too late is named."""
    source, schema = str(tmp_path / "in"), "client long, ts timestamp_ntz, name string"
    day = dt.timedelta(days=1)
    start = dt.datetime(2024, 1, 1)
    first = [(1, start + 20 * day + dt.timedelta(seconds=s), f"a{s}") for s in range(8)]
    second = [(1, start + 20 * day + dt.timedelta(seconds=s), f"b{s}") for s in range(8, 14)]
    second += [(1, start + 12 * day + dt.timedelta(seconds=s), f"c{s}") for s in range(11)]
    second += [(1, start + dt.timedelta(seconds=s), f"d{s}") for s in range(11)] + [(2, None, "none")]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):  # a run without new files changes nothing
        counts, late = count_to_tables(stream, "client", "ts", path, checkpoint, allowed=10 * 86_400)
        assert sorted(r.name for r in late.collect()) == sorted(f"d{s}" for s in range(11))
        usable = spark.read.parquet(source).where("name NOT LIKE 'd%'")
        want = as_rows(requests.throttle_audit(usable, "client", "ts"))
        got = as_rows(over_limit(counts, "client"))
        assert len(want) == 2 and sorted(r[1:] for r in got) == sorted(
            (a.replace(tzinfo=None), b.replace(tzinfo=None), n, over) for _, a, b, n, over in want
        )


def test_a_batch_written_again_counts_once(spark, tmp_path):
    rows = spark.createDataFrame(moments(*range(12)), "client long, ts timestamp_ntz")
    path = str(tmp_path / "t")
    for _ in range(2):
        add_batch(rows, 0, "client", "ts", path, "1 minute", 86_400)
    assert batch_tables(spark, path, rows.schema, "client")[0].first().n == 12


def test_throttle_stream_in_append_mode(spark, tmp_path):
    schema = "client long, ts timestamp_ntz"
    source = str(tmp_path / "in")
    rows = moments(*range(0, 60, 5), 1200, *range(2400, 2420))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        throttle_stream(stream, "client", "ts")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert [row.n for row in spark.read.parquet(str(tmp_path / "out")).collect()] == [12]


def test_usage_and_sequence(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, "b", 3), (1, "a", 2), (1, "b", 1), (1, None, 0), (2, "a", 5), (2, "c", 5)]
    df = spark.createDataFrame(
        [(key, kind, start + dt.timedelta(seconds=s)) for key, kind, s in rows],
        "key long, kind string, ts timestamp_ntz",
    )
    counts = requests.usage_counts(df, "key", "kind", ("a", "b", "c"))
    assert sorted(as_rows(counts)) == [(1, 1, 2, 0), (2, 1, 0, 1)]
    order = requests.first_use_sequence(df, "key", "kind", "ts", ("c", "b", "a"))
    assert {row.key: row.sequence for row in order.collect()} == {1: ["b", "a"], 2: ["a", "c"]}
    assert plan_of(order).count("Exchange") == 1

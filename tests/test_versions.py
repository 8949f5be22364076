"""Tables that are replaced in one step, and CSV lines kept apart."""

import datetime
import functools
import pathlib
import re
import time

import pytest
from pyspark.sql import functions as F

from dockside.plans import catalog, ingest
from dockside.plans.catalog import PACKED, _write_csv
from dockside.schema import ORDER_TYPES, REQUIRED_COLUMNS
from dockside.session import CLEANUP_KEY
from dockside.sources import csv_orders, versions
from dockside.sources.csv_orders import read_orders_csv, split_orders_csv
from dockside.sources.tables import load_stored, write_table
from helpers import as_rows


def numbers(spark, n):
    return spark.range(n)


def failing(spark):
    @F.udf("long")
    def stop(i):
        if i == 90:
            raise RuntimeError("no more")
        return i

    return spark.range(100).select(stop("id").alias("id"))


def folders(path):
    return sorted(p.name for p in pathlib.Path(path).glob("v-*"))


def test_a_failing_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="no more"):
        write_table(failing(spark), path)
    with pytest.raises(FileNotFoundError):
        load_stored(spark, path)
    write_table(numbers(spark, 5), path)
    before = folders(path)
    with pytest.raises(Exception, match="no more"):
        write_table(failing(spark), path)
    assert load_stored(spark, path).count() == 5 and folders(path) == before


def test_readers_see_old_or_new(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(numbers(spark, 5), path)
    old = load_stored(spark, path)
    seen = []

    def write(folder):
        numbers(spark, 9).write.parquet(folder)
        # All rows are there, and the table is still the old one.
        seen.append(load_stored(spark, path).count())

    other = str(tmp_path / "other")

    def first(folder):
        numbers(spark, 2).write.parquet(folder)
        with pytest.raises(FileNotFoundError):
            load_stored(spark, other)

    versions.replace_table(spark, other, first)
    assert load_stored(spark, other).count() == 2
    versions.replace_table(spark, path, write)
    assert seen == [5] and load_stored(spark, path).count() == 9
    assert old.count() == 5
    write_table(numbers(spark, 1), path)
    assert len(folders(path)) == versions.KEPT == len(versions.commits(spark, path))


def test_a_table_replaced_by_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(numbers(spark, 4), path)
    for _ in range(4):
        held = load_stored(spark, path)
        write_table(held.union(held), path)
    assert load_stored(spark, path).count() == 64


def test_two_writers_at_one_time(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(numbers(spark, 1), path)

    def write(folder):
        numbers(spark, 2).write.parquet(folder)
        write_table(numbers(spark, 3), path)

    versions.replace_table(spark, path, write)
    assert load_stored(spark, path).count() == 2


def test_a_plain_folder_is_read_and_replaced(spark, tmp_path):
    path = str(tmp_path / "plain")
    numbers(spark, 7).write.parquet(path)
    assert load_stored(spark, path).count() == 7
    write_table(numbers(spark, 2), path)
    assert load_stored(spark, path).count() == 2
    assert versions.current_version(spark, str(tmp_path / "none")) is None


HEADER = " Order Id ,Market,Sales,order date (DateOrders)"
LINES = [
    "1,Europe,10.5,1/31/2018 22:56",
    "2,Europe",
    "3,Africa,much,1/31/2018 22:56",
    "4,Africa,1,soon",
    "5,Africa,NA,",
    "x,Africa,NaN,3/25/2018 2:30",
    "6,Europe,1,1/31/2018 22:56,more",
    '7,"a, ""b""",2,3/25/2018 2:30',
]


def test_good_and_bad_lines_are_all(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([HEADER, *LINES[:4]]), encoding="latin-1")
    (folder / "b.csv").write_text("\n".join([HEADER, *LINES[4:]]), encoding="latin-1")
    good, bad = split_orders_csv(spark, str(folder))
    late = datetime.datetime(2018, 1, 31, 22, 56)
    assert sorted(as_rows(good)) == [
        (1, "Europe", 10.5, late),
        (5, "Africa", None, None),
        (7, 'a, "b"', 2.0, datetime.datetime(2018, 3, 25, 2, 30)),
    ]
    found = sorted((r.reason, pathlib.Path(r.file).name, r.split, r.record[:8]) for r in bad.collect())
    assert [f[:3] for f in found] == [
        ("malformed line", "a.csv", 0),
        ("malformed line", "b.csv", 0),
        ("order_date_dateorders does not fit", "a.csv", 0),
        ("order_id does not fit", "b.csv", 0),
        ("sales does not fit", "a.csv", 0),
    ]
    assert found[0][3] == "2,Europe" and good.count() + bad.count() == len(LINES)
    (folder / "c.csv").write_text("Market\nEurope\n")
    with pytest.raises(Exception, match="(?i)header"):
        split_orders_csv(spark, str(folder))
    with pytest.raises(FileNotFoundError):
        split_orders_csv(spark, str(tmp_path / "none"))


def test_good_lines_are_read_alike(spark, tmp_path):
    """In any zone, also at an hour that a zone leaves out."""
    file = tmp_path / "good.csv"
    file.write_text("\n".join([HEADER, LINES[0], LINES[4], LINES[7]]), encoding="latin-1")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            good, bad = split_orders_csv(spark, str(file))
            plain = read_orders_csv(spark, str(file))
            assert good.dtypes == plain.dtypes and bad.count() == 0
            assert sorted(as_rows(good)) == sorted(as_rows(plain))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_code_for_wide_files_is_compiled(spark, tmp_path, monkeypatch, capsys):
    """The JVM leaves methods of more than 8,000 bytes uncompiled."""
    names = [*ORDER_TYPES, "order_date_dateorders", *[f"text_{i}" for i in range(26)]]
    file = tmp_path / "wide.csv"
    file.write_text(",".join(names) + "\n" + ",".join(["1"] * len(names)) + "\n")
    monkeypatch.setattr(csv_orders, "store", lambda df, name: df)
    good, bad = split_orders_csv(spark, str(file))
    assert [r.reason for r in bad.collect()] == ["order_date_dateorders does not fit"]
    assert good.columns == names and good.count() == 0
    good.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_names_of_headers_do_not_meet_own_ones(spark, tmp_path):
    file = tmp_path / "names.csv"
    file.write_text("Texts,#Order Id,try,Reason\nNA,7,b,c\n,x,,\n")
    good, bad = split_orders_csv(spark, str(file))
    assert good.columns == ["texts", "order_id", "try", "reason"]
    assert as_rows(good) == [(None, 7, "b", "c")]
    assert [(r.reason, r.record) for r in bad.collect()] == [("order_id does not fit", '{"order_id":"x"}')]


def test_every_task_writes_a_csv_file(spark, tmp_path):
    path = tmp_path / "export"
    _write_csv(spark.range(0, 900, 1, 9).toDF("order_id"), str(path))
    assert len(list(path.glob("*.csv"))) == 9
    assert read_orders_csv(spark, str(path)).count() == 900


def _shuffle_files(spark):
    """How many shuffle files lie on the local disks."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return blocks.getAllFiles().mkString(" ").count("shuffle_")


def test_an_export_frees_its_shuffles(spark, tmp_path):
    before = spark.conf.get(CLEANUP_KEY, None)
    held = _shuffle_files(spark)
    _write_csv(spark.range(900).repartition(3, "id").toDF("order_id"), str(tmp_path / "export"))
    for _ in range(100):
        if _shuffle_files(spark) <= held:
            break
        time.sleep(0.1)  # files go shortly after the query
    assert _shuffle_files(spark) <= held
    assert spark.conf.get(CLEANUP_KEY, None) == before


def test_packed_exports_are_small_files_with_the_same_rows(spark, tmp_path):
    rows = spark.range(0, 2500, 1, 2).selectExpr(
        "id AS order_id", "concat('São \"', id, ' Paulo') AS market", "id / 7 AS sales",
        "timestamp_ntz '2018-01-31 22:56:00' AS order_date_dateorders",
    )
    plain, packed = tmp_path / "plain", tmp_path / "packed"
    _write_csv(rows, str(plain))
    _write_csv(rows, str(packed), **{**PACKED, "maxRecordsPerFile": 500})
    assert len(list(packed.glob("*.csv.gz"))) == 6
    want = sorted(as_rows(rows))
    assert sorted(as_rows(read_orders_csv(spark, str(packed)))) == want
    good, bad = split_orders_csv(spark, str(packed))
    assert sorted(as_rows(good)) == want and bad.count() == 0
    sizes = [sum(f.stat().st_size for f in folder.glob("part-*")) for folder in (plain, packed)]
    assert sizes[1] * 3 < sizes[0]


def test_round_trip_packs_its_export_and_removes_it(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "new_shared_path", lambda spark, name: str(tmp_path / name))
    real = catalog.read_orders_csv

    def read(spark, path, *more):
        seen.extend(file.name for file in pathlib.Path(path).glob("part-*"))
        return real(spark, path, *more)

    monkeypatch.setattr(catalog, "read_orders_csv", read)
    found = catalog.QUERIES["csv_round_trip"](spark, "/root/testdata/sf0.001")
    assert seen and all(name.endswith(".csv.gz") for name in seen)
    assert [p.name for p in (tmp_path / "round-trip").iterdir()] == ["orders"]
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


@pytest.mark.parametrize("fails", [False, True])
def test_lines_held_by_a_load_go_with_it(spark, tmp_path, monkeypatch, fails):
    file = tmp_path / "wide.csv"
    names = (*REQUIRED_COLUMNS, "order_id", "customer_zipcode")
    file.write_text("\n".join([",".join(names), ",".join("1" for _ in names), "x"]) + "\n")
    held = tmp_path / "lines"
    monkeypatch.setattr(ingest, "new_shared_path", lambda spark, name: str(tmp_path / name))
    clean, seen = ingest.clean_orders, []

    def cleaned(lines):
        seen.append(held.is_dir())
        if fails:
            raise RuntimeError("no more")
        return clean(lines)

    monkeypatch.setattr(ingest, "clean_orders", cleaned)
    load = functools.partial(ingest.run_ingest, spark, str(file), str(tmp_path / "out"), keep_bad=True)
    if fails:
        with pytest.raises(RuntimeError, match="no more"):
            load()
    else:
        paths = load()
        assert load_stored(spark, paths["orders"]).count() == 1
        assert [r.reason for r in load_stored(spark, paths["rejected"]).collect()] == ["malformed line"]
    assert seen == [True] and not held.exists()

"""As-of and range joins, running totals, ranks and percentiles against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockside.operators.asof import asof_join
from dockside.operators.intervals import interval_join
from dockside.operators.ordered import exact_percentiles, global_rank, running_total
from helpers import as_rows, plan_of


def keyed(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("or_equal", [False, True])
@pytest.mark.parametrize("stretch", [1, 7, 10**6])
def test_asof(spark, or_equal, stretch):
    rng = random.Random(stretch)
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(60)])) for i in range(150)]
    left.append(left[0])
    right = [(rng.choice([1, 1, 2, None]), rng.choice([None, *range(60)]), i, f"v{i}" if i % 5 else None) for i in range(60)]
    found = asof_join(
        spark.createDataFrame(left, "id long, k long, ts long"),
        spark.createDataFrame(right, "k long, ts long, n long, v string").repartition(3),
        "k", "ts", ["n", "v"], "n", stretch, or_equal,
    )
    want = []
    for row in left:
        _, k, ts = row
        before = [
            (t, n, v) for rk, t, n, v in right
            if None not in (k, ts, rk, t) and rk == k and (t <= ts if or_equal else t < ts)
        ]
        last = max(before, key=lambda r: r[:2]) if before else (None, None, None)
        want.append((*row, last[1], last[2]))
    assert keyed(as_rows(found)) == keyed(want)


def test_asof_empty_sides_and_clash(spark):
    left = spark.createDataFrame([(1, 1, 5)], "id long, k long, ts long")
    right = spark.createDataFrame([(1, 4, 9)], "k long, ts long, n long")
    assert as_rows(asof_join(left, right.limit(0), "k", "ts", ["n"], "n")) == [(1, 1, 5, None)]
    assert as_rows(asof_join(left.limit(0), right, "k", "ts", ["n"], "n")) == []
    with pytest.raises(ValueError, match="already"):
        asof_join(left.withColumn("prev_n", F.lit(1)), right, "k", "ts", ["n"], "n")


def test_asof_cuts_a_hot_key(spark):
    """Windows over rows go by key and stretch; the one by key sees a row per stretch."""
    left = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("ts"))
    right = spark.range(0, 2000, 3).select(F.lit(1).alias("k"), F.col("id").alias("ts"), "id")
    found = asof_join(left, right, "k", "ts", ["id"], "id", stretch=100)
    assert found.where("prev_id = ts - 1 - (ts - 1) % 3 OR ts = 0 AND prev_id IS NULL").count() == 2000
    plan = plan_of(found)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # Rows are dealt by key and stretch for their window; by the key alone only a row per stretch is.
    by_key = [line for line in plan.splitlines() if "hashpartitioning(_key" in line and ", _at" not in line]
    assert len(by_key) == 1 and "hashpartitioning(_key#" in plan


@pytest.mark.parametrize("key", [None, "k"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals(spark, key, how):
    rng = random.Random(4)
    points = [(i, rng.choice([1, 2, None]), rng.choice([None, *range(-50, 400)])) for i in range(120)]
    spans = []
    for i in range(60):
        start = rng.choice([None, *range(-40, 300)])
        size = rng.choice([0, 1, 2, 3, 10, 100, 5000, -5])
        spans.append((100 + i, rng.choice([1, 2, None]), start, None if start is None else start + size))
    spans += [(900, 1, -(10**9), 10**9), (901, 2, 5, None)]
    found = interval_join(
        spark.createDataFrame(points, "id long, k long, at long"),
        spark.createDataFrame(spans, "id long, k long, b long, e long"),
        "at", "b", "e", 4, key, how,
    ).select("p.id", "i.id")
    want = []
    for i, k, at in points:
        hits = [
            n for n, sk, b, e in spans
            if None not in (at, b, e) and b <= at < e and (not key or (k is not None and k == sk))
        ]
        want += [(i, n) for n in hits] or ([(i, None)] if how == "left" else [])
    assert keyed(as_rows(found)) == keyed(want)


def test_intervals_without_product(spark):
    points = spark.range(100).withColumnRenamed("id", "at")
    spans = spark.range(0, 100, 10).select(F.col("id").alias("b"), (F.col("id") + 10).alias("e"))
    joined = interval_join(points, spans, "at", "b", "e", 10)
    assert joined.count() == 100
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)
    # A long interval touches two buckets at most, however short the shortest bucket is.
    long = spark.createDataFrame([(0, 10**12)], "b long, e long")
    assert interval_join(points, long, "at", "b", "e", 1).count() == 100
    assert interval_join(points, spans.limit(0), "at", "b", "e", 10, how="left").count() == 100
    with pytest.raises(ValueError):
        interval_join(points, spans, "at", "b", "e", 0)


def test_running_total(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, *range(-5, 50)])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(4)
    for width in (1, 10, 1000):
        found = running_total(df, "k", ["at"], "v", F.floor(F.col("at") / width))
        sums, want = {}, []
        for k, at, v in sorted(rows, key=lambda r: r[1]):
            sums[k] = sums.get(k, 0) + (v or 0)
            want.append((k, at, v, sums[k]))
        assert keyed(as_rows(found)) == keyed(want)
    plan = plan_of(running_total(df, "k", ["at"], "v", F.floor(F.col("at") / 10)))
    # The one window by key alone is over totals of stretches.
    assert plan.count("Window [") == 2 and "_total" in plan
    assert as_rows(running_total(df.limit(0), "k", ["at"], "v", F.lit(0))) == []


def test_global_rank(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 1, 1, *range(50)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v long, id long").repartition(5)
    found = as_rows(global_rank(df, [F.desc_nulls_last("v"), F.asc("id")]))
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(found, key=lambda r: r[2]) == [(*r, i + 1) for i, r in enumerate(want)]
    assert as_rows(global_rank(df.limit(0), [F.asc("id")])) == []
    plan = plan_of(global_rank(df, [F.asc("v")]))
    assert "Window" not in plan and "SinglePartition" not in plan


def test_exact_percentiles(spark):
    rng = random.Random(10)
    values = [rng.choice([5.0, rng.random() * 100]) for _ in range(801)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(4)
    shares = [0.0, 0.1, 0.333, 0.5, 0.99, 1.0]
    found = as_rows(exact_percentiles(df, "x", shares))
    assert [s for s, _ in found] == shares
    assert [v for _, v in found] == pytest.approx(np.quantile(values, shares).tolist())
    assert as_rows(exact_percentiles(df.limit(0), "x", [0.5])) == [(0.5, None)]
    one = spark.createDataFrame([(3.0,)] * 50, "x double")
    assert as_rows(exact_percentiles(one, "x", [0.2, 0.9])) == [(0.2, 3.0), (0.9, 3.0)]
    with pytest.raises(ValueError):
        exact_percentiles(df, "x", [1.5])

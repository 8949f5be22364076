"""Sketches by day: error, new days, replaced days."""

import random

from pyspark.sql import functions as F

from dockside.operators.sketches import add_days, approx_distinct, error_bound
from helpers import as_rows


def rows_of(spark, first, last, seed=0, users=4000):
    rng = random.Random(seed)
    rows = [
        (f"2024-01-{d:02d}", rng.choice(["a", "b", None]), rng.choice([None, *range(users)]))
        for d in range(first, last + 1)
        for _ in range(3000)
    ]
    return rows, spark.createDataFrame(rows, "day string, k string, user long").repartition(3)


def exact(rows):
    found = {}
    for _, k, user in rows:
        found.setdefault(k, set()).update([] if user is None else [user])
    return {k: len(v) for k, v in found.items()}


def test_days_are_added_and_replaced(spark, tmp_path):
    path = str(tmp_path / "sketches")
    old, old_df = rows_of(spark, 1, 4)
    add_days(old_df, path, F.col("day"), ["k"], "user")
    new, new_df = rows_of(spark, 4, 8, seed=1)
    add_days(new_df, path, F.col("day"), ["k"], "user")
    rows = [r for r in old if r[0] != "2024-01-04"] + new
    for days in (None, ("2024-01-02", "2024-01-05")):
        some = [r for r in rows if not days or days[0] <= r[0] <= days[1]]
        got = {r.k: r for r in approx_distinct(spark, path, ["k"], days).collect()}
        want = exact(some)
        assert set(got) == set(want)
        for k, n in want.items():
            assert abs(got[k].estimate - n) <= error_bound() * n
            assert got[k].n == sum(r[1] == k and r[2] is not None for r in some)
    plan = approx_distinct(spark, path, ["k"], days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_few_values_are_exact_and_nulls(spark, tmp_path):
    path = str(tmp_path / "few")
    df = spark.createDataFrame([(None, "x", 1), ("2024-01-01", "x", 2), ("2024-01-01", "y", None)], "d string, k string, v long")
    add_days(df, path, F.col("d"), ["k"], "v", lg_buckets=8)
    assert sorted(as_rows(approx_distinct(spark, path, ["k"]))) == [("x", 2, 2), ("y", 0, 0)]
    assert error_bound(8) > error_bound(12) > 0.04

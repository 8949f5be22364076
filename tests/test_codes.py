"""Search by codes: recall, what it reads, and its limits."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockside.operators import codes, vectors


def frame(spark, name, matrix, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def clustered(n, dims=64, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims)) * 3
    return middles[rng.integers(0, groups, n)] + rng.normal(size=(n, dims))


def bytes_of(path, cells=None, column=None):
    """Bytes of one column in the folders of some cells, as Parquet states them."""
    import pyarrow.parquet as pq

    total = 0
    for file in pathlib.Path(path).rglob("*.parquet"):
        if cells is not None and int(file.parent.name.split("=")[1]) not in cells:
            continue
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                if column is None or group.column(c).path_in_schema.startswith(column):
                    total += group.column(c).total_compressed_size
    return total


def test_recall_and_bytes(spark, tmp_path):
    points = clustered(6000)
    base = frame(spark, "doc_id", points)
    asked = frame(spark, "query_id", points[:4] + 0.05)
    path = str(tmp_path / "codes")
    codes.build_codes(base, path, n_cells=64, sample_rows=3000)
    found = codes.knn_codes(asked, spark, path, 10, n_probe=6)
    exact = vectors.knn(asked, base, 10, "l2sq")
    row = codes.recall(found, exact).first()
    assert (row.queries, row.exact_hits) == (4, 40) and row.recall >= 0.9
    # Scores of what was found are exact.
    both = found.join(exact.select("query_id", "doc_id", F.col("score").alias("s")), ["query_id", "doc_id"])
    assert both.where("abs(score - s) > 0.0001").count() == 0
    held = {r.cell for r in spark.read.parquet(f"{path}/rows").join(found, "doc_id").select("cell").collect()}
    read = bytes_of(f"{path}/rows", column="codes") + bytes_of(f"{path}/rows", held, "embedding")
    assert read < bytes_of(f"{path}/rows") / 4
    assert spark.read.parquet(f"{path}/rows").count() == 6000


def test_all_cells_and_candidates_are_exact(spark, tmp_path):
    points = clustered(300, dims=7, groups=5)
    base, asked = frame(spark, "doc_id", points), frame(spark, "query_id", points[:5])
    path = str(tmp_path / "codes")
    codes.build_codes(base, path, n_cells=6, n_parts=3)
    found = codes.knn_codes(asked, spark, path, 8, n_probe=6, per_hit=100)
    key = ("query_id", "doc_id", "rank", "score")
    assert sorted(found.select(*key).collect()) == sorted(vectors.knn(asked, base, 8, "l2sq").select(*key).collect())


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 2.0]), (6, [9.0, 9.0])]
    base = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    path = str(tmp_path / "odd")
    codes.build_codes(base, path, n_cells=2)
    asked = frame(spark, "query_id", [[1.0, 2.0]])
    hits = codes.knn_codes(asked, spark, path, 5, n_probe=2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in hits] == [(1, 0.0), (5, 0.0), (6, 113.0)]
    assert codes.knn_codes(asked.limit(0), spark, path, 5).collect() == []
    empty = str(tmp_path / "empty")
    codes.build_codes(base.limit(0), empty)
    assert codes.knn_codes(asked, spark, empty, 5).collect() == []
    with pytest.raises(ValueError):
        codes.build_codes(base, path, n_cells=10**6)


def test_repeated_vectors_need_no_more_codes(spark, tmp_path):
    path = str(tmp_path / "same")
    base = frame(spark, "doc_id", np.ones((50, 8)))
    codes.build_codes(base, path, n_cells=4)
    hits = codes.knn_codes(frame(spark, "query_id", np.ones((1, 8))), spark, path, 3, n_probe=4).collect()
    assert sorted(r.doc_id for r in hits) == [0, 1, 2]

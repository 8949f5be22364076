import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from helpers import as_rows, plan_of
from dockside.functions import nearest
from dockside.operators import cells, vectors

SCHEMA = "{} long, embedding array<float>"


def frame(spark, name, matrix):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, SCHEMA.format(name))


def brute(queries, base, k, metric):
    queries, base = queries.astype("float32").astype(float), base.astype("float32").astype(float)
    found = []
    for number, query in enumerate(queries):
        if metric == "l2sq":
            values = ((base - query) ** 2).sum(axis=1)
        else:
            norms = np.linalg.norm(base, axis=1) * np.linalg.norm(query)
            values = -np.divide(base @ query, norms, out=np.zeros(len(base)), where=norms > 0)
        order = sorted(range(len(base)), key=lambda i: (round(values[i], 9), i))[:k]
        found += [(number, i, place + 1) for place, i in enumerate(order)]
    return sorted(found)


def found_by(hits):
    return sorted((row.query_id, row.doc_id, row["rank"]) for row in hits.collect())


@pytest.fixture
def points():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 8))
    base[200:400] = base[0]  # a third of the rows are copies
    return rng.normal(size=(23, 8)), base


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
@pytest.mark.parametrize("per_block", [1000, 5])
def test_knn_equals_brute_force(spark, points, metric, per_block):
    queries, base = points
    hits = vectors.knn(
        frame(spark, "query_id", queries),
        frame(spark, "doc_id", base).repartition(7),
        6,
        metric,
        per_block,
    )
    assert found_by(hits) == brute(queries, base, 6, metric)


def test_knn_in_small_steps(spark, points, monkeypatch):
    queries, base = points
    monkeypatch.setattr(nearest, "ROWS_PER_STEP", 37)
    hits = vectors.knn(frame(spark, "query_id", queries), frame(spark, "doc_id", base), 10)
    assert found_by(hits) == brute(queries, base, 10, "cosine")


def test_text_ids_and_ties(spark):
    base = spark.createDataFrame(
        [(name, [1.0, 0.0]) for name in ("é", "b", "a", "Z")], "doc_id string, embedding array<float>"
    )
    query = frame(spark, "query_id", np.array([[2, 0]]))
    hits = vectors.knn(query, base.repartition(3), 3).orderBy("rank")
    assert [row.doc_id for row in hits.collect()] == ["Z", "a", "b"]


def test_knn_edge_cases(spark):
    base = frame(spark, "doc_id", np.array([[1, 0], [-1, 0], [0, 1], [0, 0]]))
    query = frame(spark, "query_id", np.array([[1, 0]]))
    hits = vectors.knn(query, base, 4)
    assert [(row.doc_id, row.score) for row in hits.orderBy("rank").collect()] == [
        (0, 1.0),
        (2, 0.0),
        (3, 0.0),
        (1, -1.0),
    ]
    assert vectors.knn(query.limit(0), base, 4).count() == 0
    assert vectors.knn(query, base.limit(0), 4).count() == 0
    with pytest.raises(ValueError, match="unique"):
        vectors.knn(query.union(query), base, 4)
    with pytest.raises(ValueError):
        vectors.knn(query, base, 4, "dot")


def test_k_is_not_cut(spark, points):
    queries, base = points
    hits = vectors.knn(frame(spark, "query_id", queries[:2]), frame(spark, "doc_id", base), 50, "l2sq")
    assert found_by(hits) == brute(queries[:2], base, 50, "l2sq")


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_vectors_that_cannot_be_compared(spark, metric):
    good = np.random.default_rng(1).normal(size=(6, 2))
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(good)]
    odd = [(10, None), (11, [None, 1.0]), (12, [float("nan")] * 2), (13, [float("inf"), 0.0])]
    base = spark.createDataFrame(rows + odd, SCHEMA.format("doc_id"))
    query = frame(spark, "query_id", np.array([[1.0, 0.5]]))
    assert found_by(vectors.knn(query, base, 9, metric)) == brute(
        np.array([[1.0, 0.5]]), good, 9, metric
    )
    for bad in ([None, 1.0], [float("nan"), 1.0]):
        asked = spark.createDataFrame([(1, bad)], SCHEMA.format("query_id"))
        with pytest.raises(ValueError, match="finite"):
            vectors.knn(asked, base, 2, metric)


def operators_of(df):
    return re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", plan_of(df), re.MULTILINE)


@pytest.mark.parametrize("held,groups", [(16, 1), (2, 4)])
def test_base_vectors_come_to_python_once(spark, monkeypatch, held, groups):
    """Eight blocks of queries: each chunk of the base goes by once for as many as a task holds."""
    monkeypatch.setattr(vectors, "BLOCKS_HELD", held)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 6))
    base, asked = frame(spark, "doc_id", points), frame(spark, "query_id", points[:40])
    dealt = vectors._dealt(asked, base, per_block=5)
    assert dealt.agg(F.sum(F.length("doc_vectors"))).first()[0] == groups * 400 * 6 * 8
    hits = vectors.knn(asked, base, 3, "l2sq", per_block=5)
    assert found_by(hits) == brute(points[:40], points, 3, "l2sq")


def test_one_plan_for_any_number_of_queries(spark):
    rng = np.random.default_rng(8)
    base = frame(spark, "doc_id", rng.normal(size=(50, 4)))
    plans = [
        operators_of(vectors.knn(frame(spark, "query_id", rng.normal(size=(n, 4))), base, 3))
        for n in (3, 5000)
    ]
    assert plans[0] == plans[1]
    text = " ".join(plans[0])
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "MapInArrow" in text and "WindowGroupLimit" in text


def test_cells_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = np.concatenate([rng.normal(loc=10 * c, scale=0.5, size=(80, 4)) for c in range(6)])
    queries = np.concatenate([base[::90] + 0.1, rng.normal(size=(2, 4)) * 30])
    path = str(tmp_path / "cells")
    cells.build_cells(frame(spark, "doc_id", base), path, n_cells=6)
    for k in (5, 50, 500):
        hits = cells.knn_cells(frame(spark, "query_id", queries), spark, path, k)
        assert found_by(hits) == brute(queries, base, k, "l2sq")
    one = cells.knn_cells(frame(spark, "query_id", queries[:1]), spark, path, 5)
    assert found_by(one) == brute(queries[:1], base, 5, "l2sq")
    # One cell of six is read.
    assert re.search(r"PartitionFilters: \[[^\]]*\(cell#\d+ = \d\)", plan_of(one))


def test_queries_meet_only_their_own_cells(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = np.concatenate([rng.normal(loc=10 * c, scale=0.5, size=(80, 4)) for c in range(6)])
    path = str(tmp_path / "cells")
    cells.build_cells(frame(spark, "doc_id", base), path, n_cells=6)
    queries = frame(spark, "query_id", base[[3, 403]])
    routed = cells.route_queries(queries, spark, path, 5).collect()
    assert sorted(list(row.query_ids) for row in routed) == [[0], [1]]
    with pytest.raises(ValueError):
        cells.build_cells(queries, path, n_cells=10**6)


@pytest.mark.parametrize("dims", [3, 64, 384])
def test_mean_vectors(spark, dims):
    rng = np.random.default_rng(dims)
    points = rng.normal(size=(30, dims))
    rows = [(i % 3, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(0, None), (1, [float("nan")] * dims), (2, [None] * dims), (7, [1.0] * dims), (7, [-1.0] * dims)]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    got = {r.query_id: r.embedding for r in vectors.mean_vectors(df, "label", "v").collect()}
    for label in range(3):
        mean = points[label::3].mean(axis=0)
        assert np.allclose(got[label], mean / np.linalg.norm(mean))
    assert got[7] == [0.0] * dims


def test_mean_of_mixed_lengths_stops(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "label int, v array<double>")
    with pytest.raises(Exception, match="(?i)dimension|size"):
        vectors.mean_vectors(df.coalesce(1), "label", "v").collect()


def test_search_and_context(spark):
    corpus = spark.createDataFrame(
        [("a", "first", "s", [1.0, 0.0]), ("b", "second", None, [0.6, 0.8])],
        "doc_id string, text string, source string, embedding array<float>",
    )
    query = frame(spark, "query_id", np.array([[1, 0]]))
    hits = vectors.search(query, corpus, corpus, 4)
    assert sorted(tuple(row) for row in hits.collect()) == [
        (0, 1, "a", "first", "s", 1.0),
        (0, 2, "b", "second", "unknown", 0.2),
    ]
    cosine = vectors.search(query, corpus, corpus, 4, "cosine").collect()
    assert {row.doc_id: row.relevance_score for row in cosine} == {"a": 1.0, "b": 0.6}
    assert as_rows(vectors.search_context(hits)) == [(0, "first\n\nsecond")]


def test_search_gives_ten_hits_at_most(spark, points):
    queries, base = points
    texts = spark.range(600).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    hits = vectors.search(
        frame(spark, "query_id", queries[:2]), frame(spark, "doc_id", base), texts, 50
    )
    assert hits.count() == 20


def test_vectorizer_saves_and_ranks(spark, tmp_path):
    docs = spark.createDataFrame(
        [("a", "late orders in Europe"), ("b", "profit of shoes"), ("c", "late trains in Africa")],
        "id string, text string",
    )
    model = vectors.fit_vectorizer(docs)
    model.write().save(str(tmp_path / "model"))
    again = vectors.PipelineModel.load(str(tmp_path / "model"))
    embedded = vectors.embed_corpus(docs, again)
    sizes = [float(np.linalg.norm(row.embedding)) for row in embedded.collect()]
    assert np.allclose(sizes, 1.0) and len(embedded.first().embedding) == vectors.DIMENSIONS
    ask = spark.createDataFrame([(1, "PROFIT on shoes?")], "query_id int, text string")
    hits = vectors.search(
        vectors.embed_corpus(ask, again),
        embedded.withColumnRenamed("id", "doc_id"),
        embedded.selectExpr("id AS doc_id", "text", "'s' AS source"),
        1,
    )
    assert hits.first().doc_id == "b"


def test_words_of_any_script(spark):
    docs = spark.createDataFrame([("a", "São Paulo"), ("b", "Киев"), ("c", "so pao")], "id string, text string")
    embedded = vectors.embed_corpus(docs, vectors.fit_vectorizer(docs)).collect()
    assert all(any(x > 0 for x in row.embedding) for row in embedded)
    assert embedded[0].embedding != embedded[2].embedding


def test_own_model_sees_small_batches(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "id int, text string").coalesce(1)

    def load():
        def encode(texts):
            assert len(texts) <= 32
            return [[float(len(text)), float(len(texts))] for text in texts]

        return encode

    rows = vectors.embed_with_model(df, load).collect()
    assert [row.embedding[0] for row in rows] == [float(i) for i in range(70)]
    assert {row.embedding[1] for row in rows} == {32.0, 6.0}

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockside.llm.neighbours import Tree, nearest

TYPE = "vec_id long, embedding array<float>, _size int, rank int, query_id string, _shard string"


def brute(rows, k):
    held = []
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            held.append((i, np.array(v, "f4").astype(float)))
    out = []
    for i, q in held:
        if i % 20 == 0:
            near = [(-np.cumsum(q * x)[-1], j) for j, x in held if j != i and len(x) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    made = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    made += [(1000 + i, [0.5, 0.5, 0.1, 0.0, 0.0, 0.1]) for i in range(150)]
    made += [(2000 + i, (10 * rng.normal(size=6)).tolist()) for i in range(30)]
    made += [(3000, None), (3020, [0.0] * 6), (3040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3060, [])]
    made += [(3080, [float("nan")] * 6), (3100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    return made + [(3120, [1.0, 2.0]), (3121, [2.0, 1.0]), (3122, [0.5, 0.5])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "q", "s") for r in rows], TYPE).repartition(3)


def test_as_brute_force(spark, rows, monkeypatch):
    import dockside.llm.neighbours as module

    monkeypatch.setattr(module, "ROWS_PER_SHARD", 200)
    monkeypatch.setattr(module, "QUERIES_PER_BLOCK", 10)
    got = nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 7).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7)


def test_few_rows(spark):
    assert nearest(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    two = [(20, [1.0, 0.0]), (7, [-1.0, 0.5])]
    got = nearest(frame(spark, two), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in got] == [(20, 1, 7, -1.0)]


def test_repeated_rows_are_found_one_by_one(spark):
    rows = [(20, [1.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    got = nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 3, 1.0), (20, 2, 3, 1.0)]


def test_factor_below_one_loses_little(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 12))
    vectors = centres[rng.integers(20, size=4000)] + 0.15 * rng.normal(size=(4000, 12))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.arange(4000)
    tree = Tree.from_bytes(Tree.build(ids, vectors).to_bytes())
    queries = np.flatnonzero(ids % 50 == 0)
    found = {}
    for factor in (1.0, 0.7):
        q, f, _ = tree.search(queries, vectors[queries], 10, factor)
        found[factor] = set(zip(q.tolist(), f.tolist()))
    exact = set()
    for n, q in enumerate(queries):
        s = vectors @ vectors[q]
        s[q] = -np.inf
        exact |= {(n, int(j)) for j in np.argsort(-s)[:10]}
    assert found[1.0] == exact
    assert len(found[0.7] & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("kind", ["equidistant", "equal", "two places"])
def test_ties_do_not_deepen_the_tree(kind):
    """Vectors at one distance from each other, or all at one place."""
    vectors = {
        "equidistant": np.eye(2000),
        "equal": np.ones((2000, 3)),
        "two places": np.repeat(np.eye(2), 1000, axis=0),
    }[kind]
    tree = Tree.build(np.arange(2000), vectors.astype("f4"), seed=1)
    own = np.array([5, 1700])
    query, ids, products = tree.search(own, vectors[own], 4)
    for n, i in enumerate(own):
        exact = vectors @ vectors[i]
        want = sorted((j for j in range(2000) if j != i), key=lambda j: (-exact[j], j))[:4]
        assert ids[query == n].tolist() == want and products[query == n].tolist() == exact[want].tolist()
    assert len(tree.nodes) < 100

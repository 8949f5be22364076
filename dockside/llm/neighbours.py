"""Nearest neighbours by inner product with a vantage-point tree per shard.

Vectors of a shard get one more component, which makes them all as long as its
longest one; then the largest inner product is the smallest Euclidean distance,
and the triangle inequality holds. A node of the tree keeps a vantage point and
the least and greatest distance of each half from it. A query leaves a half out if
its distance from every vector in there must exceed ``factor`` times that of its
k-th hit so far: one restores exact search, less is faster and may lose hits.

Queries go through a tree in blocks: each first goes down to the leaf it belongs
to, which gives a first k-th hit, and then all of them walk the tree together.
Every shard meets every block of queries as a row of its own, so neither side is
broadcast; only k hits per query and shard leave a task.
"""

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockside.llm.common import record_batch, store

ROWS_PER_SHARD = 8192
QUERIES_PER_BLOCK = 1024
LEAF = 128

# Covers rounding of distances and products, relative to the lengths.
SLACK = 1e-9


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, added from the first component to the last one."""
    return np.cumsum(left * right, axis=1)[:, -1] if len(left) else np.zeros(0)


class Tree:
    """Vantage-point tree over vectors in an order of its own."""

    FIELDS = ("ids", "vectors", "nodes", "spans", "top")

    def __init__(self, ids, vectors, nodes, spans, top):
        self.ids, self.vectors, self.nodes, self.spans, self.top = ids, vectors, nodes, spans, top
        self.wide = vectors.astype(np.float64)
        squares = np.einsum("ij,ij->i", self.wide, self.wide)
        self.lifted = np.column_stack([self.wide, np.sqrt(np.maximum(float(top) - squares, 0.0))])

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, seed: int = 0) -> "Tree":
        wide = vectors.astype(np.float64)
        squares = np.einsum("ij,ij->i", wide, wide)
        top = squares.max()
        lifted = np.column_stack([wide, np.sqrt(np.maximum(top - squares, 0.0))])
        order = np.arange(len(ids))
        rng = np.random.default_rng(seed)
        nodes, spans = [], []

        def grow(start, end):
            """Number of the node over ``order[start:end]``."""
            number = len(nodes)
            # First and last row, children (-1: a leaf), vantage point.
            nodes.append([start, end, -1, -1, -1])
            spans.append([0.0] * 4)
            if end - start <= LEAF:
                return number
            part = order[start:end]
            vantage = part[rng.integers(len(part))]
            away = np.sqrt(((lifted[part] - lifted[vantage]) ** 2).sum(axis=1))
            rank = np.argsort(away, kind="stable")
            part, away = part[rank], away[rank]
            # Equal distances are cut by place, so the tree is never deeper than its size's logarithm.
            cut = len(away) // 2
            order[start:end] = part
            nodes[number][4] = vantage
            spans[number] = [away[0], away[cut - 1], away[cut], away[-1]]
            nodes[number][2] = grow(start, start + cut)
            nodes[number][3] = grow(start + cut, end)
            return number

        grow(0, len(ids))
        held = np.array(nodes, np.int64)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        inner = held[:, 4] >= 0
        held[inner, 4] = place[held[inner, 4]]
        return cls(ids[order], vectors[order], held, np.array(spans), np.float64(top))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Tree":
        with np.load(io.BytesIO(data)) as held:
            return cls(*(held[f] for f in cls.FIELDS))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0):
        """Best ``k`` rows of each query: its number, ids and products, best first.

        ``own`` are ids of rows that a query may not find.
        """
        return _Walk(self, own, queries, k, factor).run()


class _Walk:
    def __init__(self, tree, own, queries, k, factor):
        self.tree, self.own, self.k, self.factor = tree, own, k, factor
        self.queries = queries
        self.lifted = np.column_stack([queries, np.zeros(len(queries))])
        self.squares = np.einsum("ij,ij->i", queries, queries)
        self.slack = SLACK * np.sqrt(self.squares * float(tree.top)) + 1e-300
        n = len(queries)
        self.floor = np.full(n, -np.inf)  # product of the k-th hit
        self.query = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.seen_leaf = np.full(n, -1)

    def reach(self, at):
        """Distance within which a row would still be among the hits."""
        squares = self.squares[at] + float(self.tree.top) - 2 * (self.floor[at] - self.slack[at])
        return np.sqrt(np.maximum(squares, 0.0)) + np.sqrt(self.slack[at])

    def away(self, node, at):
        point = self.tree.lifted[self.tree.nodes[node, 4]]
        return np.sqrt(((self.lifted[at] - point) ** 2).sum(axis=1))

    def leaf(self, node, at):
        start, end = self.tree.nodes[node, :2]
        for first in range(start, end, 1024):
            rows = np.arange(first, min(end, first + 1024))
            rough = self.queries[at] @ self.tree.wide[rows].T
            near = rough >= (self.floor[at] - self.slack[at])[:, None]
            near &= self.tree.ids[rows][None, :] != self.own[at][:, None]
            q, r = np.nonzero(near)
            q, r = at[q], rows[r]
            score = exact_products(self.queries[q], self.tree.wide[r])
            mine = np.isin(self.query, at)
            query = np.concatenate([self.query[mine], q])
            row = np.concatenate([self.row[mine], r])
            score = np.concatenate([self.score[mine], score])
            order = np.lexsort((self.tree.ids[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            kept = place < self.k
            last = place == self.k - 1
            self.floor[query[last]] = score[last]
            self.query = np.concatenate([self.query[~mine], query[kept]])
            self.row = np.concatenate([self.row[~mine], row[kept]])
            self.score = np.concatenate([self.score[~mine], score[kept]])

    def down(self, node, at):
        """Each query to the leaf it belongs to."""
        inner, outer = self.tree.nodes[node, 2:4]
        if inner < 0:
            self.seen_leaf[at] = node
            self.leaf(node, at)
            return
        low, high = self.tree.spans[node, 1], self.tree.spans[node, 2]
        inside = self.away(node, at) <= (low + high) / 2
        for child, part in ((inner, at[inside]), (outer, at[~inside])):
            if len(part):
                self.down(child, part)

    def rest(self, node, at):
        """All queries through the halves that may still hold a hit."""
        inner, outer = self.tree.nodes[node, 2:4]
        if inner < 0:
            at = at[self.seen_leaf[at] != node]
            if len(at):
                self.leaf(node, at)
            return
        away = self.away(node, at)
        spans = self.tree.spans[node]
        for child, low, high in ((inner, *spans[:2]), (outer, *spans[2:])):
            least = np.maximum(np.maximum(away - high, low - away), 0.0)
            part = at[least <= self.factor * self.reach(at)]
            if len(part):
                self.rest(child, part)

    def run(self):
        everyone = np.arange(len(self.queries))
        self.down(0, everyone)
        self.rest(0, everyone)
        order = np.lexsort((self.tree.ids[self.row], -self.score, self.query))
        return self.query[order], self.tree.ids[self.row[order]], self.score[order]


def comparable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there, finite and not zero: ``vec_id, embedding, _size``."""
    held = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return held.where(
        F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    ).withColumn("_size", F.size("embedding"))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def build_trees(vectors: DataFrame, rows: int) -> DataFrame:
    """One tree per row, stored in the shared folder: ``_size, _shard, tree``."""
    shards = max(1, -(-rows // ROWS_PER_SHARD))
    schema = pa.schema([("_size", pa.int32()), ("_shard", pa.int32()), ("tree", pa.binary())])

    def build(key, table):
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        held = _matrix(table["embedding"], key[0].as_py())
        tree = Tree.build(ids[order], held[order])
        return pa.table([[key[0]], [key[1]], [tree.to_bytes()]], schema=schema)

    # Any even deal is right, so rows are dealt by number and no id can fill a shard.
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    dealt = vectors.withColumn("_shard", number)
    built = dealt.groupBy("_size", "_shard").applyInArrow(
        build, "_size int, _shard int, tree binary"
    )
    return store(built, "trees")


def query_blocks(queries: DataFrame, rows: int) -> DataFrame:
    """Queries packed into rows: ``_size, _block, ids, vectors``."""
    blocks = max(1, -(-rows // QUERIES_PER_BLOCK))
    schema = pa.schema(
        [("_size", pa.int32()), ("_block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]
    )

    def pack(key, table):
        ids = table["vec_id"].to_numpy()
        held = _matrix(table["embedding"], key[0].as_py())
        order = np.lexsort((*held.T[::-1], ids))
        columns = [[key[0]], [key[1]], [ids[order].tobytes()], [held[order].tobytes()]]
        return pa.table(columns, schema=schema)

    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = queries.withColumn("_block", number)
    packed = dealt.groupBy("_size", "_block").applyInArrow(
        pack, "_size int, _block int, ids binary, vectors binary"
    )
    return store(packed, "queries")


def nearest(
    vectors: DataFrame, is_query, k: int = 20, factor: float = 1.0
) -> DataFrame:
    """The ``k`` nearest rows of every query row: ``query_id, rank, vec_id, score``.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on
    ``vec_id``. Nearness is the inner product in double precision, ties go to the
    smaller ``vec_id``; rows with the query's own ``vec_id`` are left out. Vectors
    that are NULL, zero, or hold a NULL or non-finite component, and rows without
    ``vec_id``, take no part; only vectors of equal length are compared. Repeated
    rows are found, and ask, one by one. With ``factor`` one the result is exact.
    """
    if not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    held = comparable(vectors)
    asking = held.where(is_query)
    counts = held.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    trees = build_trees(held, counts[0])
    blocks = query_blocks(asking, counts[1])
    shards = max(1, -(-counts[0] // ROWS_PER_SHARD))
    # Every block of queries goes to every shard, a row each.
    sent = blocks.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = trees.join(sent, ["_size", "_shard"])
    schema = pa.schema(
        [
            ("_block", pa.int32()),
            ("_number", pa.int32()),
            ("query_id", pa.int64()),
            ("vec_id", pa.int64()),
            ("score", pa.float64()),
        ]
    )

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids = np.frombuffer(row["ids"], np.int64)
                queries = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                query, found, score = Tree.from_bytes(row["tree"]).search(ids, queries, k, factor)
                block = np.full(len(query), row["_block"], np.int32)
                yield record_batch(
                    schema, block, query.astype(np.int32), ids[query], found, score
                )

    hits = pairs.select("_block", "ids", "vectors", "tree", "_size").mapInArrow(
        search, "_block int, _number int, query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("_block", "_number", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

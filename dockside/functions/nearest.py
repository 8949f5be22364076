"""What one task does in a nearest-neighbour search: packed vectors in, k rows out."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Tasks get these functions by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Base rows compared at a time: bounds the score matrix of a task's step.
ROWS_PER_STEP = 2048


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    lengths = np.asarray(column.value_lengths())
    dims = int(lengths[0]) if len(lengths) else 0
    if (lengths != dims).any():
        raise ValueError(f"expected vectors of {dims} numbers")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype("float64", copy=False).reshape(len(lengths), dims)


def pack(rows: int, names: tuple[str, ...]):
    """Function for ``mapInArrow``: ids and vectors of up to ``rows`` rows in one row.

    A third column, if there is one, has one value in each packed row.
    """

    def packed(batches):
        for batch in batches:
            keys = batch.column(2).to_numpy() if batch.num_columns > 2 else np.zeros(batch.num_rows)
            for key in np.unique(keys):
                held = batch.filter(pa.array(keys == key))
                for start in range(0, held.num_rows, rows):
                    part = held.slice(start, rows)
                    vectors = matrix(part.column(1))
                    ids = part.column(0)
                    columns = [
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([vectors.shape[1]], pa.int32()),
                        pa.array([vectors.tobytes()], pa.binary()),
                    ]
                    if batch.num_columns > 2:
                        columns.append(part.column(2).slice(0, 1))
                    yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return packed


def unpack(ids, dims, vectors) -> tuple[pa.Array, np.ndarray]:
    return ids.values, np.frombuffer(vectors.as_py(), "float64").reshape(-1, dims.as_py())


def closeness(base: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Matrix base x query: cosine, or minus the squared distance."""
    dots = base @ queries.T
    base_sq = (base * base).sum(axis=1)[:, None]
    query_sq = (queries * queries).sum(axis=1)[None, :]
    if metric == "l2sq":
        return -np.maximum(base_sq + query_sq - 2 * dots, 0.0)
    norms = np.sqrt(base_sq * query_sq)
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def best_per_query(found: pa.Table, k: int) -> pa.Table:
    """The k closest rows of each query, equal closeness going by id."""
    found = found.sort_by([("query", "ascending"), ("closeness", "descending"), ("doc_id", "ascending")])
    query = found["query"].to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return found.filter(pa.array(place < k))


def best_of(ids, base, queries, k, metric) -> pa.Table:
    """The k closest rows of ``base`` for each query: ``query`` (its number), ``doc_id``, ``closeness``."""
    if base.shape[1] != queries.shape[1]:
        raise ValueError(f"expected vectors of {queries.shape[1]} numbers")
    best = None
    floor = np.full(len(queries), -np.inf)
    for start in range(0, len(base), ROWS_PER_STEP):
        rows = slice(start, start + ROWS_PER_STEP)
        # Equal vectors must tie exactly, whichever task computes them.
        scores = np.round(closeness(base[rows], queries, metric), 10)
        if len(scores) > k:
            kth = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
            bar = np.maximum(kth, floor)
        else:
            bar = floor
        row, column = np.nonzero(scores >= bar)
        found = pa.table(
            {
                "query": column,
                "doc_id": ids.take(pa.array(row + start)),
                "closeness": scores[row, column],
            }
        )
        best = best_per_query(found if best is None else pa.concat_tables([best, found]), k)
        query, last = best["query"].to_numpy(), best["closeness"].to_numpy()
        full = np.flatnonzero(np.bincount(query, minlength=len(queries)) >= k)
        floor[full] = last[np.searchsorted(query, full, side="right") - 1]
    return best


def nearest_in_parts(k, metric):
    """Function for ``mapInArrow`` over rows sorted by part: the part's packed queries, then its base vectors.

    Columns: part, query ids, dims and vectors (NULL in a row of base vectors), base ids, dims and
    vectors (NULL in a row of queries). Queries are held while the part's base vectors go by, each of which
    comes to this process once. At most k rows per query leave for each row of base vectors.
    """

    def scan(batches):
        part, asked = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != part:
                    part, asked = batch.column(0)[i].as_py(), []
                if batch.column(1)[i].is_valid:
                    # Copied, as the batch goes before they are needed last.
                    ids, queries = unpack(*(batch.column(c)[i] for c in range(1, 4)))
                    asked.append((pa.concat_arrays([ids]), queries.copy()))
                    continue
                ids, base = unpack(*(batch.column(c)[i] for c in range(4, 7)))
                for query_ids, queries in asked:
                    best = best_of(ids, base, queries, k, metric)
                    if best is None:
                        continue
                    columns = [
                        query_ids.take(best["query"].combine_chunks()),
                        best["doc_id"].combine_chunks(),
                        best["closeness"].combine_chunks(),
                        pa.array(np.full(best.num_rows, part, np.int32)),
                    ]
                    names = ["query_id", "doc_id", "closeness", "part"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return scan


def nearest_in_pairs(k, metric):
    """Function for ``mapInArrow`` over pairs of packed queries and packed base vectors.

    Columns: query ids, dims and vectors, base ids, dims and vectors, and a number
    that is passed on. At most k rows per query leave for each pair.
    """

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, queries = unpack(*(batch.column(c)[i] for c in range(3)))
                ids, base = unpack(*(batch.column(c)[i] for c in range(3, 6)))
                best = best_of(ids, base, queries, k, metric)
                if best is None:
                    continue
                columns = [
                    query_ids.take(best["query"].combine_chunks()),
                    best["doc_id"].combine_chunks(),
                    best["closeness"].combine_chunks(),
                    pa.repeat(batch.column(6)[i], best.num_rows),
                ]
                names = ["query_id", "doc_id", "closeness", "part"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return scan


def queries_by_cell(k, cells, centres, radii, sizes):
    """Function for ``mapInArrow``: packed queries of a task to the cells each must see.

    The k nearest vectors of a query lie within the reach of its nearest cells that
    hold k vectors together; a cell that begins beyond that is left out.
    """

    def route(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, queries = unpack(*(batch.column(c)[i] for c in range(3)))
                squares = (queries**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :]
                away = np.sqrt(np.maximum(squares - 2 * queries @ centres.T, 0.0))
                # Cells by the farthest that their vectors can be.
                farthest = away + radii[None, :]
                order = np.argsort(farthest, axis=1)
                held = np.cumsum(sizes[order], axis=1)
                enough = (held < k).sum(axis=1)
                reach = np.full(len(queries), np.inf)
                some = enough < len(cells)
                spot = order[np.arange(len(queries))[some], enough[some]]
                reach[some] = farthest[np.flatnonzero(some), spot]
                # The slack covers rounding of distances.
                seen = away - radii[None, :] <= reach[:, None] * (1 + 1e-9) + 1e-6
                for c in np.flatnonzero(seen.any(axis=0)):
                    mine = np.flatnonzero(seen[:, c])
                    part = ids.take(pa.array(mine))
                    columns = [
                        pa.array([cells[c]], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part),
                        pa.array([queries.shape[1]], pa.int32()),
                        pa.array([queries[mine].tobytes()], pa.binary()),
                    ]
                    names = ["cell", "query_ids", "query_dims", "query_vectors"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return route

"""What one task does with coded vectors: fitting a part, coding rows, and scoring codes."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from dockside.functions.nearest import matrix, unpack

# Tasks get these functions by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of codes packed into one, and compared at a time.
ROWS_PER_CHUNK = 16384
STEP = 1024


def code_centres(points: np.ndarray, most: int, rounds: int = 12) -> np.ndarray:
    """At most ``most`` centres of ``points``, by Lloyd's rounds from evenly spread ones."""
    known = np.unique(points, axis=0)
    centres = known[np.linspace(0, len(known) - 1, min(most, len(known))).astype(int)]
    if len(known) <= most:
        return centres
    for _ in range(rounds):
        nearest = np.concatenate([_nearest(points[i : i + STEP], centres) for i in range(0, len(points), STEP)])
        sums = np.stack([np.bincount(nearest, x, len(centres)) for x in points.T], axis=1)
        sizes = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def _edges(books: list[np.ndarray]) -> list[int]:
    return np.cumsum([0, *(book.shape[1] for book in books)]).tolist()


def encode_rows(centres: np.ndarray, books: list[np.ndarray]):
    """Function for ``mapInArrow`` over ``doc_id, embedding``: adds ``cell`` and ``codes``."""
    edges = _edges(books)

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column(1))
            if points.shape[1] != edges[-1]:
                raise ValueError("vectors must have one length")
            cells, codes = np.zeros(len(points), np.int32), np.zeros((len(points), len(books)), np.uint8)
            for start in range(0, len(points), STEP):
                step = slice(start, start + STEP)
                cells[step] = _nearest(points[step], centres)
                rest = points[step] - centres[cells[step]]
                for part, book in enumerate(books):
                    codes[step, part] = _nearest(rest[:, edges[part] : edges[part + 1]], book)
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            names = [*batch.schema.names, "cell", "codes"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), packed], names=names)

    return encode


def pack_codes():
    """Function for ``mapInArrow`` over ``doc_id, codes, cell``: chunks of rows of one cell."""

    def packed(batches):
        for batch in batches:
            cells = batch.column(2).to_numpy()
            for cell in np.unique(cells):
                held = batch.filter(pa.array(cells == cell))
                for start in range(0, held.num_rows, ROWS_PER_CHUNK):
                    part = held.slice(start, ROWS_PER_CHUNK)
                    ids = part.column(0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                            pa.array([b"".join(part.column(1).to_pylist())], pa.binary()),
                            pa.array([int(cell)], pa.int32()),
                        ],
                        names=["doc_ids", "codes", "cell"],
                    )

    return packed


def queries_by_nearest(centres: np.ndarray, n_probe: int):
    """Function for ``mapInArrow`` over packed queries: a row for each cell that some of them look at."""

    def route(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, queries = unpack(*(batch.column(c)[i] for c in range(3)))
                if queries.shape[1] != centres.shape[1]:
                    raise ValueError(f"expected vectors of {centres.shape[1]} numbers")
                far = (centres**2).sum(axis=1) - 2 * queries @ centres.T
                probed = np.argsort(far, axis=1, kind="stable")[:, :n_probe]
                for cell in np.unique(probed):
                    rows = np.flatnonzero((probed == cell).any(axis=1))
                    some = ids.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(cell)], pa.int32()),
                            pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), some),
                            pa.array([queries.shape[1]], pa.int32()),
                            pa.array([queries[rows].tobytes()], pa.binary()),
                        ],
                        names=["cell", "query_ids", "query_dims", "query_vectors"],
                    )

    return route


def score_codes(centres: np.ndarray, books: list[np.ndarray], keep: int):
    """Function for ``mapInArrow`` over pairs of packed queries and packed codes of one cell.

    Columns: query ids, dims and vectors, base ids and codes, cell, and a number that is passed on.
    At most ``keep`` rows per query leave for each pair: those with the least estimated distance.
    """
    edges = _edges(books)

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, queries = unpack(*(batch.column(c)[i] for c in range(3)))
                doc_ids = batch.column(3)[i].values
                codes = np.frombuffer(batch.column(4)[i].as_py(), np.uint8).reshape(-1, len(books))
                cell, part = (batch.column(c)[i].as_py() for c in (5, 6))
                rest = queries - centres[cell]
                query, row, far = [], [], []
                for q in range(len(rest)):
                    total = np.zeros(len(codes))
                    for p, book in enumerate(books):
                        table = ((book - rest[q, edges[p] : edges[p + 1]]) ** 2).sum(axis=1)
                        total += table[codes[:, p]]
                    best = np.arange(len(total))
                    if len(total) > keep:
                        bar = np.partition(total, keep - 1)[keep - 1]
                        best = np.flatnonzero(total <= bar)
                    query.append(np.full(len(best), q))
                    row.append(best)
                    far.append(total[best])
                row = np.concatenate(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        query_ids.take(pa.array(np.concatenate(query))),
                        doc_ids.take(pa.array(row)),
                        pa.array(np.full(len(row), cell, np.int32)),
                        pa.array(np.concatenate(far)),
                        pa.array(np.full(len(row), part, np.int32)),
                    ],
                    names=["query_id", "doc_id", "cell", "distance", "part"],
                )

    return score

"""Approximate nearest neighbours by product-quantised codes.

Vectors are clustered into cells. What is left of a vector after its cell's centre is cut into
parts, and each part is replaced by the number of the nearest of at most 256 centres for
that part: 16 bytes stand for a vector of 64 numbers (256 bytes). Cells and parts are fitted on a
sample of bounded size; every vector is coded. The table has codes and vectors as columns
of one row, in folders by cell.

A query reads the codes of its nearest cells alone. For each cell and part it has a table of
squared distances to the centres, so a code's distance is a sum of looked-up numbers. The
nearest codes are candidates; their vectors, and those of no other cells, are then
read for exact distances.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockside.functions.checks import at_least_one
from dockside.functions.code_search import (
    code_centres, encode_rows, pack_codes, queries_by_nearest, score_codes,
)
from dockside.operators.cells import CELL_PARTS, MOST_CELLS
from dockside.operators.vectors import _scored, finite, packed_queries
from dockside.session import store

# Rows that cells and codes are fitted on; of more, those with the smallest share of id hashes.
SAMPLE_ROWS = 65_536

# Centres of a part: a code is one byte.
CODES = 256


def build_codes(
    base: DataFrame,
    path: str,
    n_cells: int = 256,
    n_parts: int = 16,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
) -> None:
    """Write the index of ``base`` (``doc_id``, ``embedding``) to ``path``.

    Fitted on about ``sample_rows`` rows, chosen by hash of the id (all rows, if there are fewer). Vectors
    that are NULL or not finite are left out; all others are coded. ``rebalance`` lets AQE split a
    cell that holds much of the table between tasks.
    """
    if not 1 <= n_cells <= MOST_CELLS:
        raise ValueError(f"n_cells must be from 1 to {MOST_CELLS}")
    spark = base.sparkSession
    usable = base.select("doc_id", "embedding").where(finite("embedding"))
    rows = usable.count()
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(max(rows, 1))) < sample_rows
    sample = store(usable.where(chosen).select(F.col("embedding").cast("array<double>").alias("v")), "sample")
    dims = [r.n for r in sample.select(F.size("v").alias("n")).distinct().take(2)]
    if len(dims) > 1:
        raise ValueError("vectors must have one length")
    if not dims:
        centres, books = np.zeros((0, 0)), []
    else:
        points = sample.select("v", array_to_vector("v").alias("_v"))
        model = KMeans(k=n_cells, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(points)
        centres = np.array(model.clusterCenters())
        books = _fit_parts(sample, centres, min(n_parts, dims[0]))
    spark.createDataFrame(
        [(cell, [float(x) for x in row]) for cell, row in enumerate(centres)], "cell int, centre array<double>"
    ).write.mode("overwrite").parquet(f"{path}/centres")
    spark.createDataFrame(
        [(part, code, [float(x) for x in row]) for part, book in enumerate(books) for code, row in enumerate(book)],
        "part int, code int, centre array<double>",
    ).write.mode("overwrite").parquet(f"{path}/parts")
    # The type of the ids, also where there are no rows.
    usable.select("doc_id").limit(0).write.mode("overwrite").parquet(f"{path}/ids")
    schema = T.StructType(
        [*usable.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType())]
    )
    coded = usable.mapInArrow(encode_rows(centres, books), schema)
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")


def _fit_parts(sample: DataFrame, centres: np.ndarray, n_parts: int) -> list[np.ndarray]:
    """Centres of every part of what the cells leave; the parts are fitted side by side."""
    edges = [int(p[0]) for p in np.array_split(np.arange(centres.shape[1]), n_parts)] + [centres.shape[1]]

    def cut(frames):
        for frame in frames:
            if not len(frame):
                continue
            v = np.stack(frame["v"].to_numpy())
            rest = v - centres[((centres**2).sum(1) - 2 * v @ centres.T).argmin(axis=1)]
            for part in range(n_parts):
                yield pd.DataFrame({"part": part, "v": list(rest[:, edges[part] : edges[part + 1]])})

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        book = code_centres(np.stack(frame["v"].to_numpy()), CODES)
        return pd.DataFrame({"part": frame["part"].iloc[0], "code": np.arange(len(book)), "centre": list(book)})

    cuts = sample.select("v").mapInPandas(cut, "part int, v array<double>")
    # A group is as large as the sample, which is bounded.
    fitted = cuts.groupBy("part").applyInPandas(fit, "part int, code int, centre array<double>")
    return _books(fitted)


def _books(rows: DataFrame) -> list[np.ndarray]:
    held: dict[int, list] = {}
    for r in rows.orderBy("part", "code").collect():  # 256 times the length of a vector
        held.setdefault(r.part, []).append(r.centre)
    return [np.array(held[part]) for part in sorted(held)]


def knn_codes(
    queries: DataFrame,
    spark: SparkSession,
    path: str,
    k: int = 4,
    n_probe: int = 8,
    per_hit: int = 4,
) -> DataFrame:
    """About the k nearest vectors by squared distance, over a table of :func:`build_codes`.

    Columns as ``knn`` with ``l2sq``; ranks and scores are exact among what was found. A query looks at the
    codes of its ``n_probe`` nearest cells and at the vectors of ``per_hit * k`` candidates; more of either
    finds more, and all cells with as many candidates as vectors make it exact. Equal distances go by id.
    """
    k = at_least_one(k)
    asked = store(queries.select("query_id", "embedding").where("embedding IS NOT NULL"), "asked")
    # At most MOST_CELLS rows.
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    books = _books(spark.read.parquet(f"{path}/parts"))
    ids = spark.read.parquet(f"{path}/ids").schema["doc_id"].dataType
    kinds = {"query_id": asked.schema["query_id"].dataType, "doc_id": ids}
    if not len(centres):
        empty = T.StructType(
            [
                *(T.StructField(n, t) for n, t in kinds.items()),
                T.StructField("closeness", T.DoubleType()),
                T.StructField("rank", T.IntegerType()),
            ]
        )
        return _scored(spark.createDataFrame([], empty), "l2sq")
    stored = spark.read.parquet(f"{path}/rows")
    query_type = kinds["query_id"].simpleString()
    routed = store(
        packed_queries(asked).mapInArrow(
            queries_by_nearest(centres, n_probe),
            f"cell int, query_ids array<{query_type}>, query_dims int, query_vectors binary",
        ),
        "routed",
    )
    needed = sorted(r.cell for r in routed.select("cell").distinct().collect())
    doc_type = kinds["doc_id"].simpleString()
    chunks = stored.where(F.col("cell").isin(needed)).select("doc_id", "codes", "cell")
    chunks = chunks.mapInArrow(pack_codes(), f"doc_ids array<{doc_type}>, codes binary, cell int")
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(CELL_PARTS)).cast("int")
    pairs = chunks.withColumn("part", part).join(routed, "cell")
    schema = T.StructType(
        [
            T.StructField("query_id", kinds["query_id"]),
            T.StructField("doc_id", kinds["doc_id"]),
            T.StructField("cell", T.IntegerType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("part", T.IntegerType()),
        ]
    )
    names = ("query_ids", "query_dims", "query_vectors", "doc_ids", "codes", "cell", "part")
    found = pairs.select(*names).mapInArrow(score_codes(centres, books, k * per_hit), schema)
    # Ranked within parts first, so a query's rows never meet in one task before most are gone.
    for keys in (("query_id", "part"), ("query_id",)):
        order = Window.partitionBy(*keys).orderBy("distance", "doc_id")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k * per_hit)
    candidates = store(found.select("query_id", "doc_id", "cell"), "candidates")
    held = sorted(r.cell for r in candidates.select("cell").distinct().collect())
    vectors = stored.where(F.col("cell").isin(held)).select("cell", "doc_id", "embedding")
    near = candidates.join(vectors, ["cell", "doc_id"]).join(
        asked.select("query_id", F.col("embedding").alias("_asked")), "query_id"
    )
    apart = F.zip_with("embedding", "_asked", lambda x, y: x.cast("double") - y.cast("double"))
    squares = F.aggregate(apart, F.lit(0.0), lambda acc, d: acc + d * d)
    near = near.select("query_id", "doc_id", F.round(-squares, 10).alias("closeness"))
    order = Window.partitionBy("query_id").orderBy(F.desc("closeness"), F.asc("doc_id"))
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return _scored(ranked, "l2sq")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """How many of the ``exact`` hits were ``found``: ``queries, hits, exact_hits, recall``.

    A hit counts if it is no farther than the last exact one, so that ties are no faults.
    """
    last = exact.groupBy("query_id").agg(F.max("score").alias("reach"), F.count(F.lit(1)).alias("n"))
    counted = last.join(found, "query_id", "left").groupBy("query_id").agg(
        F.first("n").alias("n"), F.count_if(F.col("score") <= F.col("reach")).alias("hits")
    )
    return counted.agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("hits").alias("hits"),
        F.sum("n").alias("exact_hits"),
        (F.sum("hits") / F.sum("n")).alias("recall"),
    )

"""Vectors stored by cell, so that each query meets only the cells it needs.

The base is clustered once and written as a table partitioned by cell. Every cell
keeps its centre, its radius and its size. By the triangle inequality no vector of
a cell is nearer to a query than the centre's distance less the radius, so a cell
that begins beyond the reach of the k nearest is left out and the result is exact.
"""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockside.functions.checks import at_least_one
from dockside.functions.nearest import queries_by_cell
from dockside.operators.vectors import _scored, finite, packed_base, packed_queries, pair_search

# Bound of what is known of all cells at once: with 64 numbers each about 8 MB.
MOST_CELLS = 16_384

# Parts within which the hits of a query are ranked first.
CELL_PARTS = 64


def build_cells(base: DataFrame, path: str, n_cells: int = 256, seed: int = 7) -> None:
    """Write ``base`` (``doc_id``, ``embedding``) partitioned by cell.

    ``rebalance`` lets AQE split a cell that holds much of the table between
    tasks and join small ones, so no cell is one task's work. Vectors that are
    NULL or not finite are left out.
    """
    if not 1 <= n_cells <= MOST_CELLS:
        raise ValueError(f"n_cells must be from 1 to {MOST_CELLS}")
    usable = base.where(finite("embedding"))
    vectors = usable.select("doc_id", "embedding", array_to_vector("embedding").alias("_v"))
    model = KMeans(k=n_cells, seed=seed, featuresCol="_v", predictionCol="cell").fit(vectors)
    spark = base.sparkSession
    centres = spark.createDataFrame(
        [(cell, [float(x) for x in centre]) for cell, centre in enumerate(model.clusterCenters())],
        "cell int, centre array<double>",
    )
    assigned = model.transform(vectors).select("doc_id", "embedding", "cell")
    assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(
        f"{path}/vectors"
    )
    stored = spark.read.parquet(f"{path}/vectors")
    differences = F.zip_with("embedding", "centre", lambda x, c: x.cast("double") - c)
    distance = F.sqrt(F.aggregate(differences, F.lit(0.0), lambda acc, d: acc + d * d))
    sizes = (
        stored.join(centres, "cell")
        .groupBy("cell")
        .agg(F.max(distance).alias("radius"), F.count(F.lit(1)).alias("n"))
    )
    sizes.join(centres, "cell").write.mode("overwrite").parquet(f"{path}/cells")


def route_queries(queries: DataFrame, spark: SparkSession, path: str, k: int) -> DataFrame:
    """Packed queries of each cell they must see: ``cell, query_ids, query_dims, query_vectors``."""
    # At most MOST_CELLS rows.
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    blocks = packed_queries(queries)
    id_type = blocks.schema["query_ids"].dataType.simpleString()
    schema = f"cell int, query_ids {id_type}, query_dims int, query_vectors binary"
    if not cells:
        return spark.createDataFrame([], schema)
    route = queries_by_cell(
        k,
        [row.cell for row in cells],
        np.array([row.centre for row in cells]),
        np.array([row.radius for row in cells]),
        np.array([row.n for row in cells]),
    )
    return blocks.mapInArrow(route, schema)


def knn_cells(queries: DataFrame, spark: SparkSession, path: str, k: int = 4) -> DataFrame:
    """As ``knn`` with ``l2sq``, over a table written by :func:`build_cells`.

    Queries are joined with the vectors of their own cells; folders of cells that no
    query needs are not read.
    """
    k = at_least_one(k)
    routed = route_queries(queries, spark, path, k)
    needed = sorted(row.cell for row in routed.select("cell").distinct().collect())
    stored = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(needed))
    chunks = packed_base(stored.select("doc_id", "embedding", "cell"), by="cell")
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(CELL_PARTS)).cast("int")
    pairs = chunks.withColumn("part", part).join(routed, "cell")
    return _scored(pair_search(pairs, F.col("part"), k, "l2sq"), "l2sq")

"""Text vectors and nearest-neighbour search for a table of queries."""

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, IDF, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockside.functions.checks import at_least_one, clamp_k
from dockside.functions.nearest import nearest_in_pairs, nearest_in_parts, pack
from dockside.session import store

# Fixed value: length of a text vector.
DIMENSIONS = 384

# Rows packed into one: bounds what a task compares at a time.
QUERIES_PER_BLOCK = 1024
ROWS_PER_CHUNK = 8192
# Blocks of queries that a task holds while base vectors go by.
BLOCKS_HELD = 16


# ---- text vectors ----------------------------------------------------------


def fit_vectorizer(corpus: DataFrame, text_col: str = "text", dims: int = DIMENSIONS) -> PipelineModel:
    """Hashed TF-IDF vectors of unit length, as a fitted Spark ML pipeline.

    Words go to ``dims`` buckets by hash, so there is no vocabulary to collect;
    fitting is one distributed pass that counts documents per bucket.
    """
    words = RegexTokenizer(
        inputCol=text_col, outputCol="_words", pattern="[\\p{L}\\p{N}]+", gaps=False, toLowercase=True
    )
    buckets = SQLTransformer(
        statement=(
            "SELECT *, transform(_words, w -> string(pmod("
            f"bigint(conv(substr(md5(w), 1, 8), 16, 10)), {dims}))) AS _buckets FROM __THIS__"
        )
    )
    counts = CountVectorizerModel.from_vocabulary(
        [str(bucket) for bucket in range(dims)], inputCol="_buckets", outputCol="_counts"
    )
    weights = IDF(inputCol="_counts", outputCol="_weights")
    unit = Normalizer(inputCol="_weights", outputCol="_unit", p=2.0)
    return Pipeline(stages=[words, buckets, counts, weights, unit]).fit(corpus)


def embed_corpus(df: DataFrame, vectorizer: PipelineModel) -> DataFrame:
    """``df`` with an ``embedding`` column, from a fitted vectorizer."""
    vectors = vectorizer.transform(df.select("*"))
    return vectors.select(*df.columns, vector_to_array("_unit", "float32").alias("embedding"))


def embed_with_model(df: DataFrame, load_model, text_col="text", batch_rows: int = 32) -> DataFrame:
    """``df`` with an ``embedding`` column from a model of the caller's own.

    ``load_model()`` runs once per task and returns a function from a list of
    texts to a list of vectors; it sees at most ``batch_rows`` texts at a time.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def encode(frames):
        model = load_model()
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                part = frame.iloc[start : start + batch_rows]
                vectors = model(part[text_col].tolist())
                yield part.assign(embedding=[np.asarray(v, dtype="float32") for v in vectors])

    return df.mapInPandas(encode, schema)


def finite(vector: str) -> Column:
    """Whether a vector is there and has only finite numbers."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One mean vector of unit length per key: ``query_id``, ``embedding``.

    Vectors that are NULL or hold a NULL or non-finite number are left out; those of
    different lengths under one key stop the job. A zero mean stays zero.
    """
    usable = df.where(finite(vector))
    points = array_to_vector(F.col(vector).cast("array<double>"))
    means = usable.groupBy(F.col(key).alias("query_id")).agg(Summarizer.mean(points).alias("mean"))
    mean = means.select("query_id", vector_to_array("mean").alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = F.transform("mean", lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))
    return mean.select("query_id", unit.alias("embedding"))


# ---- nearest neighbours ----------------------------------------------------


def packed_queries(queries: DataFrame, rows: int = QUERIES_PER_BLOCK) -> DataFrame:
    """Queries in blocks: ``query_ids, query_dims, query_vectors``.

    Ids must be unique and not NULL, vectors finite; one look at the queries, which
    are then read from the shared folder, makes sure of it.
    """
    asked = store(queries.select("query_id", "embedding").where("embedding IS NOT NULL"), "queries")
    seen = asked.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("query_id").alias("ids"),
        F.count_if(~finite("embedding")).alias("odd"),
    ).first()
    if seen.n != seen.ids:
        raise ValueError("query_id must be unique and not NULL")
    if seen.odd:
        raise ValueError("query vectors must be finite")
    id_type = asked.schema["query_id"].dataType.simpleString()
    names = ("query_ids", "query_dims", "query_vectors")
    return asked.mapInArrow(
        pack(rows, names), f"query_ids array<{id_type}>, query_dims int, query_vectors binary"
    )


def packed_base(base: DataFrame, rows: int = ROWS_PER_CHUNK, by: str | None = None) -> DataFrame:
    """Comparable base vectors in chunks: ``doc_ids, doc_dims, doc_vectors``.

    With ``by``, an int column, a chunk has one value of it, which is a column, too.
    """
    id_type = base.schema["doc_id"].dataType.simpleString()
    names = ("doc_ids", "doc_dims", "doc_vectors")
    usable = base.select("doc_id", "embedding", *([by] if by else [])).where(finite("embedding"))
    kind = f", {by} int" if by else ""
    return usable.mapInArrow(
        pack(rows, (*names, by) if by else names),
        f"doc_ids array<{id_type}>, doc_dims int, doc_vectors binary{kind}",
    )


def pair_search(pairs: DataFrame, part: Column, k: int, metric: str) -> DataFrame:
    """The k nearest of every query over pairs of packed queries and base vectors.

    Ranked twice: within ``part``, a number that many pairs share, and then over
    what these leave, so a query's rows never meet in one task before most are gone.
    """
    found = pairs.select(*PACKED, part.cast("int").alias("part")).mapInArrow(
        nearest_in_pairs(k, metric), _found_schema(pairs)
    )
    return _ranked(found, k)


PACKED = ("query_ids", "query_dims", "query_vectors", "doc_ids", "doc_dims", "doc_vectors")


def _found_schema(packed: DataFrame) -> T.StructType:
    ids = {n: packed.schema[n].dataType.elementType for n in ("query_ids", "doc_ids")}
    return T.StructType(
        [
            T.StructField("query_id", ids["query_ids"]),
            T.StructField("doc_id", ids["doc_ids"]),
            T.StructField("closeness", T.DoubleType()),
            T.StructField("part", T.IntegerType()),
        ]
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    for keys in (("query_id", "part"), ("query_id",)):
        order = Window.partitionBy(*keys).orderBy(F.desc("closeness"), F.asc("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "doc_id", "closeness", "rank")


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int = 4,
    metric: str = "cosine",
    per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """The k nearest base vectors of every query.

    ``queries`` has ``query_id`` (unique) and ``embedding``; ``base`` has
    ``doc_id`` and ``embedding``. The result has ``query_id``, ``doc_id``,
    ``rank``, ``closeness`` (greater is nearer) and ``score``: the cosine, or
    for ``l2sq`` the squared distance, to four places. Equal closeness goes by
    ``doc_id``. Base vectors that are NULL or hold a NULL or non-finite number are
    not comparable and never found; the cosine with a zero vector is 0.

    The base is read once, in chunks of packed rows that are dealt to as many parts
    as there are shuffle partitions; every part gets each block of queries and holds these while its
    chunks go by, so a chunk is copied to Python once for 16 blocks. The plan is the same for any
    number of queries.
    """
    if metric not in ("cosine", "l2sq"):
        raise ValueError("metric must be cosine or l2sq")
    return _scored(_nearest(queries, base, at_least_one(k), metric, per_block), metric)


def _nearest(queries, base, k, metric, per_block=QUERIES_PER_BLOCK) -> DataFrame:
    """Ranked rows of :func:`knn`."""
    dealt = _dealt(queries, base, per_block)
    found = dealt.mapInArrow(nearest_in_parts(k, metric), _found_schema(dealt))
    return _ranked(found, k)


def _dealt(queries, base, per_block=QUERIES_PER_BLOCK) -> DataFrame:
    """``part`` and packed rows, sorted: of each part its queries, and then its base vectors."""
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = packed_queries(queries, per_block)
    n = blocks.agg(F.sum(F.size("query_ids"))).first()[0] or 0
    # Queries beyond what a task holds are another group, which meets all base vectors in parts of its own.
    groups = max(1, -(-n // (BLOCKS_HELD * per_block)))

    def any_of(number: int):
        return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(number)).cast("int")

    def each_of(number: int):
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    chunks = packed_base(base).withColumn("_part", any_of(parts)).withColumn("_group", each_of(groups))
    blocks = blocks.withColumn("_group", any_of(groups)).withColumn("_part", each_of(parts))
    part = (F.col("_part") * groups + F.col("_group")).cast("int").alias("part")
    both = blocks.select(part, *PACKED[:3]).unionByName(chunks.select(part, *PACKED[3:]), allowMissingColumns=True)
    dealt = both.repartition("part").sortWithinPartitions("part", F.col("query_ids").isNull())
    return dealt.select("part", *PACKED)


def _scored(ranked: DataFrame, metric: str) -> DataFrame:
    sign = -1.0 if metric == "l2sq" else 1.0
    # "+ 0.0" turns a negative zero into zero.
    score = F.round(F.col("closeness") * sign + F.lit(0.0), 4).alias("score")
    return ranked.select("query_id", "doc_id", "rank", "closeness", score)


def search(
    queries: DataFrame,
    base: DataFrame,
    texts: DataFrame,
    k: int = 4,
    metric: str = "l2sq",
) -> DataFrame:
    """Hits with their text: ``query_id, rank, doc_id, text, source, relevance_score``.

    ``base`` has ``doc_id`` and ``embedding``, ``texts`` has ``doc_id``, ``text`` and
    ``source``: only hits meet texts. At most ten hits per query, as a search tool
    gives. Relevance is one minus the distance, to three places.
    """
    if metric not in ("cosine", "l2sq"):
        raise ValueError("metric must be cosine or l2sq")
    hits = _nearest(queries, base, clamp_k(k), metric)
    distance = -F.col("closeness") if metric == "l2sq" else 1 - F.col("closeness")
    return texts.select("doc_id", "text", "source").join(hits, "doc_id").select(
        "query_id",
        "rank",
        "doc_id",
        "text",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        (F.round(1 - distance, 3) + F.lit(0.0)).alias("relevance_score"),
    )


def search_context(hits: DataFrame) -> DataFrame:
    """Hit texts of each query, best first, joined by a blank line (at most ten)."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    context = F.array_join(F.transform(ranked, lambda hit: hit["text"]), "\n\n")
    return hits.groupBy("query_id").agg(context.alias("context"))

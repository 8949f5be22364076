"""A corpus from raw documents: five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``. Scores, fingerprints,
windows, postings and queues are made from all rows a stage gets; only the
toxicity model is fitted on a bounded sample of labelled rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockside.llm import decontaminate, packing, simhash, substring_dedup, toxicity
from dockside.llm.catalog import read, vocabulary
from dockside.llm.common import in_files, row_numbers, store

# Rows that one bitmap tells of, and bitmaps (4 KB each) that one broadcast holds: 64 MB.
ROWS_TOLD = 32768
MAPS_TOLD = 16384


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column has it."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows of a table in files with a column that tells them apart, and the name of that column."""
    name = free_name("_row", docs.columns)
    place = F.concat_ws(":", F.col(f"{name}.file"), F.col(f"{name}.number"))
    return row_numbers(docs, name).withColumn(name, place), name


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a table in files that are not the ``row`` of one of ``dropped``.

    ``row`` ends with a row's file and its number there. Dropped rows become bitmaps
    of 32,768 rows of one file. These go to where the texts are read, at most
    64 MB of them at a time: a larger table is read in ranges of files, each with
    its own bitmaps. No text is shuffled, however many rows are dropped.
    """
    place = F.split("row", ":")
    file, number = (F.element_at(place, k).cast("long") for k in (-2, -1))
    gone = dropped.select(file.alias("file"), number.alias("number"))
    maps = gone.groupBy("file", F.floor(F.col("number") / ROWS_TOLD).alias("stretch")).agg(
        F.bitmap_construct_agg(F.col("number") % ROWS_TOLD).alias("bits")
    )
    maps = store(maps, "dropped")
    if maps.count() <= MAPS_TOLD:
        return _unmarked(docs, maps)
    # Files and how many bitmaps each has; a driver that lists the table holds as many names.
    path = F.col("_metadata.file_path")
    files = docs.select(path.alias("path")).distinct().withColumn("file", F.xxhash64("path"))
    sizes = maps.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    listed = files.join(sizes, "file", "left").orderBy("path").select("path", "file", F.coalesce("n", F.lit(0)))
    ranges, held = [], MAPS_TOLD + 1
    for name, number, n in listed.collect():
        if held + n > MAPS_TOLD:
            ranges.append([])
            held = 0
        ranges[-1].append((name, number))
        held += n
    kept = None
    for part in ranges:
        some = docs.where(path.between(part[0][0], part[-1][0]))
        rows = _unmarked(some, maps.where(F.col("file").isin([number for _, number in part])))
        kept = rows if kept is None else kept.unionAll(rows)
    return kept


def _unmarked(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows whose bit is not set in ``maps``, which has a bounded size."""
    name = free_name("_place", docs.columns)
    rows, maps = row_numbers(docs, name).alias("rows"), F.broadcast(maps).alias("maps")
    file, number = F.col(f"rows.{name}.file"), F.col(f"rows.{name}.number")
    found = (file == F.col("maps.file")) & (F.floor(number / ROWS_TOLD) == F.col("maps.stretch"))
    at = (number % ROWS_TOLD).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("maps.bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    power = F.pow(F.lit(2), at % 8).cast("int")
    set_bit = byte.cast("int").bitwiseAND(power) > 0
    kept = rows.join(maps, found, "left").where(~F.coalesce(set_bit, F.lit(False)))
    return kept.select(*[F.col(f"rows.`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    A NULL text is judged as an empty one; each of repeated rows is judged by itself.
    An empty table stays empty. Nothing is shuffled but the labelled rows it learns from.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: with the smallest id, NULL last.

    Of rows that share that id the one with the smallest hash of its values stays,
    and of equal rows any one. NULL and empty texts are near-duplicates of each other.
    An empty table stays empty.
    """
    docs = in_files(docs)
    rows, name = with_row(docs)
    # Numbers that sort by the row's values first.
    values = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])), 16, "0")
    rows = rows.withColumn(name, F.concat_ws(":", values, name))
    found = store(simhash.near_duplicates(rows, name), "near")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # Combined before the shuffle, so a hot group is a row per task.
    first = found.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    # Stored, so that Spark can split a hot group's rows when it joins them.
    first = store(first.where("n > 1").select("component", F.col("first.row").alias("kept")), "first")
    return without(docs, found.join(first, "component").where("row <> kept"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has, too.

    Where nothing is left of a document that had words, it goes.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = substring_dedup.remove_repeats(docs, with_text=True, carry=others)
    kept = kept.where("n_words = 0 OR n_removed < n_words")
    columns = {
        "doc_id": F.col("doc_id"),
        "text": F.col("kept_text").alias("text"),
        "n_chars": F.char_length("kept_text").cast("long").alias("n_chars"),
    }
    return kept.select(*[columns.get(c, F.col(f"carried.{c}").alias(c)) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule does not call contaminated.

    NULL and empty texts are clean; every row is judged by itself, whether its id is NULL or
    repeated. An empty table stays empty.
    """
    docs = in_files(docs)
    rows, name = with_row(docs)
    found = decontaminate.contamination(rows, read(spark, sf_dir, "benchmark"), row=name)
    return without(docs, found.where("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, every window with the corpus's mix of sources.

    A NULL or empty text is its end token alone, a NULL source a source of its own; repeated
    rows are packed as often as they stand there. An empty table gives no piece.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# A fitted classifier has no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)

"""Every stage of the pipeline on its own input, against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dockside.llm import simhash, toxicity
from dockside.llm.packing import encode_documents
from dockside.llm.catalog import vocabulary
from test_decontaminate import brute as contaminated
from test_substring_dedup import SPLIT, brute as repeats

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """Input and result of each stage, the inputs written and read again."""
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    found = []
    for _, stage in corpus_pipeline.STAGES:
        done = corpus_pipeline.store(stage(spark, docs, SOURCE), "stage")
        found.append((docs, done))
        docs = done
    return found


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_all_but_the_last_keep_the_columns(results):
    for before, after in results[:4]:
        assert before.dtypes == after.dtypes
        assert 0 < after.count() <= before.count()


def test_toxic_documents_go(spark, results):
    before, after = map(rows_of, results[0])
    docs = results[0][0]
    model = toxicity.fit(docs, spark.read.parquet(f"{SOURCE}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    assert set(after) == set(before) - bad
    assert all(after[i] == before[i] for i in after)


def test_one_of_each_group_stays(results):
    before, after = map(rows_of, results[1])
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(results[1][0]).collect()}
    assert set(after) == {i for i in before if groups[i] == i} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_repeated_passages_go(results):
    before, after = map(rows_of, results[2])
    want = {i: (n, gone, digest) for i, n, gone, digest in repeats([(i, r.text) for i, r in before.items()])}
    for i, (n, gone, digest) in want.items():
        if n and gone == n:
            assert i not in after
            continue
        kept = " ".join(SPLIT.findall(after[i].text))
        assert hashlib.sha256(kept.encode()).hexdigest() == digest
        if not gone:
            assert after[i] == before[i]
        assert after[i].n_chars == len(after[i].text)
        assert (after[i].lang, after[i].source) == (before[i].lang, before[i].source)


def test_contaminated_documents_go(spark, results):
    before, after = map(rows_of, results[3])
    items = [tuple(r) for r in spark.read.parquet(f"{SOURCE}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(i, r.text) for i, r in before.items()], items) if r[5]}
    assert bad and set(after) == set(before) - bad
    assert all(after[i] == before[i] for i in after)


def test_all_tokens_are_packed(results):
    docs, pieces = results[4]
    counted = encode_documents(docs, vocabulary("word_bpe_49k.json"))
    want = counted.groupBy("doc_id").agg(F.sum("n").alias("n"))
    got = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("sequence_id").alias("s"))
    sizes = {r.s: r.n for r in by.collect()}
    assert all(n == 2048 for s, n in sizes.items() if s != max(sizes))


def test_rows_without_id_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(None, "a b", "en", None, 3), (1, None, None, "s", None), (1, "", "en", "s", 0), (2, "a b", "en", "t", 3)],
        spark.read.parquet(f"{SOURCE}/documents.parquet").schema,
    )
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.store(stage(spark, frame, SOURCE), "stage")
        frame.collect()


@pytest.mark.parametrize("stored", [True, False])
def test_rows_are_judged_one_by_one(spark, stored):
    passage = max((r.text for r in spark.read.parquet(f"{SOURCE}/benchmark.parquet").collect()), key=len)
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    # Id and text; the copies of one text are next to each other.
    given = [(None, a), (None, a), (None, passage), (None, passage), (5, passage), (5, b), (9, b), (9, b)]
    given += [(None, b), (5, c), (5, c)]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in given],
        spark.read.parquet(f"{SOURCE}/documents.parquet").schema,
    ).repartition(3)
    if stored:
        docs = corpus_pipeline.store(docs, "given")
    dealt = corpus_pipeline.drop_near_duplicates(spark, docs, SOURCE)
    assert dealt.dtypes == docs.dtypes
    def key(r):
        return (r[0] or 0, r[1])

    want = [(None, a), (5, passage), (5, b), (5, c)]
    assert sorted([(r.doc_id, r.text) for r in dealt.collect()], key=key) == sorted(want, key=key)
    clean = corpus_pipeline.drop_contaminated(spark, docs, SOURCE)
    assert clean.dtypes == docs.dtypes
    want = [r for r in given if r[1] != passage]
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=key) == sorted(want, key=key)


@pytest.fixture
def without_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def clashing(spark, n, files):
    """A stored table with columns of the names that the stages like."""
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("text "), F.col("id")).alias("text"),
        F.lit("keep").alias("_row"),
        F.lit("me").alias("_PLACE"),
        F.lit(7).alias("file"),
        F.lit(8).alias("bits"),
    )
    return corpus_pipeline.store(rows.repartition(files), "given")


@pytest.mark.parametrize("told,stretch", [(16384, 32768), (1, 16), (3, 8)])
def test_dropped_rows_by_file(spark, without_broadcast, monkeypatch, told, stretch):
    """Any rows of any files, in one go or in ranges of files; other columns stay as they are."""
    monkeypatch.setattr(corpus_pipeline, "MAPS_TOLD", told)
    monkeypatch.setattr(corpus_pipeline, "ROWS_TOLD", stretch)
    docs = clashing(spark, 300, 5)
    rows, name = corpus_pipeline.with_row(docs)
    for condition in ("doc_id % 3 = 0", "doc_id < 0", "true", "doc_id % 100 = 99"):
        dropped = rows.where(condition).select(F.concat(F.lit("any:"), name).alias("row"))
        kept = corpus_pipeline.without(docs, dropped)
        assert kept.dtypes == docs.dtypes
        assert sorted(kept.collect()) == sorted(docs.where(f"NOT ({condition})").collect())
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_texts_stay_where_they_are(spark, without_broadcast):
    """Whatever is dropped, no exchange carries a text."""
    docs = corpus_pipeline.store(spark.read.parquet(f"{SOURCE}/documents.parquet"), "given")
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        kept = stage(spark, docs, SOURCE)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        assert "BroadcastHashJoin" in plan


def test_columns_of_clashing_names_survive(spark):
    schema = spark.read.parquet(f"{SOURCE}/documents.parquet").schema
    docs = clashing(spark, 40, 2).withColumn("source", F.lit("s")).unionByName(
        clashing(spark, 40, 2).withColumn("source", F.lit("s"))
    )
    assert {"doc_id", "text"} <= set(schema.fieldNames())
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SOURCE)
    assert kept.dtypes == docs.dtypes
    assert {(r._row, r._PLACE, r.file, r.bits) for r in kept.collect()} == {("keep", "me", 7, 8)}
    clean = corpus_pipeline.drop_contaminated(spark, docs, SOURCE)
    assert sorted(clean.collect()) == sorted(docs.collect())

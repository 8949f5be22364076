import random
import zlib

import pytest

from dockside.llm import toxicity


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(80)]
    rude = ["idiot", "scum", "moron"]
    rows = []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(5)] = rng.choice(rude)
        # Groups stand in toxic texts far more often than in others.
        if rng.random() < (0.8 if toxic else 0.05):
            words.append(rng.choice(["muslims", "women", "immigrants"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def frames(spark, sentences):
    docs = spark.createDataFrame(
        [(i, t, 1.0, "x") for i, t, _ in sentences], "doc_id long, text string, score double, toxic string"
    )
    labels = spark.createDataFrame(
        [(i, y, y) for i, _, y in sentences], "doc_id long, quality int, toxic int"
    )
    return docs, labels


def auc(pairs):
    ones = [s for s, y in pairs if y]
    zeros = [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_held_out_accuracy(frames, sentences):
    docs, labels = frames
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    label = {i: y for i, _, y in sentences}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out]
    assert auc(held) > 0.97
    assert sum((s >= 0.5) == bool(y) for s, y in held) > 0.9 * len(held)


def test_swaps_take_the_weight_from_groups(frames):
    docs, labels = frames
    free = toxicity.fit(docs, labels, swap_penalty=0.0)
    fair = toxicity.fit(docs, labels, swap_penalty=10.0)

    def weight(model, word):
        return sum(model.weights.get(f, 0.0) for f in toxicity.features_of(word))

    for word in (b"muslims", b"women", b"immigrants"):
        assert weight(free, word) > 0.5
        change = weight(fair, word) - weight(fair, b"people")
        assert abs(change) < 0.35 * abs(weight(free, word) - weight(free, b"people"))
    assert weight(fair, b"idiot") > 1


def test_neutral_mentions_of_groups_get_lower_scores(spark, frames):
    docs, labels = frames
    rng = random.Random(8)
    groups = ["muslims", "women", "immigrants"]
    rows = []
    for i in range(120):
        words = [f"word{rng.randrange(80)}" for _ in range(rng.randint(5, 30))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, groups[i % 3]]))]
    neutral = spark.createDataFrame(rows, "doc_id long, text string")

    def scores(penalty):
        got = toxicity.score(neutral, toxicity.fit(docs, labels, swap_penalty=penalty)).collect()
        return {r.doc_id: r.score for r in got}

    free, fair = scores(0.0), scores(10.0)
    mentions = [i for i, _ in rows if i % 2]

    def rise(by):
        return sum(by[i] - by[i - 1] for i in mentions) / len(mentions)

    def wrong(by):
        return sum(by[i] >= 0.5 for i in mentions)

    assert rise(fair) < 0.5 * rise(free)
    assert sum(fair[i] for i in mentions) < sum(free[i] for i in mentions)
    assert wrong(fair) < wrong(free)


def test_training_never_sees_the_held_out_fifth(spark, frames):
    docs, labels = frames
    flipped = labels.selectExpr(
        "doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - toxic, toxic) AS toxic"
    )
    assert toxicity.fit(docs, labels, steps=20) == toxicity.fit(docs, flipped, steps=20)


def test_odd_rows(spark, frames):
    docs, labels = frames
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (None, "idiot"), (4, "idiot " * 30000), (4, "ok"), (5, " é ü")],
        "doc_id long, text string",
    )
    got = toxicity.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, round(r.score, 3)): r for r in got}
    (plain,) = {r.score for r in got if r.doc_id in (1, 2)}
    assert plain < 0.5
    assert max(by, key=lambda k: k[1])[0] in (4, None)


def test_empty_tables(spark, frames):
    docs, labels = frames
    none = toxicity.fit(docs, labels.limit(0))
    assert none.weights == {} and none.bias < 0
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), none).collect() == []
    assert toxicity.fit(docs.limit(0), labels).weights == {}

"""Class-based scores against a plain reading of their definition, and the exchange against its likelihood."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockside.llm import brown
from dockside.llm.brown import ALL, CLASSES, END, OTHER, class_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
def split():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2



def tokens_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), ""]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows, class_of):
    """Scores of all rows, given the class of each training word."""
    docs = [(i, held_out(i), tokens_of(t)) for i, t in rows]
    n = Counter(w for _, out, ws in docs if not out for w in ws)
    total = sum(n.values())
    size, moved = Counter(), Counter()
    for w, k in n.items():
        size[class_of[w]] += k
    for _, out, ws in docs:
        for a, b in zip(["", *ws[:-1]], ws) if not out else ():
            for c in {class_of[a], OTHER if n[a] == 1 and a else class_of[a]}:
                for d in {class_of[b], OTHER if n[b] == 1 else class_of[b]}:
                    moved[c, d] += 1
    single = sum(k == 1 for k in n.values())
    leaves = Counter()
    for (c, _), k in moved.items():
        leaves[c] += k

    def share(c):
        return (single + 1 if c == OTHER else size[c]) / (total + single + 1)

    out = []
    for i, held, ws in docs:
        base = score = 0.0
        last = class_of.get("", OTHER)
        for w in ws:
            c = class_of.get(w, OTHER)
            base += math.log10((n[w] + 1) / (total + len(n) + 1))
            score += math.log10((moved[last, c] + CLASSES * share(c)) / (leaves[last] + CLASSES))
            score += math.log10(n[w] / size[c]) if n[w] else 0.0
            last = c
        out.append((i, held, len(ws), sum(n[w] > 0 for w in ws), total, base, score))
    return out


def check(model, rows):
    class_of = {bytes(r.word).decode(): r["class"] for r in model.words.collect()}
    counts = {bytes(r.word).decode(): r.n for r in model.words.collect()}
    n = Counter(w for i, t in rows if not held_out(i) for w in tokens_of(t))
    assert counts == dict(n) and all(1 <= c <= CLASSES or (c, w) == (END, "") for w, c in class_of.items())
    got = sorted(map(tuple, model.scores.collect()), key=repr)
    want = sorted(brute(rows, class_of), key=repr)
    assert len(got) == len(want)

    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 4), round(r[6], 4))

    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_scores(make_docs, corpus):
    rows = [*corpus, (500, "once-only words here"), (501, "never w1 seen-before"), (501, "never w1 seen-before")]
    check(class_model(make_docs(rows), split(), rounds=2), rows)


@pytest.mark.parametrize("core,block", [(4, 1), (16, 300), (10**9, 1 << 20)])
def test_any_core_and_blocks(make_docs, corpus, monkeypatch, core, block):
    """Whatever part of the words is the core, and whatever the blocks are."""
    monkeypatch.setattr(brown, "CORE_ONE_IN", core)
    monkeypatch.setattr(brown, "BLOCK_BYTES", block)
    monkeypatch.setattr(brown, "MOST_COUNTED", 50)
    rows = [r for r in corpus if r[0] is None or r[0] < 120 or r[0] > 299][:70]
    check(class_model(make_docs(rows), split(), rounds=1), rows)


def test_nothing_to_learn_from(make_docs):
    empty = class_model(make_docs([(1, "a")]).limit(0), split())
    assert empty.scores.collect() == [] and empty.words.collect() == []
    out = [i for i in range(100) if held_out(i)][:3]
    rows = [(i, "some words") for i in out]
    for row in class_model(make_docs(rows), split()).scores.collect():
        assert tuple(row)[1:] == (True, 3, 0, 0, 0.0, 0.0)
    rows = [(None, None), (None, ""), (out[0], "x")]
    check(class_model(make_docs(rows), split()), rows)


def test_model_is_a_distribution(make_docs, corpus):
    model = class_model(make_docs(corpus), split(), rounds=1)
    assert model.transitions.sum(axis=1) == pytest.approx(np.ones(ALL))
    sizes = defaultdict(int)
    for r in model.words.collect():
        sizes[r["class"]] += r.n
    # Emissions of a class add up to 1, and classes without words are as good as never entered.
    empty = [c for c in range(OTHER) if not sizes[c]]
    assert model.transitions[:, empty].sum() == 0


def sentences(rng, n):
    kinds = [[f"{k}{i}" for i in range(12)] for k in "dnv"]
    return [" ".join(rng.choice(kinds[j % 3]) for j in range(rng.randint(6, 30))) for _ in range(n)]


def test_exchange_finds_kinds_of_words(make_docs, monkeypatch):
    """Words that can stand for one another come together, and held-out texts gain by it."""
    monkeypatch.setattr(brown, "CLASSES", 3)
    monkeypatch.setattr(brown, "OTHER", 4)
    monkeypatch.setattr(brown, "ALL", 5)
    rows = list(enumerate(sentences(random.Random(2), 300)))
    model = class_model(make_docs(rows), split())
    kinds = defaultdict(Counter)
    for r in model.words.where("length(word) > 0").collect():
        kinds[r["class"]][bytes(r.word).decode()[0]] += 1
    assert sum(max(c.values()) for c in kinds.values()) >= 34 and len(kinds) == 3
    total = model.scores.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > 0.75 * total[1]


def test_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 50, (ALL, ALL))
    # A word between classes that it cannot be in itself.
    code = np.array([END, OTHER, ALL + END, ALL + OTHER])
    n = np.array([3, 4, 2, 5])
    best = brown.best_classes(table, np.zeros(4, int), code, n, np.array([7]))[0]
    values = {}
    for c in range(1, CLASSES + 1):
        moved = table.copy()
        moved[END, c] += 3
        moved[OTHER, c] += 4
        moved[c, END] += 2
        moved[c, OTHER] += 5
        values[c] = brown.likelihood(moved)
    assert values[best] == pytest.approx(max(values.values()))


def test_rows_of_a_word_meet_over_batches(spark, make_docs, corpus, monkeypatch):
    monkeypatch.setattr(brown, "BLOCK_BYTES", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = corpus[:60]
        check(class_model(make_docs(rows), split(), rounds=1), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

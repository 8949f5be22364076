import hashlib
import re

import pytest

from dockside.llm import decontaminate
from dockside.llm.decontaminate import Phrases, Postings, contamination, find_phrases, windows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, size=13):
    windows = []
    for key, t in items:
        w = words(t)
        if w:
            windows += [(key, w[p : p + size]) for p in range(max(1, len(w) - size + 1))]
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for key, v in windows:
            for p in range(len(w) - len(v) + 1):
                if w[p : p + len(v)] == v:
                    hit.update(range(p, p + len(v)))
                    found.add(str(key))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        bad = bool(hit) and 20 * len(hit) >= len(w)
        out.append((i, len(w), len(hit), len(found), digest, bad))
    return sorted(out, key=repr)


@pytest.fixture
def items(corpus):
    long = corpus[4][1].split()
    return [
        (1, " ".join(long[2:30])),
        (10, " ".join(long[:20]).upper()),
        (2, "w1 w2"),
        (3, "one"),
        (4, None),
        (5, "?!"),
        (6, corpus[60][1]),
    ]


def test_as_brute_force(spark, make_docs, corpus, items):
    bench = spark.createDataFrame(
        [(k, t, "x") for k, t in items], "item_id long, text string, doc_id string"
    )
    rows = [r for r in corpus if r[0] != 305]
    got = [tuple(r) for r in contamination(make_docs(rows), bench).collect()]
    assert sorted(got, key=repr) == brute(rows, items)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_empty_tables(spark, make_docs, items):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = contamination(make_docs([(1, "a b"), (2, None)]), bench).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in sorted(got)] == [
        (1, 2, 0, False),
        (2, 0, 0, False),
    ]
    full = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(make_docs([]), full).collect() == []


def test_phrases_and_near_phrases(make_docs):
    docs = make_docs([(1, "a b c d"), (2, "a x b y c"), (3, "c b a"), (4, "a b"), (5, "c d a b c")])
    phrases = {"p": "a b c", "q": "b"}
    exact = {tuple(r) for r in find_phrases(docs, phrases).collect() if r.phrase_id == "p"}
    assert exact == {(1, "p", 0, 3), (5, "p", 2, 5)}
    near = {tuple(r) for r in find_phrases(docs, phrases, slop=2).collect() if r.phrase_id == "p"}
    assert near == exact | {(2, "p", 0, 5)}


def test_benchmark_is_bounded_while_it_is_read(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_TERMS", 100)
    read = []

    def items():
        for i in range(1000):
            read.append(i)
            yield str(i), " ".join(f"w{i}x{j}" for j in range(15))

    with pytest.raises(ValueError, match="more than 100 terms"):
        windows_of(items(), 13)
    assert len(read) == 3
    # Equal windows count once.
    assert len(windows_of(((str(i), "a b c") for i in range(500)), 13)) == 1


def test_phrases_are_looked_up_by_their_rarest_term(make_docs):
    known = Phrases({(b"a", b"rare"): ["p"], (b"a", b"b"): ["q"], (b"b", b"gone"): ["r"]})
    index = decontaminate.build_index(make_docs([(1, "a a a b a b"), (2, "a rare a")]), known.terms, 2)
    known.rank(index)
    assert {w: known.led_by.get(t) for w, t in known.terms.items()} == {
        b"a": None, b"b": [1], b"gone": [2], b"rare": [0],
    }
    row = Postings([known.terms[b"a"], known.terms[b"b"]], [1, 1], b"\0\0\0\0\1\0\0\0")
    assert row.candidates(known) == [1]

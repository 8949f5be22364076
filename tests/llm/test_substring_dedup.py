import hashlib
import re

from dockside.llm import substring_dedup
from dockside.llm.substring_dedup import longest_repeats, remove_repeats

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, size=13):
    least = {}
    for i, t in rows:
        w = SPLIT.findall(t or "")
        for p in range(len(w) - size + 1):
            if i is not None:
                k = tuple(w[p : p + size])
                least[k] = min(i, least.get(k, i))
    out = []
    for i, t in rows:
        w = SPLIT.findall(t or "")
        gone = set()
        for p in range(len(w) - size + 1):
            if i is not None and least[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_as_brute_force(make_docs, corpus):
    got = [tuple(r) for r in remove_repeats(make_docs(corpus)).collect()]
    assert sorted(got, key=repr) == brute(corpus)
    assert sum(r[2] for r in got) > 500


def test_other_sizes(make_docs, corpus):
    for size in (1, 2, 6):
        got = [tuple(r) for r in remove_repeats(make_docs(corpus), size).collect()]
        assert sorted(got, key=repr) == brute(corpus, size)


def test_text_is_kept(make_docs):
    words = [f"a{i}" for i in range(20)]
    rows = [(1, " ".join(words)), (2, "x  y\n" + " ".join(words) + " z"), (3, "p  q")]
    got = {r.doc_id: r.kept_text for r in remove_repeats(make_docs(rows), with_text=True).collect()}
    assert got == {1: " ".join(words), 2: "x y z", 3: "p  q"}


def test_other_columns_are_carried(make_docs):
    words = " ".join(f"a{i}" for i in range(20))
    rows = [(1, words), (2, words), (3, "x"), (None, words), (2, "y")]
    got = remove_repeats(make_docs(rows), with_text=True, carry=("source", "fp")).collect()
    assert sorted((str(r.doc_id), r.kept_text, r.carried.source) for r in got) == [
        ("1", words, "s1"),
        ("2", "", "s2"),
        ("2", "y", "s2"),
        ("3", "x", "s0"),
        ("None", words, "s0"),
    ]


def test_empty_table(make_docs):
    assert remove_repeats(make_docs([])).collect() == []
    assert longest_repeats(make_docs([])).collect() == []


def test_longest(make_docs):
    words = [f"a{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:14])), (3, " ".join(words[5:40])), (4, "b"), (5, "b")]
    got = {r.doc_id: r.longest for r in longest_repeats(make_docs(rows)).collect()}
    assert got == {2: 13, 3: 26}


def test_rows_of_one_id_are_dealt_out(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4096)
    passage = " ".join(f"b{i}" for i in range(60))
    hot = [(9000, f"{passage} {i}") for i in range(150)] + [(None, passage)] * 150 + [(8000, passage)] * 60
    blocks, total = substring_dedup.blocks_of(make_docs(corpus + hot))
    counts = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert sum(counts) == len(corpus + hot)
    assert len(counts) > 10 and max(counts) < 60
    # The same at every reading.
    twice = [sorted(map(tuple, blocks.select("_block", "doc_id", "text").collect()), key=repr) for _ in "ab"]
    assert twice[0] == twice[1]
    got = [tuple(r) for r in remove_repeats(make_docs(corpus + hot)).collect()]
    assert sorted(got, key=repr) == brute(corpus + hot)

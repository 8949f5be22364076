"""Fill-in-the-middle against a regular expression, and the round trip of every output."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dockside.llm import fill_middle
from dockside.llm.fill_middle import Layout, fill_in_middle, restored_text

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text, cut=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = ["".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None))]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return (doc_id, len(units), "plain", None, None, text)
    sizes = (len(parts[0]), len(parts[1]))
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", *sizes, f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}")
    return (doc_id, len(units), "psm", *sizes, f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}")


ODD = ["", None, " ", "a", "Z", "[`{@", "a\x00b\x00", "ñandú Straße", "\x7f\x80߿ࠀ￿\U00010000😀x", "<P", "x<P>y", "<S>", "<", "<<S", "a" * 7, "a" * 8, "a" * 9, "é" * 8, "12345678", "\r\n x"]


def test_every_row(spark, corpus, make_docs):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b c"), (5, "twice"), (5, "twice")]
    rows += [(2000, "wörd " * 100_000)]
    docs = make_docs(rows)
    found = fill_in_middle(docs).select("*", restored_text().alias("back")).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in found))) == sorted(repr(brute(*r)) for r in rows)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_small_steps_and_empty_table(spark, corpus, make_docs, monkeypatch):
    rows = [r for r in corpus if r[0] and r[0] < 40]
    texts = [(t or "").encode() for _, t in rows]
    whole = fill_middle.rearranged([i for i, _ in rows], texts, 1, 90, 20).to_pylist()
    one_by_one = [fill_middle.rearranged([i], [t], 1, 90, 20).to_pylist()[0] for (i, _), t in zip(rows, texts)]
    assert whole == one_by_one
    assert fill_in_middle(make_docs(rows).limit(0)).collect() == []


def test_other_shares(make_docs):
    rows = [(i, f"text {i} of some words") for i in range(40)]
    for cut, spm in ((0, 20), (100, 100), (100, 0)):
        found = [tuple(r) for r in fill_in_middle(make_docs(rows), 1, cut, spm).collect()]
        assert sorted(found) == sorted(brute(*r, cut, spm) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5), st.integers(0, 2**31))
def test_units_and_cuts(texts, seed):
    laid = Layout([t.encode() for t in texts])
    units = [UNIT.findall(t) for t in texts]
    assert laid.n.tolist() == [len(u) for u in units]
    rng = random.Random(seed)
    k = np.array([rng.randint(0, len(u)) for u in units])
    heads = ["".join(u[:n]) for u, n in zip(units, k)]
    at = laid.byte_after(k)
    assert at.tolist() == [len(h.encode()) for h in heads]
    assert laid.points_in(at).tolist() == [len(h) for h in heads]


def test_no_shuffle(make_docs):
    plan = fill_in_middle(make_docs([(1, "a b")]).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_marks_that_parts_could_make(spark, form):
    pieces = ["<", "<S", "<P", "S>", ">", "<M", "M>x", ""]
    rows = []
    for a in pieces:
        for b in pieces:
            for c in pieces:
                if any(m in a + b + c for m in ("<P>", "<S>", "<M>")):
                    continue
                out = {"plain": a + b + c, "psm": f"<P>{a}<S>{c}<M>{b}", "spm": f"<S>{c}<P>{a}<M>{b}"}[form]
                rows.append((form, out, a + b + c))
    df = spark.createDataFrame(rows, "form string, output string, want string")
    assert df.where(~restored_text().eqNullSafe(df.want)).count() == 0

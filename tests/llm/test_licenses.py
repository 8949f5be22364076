import itertools
import math
import random
import re

import pytest

from dockside.llm.licenses import BASE_PHRASES, LEAST_SHARE, TEMPLATES, TOLERANCE, Scanner, scan_licenses, templates

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in BASE_PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return (
        len(w),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({x for _, x in places})),
    )


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "x MIT license mit LICENSE gnu GNU General Public-License, v3",
    "CC BY cc by-sa 4.0",
    "gnu general public",
    "license apache",
    "cc",
    "by cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
    "Permission was hereby granted free of charge to any person obtaining the copy",
    "ñ mit licenseé",
    "",
    None,
    "mit license " * 3000,
]


def test_base_columns_as_brute_force(make_docs, corpus):
    rows = list(enumerate(TEXTS)) + corpus
    got = scan_licenses(make_docs(rows)).collect()
    mine = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got if r.doc_id is not None)
    assert mine == sorted((i, *brute(t)) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_own_labels(make_docs):
    got = {r.doc_id: r for r in scan_licenses(make_docs(list(enumerate(TEXTS)))).collect()}
    assert got[0].labels == "apache,apache-2.0"
    assert got[7].labels == got[8].labels == "mit-text"
    assert got[8].score < got[7].score == 1.0
    assert got[2].labels == "cc-by,cc-by-sa"
    assert got[3].labels == "" and got[11].score == 0.0


def test_empty_table(make_docs):
    assert scan_licenses(make_docs([])).collect() == []


def brute_labels(texts):
    """Labels and score by trying all places of all phrases of every template."""
    worded = [WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]

    def weight(word):
        return math.log((len(texts) + 1) / (sum(word in w for w in worded) + 0.5)) + 1e-9

    known = [(label, f"[{phrase}]", True) for phrase, label in BASE_PHRASES]
    known += [(label, text, False) for label, text in TEMPLATES]
    out = []
    for w in worded:
        found, best = set(), 0.0
        for label, text, base in known:
            plain = text.replace("[", "").replace("]", "").split()
            phrases = [(len(text[: m.start()].split()), m[1].split()) for m in re.finditer(r"\[(.*?)\]", text)]
            stand = [[i for i in range(len(w)) if w[i : i + len(p)] == p] for _, p in phrases]
            for at in itertools.product(*stand):
                shifts = [a - o for a, (o, _) in zip(at, phrases)]
                ends = [a + len(p) for a, (_, p) in zip(at, phrases)]
                if any(abs(x - y) > TOLERANCE for x, y in zip(shifts, shifts[1:])):
                    continue
                if any(end > start for end, start in zip(ends, at[1:])):
                    continue
                held = 0.0
                for i, word in enumerate(plain):
                    n = max([k for k, (o, _) in enumerate(phrases) if o <= i], default=0)
                    o, p = phrases[n]
                    near = [k for k in range(len(w)) if abs(k - i - shifts[n]) <= TOLERANCE]
                    if o <= i < o + len(p) or word in [w[k] for k in near]:
                        held += weight(word)
                share = held / sum(map(weight, plain))
                best = max(best, share)
                if base or share >= LEAST_SHARE:
                    found.add(label)
        out.append((",".join(sorted(found)), best))
    return out


def noisy_texts():
    """Templates with words left out, put in or changed, joined at random."""
    rng = random.Random(3)
    plain = [t.replace("[", "").replace("]", "") for _, t in TEMPLATES] + [p for p, _ in BASE_PHRASES]
    spare = sorted({w for t in plain for w in t.split()}) + ["x", "y"]
    out = []
    for _ in range(400):
        words = []
        for text in rng.choices(plain, k=rng.randint(1, 3)):
            for word in text.split():
                chance = rng.random()
                words += [] if chance < 0.04 else [rng.choice(spare)] if chance < 0.07 else [word]
                words += rng.choices(spare, k=rng.randint(1, 3)) if chance > 0.96 else []
        out.append(" ".join(words))
    return out


def test_labels_and_score_as_brute_force(make_docs):
    texts = TEXTS[:-1] + noisy_texts()
    got = {r.doc_id: r for r in scan_licenses(make_docs(list(enumerate(texts)))).collect()}
    want = brute_labels(texts)
    assert sum(bool(labels) for labels, _ in want) > 100
    for i, (labels, score) in enumerate(want):
        assert got[i].labels == labels, texts[i]
        assert got[i].score == pytest.approx(score, abs=1e-9)


def test_nothing_is_found_without_postings():
    scanner = Scanner(templates(), 10, {})
    assert [scanner.scan((t or "").encode())[5] for t in TEXTS[:3]] != ["", "", ""]
    scanner.postings.clear()
    assert {scanner.scan((t or "").encode())[5] for t in TEXTS} == {""}


@pytest.mark.parametrize(
    "text, labels",
    [
        (
            "redistribute it under the terms of the GNU General Public License as published by the Free"
            " Software Foundation; either version 3 of the License, or (at your option) any later version.",
            {"gpl", "gpl-3.0"},
        ),
        (
            "the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
            {"gpl", "gpl-2.0"},
        ),
        ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", {"lgpl", "lgpl-2.1"}),
        ("// SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}),
        ("# SPDX-License-Identifier: MIT", {"mit-notice"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0"}),
        ("subject to the terms of the Mozilla Public License, v. 2.0", {"mpl", "mpl-2.0"}),
    ],
)
def test_notices_as_published(make_docs, text, labels):
    (row,) = scan_licenses(make_docs([(1, text)])).collect()
    assert set(row.labels.split(",")) == labels

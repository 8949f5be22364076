"""License scans: a positional index of templates, looked up by a file's rarest licence words.

A template is a run of words in which mandatory phrases stand. The index holds, for
every word of these phrases, the templates and the place in each of them. A file
takes its own licence words from the one with the highest inverse document frequency
on; a template is looked up by the first of its words that comes up, and the postings
of the next one must lie where the first puts them. Then the phrases are verified:
each word for word, in their order, and at most ``TOLERANCE`` words nearer to or
farther from the phrase before than in the template. The score is the share of the
template's weight that the file holds there. A file that holds all phrases holds all
their words, so the look-up loses nothing.
"""

import bisect
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import record_batch, text_bytes, words_of

# Phrase and label of the base rule.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Labels and texts of the templates that go beyond the base rule, in the
# words of the licences; phrases in brackets are mandatory.
TEMPLATES = (
    ("agpl", "[gnu affero general public license]"),
    ("agpl-3.0", "[gnu affero general public license] as published by the free software foundation"
     " [version 3 of the license]"),
    ("agpl-3.0", "[gnu affero general public license version 3]"),
    ("agpl-3.0", "[spdx license identifier agpl 3 0]"),
    ("apache-2.0", "[apache license version 2 0]"),
    ("apache-2.0", "[apache license v2 0]"),
    ("apache-2.0", "[spdx license identifier apache 2 0]"),
    ("apache-2.0", "you may not use this file [except in compliance] with the license"),
    ("artistic", "[artistic license]"),
    ("bsd", "redistribution and use in [source and binary forms] with or without modification are permitted"),
    ("bsd-2-clause", "[spdx license identifier bsd 2 clause]"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used"
     " to [endorse or promote products derived from this software]"),
    ("bsd-3-clause", "[spdx license identifier bsd 3 clause]"),
    ("bsl-1.0", "[boost software license] version 1 0"),
    ("cc-by-4.0", "[cc by 4 0]"),
    ("cc-by-nc", "[cc by nc]"),
    ("cc-by-nc", "[creative commons attribution noncommercial]"),
    ("cc-by-nd", "[cc by nd]"),
    ("cc-by-nd", "[creative commons attribution noderivatives]"),
    ("cc-by-sa", "[cc by sa]"),
    ("cc-by-sa", "[creative commons attribution sharealike]"),
    ("cc-by-text", "[creative commons attribution]"),
    ("cc0", "[cc0 1 0] universal"),
    ("epl", "[eclipse public license]"),
    ("gfdl", "[gnu free documentation license]"),
    ("gpl-2.0", "[gnu general public license] as published by the free software foundation"
     " [version 2 of the license]"),
    ("gpl-2.0", "[gnu general public license version 2]"),
    ("gpl-2.0", "[gnu general public license v2]"),
    ("gpl-2.0", "[spdx license identifier gpl 2 0]"),
    ("gpl-3.0", "[gnu general public license] as published by the free software foundation"
     " [version 3 of the license]"),
    ("gpl-3.0", "[gnu general public license version 3]"),
    ("gpl-3.0", "[gnu general public license v3]"),
    ("gpl-3.0", "[spdx license identifier gpl 3 0]"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the"
     " [gnu general public license]"),
    ("isc", "[isc license]"),
    ("isc", "permission to use copy modify and or [distribute this software for any purpose] with or without"
     " fee [is hereby granted]"),
    ("lgpl", "[gnu lesser general public license]"),
    ("lgpl-2.1", "[gnu lesser general public license] as published by the free software foundation"
     " [version 2 1 of the license]"),
    ("lgpl-2.1", "[gnu lesser general public license version 2 1]"),
    ("lgpl-3.0", "[gnu lesser general public license version 3]"),
    ("mit-notice", "released under the [mit license]"),
    ("mit-notice", "[spdx license identifier mit]"),
    ("mit-text", "permission is [hereby granted free of charge] to any person obtaining a copy"),
    ("mit-text", "the above [copyright notice and this permission notice] shall be included in all copies"
     " or substantial portions of the software"),
    ("mpl", "[mozilla public license]"),
    ("mpl-2.0", "[mozilla public license version 2 0]"),
    ("mpl-2.0", "[mozilla public license v 2 0]"),
    ("mpl-2.0", "[spdx license identifier mpl 2 0]"),
    ("unlicense", "this is [free and unencumbered software released into the public domain]"),
    ("zlib", "this software is provided as is without any express or implied warranty [in no event will the"
     " authors be held liable] for any damages arising from the use of this software"),
)

# Share of a template's weight that must agree.
LEAST_SHARE = 0.8
# Words by which a place may differ from where the phrase before puts it.
TOLERANCE = 4


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, int], ...]  # first and last place, plus one, of each mandatory phrase
    base: bool = False

    @classmethod
    def marked(cls, label: str, text: str) -> "Template":
        """A template whose mandatory phrases stand in brackets."""
        words, phrases, start = [], [], None
        for part in text.encode().split():
            if part.startswith(b"["):
                start = len(words)
            words.append(part.strip(b"[]"))
            if part.endswith(b"]"):
                phrases.append((start, len(words)))
        if not phrases:
            raise ValueError(f"no mandatory phrase in {text!r}")
        return cls(label, tuple(words), tuple(phrases))


def templates() -> list[Template]:
    """All templates; a base phrase is a template that is mandatory as a whole."""
    base = [(label, tuple(phrase.encode().split())) for phrase, label in BASE_PHRASES]
    found = [Template(label, words, ((0, len(words)),), True) for label, words in base]
    return found + [Template.marked(label, text) for label, text in TEMPLATES]


def word_frequencies(docs: DataFrame, words: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many of them each of ``words`` stands.

    One pass over all texts; every task returns at most one row per word.
    """

    def count(batches):
        seen = dict.fromkeys(words, 0)
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += 1
                for word in words.intersection(words_of(text)):
                    seen[word] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([b"", *seen], pa.binary()), pa.array([total, *seen.values()], pa.int64())],
            names=["word", "n"],
        )

    counted = docs.select(text_bytes().alias("text")).mapInArrow(count, "word binary, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(row.word): row.n for row in rows}
    return found.pop(b"", 0), found


class Scanner:
    """Index of templates, given how many documents hold each word."""

    def __init__(self, known: list[Template], total: int, frequencies: dict[bytes, int]):
        self.known = known
        self.weight = {
            w: math.log((total + 1.0) / (frequencies.get(w, 0) + 0.5)) + 1e-9 for t in known for w in t.words
        }
        self.whole = [sum(map(self.weight.get, t.words)) for t in known]
        # Word: the templates in whose mandatory phrases it stands, and the first place in each.
        self.postings: dict[bytes, dict[int, int]] = {}
        self.needed = []
        for number, t in enumerate(known):
            places = [i for start, end in t.phrases for i in range(start, end)]
            for i in places:
                self.postings.setdefault(t.words[i], {}).setdefault(number, i)
            self.needed.append(frozenset(t.words[i] for i in places))
        rarest = sorted(self.postings, key=lambda w: (-self.weight[w], w))
        self.order = {w: i for i, w in enumerate(rarest)}

    def candidates(self, present: set[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Templates whose phrases a file with these words may hold, and the two words to look by."""
        first: dict[int, bytes] = {}
        second: dict[int, bytes] = {}
        for word in sorted(present, key=self.order.__getitem__):
            for number in self.postings[word]:
                if number not in first:
                    first[number] = word
                elif number not in second:
                    second[number] = word
        return [(n, w, second.get(n, w)) for n, w in first.items() if self.needed[n] <= present]

    def places_of(self, number: int, first: bytes, second: bytes, places: dict[bytes, list[int]]):
        """Places of the first word that the postings of the second one agree with."""
        t = self.known[number]
        i, j = self.postings[first][number], self.postings[second][number]
        apart = abs(self._phrase(t, i) - self._phrase(t, j))
        there = places[second]
        for p in places[first]:
            at = p - i + j
            k = bisect.bisect_left(there, at - apart * TOLERANCE)
            if k < len(there) and there[k] <= at + apart * TOLERANCE:
                yield p - i

    @staticmethod
    def _phrase(t: Template, place: int) -> int:
        return next(n for n, (start, end) in enumerate(t.phrases) if start <= place < end)

    def placements(self, t: Template, from_phrase: int, shift: int, words: list[bytes]) -> list[list[int]]:
        """Shifts of all phrases, one list per way to place them, where one phrase's shift is given."""

        def stands(n, by):
            start, end = t.phrases[n]
            return start + by >= 0 and words[start + by : end + by] == list(t.words[start:end])

        if not stands(from_phrase, shift):
            return []
        found = [[shift]]
        near = range(-TOLERANCE, TOLERANCE + 1)
        for n in range(from_phrase - 1, -1, -1):
            # No phrase reaches into the next one.
            room = t.phrases[n + 1][0] - t.phrases[n][1]
            found = [[s[0] + d, *s] for s in found for d in near if -d + room >= 0 and stands(n, s[0] + d)]
        for n in range(from_phrase + 1, len(t.phrases)):
            room = t.phrases[n][0] - t.phrases[n - 1][1]
            found = [[*s, s[-1] + d] for s in found for d in near if d + room >= 0 and stands(n, s[-1] + d)]
        return found

    def share(self, number: int, shifts: list[int], words: list[bytes]) -> float:
        """Share of a template's weight that stands near its place, the phrase before telling the place."""
        t = self.known[number]
        missing = 0.0
        for i, word in enumerate(t.words):
            n = max(0, sum(start <= i for start, _ in t.phrases) - 1)
            start, end = t.phrases[n]
            at = i + shifts[n]
            near = words[max(0, at - TOLERANCE) : max(0, at + TOLERANCE + 1)]
            if not start <= i < end and word not in near:
                missing += self.weight[word]
        return max(0.0, 1.0 - missing / self.whole[number])

    def scan(self, text: bytes):
        """Word count, base places, their first and last word, labels and score."""
        words = words_of(text)
        n_base, starts, base, labels, score = 0, [], set(), set(), 0.0
        looked_up = self.candidates(self.postings.keys() & set(words))
        if looked_up:
            wanted = {w for _, first, second in looked_up for w in (first, second)}
            places: dict[bytes, list[int]] = {}
            for i, word in enumerate(words):
                if word in wanted:
                    places.setdefault(word, []).append(i)
            for number, first, second in looked_up:
                t = self.known[number]
                from_phrase = self._phrase(t, self.postings[first][number])
                for shift in self.places_of(number, first, second, places):
                    for shifts in self.placements(t, from_phrase, shift, words):
                        if t.base:
                            n_base += 1
                            starts.append(shift)
                            base.add(t.label)
                            score = 1.0
                            continue
                        share = self.share(number, shifts, words)
                        score = max(score, share)
                        if share >= LEAST_SHARE:
                            labels.add(t.label)
        return (
            len(words),
            n_base,
            min(starts) if starts else None,
            max(starts) if starts else None,
            ",".join(sorted(base)),
            ",".join(sorted(base | labels)),
            score,
        )


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
    ]
)


def scan_licenses(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """License labels of every row of ``docs`` (``doc_id``, ``text``); other columns are ignored.

    A NULL or empty text has no words, no labels and score 0; a very long one is read
    whole. Repeated rows give repeated results; a NULL ``doc_id`` is passed on. Words of
    equal frequency are taken in the order of their bytes, which changes no result: every
    place where a template's phrases stand is found, and the best one gives the score.
    Weights come from all texts; two passes over the texts, and no shuffle of them. An
    empty table gives an empty one.
    """
    known = templates() if known is None else known
    total, frequencies = word_frequencies(docs, {w for t in known for w in t.words})

    def scan(batches):
        scanner = Scanner(known, total, frequencies)
        for batch in batches:
            found = [scanner.scan(text) for text in batch.column(1).to_pylist()]
            columns = list(zip(*found)) if found else [()] * 7
            yield record_batch(RESULT, batch.column(0), *columns)

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long,"
        " base_labels string, labels string, score double",
    )

"""Benchmark decontamination with a positional inverted index over the training texts.

The index is cut by document: a row holds some megabytes of texts as postings,
the places of each indexed term, so building and searching it move no postings
between tasks. Documents of a row follow each other with a gap, so a place is one
number and a phrase never spans two documents.

A phrase is looked up from its rarest term over the whole index: its places less
its offset in the phrase are the possible starts, and every further term, rarest
first, keeps the starts at which it stands, too. Terms outside the test set never
matter for an exact or near match of its phrases, so only the test set's terms are
kept: an index serves one test set, and another one is another index. Test sets are
small next to the corpus; what is sent to the tasks is bounded by ``MOST_TERMS``,
which is checked while the test set is read.
"""

import hashlib
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import record_batch, store, text_bytes, words_of

# Bytes of text behind one row of the index.
ROW_BYTES = 8 << 20

# Terms of all phrases together that a search accepts (about 100 MB in a task).
MOST_TERMS = 20_000_000

INDEX_TYPE = (
    "doc_ids array<bigint>, n_words array<bigint>, starts array<bigint>,"
    " terms array<int>, occurrences array<bigint>, places binary, rows array<string>"
)
INDEX = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("terms", pa.list_(pa.int32())),
        ("occurrences", pa.list_(pa.int64())),
        ("places", pa.binary()),
        ("rows", pa.list_(pa.string())),
    ]
)


def build_index(docs: DataFrame, terms: dict[bytes, int], gap: int, row: str | None = None) -> DataFrame:
    """Postings of ``terms`` (number by word) in all texts, stored in the shared folder.

    ``row`` names a column of texts that tell the rows of ``docs`` apart.
    """

    def row_of(ids, counts, parts, rows):
        starts = np.cumsum([0] + [n + gap for n in counts])[:-1]
        term = np.concatenate([t for t, _ in parts]) if parts else np.zeros(0, np.int32)
        place = (
            np.concatenate([p + s for (_, p), s in zip(parts, starts)])
            if parts
            else np.zeros(0, np.int64)
        )
        order = np.argsort(term, kind="stable")
        held, first = np.unique(term[order], return_index=True)
        sizes = np.diff(np.append(first, len(term)))
        places = place[order].astype("<u4").tobytes()
        return record_batch(INDEX, [ids], [counts], [starts], [held], [sizes], [places], [rows])

    def index(batches):
        ids, counts, parts, rows, size = [], [], [], [], 0
        for batch in batches:
            for doc_id, text, name in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                term = np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words))
                place = np.flatnonzero(term >= 0)
                ids.append(doc_id)
                counts.append(len(words))
                parts.append((term[place], place))
                rows.append(name)
                size += len(text)
                if size >= ROW_BYTES:
                    yield row_of(ids, counts, parts, rows)
                    ids, counts, parts, rows, size = [], [], [], [], 0
        if ids:
            yield row_of(ids, counts, parts, rows)

    name = F.col(row) if row else F.lit(None)
    texts = docs.select(
        F.col("doc_id").cast("long"), text_bytes().alias("text"), name.cast("string").alias("row")
    )
    return store(texts.mapInArrow(index, INDEX_TYPE), "postings")


class Phrases:
    """Phrases as term numbers; equal phrases are searched for once."""

    def __init__(self, phrases: dict[tuple[bytes, ...], list]):
        if sum(map(len, phrases)) > MOST_TERMS:
            raise ValueError(f"the phrases have more than {MOST_TERMS} terms")
        words = sorted({w for phrase in phrases for w in phrase})
        self.terms = {w: i for i, w in enumerate(words)}
        self.phrases = [np.array([self.terms[w] for w in p], np.int32) for p in phrases]
        self.owners = list(phrases.values())
        self.longest = max(map(len, self.phrases), default=1)
        self.order: list[np.ndarray] = []
        self.led_by: dict[int, list[int]] = {}

    def rank(self, index: DataFrame) -> None:
        """Order the terms of every phrase by how often they occur in the whole index; file it by the rarest."""
        pairs = F.explode(F.arrays_zip("terms", "occurrences")).alias("p")
        sums = index.select(pairs).groupBy("p.terms").agg(F.sum("p.occurrences").alias("n"))
        often = np.zeros(len(self.terms), np.int64)
        for row in sums.collect():  # one row per term of the test set
            often[row.terms] = row.n
        self.order = [np.argsort(often[p], kind="stable") for p in self.phrases]
        self.led_by = {}
        for i, (phrase, order) in enumerate(zip(self.phrases, self.order)):
            self.led_by.setdefault(int(phrase[order[0]]), []).append(i)


class Postings:
    """One row of the index."""

    def __init__(self, terms, occurrences, places):
        self.terms = np.array(terms, np.int32)
        ends = np.cumsum(np.array(occurrences, np.int64))
        self.ends = ends
        self.places = np.frombuffer(places, "<u4").astype(np.int64)
        self.at = {t: i for i, t in enumerate(self.terms.tolist())}

    def of(self, term: int) -> np.ndarray:
        i = self.at[term]
        return self.places[self.ends[i - 1] if i else 0 : self.ends[i]]

    def candidates(self, phrases: Phrases):
        """Numbers of the phrases of which this row has all terms, looked up by the rarest one."""
        here = np.zeros(len(phrases.terms), bool)
        here[self.terms] = True
        led = (i for t in self.terms.tolist() for i in phrases.led_by.get(t, ()))
        return [i for i in led if here[phrases.phrases[i]].all()]

    def exact(self, phrase: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Starts of a phrase, by intersecting offset places from the rarest term on."""
        starts = self.of(int(phrase[order[0]])) - order[0]
        for i in order[1:]:
            if not len(starts):
                break
            held = self.of(int(phrase[i]))
            spot = np.searchsorted(held, starts + i)
            spot[spot == len(held)] = 0
            starts = starts[held[spot] == starts + i]
        return starts

    def near(self, phrase: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of places where the terms follow in order with ``slop`` words more at most."""
        starts = last = self.of(int(phrase[0]))
        for term in phrase[1:].tolist():
            held = self.of(term)
            spot = np.searchsorted(held, last, side="right")
            kept = spot < len(held)
            starts, last = starts[kept], held[spot[kept]]
        close = last - starts < len(phrase) + slop
        return starts[close], last[close] + 1


def find_phrases(docs: DataFrame, phrases: dict[str, str], slop: int = 0) -> DataFrame:
    """Where texts stand in texts: ``doc_id, phrase_id, first_word, end_word``.

    With ``slop`` the words of a phrase stand in order with at most so many other
    words between them; of the matches with one start the shortest is given.
    """
    named: dict[tuple[bytes, ...], list] = {}
    for key, text in phrases.items():
        named.setdefault(tuple(words_of(text.encode())), []).append(key)
    known = Phrases({p: keys for p, keys in named.items() if p})
    index = build_index(docs, known.terms, known.longest + slop)
    known.rank(index)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("phrase_id", pa.string()),
            ("first_word", pa.int64()),
            ("end_word", pa.int64()),
        ]
    )

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                posted = Postings(row["terms"], row["occurrences"], row["places"])
                starts_of = np.array(row["starts"], np.int64)
                out = []
                for i in posted.candidates(known):
                    phrase = known.phrases[i]
                    if slop:
                        starts, ends = posted.near(phrase, slop)
                    else:
                        starts = posted.exact(phrase, known.order[i])
                        ends = starts + len(phrase)
                    docs_of = np.searchsorted(starts_of, starts, side="right") - 1
                    for d, a, b in zip(docs_of.tolist(), starts.tolist(), ends.tolist()):
                        base = row["starts"][d]
                        out += [(row["doc_ids"][d], key, a - base, b - base) for key in known.owners[i]]
                yield record_batch(schema, *(zip(*out) if out else [()] * 4))

    return index.mapInArrow(
        search, "doc_id long, phrase_id string, first_word long, end_word long"
    )


def windows_of(items: Iterable[tuple[str, str | None]], size: int) -> dict[tuple[bytes, ...], list[str]]:
    """Windows of ``size`` words and the items they come from; a shorter item is one window.

    Stops with an error at the item that brings the windows over ``MOST_TERMS`` terms.
    """
    found: dict[tuple[bytes, ...], list[str]] = {}
    terms = 0
    for item_id, text in items:
        words = tuple(words_of((text or "").encode()))
        if not words:
            continue
        for start in range(max(1, len(words) - size + 1)):
            owners = found.setdefault(words[start : start + size], [])
            if not owners:
                terms += min(size, len(words))
                if terms > MOST_TERMS:
                    raise ValueError(f"the benchmark's windows have more than {MOST_TERMS} terms")
            if item_id not in owners:
                owners.append(item_id)
    return found


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
    ]
)


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, row: str | None = None
) -> DataFrame:
    """How much of every text stands in ``benchmark`` (``item_id``, ``text``).

    A word is hit if an occurrence of a benchmark window covers it. A document is
    contaminated if at least one of ``one_in`` words is hit. Columns: ``doc_id,
    n_words, n_hit, n_items, items_sha256, contaminated``. NULL and empty texts
    have no words and are clean; items without words match nothing; a NULL
    ``item_id`` counts as the empty one; repeated rows give repeated results. ``row``
    names a column of texts that tell the rows of ``docs`` apart; it comes along as ``row``.
    """
    schema = RESULT.append(pa.field("row", pa.string())) if row else RESULT
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"
    )
    # A test set is bounded by its windows' terms, which are counted while it is read.
    known = Phrases(windows_of(((r.item_id, r.text) for r in items.toLocalIterator()), size))
    index = build_index(docs, known.terms, size, row)
    known.rank(index)

    def search(batches):
        for batch in batches:
            for held in batch.to_pylist():
                posted = Postings(held["terms"], held["occurrences"], held["places"])
                starts_of = np.array(held["starts"], np.int64)
                counts = np.array(held["n_words"], np.int64)
                edges = np.zeros(int(counts.sum()) + (len(counts) + 1) * size + 1, np.int32)
                items_of: dict[int, set[str]] = {}
                for i in posted.candidates(known):
                    starts = posted.exact(known.phrases[i], known.order[i])
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + len(known.phrases[i]), -1)
                    for d in set((np.searchsorted(starts_of, starts, side="right") - 1).tolist()):
                        items_of.setdefault(d, set()).update(known.owners[i])
                covered = np.concatenate([[0], np.cumsum(np.cumsum(edges) > 0)])
                hits = covered[starts_of + counts] - covered[starts_of]
                names = [",".join(sorted(items_of.get(d, ()))) for d in range(len(counts))]
                yield record_batch(
                    schema,
                    held["doc_ids"],
                    counts,
                    hits,
                    [len(items_of.get(d, ())) for d in range(len(counts))],
                    [hashlib.sha256(n.encode()).hexdigest() for n in names],
                    (hits > 0) & (one_in * hits >= counts),
                    *([held["rows"]] if row else []),
                )

    return index.mapInArrow(
        search,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string,"
        " contaminated boolean" + ", row string" * bool(row),
    )

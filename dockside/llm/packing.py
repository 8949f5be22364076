"""Mixture-controlled packing: deficit round-robin over one queue per source.

A round serves every source with its quantum, its share of a window's tokens. The
part of a token that a round could not serve is the source's deficit, carried to
the next round; a queue that has run dry is passed over. Texts may be cut
anywhere, so what source s has been given after k rounds is known without
running them:

    given(s, k) = min(tokens of s, floor(k * window * share of s))

Rounds follow each other without a gap, and the stream is cut into sequences.
Where a text lies in its queue needs only sums per input partition, so neither a
queue nor a partition waits for another one: deficits carry over windows and
partitions alike, and nothing but the last sequence has room left.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockside.llm.common import record_batch, store, worker_memo

# Words that a worker remembers at most.
REMEMBERED = 800_000

# Sources that a mixture can have; their totals and quanta go to every task.
MOST_SOURCES = 10_000


class WordEncoder:
    """Ids of texts by a vocabulary of the library ``tokenizers`` that drops white space.

    Its pieces never cross white space, so a text's ids are those of its words one
    after the other. A batch's words are numbered, each different one is encoded
    once, and the most common ones are remembered. Ids are 16-bit numbers.
    """

    # Letters and punctuation that no normalisation changes but lower-casing.
    PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]+")
    RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.ends = np.zeros(1 << 16, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.ids: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u2") for x in found]

    def _new_ids(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        # Special strings hold a bar; any word with one is encoded by itself.
        plain = [w for w in words if self.PLAIN.fullmatch(w) and "|" not in w]
        for start in range(0, len(plain), 4096):
            part = plain[start : start + 4096]
            # One text for many words: each run of a word ends at a token with the end mark.
            (joined,) = self._encode([" ".join(part)])
            ends = np.flatnonzero(self.ends[joined]) + 1
            runs = np.cumsum([1 if w.isalpha() else len(self.RUNS.findall(w)) for w in part])
            if len(ends) == runs[-1]:
                cuts = ends[runs - 1].tolist()
                raw = joined.tobytes()
                for word, begin, end in zip(part, [0, *cuts], cuts):
                    out[word] = raw[2 * begin : 2 * end]
        rest = [w for w in words if w not in out]
        out.update(zip(rest, (x.tobytes() for x in self._encode(rest))))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text begins and ends."""
        lists = pc.ascii_split_whitespace(texts)
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.to_pylist()
        ids = list(map(self.ids.get, words))
        missing = [w for w, x in zip(words, ids) if x is None]
        if missing:
            fresh = self._new_ids(missing)
            for word in missing[: max(0, REMEMBERED - len(self.ids))]:
                self.ids[word] = fresh[word]
            ids = [fresh[w] if x is None else x for w, x in zip(words, ids)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 2
        pool = np.frombuffer(b"".join(ids), dtype="<u2")
        place = numbered.indices.to_numpy()
        taken = sizes[place]
        after = np.cumsum(taken)
        first = (np.cumsum(sizes) - sizes)[place] - (after - taken)
        flat = pool[np.repeat(first, taken) + np.arange(after[-1] if len(after) else 0)]
        offsets = lists.offsets.to_numpy()
        return flat, np.concatenate([[0], after])[offsets - offsets[0]]


def encoder_for(path: str) -> WordEncoder:
    memo = worker_memo("word_encoders")
    if path not in memo:
        memo[path] = WordEncoder(path)
    return memo[path]


def encode_documents(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Ids of every text with the end id, and how many ids of its source and task lie before.

    Columns ``doc_id, source, part, before, n, ids`` (16-bit numbers).
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("source", pa.string()),
            ("part", pa.int64()),
            ("before", pa.int64()),
            ("n", pa.int64()),
            ("ids", pa.binary()),
        ]
    )
    end = np.array([end_id], dtype="<u2").tobytes()

    def encode(batches):
        encoder = encoder_for(path)
        part = TaskContext.get().partitionId()
        served: dict[str, int] = {}
        for batch in batches:
            # A thousand texts at a time: ids take the place of texts.
            for start in range(0, batch.num_rows, 1024):
                ids, texts, sources = batch.slice(start, 1024).columns
                flat, cuts = encoder.encode(texts)
                raw, cuts = flat.tobytes(), (2 * cuts).tolist()
                found = [raw[a:b] + end for a, b in zip(cuts, cuts[1:])]
                sizes = [len(x) // 2 for x in found]
                before, sources = [], sources.to_pylist()
                for source, n in zip(sources, sizes):
                    before.append(served.get(source, 0))
                    served[source] = before[-1] + n
                yield record_batch(schema, ids, sources, [part] * len(ids), before, sizes, found)

    return docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    ).mapInArrow(encode, "doc_id long, source string, part long, before long, n long, ids binary")


class Mixture:
    """Rounds of a deficit round-robin over queues of known length."""

    def __init__(self, totals: dict[str, int], window: int, targets: dict[str, float] | None = None):
        self.sources = sorted(totals)
        self.place = {s: i for i, s in enumerate(self.sources)}
        self.totals = np.array([totals[s] for s in self.sources], dtype=object)
        if targets is None:
            shares = [int(t) for t in self.totals]
        else:
            # Sources without a target are served, too, once per round, with one token at least.
            shares = [max(1, round(1e9 * targets.get(s, 0.0))) for s in self.sources]
        self.window = window
        self.shares = np.array(shares, dtype=object)
        # No quantum below one token, so every queue moves on in every round.
        self.sum = max(1, sum(shares))
        self.quantum = [max(window * s, self.sum) for s in shares]

    def given(self, rounds: int) -> list[int]:
        """Tokens each source has been given after so many rounds."""
        return [min(t, rounds * q // self.sum) for t, q in zip(self.totals, self.quantum)]

    def segments(self, source: str, start: int, end: int):
        """Where tokens ``start`` to ``end`` of a queue lie in the stream: ``(from, length, at)``."""
        i = self.place[source]
        q = self.quantum[i]
        while start < end:
            # The round whose end is the first beyond this token.
            k = (start + 1) * self.sum
            rounds = -(-k // q)
            before, after = self.given(rounds - 1), self.given(rounds)
            at = sum(before) + sum(a - b for a, b in zip(after[:i], before[:i]))
            taken = min(end, after[i]) - start
            yield start, taken, at + start - before[i]
            start += taken


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def pack(
    docs: DataFrame,
    path: str,
    length: int = 2048,
    sequences_per_window: int = 32,
    targets: dict[str, float] | None = None,
    end_id: int = 1,
) -> DataFrame:
    """Pieces of all texts in sequences of ``length`` ids.

    ``targets`` are token shares by source; without them a window has the shares
    of the whole table, so that every window and the last one look alike. A source
    may not exceed its queue: once it has run dry the others share the stream.
    A NULL or empty text is its end id alone, a NULL source is a queue of its own
    (with the empty name), repeated rows are packed one by one, and columns other
    than ``doc_id``, ``text`` and ``source`` are ignored.
    """
    coded = store(encode_documents(docs, path, end_id), "coded")
    sums = coded.groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and task; it is joined as Spark sees fit by its size.
    starts = store(
        sums.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), "n"),
        "queues",
    )
    rows = starts.groupBy("source").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a mixture has at most {MOST_SOURCES} sources")
    mixture = Mixture({row.source: row.n for row in rows}, length * sequences_per_window, targets)

    def cut(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for doc_id, source, base, before, n, ids in zip(*columns):
                wide = memoryview(np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes())
                first = base + before
                for start, size, at in mixture.segments(source, first, first + n):
                    while size:
                        taken = min(size, length - at % length)
                        begin = start - first
                        crc = zlib.crc32(wide[4 * begin : 4 * (begin + taken)])
                        out.append((doc_id, begin, taken, crc, n, at // length, at % length))
                        start, at, size = start + taken, at + taken, size - taken
            yield record_batch(PIECES, *(zip(*out) if out else [()] * 7))

    placed = coded.join(starts.select("source", "part", "base"), ["source", "part"])
    return placed.select("doc_id", "source", "base", "before", "n", "ids").mapInArrow(
        cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long",
    )

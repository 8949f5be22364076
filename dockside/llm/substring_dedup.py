"""Substring dedup by level-wise doubling.

A window of n words can only repeat if the windows of half its length in it do. So
the first level looks at windows of half the length: of those in a full window
one is enough, the one with the smallest hash, which is the same wherever the
full window stands. What stands in one document alone is out. The next level has
windows of twice the length, and only those whose half survived. The contract's
length is reached after one doubling; :func:`longest_repeats` goes on until no
window survives.

Texts are dealt row by row into blocks of some megabytes, whatever their ``doc_id``, so
rows of one id or of one text do not meet in a block. A block hashes
its words with array operations and sends each window it holds once, with the
smallest ``doc_id`` it has for it, so a passage shared by a third of all
documents is one row per block, not one per document. Windows go by 128 bits of
hash from the second level on.

A text that a smaller ``doc_id`` has as a whole is known beforehand by its digest:
each of its windows starts in that document, so the copy sends none.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockside.llm.common import numbered, partitions_for, store, text_bytes, worker_memo

# Bytes of text in a block.
BLOCK_BYTES = 4 << 20

# Bytes whose words are hashed at a time.
STEP_BYTES = 1 << 20

# Bytes of text whose windows one task compares at a time.
TASK_BYTES = 64 << 20

# Fixed odd multipliers of the hashes.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True

NO_DOC = -(1 << 63)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose result depends on all bits of the argument."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Block:
    """Words of some documents as hashes, in an order that the rows alone decide."""

    def __init__(self, table: pa.Table, notes: pa.Table):
        rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
        #: Places of the rows in ``table``.
        self.order = sorted(
            range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1])
        )
        rows = [rows[i] for i in self.order]
        self.ids = [r[0] for r in rows]
        self.texts = [r[1] for r in rows]
        data = np.frombuffer(b" ".join([b"", *self.texts, b""]), np.uint8)
        sizes = np.fromiter(map(len, self.texts), np.int64, len(rows))
        bounds = np.cumsum(np.append(1, sizes + 1))
        inside = ~BLANKS[data]
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begins, ends = turns[0::2], turns[1::2]
        self.words = word_hashes(data, begins, ends)
        # The document of each word, and how many words each has.
        self.doc = np.searchsorted(bounds, begins, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=len(rows))
        self.first = np.cumsum(self.n_words) - self.n_words
        self.known = np.array([NO_DOC if i is None else i for i in self.ids], np.int64)
        #: Rows whose text a smaller id has, too.
        self.copy = np.zeros(len(rows), bool)
        digests = notes.filter(pc.is_valid(notes["digest"]))
        twins = set(zip(digests["a"].to_pylist(), digests["digest"].to_pylist()))
        if twins:
            some = {i for i, _ in twins}
            for n, (i, text) in enumerate(rows):
                self.copy[n] = i in some and (i, hashlib.md5(text).digest()) in twins

    def windows(self, size: int, base: int) -> np.ndarray:
        """Hash of the ``size`` words from each place on, by doubling; no check of borders."""
        return window_hash(self.words, size, base)

    def whole(self, size: int) -> np.ndarray:
        """Whether the window from each place on stays in its document, one with an id and no copy."""
        if len(self.words) < size:
            return np.zeros(0, bool)
        doc = self.doc[: len(self.words) - size + 1]
        usable = (self.known != NO_DOC) & ~self.copy
        return (doc == self.doc[size - 1 :]) & usable[doc]

    def halves(self, size: int) -> np.ndarray:
        """For each window the smallest hash of the half windows in it."""
        half = (size + 1) // 2
        grams = mixed(self.windows(half, WORD_BASES[0]))
        return sliding_least(grams, size - half + 1)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word ``data[begin:end]``, from sums over the bytes up to its ends."""
    out = np.empty(len(begins), np.uint64)
    first = 0
    while first < len(begins):
        base = begins[first]
        last = max(first + 1, int(np.searchsorted(ends, base + STEP_BYTES, side="right")))
        part = data[base : ends[last - 1]]
        power, undo = _power_tables(max(len(part), STEP_BYTES))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        a, b = begins[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[b] - sums[a]) * undo[a]
        first = last
    return mixed(out)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    memo = worker_memo("substring_powers")
    if len(memo.get("power", ())) < n:
        memo["power"] = powers(BYTE_BASE, n)
        memo["undo"] = powers(pow(BYTE_BASE, -1, 1 << 64), n)
    return memo["power"], memo["undo"]


def window_hash(words: np.ndarray, size: int, base: int) -> np.ndarray:
    if len(words) < size:
        return np.zeros(0, np.uint64)
    held, length = words, 1
    out, done = None, 0
    left = size
    while True:
        if left & 1:
            # Append the part of this length to what is there.
            if out is None:
                out = held
            else:
                n = min(len(out), len(held) - done)
                out = out[:n] * np.uint64(pow(base, length, 1 << 64)) + held[done : done + n]
            done += length
        left >>= 1
        if not left:
            return out[: len(words) - size + 1]
        held = held[:-length] * np.uint64(pow(base, length, 1 << 64)) + held[length:]
        length *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    if len(values) < width:
        return values[:0]
    held, length = values, 1
    while 2 * length <= width:
        held = np.minimum(held[:-length], held[length:])
        length *= 2
    extra = width - length
    return np.minimum(held[: len(held) - extra], held[extra:]) if extra else held


def blocks_of(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``_block, doc_id, text, _carried`` and the bytes of all texts; each row goes by its own number."""
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    texts = numbered(docs, "_dealt_by").select(
        F.col("doc_id").cast("long"), text_bytes().alias("text"), carried.alias("_carried"), "_dealt_by"
    )
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("_dealt_by"), F.lit(n)).alias("_block")
    return texts.select(block, "doc_id", "text", "_carried"), total


# What a block is told: copies (``a`` id, ``digest`` of the text), halves (``a``), or
# repeated windows (``a`` place, ``b`` smallest id).
NOTES = "_block long, a long, b long, digest binary"


def whole_copies(blocks: DataFrame) -> DataFrame:
    """Rows whose whole text a smaller ``doc_id`` has, too, as notes in the shared folder."""
    marked = blocks.where("doc_id IS NOT NULL AND octet_length(text) > 0").select(
        "_block", "doc_id", F.unhex(F.md5("text")).alias("digest")
    )
    # Minima are combined before the shuffle, so a hot text is a row per task.
    least = marked.groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    # Stored, so that Spark can split a hot text's rows when it joins them.
    repeated = store(least.where("least < most").select("digest", "least"), "digests")
    found = marked.join(repeated, "digest").where("doc_id > least")
    return store(
        found.select(
            "_block", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "digest"
        ),
        "copies",
    )


def first_level(blocks: DataFrame, copies: DataFrame, parts: int, size: int) -> DataFrame:
    """Notes of the smallest halves of windows that more than one document has."""
    sent = pa.schema([("half", pa.int64()), ("_block", pa.int64()), ("many", pa.bool_())])
    back = pa.schema([("_block", pa.int64()), ("a", pa.int64())])

    def send(key, table, notes):
        if not table.num_rows:
            return pa.Table.from_batches([], sent)
        block = Block(table, notes)
        whole = block.whole(size)
        halves = block.halves(size)[whole]
        doc = block.known[block.doc[: len(whole)][whole]]
        # Neighbours mostly share their half.
        turn = np.r_[True, (halves[1:] != halves[:-1]) | (doc[1:] != doc[:-1])][: len(halves)]
        halves, doc = halves[turn], doc[turn]
        order = np.argsort(halves, kind="stable")
        halves, doc = halves[order], doc[order]
        first = np.flatnonzero(np.r_[True, halves[1:] != halves[:-1]][: len(halves)])
        if not len(first):
            return pa.Table.from_batches([], sent)
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        number = np.full(len(first), key[0].as_py())
        return pa.table([halves[first].view(np.int64), number, many], schema=sent)

    def repeated(batches):
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches]
        if not parts:
            return
        half, block, many = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(half, kind="stable")
        half, block, many = half[order], block[order], many[order]
        first = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
        sizes = np.diff(np.append(first, len(half)))
        kept = np.repeat((sizes > 1) | np.logical_or.reduceat(many, first), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(block[kept]), pa.array(half[kept])], schema=back)

    halves = (
        blocks.groupBy("_block")
        .cogroup(copies.groupBy("_block"))
        .applyInArrow(send, "half long, _block long, many boolean")
    )
    found = halves.repartition(parts, "half").mapInArrow(repeated, "_block long, a long")
    return found.selectExpr("_block", "a", "CAST(NULL AS LONG) AS b", "CAST(NULL AS BINARY) AS digest")


def distinct_windows(block: Block, size: int, at: np.ndarray):
    """Windows at the places ``at``, grouped: order of the places, group starts, both hashes."""
    one = block.windows(size, WORD_BASES[0])[at]
    two = block.windows(size, WORD_BASES[1])[at]
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    first = np.flatnonzero(
        np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)]
    )
    return order, first, one[first], two[first]


def second_level(blocks: DataFrame, copies: DataFrame, halves: DataFrame, parts: int, size: int) -> DataFrame:
    """Notes of repeated windows: first place in the block and smallest ``doc_id`` of all.

    A block is told only of windows that it has in a document beside that one.
    """
    sent = pa.schema(
        [(n, pa.int64()) for n in ("one", "two", "_block", "place", "least")] + [("many", pa.bool_())]
    )
    back = pa.schema([(n, pa.int64()) for n in ("_block", "a", "b")])

    def send(key, table, notes):
        survivors = notes.filter(pc.is_null(notes["digest"]))
        if not table.num_rows or not survivors.num_rows:
            return pa.Table.from_batches([], sent)
        block = Block(table, notes)
        kept = np.sort(survivors["a"].to_numpy().view(np.uint64))
        halves = block.halves(size)
        spot = np.searchsorted(kept, halves)
        spot[spot == len(kept)] = 0
        at = np.flatnonzero(block.whole(size) & (kept[spot] == halves))
        if not len(at):
            return pa.Table.from_batches([], sent)
        order, first, one, two = distinct_windows(block, size, at)
        doc = block.known[block.doc[at[order]]]
        least = np.minimum.reduceat(doc, first)
        columns = [
            one.view(np.int64),
            two.view(np.int64),
            np.full(len(first), key[0].as_py()),
            np.minimum.reduceat(at[order], first),
            least,
            least != np.maximum.reduceat(doc, first),
        ]
        return pa.table(columns, schema=sent)

    def repeated(batches):
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches]
        if not parts:
            return
        one, two, block, place, least, many = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((two, one))
        one, two, block, place, least, many = (
            x[order] for x in (one, two, block, place, least, many)
        )
        first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        sizes = np.diff(np.append(first, len(one)))
        smallest = np.repeat(np.minimum.reduceat(least, first), sizes)
        # Else the block has the window in the document with the smallest id alone.
        kept = many | (smallest < least)
        columns = [pa.array(x[kept]) for x in (block, place, smallest)]
        yield pa.RecordBatch.from_arrays(columns, schema=back)

    windows = (
        blocks.groupBy("_block")
        .cogroup(copies.unionByName(halves).groupBy("_block"))
        .applyInArrow(send, "one long, two long, _block long, place long, least long, many boolean")
    )
    found = windows.repartition(parts, "one", "two").mapInArrow(
        repeated, "_block long, a long, b long"
    )
    return copies.unionByName(found.withColumn("digest", F.lit(None).cast("binary")))


def covered_words(block: Block, notes: pa.Table, size: int) -> np.ndarray:
    """Which words of a block lie in a window that a smaller ``doc_id`` has, too."""
    edges = np.zeros(len(block.words) + 1, np.int32)
    repeats = notes.filter(pc.is_null(notes["digest"]))
    if repeats.num_rows:
        place = repeats["a"].to_numpy()
        least = repeats["b"].to_numpy()
        at = np.flatnonzero(block.whole(size))
        one, two = (block.windows(size, base) for base in WORD_BASES)
        order = np.argsort(one[place], kind="stable")
        keys, place, least = one[place][order], place[order], least[order]
        # The rare equal first hashes of different windows are told apart by the second.
        low = np.searchsorted(keys, one[at], side="left")
        high = np.searchsorted(keys, one[at], side="right")
        at, low, high = (x[high > low] for x in (at, low, high))
        while len(at):
            same = two[place[low]] == two[at]
            hit = at[same & (least[low] < block.known[block.doc[at]])]
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + size, -1)
            low = low + 1
            rest = ~same & (low < high)
            at, low, high = at[rest], low[rest], high[rest]
    whole = block.copy & (block.n_words >= size)
    return (np.cumsum(edges[:-1]) > 0) | whole[block.doc]


def remove_repeats(
    docs: DataFrame, size: int = 13, with_text: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Every row of ``docs`` without the words of windows that a smaller ``doc_id`` has, too.

    Columns ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for,
    ``kept_text``: the kept words joined by one blank, or the text as it was where
    nothing is removed (NULL becomes empty), and a struct ``carried`` of the columns
    named in ``carry``. Words are what stands between ASCII
    blanks. Windows are judged on the input. NULL and empty texts have no words; a
    row with NULL ``doc_id`` keeps all words and takes none from others; rows with
    one ``doc_id`` take nothing from each other; other columns are ignored.
    """
    blocks, total = blocks_of(docs, carry)
    parts = partitions_for(docs, total, TASK_BYTES)
    copies = whole_copies(blocks)
    halves = first_level(blocks, copies, parts, size)
    notes = second_level(blocks, copies, halves, parts, size)
    fields = [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
    ]
    if with_text:
        fields.append(("kept_text", pa.string()))
    names = [name for name, _ in fields]
    schema = pa.schema(fields)

    def finish(key, table, found):
        if not table.num_rows:
            empty = schema.append(table.schema.field("_carried").with_name("carried")) if carry else schema
            return empty.empty_table()
        block = Block(table, found)
        gone = covered_words(block, found, size)
        removed = np.bincount(block.doc[gone], minlength=len(block.ids))
        hashes, texts = [], []
        for i, text in enumerate(block.texts):
            words = text.split()
            if removed[i]:
                start = block.first[i]
                words = compress(words, ~gone[start : start + block.n_words[i]])
            kept = b" ".join(words)
            hashes.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append((kept if removed[i] else text).decode())
        columns = [block.ids, block.n_words, removed, hashes, *([texts] if with_text else [])]
        done = pa.table(columns, schema=schema)
        if carry:
            done = done.append_column("carried", table["_carried"].take(block.order))
        return done

    result = T.StructType(
        [T.StructField(n, T.StringType() if n.startswith("kept") else T.LongType()) for n in names]
    )
    if carry:
        result.add("carried", blocks.schema["_carried"].dataType)
    return (
        blocks.groupBy("_block").cogroup(notes.groupBy("_block")).applyInArrow(finish, result)
    )


def _holders(size: int):
    """Function for a co-group: documents of a block with a repeated window."""
    schema = pa.schema([("doc_id", pa.int64())])

    def held(key, table, notes):
        if not table.num_rows:
            return pa.Table.from_batches([], schema)
        block = Block(table, notes)
        gone = covered_words(block, notes, size)
        ids = np.unique(block.known[block.doc[gone]])
        return pa.table([ids], schema=schema)

    return held


def longest_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """``doc_id, longest``: the longest of the lengths size, 2 size, 4 size ... at which a
    window of the document also starts in one with a smaller ``doc_id``.

    The doubling goes on until no window survives; documents without such a
    window are left out.
    """
    blocks, total = blocks_of(docs)
    parts = partitions_for(docs, total, TASK_BYTES)
    copies = whole_copies(blocks)
    found = None
    while True:
        halves = first_level(blocks, copies, parts, size)
        notes = second_level(blocks, copies, halves, parts, size)
        grouped = blocks.groupBy("_block").cogroup(notes.groupBy("_block"))
        holders = grouped.applyInArrow(_holders(size), "doc_id long").distinct()
        level = store(holders.withColumn("longest", F.lit(size).cast("long")), "repeats")
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        size *= 2
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, longest long")
    return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))

"""Near-duplicates by SimHash, found through Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The binary Golay
code has a codeword within distance 3 of every 23-bit word, so a segment is
decoded to the codewords within distance 4 of it: one or six. Two segments that
differ in at most two bits share one of them, because the word halfway between
them is decoded to a codeword near both.

Fingerprints that differ in at most four bits have two segments with at most two
errors together. Either one of these is without error, and the key is its bits
and a codeword of the other; or both have just one error, and the key is a
codeword of each (there one of the two segments has even weight, and its nearest
codeword alone will do). So equal keys meet every pair that counts; a pair with
equal keys is checked on its 64 bits.

Only different fingerprints are compared. A task links what meets in its keys and
passes on at most one row per fingerprint, its root there; alternating large-star
and small-star steps then join these trees into components.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import LOWER_BYTES, partitions_for, record_batch, store, text_bytes

BITS = 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_ERRORS = 4

# The Golay code's generator polynomial, its length and its check bits.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11

# Keys that one task holds at a time (16 bytes each).
KEYS_PER_TASK = 2_000_000
# About as many keys as a fingerprint has.
KEYS_EACH = 64

# Buckets up to this size are compared in steps over all buckets at once.
SMALL_BUCKET = 32


# ---- fingerprints ----------------------------------------------------------


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the hashes of all shingles; 0 without words.

    Words are what stands between ASCII blanks, A-Z lowered; a text of fewer words
    than a shingle is one shingle.
    """
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
        begins = [0, *ends]
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(begins, ends[width - 1 :])]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    value = 0
    for byte in range(8):
        seen = np.bincount(raw[:, byte], minlength=256)
        for bit in range(8):
            if 2 * int(seen[_BIT_SET[bit]].sum()) > len(hashes):
                value |= 1 << (8 * byte + bit)
    return value


_BIT_SET = [np.flatnonzero(np.arange(256) >> bit & 1) for bit in range(8)]


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every text as a signed number; NULL is empty.

    ``row`` names a column of texts that tell the rows apart; it comes along as ``row``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())] + [("row", pa.string())] * bool(row))

    def compute(batches):
        for batch in batches:
            found = [fingerprint(text) for text in batch.column(1).to_pylist()]
            fps = np.array(found, np.uint64).view(np.int64)
            yield record_batch(schema, batch.column(0), fps, *batch.columns[2:])

    carried = [F.col(row).alias("row")] if row else []
    texts = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"), *carried)
    return texts.mapInArrow(compute, "doc_id long, fp long" + ", row string" * bool(row))


# ---- Golay keys ------------------------------------------------------------


class Golay:
    """Decoder of the perfect binary Golay code (23, 12)."""

    def __init__(self):
        # Remainder of each power of x, and with it of each word, byte by byte.
        single = []
        for i in range(LENGTH):
            r = 1 << i
            for k in range(LENGTH - 1, CHECKS - 1, -1):
                if r >> k & 1:
                    r ^= GENERATOR << (k - CHECKS)
            single.append(r)
        self.tables = np.zeros((3, 256), np.int32)
        for part in range(3):
            for byte in range(256):
                for bit in range(8):
                    if byte >> bit & 1 and 8 * part + bit < LENGTH:
                        self.tables[part, byte] ^= single[8 * part + bit]
        # The error of each remainder: the words of weight up to 3 have all different ones.
        self.error = np.zeros(1 << CHECKS, np.int32)
        bits = [0, *(1 << i for i in range(LENGTH))]
        for a in bits:
            for b in bits:
                for c in bits:
                    if len({a, b, c} - {0}) == sum(x > 0 for x in (a, b, c)):
                        word = a | b | c
                        self.error[self.remainder(np.array([word]))[0]] = word

    def remainder(self, words: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[0, words & 255] ^ t[1, words >> 8 & 255] ^ t[2, words >> 16 & 255]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index of the codeword within distance 3."""
        return (words ^ self.error[self.remainder(words)]) >> CHECKS

    def near(self, words: np.ndarray) -> np.ndarray:
        """Indices of the codewords within distance 4: a row of six, -1 where there are fewer."""
        flips = np.array([0, *(1 << i for i in range(LENGTH))])
        found = np.sort(self.nearest(words[:, None] ^ flips[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found = -np.sort(-found, axis=1)
        return found[:, :6]


def keys_of(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints, and the number of the fingerprint of each key."""
    parts = [(fps >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in SEGMENTS]
    near = [code.near(p) for p in parts]
    # For one error: of a segment of even weight the nearest codeword is enough.
    single = []
    for p, found in zip(parts, near):
        even = np.bitwise_count(p) % 2 == 0
        one = np.full_like(found, -1)
        one[:, 0] = code.nearest(p)
        single.append(np.where(even[:, None], one, found))
    keys, owners = [], []

    def add(family, left, right):
        """Keys of ``left`` (rows x a) and ``right`` (rows x b), each -1 where there is none."""
        held = (left[:, :, None] >= 0) & (right[:, None, :] >= 0)
        key = (np.int64(family) << 40) | (left[:, :, None] << 12) | right[:, None, :]
        keys.append(key[held])
        owners.append(np.nonzero(held)[0])

    family = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                family += 1
                add(family, parts[i][:, None], near[j])
            if i < j:
                family += 1
                add(family, single[i], single[j])
    return np.concatenate(keys), np.concatenate(owners)


# ---- links -----------------------------------------------------------------


def linked_pairs(keys: np.ndarray, fps: np.ndarray):
    """Pairs of equal key whose fingerprints differ in few bits, as positions, in steps."""
    order = np.argsort(keys, kind="stable")
    keys, sorted_fps = keys[order], fps[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(keys)))
    # The place of the end of its bucket, for each row.
    end = np.repeat(first + sizes, sizes)
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    at = np.flatnonzero(small)
    for step in range(1, SMALL_BUCKET):
        at = at[at + step < end[at]]
        if not len(at):
            break
        close = np.bitwise_count(sorted_fps[at] ^ sorted_fps[at + step]) <= MOST_ERRORS
        yield order[at[close]], order[at[close] + step]
    for start, size in zip(first[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
        for i in range(start, start + size - 1):
            close = np.bitwise_count(sorted_fps[i] ^ sorted_fps[i + 1 : start + size]) <= MOST_ERRORS
            others = np.flatnonzero(close) + i + 1
            if len(others):
                yield np.repeat(order[i], len(others)), order[others]


def _gathered(pairs, least: int = 1 << 18):
    """The same pairs in larger steps."""
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= least:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def roots_of(n: int, pairs) -> np.ndarray:
    """Root, the smallest member, of each of ``n`` nodes under pairs of them."""
    root = np.arange(n)
    for left, right in _gathered(pairs):
        while True:
            a, b = root[left], root[right]
            apart = a != b
            if not apart.any():
                break
            left, right = left[apart], right[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def link(nodes: DataFrame, n: int) -> DataFrame:
    """Trees over fingerprints: ``a, b`` with b the smaller one, from all pairs that count."""
    keyed_schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    edge_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def keyed(batches):
        code = Golay()
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(start, 4096).to_numpy()
                keys, owners = keys_of(fps.view(np.uint64), code)
                yield record_batch(keyed_schema, keys, fps[owners])

    def joined(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        keys, fps = (np.concatenate(x) for x in zip(*parts))
        # In signed order, so that the smallest member is the same for every task.
        names, number = np.unique(fps, return_inverse=True)
        pairs = ((number[x], number[y]) for x, y in linked_pairs(keys, fps.view(np.uint64)))
        root = roots_of(len(names), pairs)
        moved = np.flatnonzero(root != np.arange(len(names)))
        yield record_batch(edge_schema, names[moved], names[root[moved]])

    parts = partitions_for(nodes, n * KEYS_EACH, KEYS_PER_TASK)
    keys = nodes.select("fp").mapInArrow(keyed, "key long, fp long")
    return keys.repartition(parts, "key").mapInArrow(joined, "a long, b long").distinct()


# ---- components ------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``a, root``: the smallest member of the component of each linked node but the root.

    Large-star hangs the larger neighbours of a node on its smallest neighbour,
    small-star the smaller ones; repeated, every component becomes a star. Each
    round is written to the shared folder. Minima are combined before the shuffle.
    """
    edges = store(edges.select("a", "b"), "edges")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # Stored, so that Spark can split a hub's links when it joins them.
        least = store(least.select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store(large.where("a <> b").distinct(), "large")
        small_least = store(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(small_least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            small_least.select("a", F.col("m").alias("b"))
        )
        small = store(small.where("a <> b").distinct(), "small")
        # Stars: every node has one smaller neighbour, and that one has none.
        many = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        chained = small.join(small.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if not many.count() and not chained.count():
            return small.select("a", F.col("b").alias("root"))
        edges = small


def near_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest ``doc_id`` reachable over fingerprints that
    differ in at most four bits. NULL and empty texts have fingerprint zero and
    are linked like any other. A row with NULL ``doc_id`` links others but is
    never a component's id, which is NULL where all are. Repeated rows give
    repeated results; other columns are ignored.

    With ``row``, a column of texts that tell the rows apart, the result has it as
    ``row``, and ``component``: a number that is one for all rows of a component
    and never NULL.
    """
    marked = store(fingerprints(docs, row), "fingerprints")
    nodes = store(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(link(nodes, nodes.count()))
    named = nodes.join(roots, nodes.fp == roots.a, "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    named = store(named, "roots")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = store(named.join(smallest, "root").select("fp", "root", "component_id"), "components")
    carried = ["row", F.col("root").alias("component")] if row else []
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *carried
    )

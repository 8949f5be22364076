import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from dockside.llm.sharding import SLOTS, bounds, ring_order, shard_rows, walk


def test_whole_and_even(make_docs, corpus):
    rows = corpus + [(5000 + i, f"t{i}") for i in range(301)] + [(9, "hot")] * 150
    got = shard_rows(make_docs(rows)).collect()
    assert sorted(
        ((r.doc_id, r.size, r.text_crc32) for r in got), key=repr
    ) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr
    )
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for shard in n:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n[shard]))


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(None, None)] * 3])
def test_few_rows(make_docs, rows):
    got = shard_rows(make_docs(rows)).collect()
    assert len(got) == len(rows) and all(r.slot == 0 for r in got)


def moved(counts, before, after, slack):
    """Rows that change shards, when rows of a slot keep their order."""

    def homes(shards):
        pieces = sorted(walk(counts, shards, 64, slack))
        out = []
        for slot, n in sorted(counts.items()):
            own = [(r, s) for x, r, s, _ in pieces if x == slot]
            ends = [r for r, _ in own[1:]] + [n]
            out += [s for (r, s), e in zip(own, ends) for _ in range(e - r)]
        return out

    return sum(a != b for a, b in zip(homes(before), homes(after)))


def test_little_moves_when_a_shard_is_added():
    counts = {slot: 1 + slot % 5 for slot in range(SLOTS)}
    total = sum(counts.values())
    # A ninth must move to the new shard; modulo sharding would move eight ninths.
    assert moved(counts, 8, 9, 0.25) < 0.25 * total
    assert moved(counts, 8, 9, 0.0) < 0.5 * total


def test_bounds_and_ring():
    assert bounds(17, 8, 0.0) == [3, 2, 2, 2, 2, 2, 2, 2]
    assert max(bounds(1000, 8, 0.1)) <= 138
    order = ring_order(8, 64)
    assert len(order) == SLOTS and all(sorted(o) == list(range(8)) for o in order)
    filled = Counter()
    counts = dict.fromkeys(range(SLOTS), 3)
    pieces = sorted(walk(counts, 8, 64, 0.1))
    for a, b in zip(pieces, [*pieces[1:], (None, 0, 0, 0)]):
        filled[a[2]] += (b[1] if b[0] == a[0] else 3) - a[1]
    assert sum(filled.values()) == 3 * SLOTS and max(filled.values()) <= bounds(3 * SLOTS, 8, 0.1)[0]


def ring_walk(rows, shards, virtual_nodes, slack):
    """Shard and place of every row, one by one around a plain ring; rows are ``(hash of id, hash, name)``."""
    nodes = sorted(
        (xxhash.xxh64_intdigest(f"shard {s} node {n}"), s) for s in range(shards) for n in range(virtual_nodes)
    )
    room = bounds(len(rows), shards, slack)
    filled, out = [0] * shards, {}
    waiting = sorted((h >> 52, own, name) for h, own, name in rows)
    for turn in range(shards):
        late = []
        for slot, own, name in waiting:
            at = [s for point, s in nodes if point >> 52 >= slot] + [s for _, s in nodes]
            shard = list(dict.fromkeys(at))[turn]
            if filled[shard] < room[shard]:
                out[name] = (shard, filled[shard])
                filled[shard] += 1
            else:
                late.append((slot, own, name))
        waiting = late
    return out


@pytest.mark.parametrize("slack", [0.0, 0.2])
def test_ring_row_by_row_and_any_partitioning(spark, slack):
    rows = [(i, f"text {i % 7}") for i in range(400)] + [(None, f"none {i}") for i in range(30)]
    rows += [(7, f"hot {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.col("text").cast("binary")
    hashed = docs.select(
        "doc_id", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", text).alias("own"), F.crc32(text).alias("c")
    ).collect()
    want = ring_walk([(r.h % 2**64, r.own, (r.doc_id, r.c)) for r in hashed], 8, 64, slack)
    assert len(want) == len(rows)
    for parts in (1, 3, 8):
        got = shard_rows(docs.repartition(parts, "text"), slack=slack).collect()
        assert {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in got} == want

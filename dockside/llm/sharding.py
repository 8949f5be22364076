"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has 4,096 slots of equal width. Every shard owns virtual nodes at hashed
slots; a row belongs to the slot of its hashed key and goes to the next virtual
node clockwise. A shard takes no more than its bound; rows that find it full
continue to the next shard on the ring. With no slack the bounds add up to the
number of rows, so every shard ends up exactly full; with slack fewer rows leave
the shard that the plain ring would give them.

The walk needs only the number of rows per slot, so it runs on 4,096 counts. Within
a slot rows stand in the order of a hash of their id and text. Their places come from
sorting by ranges of slot and hash, so no slot and no key is gathered into one task, and
the same rows get the same shards however the table is partitioned.
"""

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import store, text_bytes
from dockside.operators.ordered import global_rank

SLOT_BITS = 12
SLOTS = 1 << SLOT_BITS


def ring_order(shards: int, virtual_nodes: int) -> list[list[int]]:
    """For each slot the shards in the order in which the ring meets them clockwise."""
    owners: list[list[tuple[int, int]]] = [[] for _ in range(SLOTS)]
    for shard in range(shards):
        for node in range(virtual_nodes):
            point = xxhash.xxh64_intdigest(f"shard {shard} node {node}")
            owners[point >> (64 - SLOT_BITS)].append((point, shard))
    around = [shard for slot in owners for _, shard in sorted(slot)]
    first = []
    passed = 0
    for slot in owners:
        first.append(passed)
        passed += len(slot)
    orders: dict[int, list[int]] = {}
    for start in set(first):
        orders[start % len(around)] = list(dict.fromkeys(around[start:] + around[:start]))
    return [orders[start % len(around)] for start in first]


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows per shard: one apart without slack, else ``(1 + slack)`` times the mean."""
    if slack:
        return [max(1, -(-int(rows * (1 + slack) * 1000) // (1000 * shards)))] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def walk(counts: dict[int, int], shards: int, virtual_nodes: int, slack: float):
    """Where the rows of each slot go: ``(slot, from_rank, shard, first place in the shard)``.

    All rows first ask the nearest shard; those left over ask the next one, slot
    by slot around the ring, so a full shard never sends away a row that it has.
    """
    order = ring_order(shards, virtual_nodes)
    room = bounds(sum(counts.values()), shards, slack)
    filled = [0] * shards
    given = dict.fromkeys(counts, 0)
    pieces = []
    for turn in range(shards):
        for slot in sorted(counts):
            left = counts[slot] - given[slot]
            shard = order[slot][turn] if turn < len(order[slot]) else None
            if not left or shard is None:
                continue
            taken = min(left, room[shard] - filled[shard])
            if taken:
                pieces.append((slot, given[slot], shard, filled[shard]))
                filled[shard] += taken
                given[slot] += taken
    return pieces


def shard_rows(
    docs: DataFrame, shards: int = 8, virtual_nodes: int = 64, slack: float = 0.0
) -> DataFrame:
    """Shard and place of every row of ``docs``: ``doc_id, size, text_crc32, shard, slot``.

    A NULL text has size 1 and checksum 0. Rows with a NULL or repeated ``doc_id``
    share a slot of the ring and are counted one by one; of rows with one id and text
    any may overflow, which changes no row of the result. Columns other than
    ``doc_id`` and ``text`` are ignored; an empty table gives no rows. Only hashes, sizes
    and checksums are shuffled, however long a text is.
    """
    spark = docs.sparkSession
    text = text_bytes()
    keyed = store(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SLOT_BITS).cast("int").alias("_slot"),
            F.xxhash64("doc_id", text).alias("_hash"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "ring",
    )
    counted = keyed.groupBy("_slot").agg(F.count(F.lit(1)).alias("n"))
    # At most one number per slot of the ring.
    sums = sorted((row._slot, row.n) for row in counted.collect())
    pieces = walk(dict(sums), shards, virtual_nodes, slack)
    begins, total = {}, 0
    for slot, n in sums:
        begins[slot], total = total, total + n
    by_slot: dict[int, list] = {}
    for slot, rank, shard, place in pieces:
        by_slot.setdefault(slot, []).append((rank, shard, place))
    plan = spark.createDataFrame(
        [(slot, begins[slot], sorted(found)) for slot, found in by_slot.items()],
        "_slot int, _begin long, _pieces array<struct<rank:long,shard:int,place:long>>",
    )
    # The row's number parts only equal rows of equal hash, so that a hot row is dealt to many ranges.
    order = [F.asc("_slot"), F.asc("_hash"), F.asc("size"), F.asc("text_crc32"), F.asc("_row")]
    ranked = (
        global_rank(keyed, order, "_place")
        # The plan has one row per slot of the ring.
        .join(F.broadcast(plan), "_slot")
        .withColumn("_rank", F.col("_place") - 1 - F.col("_begin"))
    )
    piece = F.element_at(F.filter("_pieces", lambda p: p["rank"] <= F.col("_rank")), -1)
    return ranked.withColumn("_piece", piece).select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("_piece.shard").alias("shard"),
        (F.col("_piece.place") + F.col("_rank") - F.col("_piece.rank")).alias("slot"),
    )

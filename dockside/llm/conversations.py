"""Repair of damaged conversations at the least cost, in linear space.

What has been written so far of a repaired conversation is one of four states:
nothing, a system turn, up to a user turn, up to an assistant turn. Each row of a
conversation (kept, given another role or deleted, after any inserted turns) takes a
state to a state. By Hirschberg's division a stretch of rows is cut in the middle: costs
forward from its entry and backward from its exit meet there, and of the states with
the least sum the one whose forward edits are ASCII-least is crossed. Both halves
then go on in the same way, so no table of all rows and states is kept.

Edits up to a row are never the beginning of other edits up to it (both end with
the row's own edit), so the four states have a strict order, which the forward
pass carries along as ranks: no texts of edits are compared.

Rows are sorted over the whole table by ranges of conversation and turn, so
a conversation of any size is cut into pieces of bounded size. A piece is told by
two 4 x 4 tables, cost and order from each entry to each exit; over these the same
division finds the states between the pieces, and each piece is then solved by itself.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import partitions_for, row_numbers, store

COLUMNS = ("conv_id", "turn", "role", "text")

# Signs that count as blank, and those that end a sentence.
BLANKS = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")

# Costs of the edits, and of leaving a truncated row in.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# Rows, and characters of text, of a piece; a longer row is a piece by itself.
PIECE_ROWS = 1000
PIECE_CHARS = 1 << 20
# Rows that one task sorts.
ROWS_PER_TASK = 200_000

ROLES = {"u": "user", "a": "assistant"}

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = range(4)
EMITS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
# The turn that an edit can write in each state, and what then follows.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
# Inserted turns that end a conversation.
TAIL = {0: 0, 1: 2, 2: 1, 3: 0}

# Faults of a row.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)


def row_steps(initial: str, fault: int) -> tuple:
    """``(entry, exit, cost, edits)`` for every way over a row, the best one for each pair."""
    best = {}
    for entry in STATES:
        state = entry
        for inserts in range(3):
            ways = [(state, DELETE, "D")]
            if fault in (SOUND, CUT_OFF):
                extra = TRUNCATED if fault == CUT_OFF else 0
                ways.append((NEXT[state][1], RENAME + extra, "R"))
                if state in EMITS.get(initial, ()):
                    ways.append((EMITS[initial][state], extra, "K"))
            for leave, cost, letter in ways:
                found = (cost + INSERT * inserts, "I" * inserts + letter)
                best[entry, leave] = min(found, best.get((entry, leave), found))
            state = NEXT[state][1]
    return tuple((e, x, cost, edits) for (e, x), (cost, edits) in sorted(best.items()))


STEPS = {(i, f): row_steps(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def forward(steps: list, lo: int, hi: int, entry: int) -> dict[int, tuple[int, int]]:
    """Least cost of each state after ``steps[lo:hi]``, and the rank of its edits."""
    held = {entry: (0, 0)}
    for k in range(lo, hi):
        best = {}
        for e, x, cost, order in steps[k]:
            if e in held:
                found = (held[e][0] + cost, held[e][1], order)
                if x not in best or found < best[x]:
                    best[x] = found
        ranked = sorted(best, key=lambda x: best[x][1:])
        held = {x: (best[x][0], rank) for rank, x in enumerate(ranked)}
    return held


def backward(steps: list, lo: int, hi: int, leave: int) -> dict[int, int]:
    """Least cost from each state before ``steps[lo:hi]`` to ``leave``."""
    held = {leave: 0}
    for k in range(hi - 1, lo - 1, -1):
        best = {}
        for e, x, cost, _ in steps[k]:
            if x in held:
                best[e] = min(held[x] + cost, best.get(e, held[x] + cost))
        held = best
    return held


def crossings(steps: list, entry: int, leave: int) -> list[int]:
    """States before, between and after ``steps`` on the ASCII-least of the cheapest ways."""
    states = [entry] * len(steps) + [leave]
    spans = [(0, len(steps), entry, leave)]
    while spans:
        lo, hi, first, last = spans.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        left, right = forward(steps, lo, mid, first), backward(steps, mid, hi, last)
        met = min(
            (left[x][0] + right[x], left[x][1], x) for x in left if x in right
        )[2]
        states[mid] = met
        spans += [(lo, mid, first, met), (mid, hi, met, last)]
    return states


def best_exit(steps: list) -> int:
    """The state after all ``steps`` from which the conversation is best ended."""
    ends = forward(steps, 0, len(steps), 0)
    return min((cost + INSERT * TAIL[x], rank, x) for x, (cost, rank) in ends.items())[2]


def table_of(steps: list) -> list[tuple]:
    """``steps`` as one step: cost and order from each entry to each exit."""
    return [
        (e, x, cost, rank)
        for e in STATES
        for x, (cost, rank) in sorted(forward(steps, 0, len(steps), e).items())
    ]


def rewritten(rows: list, steps: list, entry: int, leave: int, ends: bool):
    """Cost, edits and turns of some rows between two states; ``ends`` adds the last turns."""
    states = crossings(steps, entry, leave)
    total, audit, turns = 0, [], []
    for k, (role, text) in enumerate(rows):
        cost, edits = next((c, w) for e, x, c, w in steps[k] if (e, x) == (states[k], states[k + 1]))
        total += cost
        audit.append(edits)
        state = states[k]
        for letter in edits:
            name, after = NEXT[state]
            if letter == "I":
                turns.append((ROLES[name], ""))
                state = after
            elif letter == "R":
                turns.append((ROLES[name], text))
            elif letter == "K":
                turns.append((role, text))
    state = leave
    for _ in range(TAIL[leave] if ends else 0):
        total += INSERT
        audit.append("I")
        turns.append((ROLES[NEXT[state][0]], ""))
        state = NEXT[state][1]
    return total, "".join(audit), turns


# ---- damage ----------------------------------------------------------------


def spaced(name: str) -> Column:
    """A value as text; NULL is one blank."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, one_in: int = 20) -> DataFrame:
    """``conv_id, turn, role, text`` with some rows dropped, emptied, cut, repeated or renamed.

    What happens to a row is a matter of the checksum of its ``conv_id`` and ``turn``
    alone. NULLs of ``role`` and ``text`` become one blank; NULL ids and turns stay, and
    count as a blank in the checksum. Other columns are left out.
    """
    return _damaged(conversations.select(*COLUMNS), one_in).drop("_copy")


def _damaged(conversations: DataFrame, one_in: int) -> DataFrame:
    """:func:`damaged` with all columns, and ``_copy`` to tell a repeated row from the first."""
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % one_in
    text = (
        F.when(kind == 1, "")
        .when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", ""))
        .otherwise(spaced("text"))
    )
    rows = conversations.withColumn("_kind", kind).where("_kind <> 0")
    rows = rows.withColumn("text", text).withColumn(
        "role", F.when(kind == 4, "user").otherwise(spaced("role"))
    )
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).drop("_kind")


# ---- sorted pieces ---------------------------------------------------------

PIECE = (
    "conv_id long, part int, piece int, whole boolean, n long, blank long, duplicate long,"
    " truncated long, illegal long, least long, most long, turns_seen long, first_turn long,"
    " last_turn long, first_role string, last_role string, table array<int>, cost long, audit string,"
    " roles array<string>, texts array<string>, faults array<int>"
)


def sorted_rows(rows: DataFrame, all_ids: DataFrame, parts: int) -> DataFrame:
    """Rows in order over the whole table, each first one of its kind behind a mark.

    ``flag`` is 0 for the mark of a conversation, 1 for that of the first row with some
    role and text, 2 for a row. A mark has the sorting values of what it marks, so
    both stand in one range. Rows of one turn go by role and digest of the text.
    """
    order = ("conv_id", "level", "turn", "role", "digest", "file", "number")
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    held = rows.select(
        F.col("conv_id").cast("long"),
        F.lit(1).alias("level"),
        F.col("turn").cast("long"),
        "role",
        digest.alias("digest"),
        F.col("_row.file").alias("file"),
        (F.col("_row.number") * 2 + F.col("_copy")).alias("number"),
        F.lit(2).alias("flag"),
        "text",
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "file", "number")
    firsts = held.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("at"))
    none = F.lit(None)
    marks = firsts.select(
        "conv_id", F.lit(1).alias("level"), "at.turn", "role", "digest", "at.file", "at.number",
        F.lit(1).alias("flag"), none.cast("string").alias("text"),
    )
    ids = all_ids.select(F.col("conv_id").cast("long")).distinct().select(
        "conv_id", F.lit(0).alias("level"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
        none.cast("binary").alias("digest"), none.cast("long").alias("file"), none.cast("long").alias("number"),
        F.lit(0).alias("flag"), none.cast("string").alias("text"),
    )
    ranged = held.unionByName(marks).unionByName(ids).repartitionByRange(parts, *order)
    return ranged.sortWithinPartitions(*order, "flag").select("conv_id", "turn", "role", "text", "flag")


class _Piece:
    """Rows of one conversation that follow one another."""

    def __init__(self):
        self.turns, self.rows, self.faults, self.chars = [], [], [], 0

    def add(self, turn, role, text, first: bool):
        body = text.rstrip(BLANKS)
        fault = (
            BLANK if not body
            else DUPLICATE if not first
            else CUT_OFF if body[-1] not in ENDS
            else SOUND
        )
        self.turns.append(turn)
        self.rows.append((role, text))
        self.faults.append(fault)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def told(self, conv_id, part: int, number: int, whole: bool) -> dict:
        """The row of :data:`PIECE`; a whole conversation is solved, another piece is told by its table."""
        initials = [role[:1] for role, _ in self.rows]
        steps = steps_of(initials, self.faults)
        turns = [t for t in self.turns if t is not None]
        out = {
            "conv_id": conv_id, "part": part, "piece": number, "whole": whole, "n": len(self.rows),
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE),
            "truncated": self.faults.count(CUT_OFF),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "least": turns[0] if turns else None, "most": turns[-1] if turns else None,
            "turns_seen": len(set(turns)),
            "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None,
            "first_role": initials[0] if initials else None, "last_role": initials[-1] if initials else None,
            "table": None, "cost": None, "audit": None, "faults": None,
        }
        if whole:
            cost, audit, written = rewritten(self.rows, steps, 0, best_exit(steps), True)
            out |= {"cost": cost, "audit": audit}
            out |= {"roles": [r for r, _ in written], "texts": [t for _, t in written]}
        else:
            out |= {"table": [v for step in table_of(steps) for v in step], "faults": self.faults}
            out |= {"roles": [r for r, _ in self.rows], "texts": [t for _, t in self.rows]}
        return out


def steps_of(initials: list[str], faults: list[int]) -> list:
    return [STEPS[i if i in EMITS else "", f] for i, f in zip(initials, faults)]


def _walk(batches, schema: pa.Schema):
    """Pieces of a sorted partition; the first and the last conversation may go on elsewhere."""
    part = TaskContext.get().partitionId()
    out, held_chars = [], 0
    # Pieces given in the partition, and of the conversation.
    given, of_conv = 0, 0
    piece, conv, alone, first, begun = _Piece(), None, True, False, False

    def give(whole):
        nonlocal held_chars, given, of_conv
        out.append(piece.told(conv, part, given, whole))
        held_chars += piece.chars
        given, of_conv = given + 1, of_conv + 1

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = batch.slice(at, 1024).to_pydict()
            for conv_id, turn, role, text, flag in zip(*rows.values()):
                if not begun or conv_id != conv:
                    if begun:
                        give(whole=not alone and of_conv == 0)
                        alone = False
                    piece, conv, first, begun, of_conv = _Piece(), conv_id, False, True, 0
                if flag == 1:
                    first = True
                elif flag == 2:
                    if piece.full():
                        give(whole=False)
                        piece = _Piece()
                    piece.add(turn, role, text, first)
                    first = False
            if len(out) >= 1000 or held_chars >= PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held_chars = [], 0
    if begun:
        give(whole=False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


# ---- between the pieces ----------------------------------------------------

LINK = "part int, piece int, entry int, leave int, ends boolean, gaps long, illegal_more long, whole_n long"


def _between(table: pa.Table) -> pa.Table:
    """Entry and exit of every piece of a conversation, and what only the whole can tell.

    A conversation of n rows brings n / 1000 small rows here.
    """
    rows = table.sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist()
    # A partition may begin or end with no row of the conversation.
    rows = [r for r in rows if r["n"]] or rows[:1]
    steps = [
        [tuple(r["table"][i : i + 4]) for i in range(0, len(r["table"]), 4)] for r in rows if r["n"]
    ]
    states = crossings(steps, 0, best_exit(steps)) if steps else [0, 0]
    turns, illegal, last_turn, last_role = 0, 0, None, None
    for r in rows:
        # Turns are sorted, so only neighbours can share one.
        shared = r["first_turn"] is not None and r["first_turn"] == last_turn
        turns += r["turns_seen"] - shared
        if last_role is not None and r["n"]:
            illegal += last_role + r["first_role"] not in ("su", "ua", "au")
        last_turn, last_role = r["last_turn"], r["last_role"]
    least = [r["least"] for r in rows if r["least"] is not None]
    most = [r["most"] for r in rows if r["most"] is not None]
    gaps = max(most) - min(least) + 1 - turns if least else 0
    n = sum(r["n"] for r in rows)
    out = []
    for k, r in enumerate(rows):
        head = k == 0
        out.append({
            "part": r["part"], "piece": r["piece"], "entry": states[k], "leave": states[k + 1],
            "ends": k == len(rows) - 1, "gaps": gaps if head else 0,
            "illegal_more": illegal if head else 0, "whole_n": n if head else 0,
        })
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """Cheapest repair of every conversation (``conv_id, turn, role, text``), in pieces.

    A row per piece: ``conv_id``, ``part`` and ``piece`` (their order), ``whole`` (the
    conversation has no other piece), ``gaps, blank, duplicate, truncated, illegal, cost`` (to be
    added up over the pieces), ``audit`` (the edits' initials) and the repaired turns as ``roles``
    and ``texts``. Rows go by turn, NULL first, then by role and the text's digest;
    of equal rows one is first. A row is blank, a duplicate of an earlier row of its
    conversation, truncated, or sound. A role without first letter s, u or a cannot stay.
    A conversation without rows has one piece without edits. NULL ids are one
    conversation; NULL roles and texts are one blank; other columns are ignored.

    Long texts are pieces by themselves; a conversation of any number of rows is spread
    over tasks, and only small tables of its pieces meet.
    """
    rows = row_numbers(conversations.select(*COLUMNS), "_row").withColumn("_copy", F.lit(0))
    return _repair(rows, conversations.select("conv_id"))


def repair_damaged(conversations: DataFrame, one_in: int = 20) -> DataFrame:
    """:func:`repair` of what :func:`damaged` leaves; conversations that lost all rows are there, too."""
    rows = _damaged(row_numbers(conversations.select(*COLUMNS), "_row"), one_in)
    return _repair(rows, conversations.select("conv_id"))


def _repair(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    rows = rows.select("_row", "_copy", "conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"))
    spark = rows.sparkSession
    parts = partitions_for(rows, all_ids.count(), ROWS_PER_TASK)
    schema = _arrow(spark, PIECE)
    ordered = sorted_rows(rows, all_ids, parts)
    pieces = store(ordered.mapInArrow(lambda batches: _walk(batches, schema), PIECE), "pieces")
    told = pieces.where("NOT whole")
    slim = told.select(
        "conv_id", "part", "piece", "n", "least", "most", "turns_seen", "first_turn", "last_turn",
        "first_role", "last_role", "table",
    )
    link_schema = _arrow(spark, LINK)

    def between(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_between(table), schema=link_schema)

    links = slim.groupBy("conv_id").applyInArrow(between, LINK)
    result = (
        "conv_id long, part int, piece int, whole boolean, gaps long, blank long, duplicate long,"
        " truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"
    )
    solved_schema = _arrow(spark, result)

    def solve(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                given = list(zip(row["roles"], row["texts"]))
                steps = steps_of([role[:1] for role, _ in given], row["faults"])
                cost, audit, turns = rewritten(given, steps, row["entry"], row["leave"], row["ends"])
                done = {k: row[k] for k in ("conv_id", "part", "piece", "gaps", "blank", "duplicate", "truncated")}
                done |= {"whole": False, "illegal": row["illegal"] + row["illegal_more"], "cost": cost}
                done |= {"audit": audit, "roles": [r for r, _ in turns], "texts": [t for _, t in turns]}
                yield pa.RecordBatch.from_pylist([done], schema=solved_schema)

    solved = told.join(links, ["part", "piece"]).select(
        "conv_id", "part", "piece", "blank", "duplicate", "truncated", "illegal", "roles", "texts",
        "faults", "entry", "leave", "ends", "gaps", "illegal_more",
    ).mapInArrow(solve, result)
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns_seen"), F.lit(0))
    whole = pieces.where("whole").withColumn("gaps", gaps.cast("long"))
    return whole.select(*solved.columns).unionByName(solved)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# ---- digests ---------------------------------------------------------------

DIGESTS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, repaired_sha256 string"
)


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation: sums, edits, and SHA-256 of the repaired ``role:text`` lines.

    Conversations of one piece are digested where they are. The pieces of longer ones go
    to one task in order, which digests them one after the other and keeps none.
    """
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"]))
    text = F.array_join(lines, "\n")
    whole = pieces.where("whole").withColumn("repaired_sha256", F.sha2(text.cast("binary"), 256))
    schema = _arrow(pieces.sparkSession, DIGESTS)
    sums = names[1:7]

    def follow(batches):
        conv, total, audit, digest, lines, begun = None, None, None, None, 0, False

        def done():
            values = {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([values | dict(zip(sums, total))], schema=schema)

        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                if not begun or row["conv_id"] != conv:
                    if begun:
                        yield done()
                    conv, total, audit, digest, lines = row["conv_id"], [0] * 6, [], hashlib.sha256(), 0
                    begun = True
                total = [a + row[c] for a, c in zip(total, sums)]
                audit.append(row["audit"])
                for role, text in zip(row["roles"], row["texts"]):
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
        if begun:
            yield done()

    longer = pieces.where("NOT whole").repartition("conv_id")
    longer = longer.sortWithinPartitions("conv_id", "part", "piece").mapInArrow(follow, DIGESTS)
    return whole.select(*names).unionByName(longer)

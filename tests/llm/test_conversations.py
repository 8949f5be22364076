"""Conversation repair against a plain table of all rows and states, and against all edits of short ones."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from dockside.llm import conversations
from dockside.llm.conversations import digests, repair, repair_damaged

GOAL = re.compile(r"(s?(ua)+)?\Z")
BLANK = " \t\n\x0b\f\r"
TYPE = "conv_id long, turn long, role string, text string, flag string, _row int, level string, audit int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def judged(rows):
    """Faults of the rows of one conversation, in order."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        body = text.rstrip(BLANK)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """Least cost and then ASCII-least edits, by a table from the end on; two inserts in a row at most."""

    @lru_cache(None)
    def inner(i, said, used):
        ways = []
        if i == len(rows):
            ways += [(0, "")] if said in ("", "ua") else []
        else:
            _, role, _, fault = rows[i]
            ways.append((2 + (r := outer(i + 1, said))[0], "D" + r[1]))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for letter, names, cost in (("K", (role[:1],), 0), ("R", ("u", "a"), 1)):
                    for name in names:
                        if (after := step(said, name)) is not None:
                            r = outer(i + 1, after)
                            ways.append((cost + extra + r[0], letter + r[1]))
        if used < 2:
            for more in ("u", "a"):
                if (after := step(said, more)) is not None:
                    r = inner(i, after, used + 1)
                    ways.append((5 + r[0], "I" + r[1]))
        return min(ways) if ways else (10**9, "")

    def outer(i, said):
        return inner(i, said, 0)

    return outer(0, "")


def step(said, name):
    """What has been said, shortened: nothing, s, su, ua."""
    if name == "s":
        return "s" if said == "" else None
    if name == "u":
        return "su" if said in ("", "s", "ua") else None
    if name == "a":
        return "ua" if said == "su" else None
    return None


def apply(rows, audit):
    lines, said, at = [], "", 0
    for letter in audit:
        after = "a" if said == "su" else "u"
        if letter == "D":
            at += 1
            continue
        if letter == "I":
            name, line = after, {"u": "user:", "a": "assistant:"}[after]
        else:
            _, role, text, _ = rows[at]
            at += 1
            name = role[:1] if letter == "K" else after
            line = f"{role}:{text}" if letter == "K" else f"{ {'u': 'user', 'a': 'assistant'}[after]}:{text}"
        said = step(said, name)
        lines.append(line)
    assert at == len(rows) and said in ("", "ua")
    return "\n".join(lines)


def brute(rows, ids):
    out = []
    for conv in ids:
        held = judged([r for r in rows if r[0] == conv])
        turns = [t for t, *_ in held if t is not None]
        initials = [r[:1] for _, r, _, _ in held]
        cost, audit = cheapest(tuple(held))
        counts = [sum(f == kind for *_, f in held) for kind in ("blank", "duplicate", "truncated")]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts,
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256(apply(held, audit).encode()).hexdigest(),
        ))
    return out


def made(seed, convs=60, long=()):
    rng = random.Random(seed)
    texts = ["Yes.", "no", " ", "", "Why?\n", "a b c!", "zwölf", "Yes.", "x" * 300 + "."]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, 9) if conv not in long else 90):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", None])
            if rng.random() < 0.6:
                role = ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}" + rng.choice([".", ""])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randint(0, 1), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (None, 1, "user", "Hi."), (77, 5, None, None)]
    rows += [(78, None, "system", "Only.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TYPE).repartition(3)


def found(pieces):
    return sorted(map(repr, map(tuple, digests(pieces).collect())))


@pytest.mark.parametrize("size", [1000, 4, 1])
def test_damaged_rows(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "PIECE_ROWS", size)
    rows = made(size, long=(3, 4))
    ids = list(dict.fromkeys(r[0] for r in rows))
    got = found(repair_damaged(frame(spark, rows)))
    assert got == sorted(map(repr, brute(damage(rows), ids)))


def test_rows_as_they_are(spark):
    rows = made(9)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found(repair(frame(spark, rows))) == sorted(map(repr, brute(clean, list(dict.fromkeys(r[0] for r in rows)))))


def test_empty_table(spark):
    assert digests(repair(frame(spark, made(1, 3)).limit(0))).collect() == []


def test_lost_conversations_and_one_hot_turn(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", 50)
    lost = next((c, t, "user", "a.") for c in range(100, 400) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    one = next(c for c in range(100) if zlib.crc32(f"{c}: ".encode()) % 20 > 4)
    hot = [(one, None, "user", "same text.")] * 2000
    got = digests(repair_damaged(frame(spark, [lost, *hot]))).collect()
    assert {r.conv_id for r in got} == {lost[0], one}
    for row in got:
        if row.conv_id == one:
            assert row.duplicate == 1999 and set(row.audit) <= set("DKI") and row.cost > 3900
        else:
            empty = hashlib.sha256(b"").hexdigest()
            assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", empty)


def test_hot_conversation_is_spread(spark, monkeypatch):
    monkeypatch.setattr(conversations, "ROWS_PER_TASK", 300)
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(3000)]
    pieces = repair(frame(spark, rows))
    sizes = {(r.part, r.piece): len(r.audit) for r in pieces.collect()}
    assert len({part for part, _ in sizes}) > 4 and max(sizes.values()) <= 1000
    (row,) = digests(pieces).collect()
    assert row.audit == "K" * 3000 and row.cost == 0


def test_every_edit_of_short_conversations():
    """All edits are tried, not only those a state machine allows."""
    rng = random.Random(5)
    for _ in range(40):
        rows = [
            (i, rng.choice(["user", "assistant", "system", "tool"]), f"t{i}", rng.choice(["", "", "truncated", "blank"]))
            for i in range(rng.randint(0, 3))
        ]
        best = None
        for edits in itertools.product(*[["D", "K", "Ru", "Ra"]] * len(rows)):
            if any(f == "blank" and e != "D" for e, (*_, f) in zip(edits, rows)):
                continue
            for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                roles, audit, cost = inserts[0], "I" * len(inserts[0]), 5 * len(inserts[0])
                for e, (_, role, _, f), more in zip(edits, rows, inserts[1:]):
                    roles += {"D": "", "K": role[0]}.get(e, e[1:]) + more
                    audit += e[0] + "I" * len(more)
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if f == "truncated" and e != "D" else 0) + 5 * len(more)
                if GOAL.match(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        kinds = {"": 0, "blank": 1, "truncated": 3}
        steps = conversations.steps_of([r[1][:1] for r in rows], [kinds[r[3]] for r in rows])
        got = conversations.rewritten([(r[1], r[2]) for r in rows], steps, 0, conversations.best_exit(steps), True)
        assert got[:2] == best == cheapest(tuple(rows))

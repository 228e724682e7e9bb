import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n int, block string"


def plain_repair(rows):
    """Shortest paths over every audit: a plain table of (cost, audit) per state, row by row."""
    state = {0: (0, "")}

    def inserts(now):
        for _ in range(3):
            for q, (cost, audit) in list(now.items()):
                to = c.FOLLOWING[q]
                now[to] = min(now.get(to, (9e9, "")), (cost + 3, audit + "I"))
        return now

    state = inserts(state)
    for initial, gone, extra in rows:
        after = {}
        for q, (cost, audit) in state.items():
            ways = [(q, cost + 4, "D")]
            if not gone:
                ways.append((c.FOLLOWING[q], cost + 3 + extra, "R"))
                if c.kept_from(initial, q) is not None:
                    ways.append((c.kept_from(initial, q), cost + extra, "K"))
            for to, total, letter in ways:
                after[to] = min(after.get(to, (9e9, "")), (total, audit + letter))
        state = inserts(after)
    return min(state[q] for q in (0, 3) if q in state)


def plain(rows):
    """Damaged rows -> what the query returns, conversation by conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text, *_ in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                mine += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        mine.sort()
        seen, kinds = set(), []
        for _, _, role, text in mine:
            body = text.strip(" \t\n\v\f\r")
            kinds.append("blank" if not body else "duplicate" if (role, text) in seen
                         else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        weighed = [(r[2][:1], k in ("blank", "duplicate"), 3 if k == "truncated" else 0) for r, k in zip(mine, kinds)]
        cost, audit = plain_repair(weighed)
        lines, last, rest = [], "", iter(mine)
        for e in audit:
            row = None if e == "I" else next(rest)
            if e != "D":
                role = row[2] if e == "K" else "assistant" if last == "u" else "user"
                lines.append(role + ":" + (row[3] if row else ""))
                last = role[0]
        turns = {r[1] for r in mine if r[0]}
        initials = [r[2][:1] for r in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(kinds.count, ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def awkward():
    rng = random.Random(7)
    rows = [(i, t, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None, "Umbra"]),
             rng.choice(["One.", "Two!", "cut off", "", " \t\n", None, "Long, " * 50 + "end?", f"Text {t}. "]))
            for i in range(60) for t in rng.sample(range(9), rng.randint(1, 8))]
    rows += [(70, t, ["user", "assistant"][t % 2], f"Whole {t}.") for t in range(30)]
    rows += [(71, 3, "user", "Again.")] * 7 + [(72, None, None, None), (None, 1, "user", "No id."), (None, None, "assistant", "So.")]
    rows += [(73, t, "user", "The same.") for t in range(9)] + [(74, -5, "user", "A\n."), (74, 900, "assistant", "é.")]
    rows += [(75, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No.", "why", f"T{t}."])) for t in range(60)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"rows": 3}, {"rows": 11, "octets": 40}])
def test_conversations_equal_a_plain_table(spark, limits):
    rows = awkward()
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    found = sorted(map(tuple, c.repaired_digests(table, **limits).collect()), key=str)
    assert found == plain(rows)


def test_every_short_conversation():
    """All sequences of up to four rows: cost and least audit are those of the plain table."""
    kinds = [(i, g, e) for i in "sua" for g, e in ((False, 0), (True, 0), (False, 3))] + [("x", False, 0)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert c.cheapest(rows) == plain_repair(rows)
    rng = random.Random(3)
    for _ in range(300):
        rows = [rng.choice(kinds) for _ in range(rng.randint(4, 40))]
        assert c.cheapest(rows) == plain_repair(rows)


def test_states_without_a_way():
    assert c.cheapest([], c.USER, (c.SYSTEM,)) is None
    assert c.cheapest([("s", False, 0)], c.START, (c.SYSTEM,)) == (0, "K")
    assert c.cheapest([("u", False, 0)], c.USER, (c.START,)) is None


def test_empty_table_and_lost_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert c.repaired_digests(none).count() == 0
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hi.", "x", 1, "y")], SCHEMA)
    assert c.repaired_digests(one).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_are_rows(spark):
    table = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C.")],
                                  "conv_id long, turn long, role string, text string")
    summary, turns = c.repair(table)
    assert (summary.first()["audit"], summary.first()["cost"]) == ("KIKK", 3)
    assert [tuple(t) for t in turns.first()["turns"]] == [
        ("K", 0, "user", "A."), ("I", None, "assistant", ""), ("K", 1, "user", "B."), ("K", 2, "assistant", "C.")]

"""Repair of conversation structure by a bidirectional Dijkstra search over the edit lattice.

A node of the lattice is (rows used, what stands at the end of the result): nothing, a system turn, a user turn, an assistant
turn.  Edits are edges: Keep, Rerole, Delete use a row, Insert does not.  The result must be a user-assistant alternation,
perhaps after one system turn, or nothing.  A forward heap starts from nothing, a reverse heap from the ends allowed; both
settle nodes by cost until the two least costs add up to more than the cheapest crossing, so every crossing of that cost is
known.  Each node holds its ASCII-least audit (the initials of its edits) among the cheapest; the least concatenation of a
forward and a reverse audit is the repair.  An audit names its target of every edit: only one role can follow each.

A conversation of up to `rows` rows and `octets` bytes is worked on in one piece.  Longer ones are range sorted into blocks; a block is
searched between every two of its end states, the blocks' tables are chained per conversation, and each block applies its
own piece of the audit, so no task holds the rows of a long conversation.
"""

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from plumbline.llm.common import settle

#: What one piece holds at most.
ROWS, OCTETS = 2000, 1 << 24
KEEP, REROLE, INSERT, DELETE, CUT = 0, 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that must follow each state, and the states a turn can follow.
FOLLOWING = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
NAMES = ("", "system", "user", "assistant")
FINAL = (START, ASSISTANT)
_SPACE = " \t\n\v\f\r"
_STOPS = ".!?"


def kept_from(initial, state):
    """The state after a kept turn, or None if it must not stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    wanted = {"u": USER, "a": ASSISTANT}.get(initial)
    return wanted if wanted == FOLLOWING[state] else None


def cheapest(rows, start=START, ends=FINAL):
    """rows of (initial, must go, extra cost if it stays) -> (cost, least audit) from `start` to any of `ends`, or None."""
    n = len(rows)
    ahead, back = {(0, start): (0, "")}, {(n, q): (0, "") for q in ends}
    front, rear = [(0, 0, start)], [(0, 0, q) for q in ends]
    heapq.heapify(rear)
    done_front, done_rear = set(), set()
    best = 0 if n == 0 and start in ends else None

    def reach(table, heap, other, node, cost, audit, depth):
        nonlocal best
        held = table.get(node)
        if held is None or (cost, audit) < held:
            table[node] = (cost, audit)
            if held is None or cost < held[0]:
                heapq.heappush(heap, (cost, depth, node[1]))
            met = other.get(node)
            if met is not None and (best is None or cost + met[0] < best):
                best = cost + met[0]

    while front and rear and (best is None or front[0][0] + rear[0][0] <= best):
        if front[0][0] <= rear[0][0]:
            cost, i, q = heapq.heappop(front)
            if (i, q) in done_front or ahead[i, q][0] < cost:
                continue
            done_front.add((i, q))
            audit = ahead[i, q][1]
            if i < n:
                initial, gone, extra = rows[i]
                reach(ahead, front, back, (i + 1, q), cost + DELETE, audit + "D", i + 1)
                if not gone:
                    kept = kept_from(initial, q)
                    if kept is not None:
                        reach(ahead, front, back, (i + 1, kept), cost + KEEP + extra, audit + "K", i + 1)
                    reach(ahead, front, back, (i + 1, FOLLOWING[q]), cost + REROLE + extra, audit + "R", i + 1)
            reach(ahead, front, back, (i, FOLLOWING[q]), cost + INSERT, audit + "I", i)
        else:
            cost, j, q = heapq.heappop(rear)
            i = n - j
            if (i, q) in done_rear or back[i, q][0] < cost:
                continue
            done_rear.add((i, q))
            audit = back[i, q][1]
            if i > 0:
                initial, gone, extra = rows[i - 1]
                reach(back, rear, ahead, (i - 1, q), cost + DELETE, "D" + audit, j + 1)
                if not gone:
                    for p in range(4):
                        if kept_from(initial, p) == q:
                            reach(back, rear, ahead, (i - 1, p), cost + KEEP + extra, "K" + audit, j + 1)
                    for p in BEFORE[q]:
                        reach(back, rear, ahead, (i - 1, p), cost + REROLE + extra, "R" + audit, j + 1)
            for p in BEFORE[q]:
                reach(back, rear, ahead, (i, p), cost + INSERT, "I" + audit, j)
    if best is None:
        return None
    crossings = ((node, held) for node, held in ahead.items() if node in back)
    return best, min(held[1] + back[node][1] for node, held in crossings if held[0] + back[node][0] == best)


def apply(rows, audit, state=START):
    """rows of (turn, role, text) -> the turns (edit, turn, role, text) of an audit; deleted ones are left out."""
    out, rows = [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = FOLLOWING[state]
            out.append((edit, None, NAMES[state], ""))
            continue
        turn, role, text = next(rows)
        if edit == "D":
            continue
        if edit == "R":
            role = NAMES[FOLLOWING[state]]
            state = FOLLOWING[state]
        else:
            state = kept_from(role[:1], state)
        out.append((edit, turn, role, text))
    return out


def fault(role, text, repeated):
    """The first fault of a row: blank, duplicate, truncated or None."""
    tail = text.rstrip(_SPACE)
    if not tail:
        return "blank"
    if repeated:
        return "duplicate"
    return None if tail[-1] in _STOPS else "truncated"


def _weighed(role, kind):
    return role[:1], kind in ("blank", "duplicate"), CUT if kind == "truncated" else 0


def _illegal(initials):
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_TURNS_SQL = "array<struct<edit:string,turn:long,role:string,text:string>>"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _rows(table, conv, turn, role, text):
    """(conv, turn, role, text): nulls of role and text are one space."""
    space = F.lit(" ")
    return table.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role).cast("string"), space).alias("role"),
                        F.coalesce(F.col(text).cast("string"), space).alias("text"))


def _grouped(batches):
    """Sorted batches whose first column is the conversation -> (conversation, its other columns' rows)."""
    held, last = [], ()
    for batch in batches:
        for conv, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if last != (conv,):
                if held:
                    yield last[0], held
                held, last = [], (conv,)
            held.append(tuple(rest))
    if held:
        yield last[0], held


def _whole(batches):
    """Conversations that fit a task: counts, audit and repaired turns of each."""
    schema = pa.schema([("conv", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("turns", _TURNS)])
    names, made = [f.name for f in _TURNS.value_type], []
    for conv, rows in _grouped(batches):
        seen, kinds = set(), []
        for _, role, text in rows:
            kinds.append(fault(role, text, (role, text) in seen))
            seen.add((role, text))
        cost, audit = cheapest([_weighed(role, kind) for (_, role, _), kind in zip(rows, kinds)])
        known = {t for t, _, _ in rows if t is not None}
        made.append({"conv": conv, "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
                     **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
                     "illegal": _illegal([r[:1] for _, r, _ in rows]), "cost": cost, "audit": audit,
                     "turns": [dict(zip(names, t)) for t in apply(rows, audit)]})
        if len(made) >= 512:
            yield pa.RecordBatch.from_pylist(made, schema)
            made = []
    if made:
        yield pa.RecordBatch.from_pylist(made, schema)


_BLOCK = pa.schema([
    ("conv", pa.int64()), ("block", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns_known", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    ("body", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))])
_BLOCK_SQL = ("conv long, block long, first_turn long, last_turn long, turns_known long, blank long, duplicate long, truncated long,"
              "illegal long, first string, last string, costs array<long>, audits array<string>,"
              "body array<struct<turn:long,role:string,text:string>>")


def _blocks(batches, most_rows, octets):
    """Range-sorted rows (conv, turn, role, text, repeated, part, copies) -> blocks with a table between all end states."""
    place = TaskContext.get().partitionId() << 32

    def close(conv, rows, kinds):
        nonlocal place
        weighed = [_weighed(role, kind) for (_, role, _), kind in zip(rows, kinds)]
        found = [cheapest(weighed, a, (b,)) for a in range(4) for b in range(4)]
        known = {t for t, _, _ in rows if t is not None}
        initials = [r[:1] for _, r, _ in rows]
        place += 1
        return pa.RecordBatch.from_pylist([{
            "conv": conv, "block": place, "first_turn": min(known, default=None), "last_turn": max(known, default=None),
            "turns_known": len(known), **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": _illegal(initials), "first": initials[0], "last": initials[-1],
            "costs": [f and f[0] for f in found], "audits": [f and f[1] for f in found],
            "body": [{"turn": t, "role": r, "text": x} for t, r, x in rows]}], _BLOCK)

    last, rows, kinds, size = (), [], [], 0
    for batch in batches:
        for conv, turn, role, text, repeated, part, copies in zip(*(c.to_pylist() for c in batch.columns)):
            for k in range(copies):
                if rows and (last != (conv,) or len(rows) >= most_rows or size >= octets):
                    yield close(last[0], rows, kinds)
                    rows, kinds, size = [], [], 0
                last = (conv,)
                rows.append((turn, role, text))
                kinds.append(fault(role, text, repeated or part + k > 0))
                size += len(text)
    if rows:
        yield close(last[0], rows, kinds)


def _chain(batches):
    """Blocks of each conversation in order -> its counts, and every block's piece of the audit with its first state."""
    names = ["conv", "block", "state", "piece", *_COUNTS]
    for conv, blocks in _grouped(batches):
        rest = {q: (0, 0, "") for q in FINAL}  # from a state to the end: cost, next state, audit from here on
        steps = []
        for b in reversed(blocks):
            costs, audits = b[-2], b[-1]
            now = {}
            for a in range(4):
                ways = [(costs[4 * a + e] + rest[e][0], audits[4 * a + e] + rest[e][2], e) for e in rest
                        if costs[4 * a + e] is not None]
                if ways:
                    cost, audit, e = min(ways)
                    now[a] = (cost, e, audit)
            steps.append({a: e for a, (_, e, _) in now.items()})
            rest = now
        total, state, out = rest[START][0], START, []
        for b, step in zip(blocks, reversed(steps)):
            end = step[state]
            out.append((b[0], state, b[-1][4 * state + end]))
            state = end
        known = [(b[1], b[2], b[3]) for b in blocks if b[3]]
        distinct = sum(k for _, _, k in known) - sum(x[1] == y[0] for x, y in zip(known, known[1:]))
        gaps = known[-1][1] - known[0][0] + 1 - distinct if known else 0
        seams = sum(x[9] + y[8] not in ("su", "ua", "au") for x, y in zip(blocks, blocks[1:]))
        sums = [gaps, *(sum(b[k] for b in blocks) for k in (4, 5, 6)), sum(b[7] for b in blocks) + seams, total]
        columns = [[conv] * len(out), *map(list, zip(*out)), *([v] * len(out) for v in sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "piece" else pa.int64())
                                          for n, c in zip(names, columns)], names)


def _applied(batches):
    names = [f.name for f in _TURNS.value_type]
    for batch in batches:
        conv, block, state, piece, body = (c.to_pylist() for c in batch.columns)
        turns = [[dict(zip(names, t)) for t in apply([(r["turn"], r["role"], r["text"]) for r in b], p, s)]
                 for s, p, b in zip(state, piece, body)]
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(block, pa.int64()), pa.array(turns, _TURNS)],
                                         ["conv", "block", "turns"])


def _long(rows, limit, octets):
    """(summary, turns by block) of conversations that do not fit a task."""
    # equal rows of a turn are one row with a number of copies, dealt in portions
    copies = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    early = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = copies.groupBy("conv", "role", "text").agg(F.min(early).alias("early")).select(
        F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("text").alias("text_"), "early")
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("text") == F.col("text_"))
    told = copies.join(firsts, same).withColumn("part", F.explode(F.expr(f"sequence(0L, n - 1, {limit}L)"))).select(
        "conv", "turn", "role", "text", (early > F.col("early")).alias("repeated"), "part",
        F.least(F.col("n") - F.col("part"), F.lit(limit)).alias("copies"))
    told = settle(told, "long-rows")
    size = told.agg(F.sum("copies"), F.sum(F.octet_length("text") * F.col("copies"))).first()
    parts = 1 + max(size[0] // (8 * limit), int(size[1]) // (8 * octets))
    order = ["conv", "turn", "role", "text", "part"]
    ranged = told.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    blocks = settle(ranged.mapInArrow(lambda b: _blocks(b, limit, octets), _BLOCK_SQL), "blocks")
    tasks = blocks.repartition("conv").sortWithinPartitions("conv", "block").drop("body")
    chained = settle(tasks.mapInArrow(_chain, "conv long, block long, state long, piece string, " + ", ".join(
        f"{c} long" for c in _COUNTS)), "chains")
    summary = chained.groupBy("conv", *_COUNTS).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("audit"))
    joined = blocks.select("block", "conv", "body").join(chained.select("block", "state", "piece"), "block")
    turns = joined.select("conv", "block", "state", "piece", "body").mapInArrow(_applied, f"conv long, block long, turns {_TURNS_SQL}")
    return summary.select("conv", *_COUNTS, "audit"), turns


def repair(table, conv_column="conv_id", turn_column="turn", role_column="role", text_column="text", rows=ROWS, octets=OCTETS):
    """(summary, turns) of all conversations.

    summary: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit).  turns: (conv, block, turns), the repaired
    turns (edit, turn, role, text) in order, blocks of a long conversation in order of `block`; edits are K, R or I.
    Rows are ordered by turn (nulls first), then role and text.  Null roles and texts are one space; rows without a
    conversation are one conversation.  A row's first fault counts: blank, a repeat of an earlier row's role and text,
    or no end of sentence.  Rows that repeat are duplicates.  A role that begins with none of s, u, a can only be changed or deleted.
    An empty table has no conversations.  Other columns are not read.
    """
    cast = _rows(table, conv_column, turn_column, role_column, text_column)
    sizes = cast.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    big = settle(sizes.where(f"n > {rows} OR b > {octets}").select(F.col("conv").alias("conv_")), "long")
    some = big.limit(1).count() > 0
    same = F.col("conv").eqNullSafe(F.col("conv_"))
    small = cast.join(big, same, "left_anti") if some else cast
    sorted_ = small.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kinds = "conv long, " + ", ".join(f"{c} long" for c in _COUNTS) + f", audit string, turns {_TURNS_SQL}"
    whole = settle(sorted_.mapInArrow(_whole, kinds), "repaired")
    summary, turns = whole.drop("turns"), whole.select("conv", F.lit(0).cast("long").alias("block"), "turns")
    if some:
        more, pieces = _long(cast.join(big, same, "left_semi"), rows, octets)
        summary, turns = summary.unionByName(more), turns.unionByName(pieces)
    return summary, turns


def digests(turns):
    """(conv, repaired_sha256) over `role:text` of the repaired turns, joined by newlines.

    A conversation's blocks pass through one running hash in order: a sum over one stream of bytes cannot be split, but no
    more than a block is held.
    """
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    lines = turns.select("conv", "block", F.size("turns").alias("n"), body.alias("body"))

    def run(batches):
        last, total, begun = (), None, False
        for batch in batches:
            done = []
            for conv, _, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last != (conv,):
                    if last:
                        done.append((last[0], total.hexdigest()))
                    last, total, begun = (conv,), hashlib.sha256(), False
                if n:
                    total.update((b"\n" if begun else b"") + text.encode())
                    begun = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string()))],
                                                 ["conv", "repaired_sha256"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([total.hexdigest()])],
                                             ["conv", "repaired_sha256"])

    several = turns.where("block > 0")
    alone = lines.where("block = 0").select("conv", F.sha2(F.col("body").cast("binary"), 256).alias("repaired_sha256"))
    if several.limit(1).count() == 0:
        return alone
    streamed = lines.where("block > 0").repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(
        run, "conv long, repaired_sha256 string")
    return alone.unionByName(streamed)


def damage(table, conv_column="conv_id", turn_column="turn", role_column="role", text_column="text"):
    """Rows with planned faults, by the crc32 of `conversation:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    ends of sentences, 3 repeats it, 4 makes it the user's.  Nulls of every column count as one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv_column).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_column).cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    base = table.select(kind.alias("kind"), F.col(conv_column).cast("long").alias("conv_id"), F.col(turn_column).cast("long").alias("turn"),
                        F.coalesce(F.col(role_column).cast("string"), space).alias("role"),
                        F.coalesce(F.col(text_column).cast("string"), space).alias("text")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", _STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return base.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repaired_digests(table, **limits):
    """One row per conversation of a table, after `damage`: counts, cost, audit and the hash of its repaired turns.

    A conversation that loses all rows has zeros, an empty audit and the hash of an empty string.
    """
    summary, turns = repair(damage(table), **limits)
    found = summary.join(digests(turns).select(F.col("conv").alias("conv_"), "repaired_sha256"), F.col("conv").eqNullSafe(F.col("conv_")))
    ids = table.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in _COUNTS],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))

"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Lengths are whole numbers up to the capacity, so documents and gaps of one length are interchangeable and both sorted
lists are runs.  The documents are range sorted by length on the cluster, which gives every piece its rank in its run
(a run may hold any share of all rows).  A round takes the next shorter run of documents: a successor sweep
over the gaps finds the tightest gap that takes the length, then the next, ranks decide which document gets which
sequence, the gaps shrink, and the rest of the run opens new sequences.  This is best-fit decreasing exactly.  The
rounds see run lengths only: at most `capacity` numbers, however many documents there are.  Every piece then
finds its place by (length, rank) where it lies.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.llm.common import settle, slices
from plumbline.llm.tokens import encoder, vocabulary

CAPACITY = 1024
END_ID = 2
_RANK_BITS = 48


def cut_lengths(n, capacity):
    """Lengths of a document's pieces: only the first may be shorter than the capacity when it is cut."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs, id_column="doc_id", text_column="text", path=None, end_id=END_ID, capacity=CAPACITY):
    """(id, piece, start, length, ids_crc32) of every document; null text is empty, its end id stays."""
    path = path or vocabulary()
    end = struct.pack("<I", end_id)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches):
        for part in slices(batches):
            columns = [[], [], [], [], []]
            texts = encoder(path).ids([t or "" for t in part.column(1).to_pylist()])
            for name, ids in zip(part.column(0).to_pylist(), texts):
                ids, start = memoryview(ids + end), 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    for column, value in zip(columns, (name, k, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]))):
                        column.append(value)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts, capacity=CAPACITY):
    """{length: documents} -> (runs, sequences): best-fit decreasing over runs of equal lengths.

    A run (length, first rank, documents, first sequence, sequences, offset) deals its documents over its sequences in
    turn, the next round of them behind the one before.
    """
    gaps = {}  # gap -> [(first sequence, sequences)]
    placed, opened = [], 0
    for length in range(capacity, 0, -1):
        left, rank = counts.get(length, 0), 0

        def fill(first, sequences, gap, per):
            nonlocal left, rank
            n = sequences * per
            placed.append((length, rank, n, first, sequences, capacity - gap))
            rank, left = rank + n, left - n
            if gap - per * length:
                gaps.setdefault(gap - per * length, []).append((first, sequences))

        for gap in sorted(g for g in gaps if g >= length):  # successors of the length, tightest first
            per = gap // length
            while left and gaps[gap]:
                first, sequences = gaps[gap].pop()
                whole = min(sequences, left // per)
                if whole < sequences:
                    gaps[gap].append((first + whole, sequences - whole))
                if whole:
                    fill(first, whole, gap, per)
                elif left:  # fewer documents than the next sequence takes
                    first, sequences = gaps[gap].pop()
                    if sequences > 1:
                        gaps[gap].append((first + 1, sequences - 1))
                    fill(first, 1, gap, left)
            if not left:
                break
        gaps = {g: x for g, x in gaps.items() if x}
        per = capacity // length
        for sequences, inside in ((left // per, per), (1, left % per)):
            if sequences and inside:
                first, opened = opened, opened + sequences
                fill(first, sequences, capacity, inside)
    return placed, opened


def _ranked(cut):
    """Adds (part, at): the piece's place among those of its length in a range-sorted partition."""
    ordered = cut.repartitionByRange("length", "id", "piece", "ids_crc32").sortWithinPartitions(
        "length", "id", "piece", "ids_crc32")

    def run(batches):
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            if not len(lengths):
                continue
            heads = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1]))
            sizes = np.diff(np.append(heads, len(lengths)))
            at = np.arange(len(lengths)) - np.repeat(heads, sizes)
            if lengths[0] == last:
                at[: sizes[0]] += seen
            last, seen = lengths[-1], at[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(lengths), part, np.int64)), pa.array(at)],
                names=[*batch.schema.names, "part", "at"])

    return ordered.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, part long, at long")


def pack(docs, id_column="doc_id", text_column="text", path=None, end_id=END_ID, capacity=CAPACITY):
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Every row of docs is packed: null texts as empty ones, rows that repeat as documents of their own, null ids
    under a null id.  Extra columns are not read.  No documents, no rows.
    """
    ranked = settle(_ranked(settle(pieces(docs, id_column, text_column, path, end_id, capacity), "pieces")), "ranked")
    runs = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    placed, _ = best_fit(counts, capacity)
    plan = np.array(sorted(placed), np.int64).reshape(-1, 6)
    keys = (plan[:, 0] << _RANK_BITS) + plan[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = plan[np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1]
            within = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + within % row[:, 4]),
                 pa.array(row[:, 5] + length * (within // row[:, 4]))],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    rows = ranked.join(bases, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("rank"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

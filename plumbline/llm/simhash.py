"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has one bit per majority of the shingle hashes.  For radius r every bit position gets a non-zero vector
of r + 1 bits, and every non-zero v of r + 1 bits gives a table whose mask keeps the positions with an odd product.
Up to r differing positions span at most r dimensions, so some v is orthogonal to all of them: in that table the two
fingerprints agree.  No pair within the radius is lost, and 2^(r+1) - 1 tables suffice.

Work runs on distinct fingerprints (class representatives), never on copies.  A bucket larger than `block` is cut into
blocks, and pairs of blocks are compared in separate groups; of each group only a spanning forest of verified links
leaves the task.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.common import ceil_div, settle, slices
from plumbline.llm.components import components
from plumbline.llm.runs import forest, sorted_groups

SHINGLE = 4
RADIUS = 4
BLOCK = 512
_CHUNK = 1 << 16


def fingerprint(text, words=SHINGLE):
    """64-bit fingerprint of a text as an unsigned integer; zero without words."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return 0
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, width = ends - lengths, min(words, len(found))
    starts, ends = starts[: len(found) - width + 1], ends[width - 1:]
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        hashes = [xxh64_intdigest(line[a:b], 42)
                  for a, b in zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs, id_column="doc_id", text_column="text", words=SHINGLE):
    """(id, text_hash, fp): one row per row of docs, fp the fingerprint's bits as a signed long."""
    text = F.col(text_column).cast("string")
    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches):
        for part in slices(batches):
            prints = [fingerprint(t or "", words) for t in part.column(2).to_pylist()]
            signed = np.array(prints, "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(signed, pa.int64())], ["id", "text_hash", "fp"])

    return picked.mapInArrow(run, "id long, text_hash long, fp long")


def covering_masks(radius=RADIUS, bits=64):
    """One mask for each non-zero vector of radius + 1 bits."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(bits)]
    masks = (sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, top))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(batches, radius):
    """Verified links of each sorted bucket block, as a spanning forest."""
    for heads, columns in sorted_groups(batches, keys=4):
        prints = columns["fp"].astype(np.uint64)
        reps = columns["rep"]
        sizes = np.diff(np.append(heads, len(prints)))
        last = np.repeat(heads + sizes, sizes)  # end of each row's group
        left, right = [], []
        at = np.arange(len(prints))
        for step in range(1, int(sizes.max())):
            at = at[at + step < last[at]]
            near = np.bitwise_count(prints[at] ^ prints[at + step]) <= radius
            left.append(at[near])
            right.append(at[near] + step)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            nodes, roots = forest(a, b, reps)
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])


def near_links(prints, radius=RADIUS, block=BLOCK):
    """(fp, rep) with distinct fp -> links (a, b) between reps whose components are those of all pairs within radius."""
    tables = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                       for t, m in enumerate(covering_masks(radius))])
    rows = prints.select("fp", "rep", F.explode(tables).alias("x")).select("x.t", "x.k", "fp", "rep")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    # a merge join at every size: Spark takes the exploded rows for one per fingerprint, and would send all of them to the driver
    blocks = rows.join(sizes.hint("merge"), ["t", "k"]).withColumn("nb", ceil_div(F.col("n"), block))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")))
    paired = blocks.select("t", "k", "fp", "rep", "own", F.explode(F.expr("sequence(0L, nb - 1)")).alias("other"))
    dealt = paired.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep")
    return (dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
            .mapInArrow(lambda batches: _links(batches, radius), "a long, b long"))


def simhash_groups(docs, id_column="doc_id", text_column="text", words=SHINGLE, radius=RADIUS):
    """One row per row of docs: (id, text_hash, fingerprint, component).

    A null text has no words, like an empty one: fingerprint zero, linked like any other.  A null id takes part
    but never names a component; where all ids of a component are null, so is the component.  Repeated rows give
    repeated rows; `text_hash` (xxhash64 of the text) tells rows that share an id apart.  Other columns of docs,
    whatever their names, are not read.
    """
    prints = settle(fingerprints(docs, id_column, text_column, words), "fingerprints")
    distinct = prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    # ids that repeat with other texts name several classes: those are linked through the shared id
    joined = components(near_links(settle(distinct, "classes"), radius))
    classes = distinct.join(joined, distinct["rep"] == joined["node"], "left").select(
        F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component"))
    return prints.join(classes, prints["fp"] == classes["fp_"], "left").select(
        "id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component")

"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are sets of word shingles that a document must contain whole.  Containment 1 makes the prefix one
shingle long: a window's rarest shingle, by counts over all documents, must occur in every document that holds the
window.  Only those shingles are joined.  The shingle's place gives the window's start in the document: a start before
the text or an end beyond it is dropped (position and length bounds), and the rest is verified word by word.

Two bitmaps of fixed size, whatever the tables, keep other shingles from being shuffled; the joins stay exact.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.common import settle, slices
from plumbline.llm.words import PLAIN, encode, shingles, word_hashes

WINDOW = 10
SHINGLE = 3
#: Bits of a bitmap; it is the only thing that goes through the driver.
BITMAP_BITS = 1 << 24
#: Shingle counts gathered before they leave a task.
GATHERED = 1 << 20


def windows(items, id_column="item_id", text_column="text", window=WINDOW, shingle=SHINGLE):
    """(item, window text, length, offset, shingle) of every window of every item; items without words have none."""
    rows = items.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text"))
    schema = pa.schema([("item", pa.string()), ("words", pa.string()), ("length", pa.int32()), ("offset", pa.int32()),
                        ("width", pa.int32()), ("h", pa.int64())])

    def run(batches):
        for part in slices(batches, 16):
            made = []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                hashes, starts, ends, data = word_hashes(encode(text), PLAIN)
                n = len(hashes)
                if not n:
                    continue
                length, width = min(window, n), min(shingle, n, window)
                parts = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist())]
                h = shingles(hashes, width).view(np.int64).tolist()
                for at in range(n - length + 1):
                    whole = " ".join(parts[at:at + length])
                    made += [(item, whole, length, k, width, h[at + k]) for k in range(length - width + 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, m)) for m in made], schema)

    return rows.mapInArrow(run, "item string, words string, length int, offset int, width int, h long")


def bitmap(tokens, bits=BITMAP_BITS):
    """Hashes (h) -> bits as an array of bits / 64 words: bits set are summed on the cluster, a fixed size comes back."""
    slot = F.pmod("h", F.lit(bits))
    words = tokens.select(F.shiftright(slot, 6).cast("int").alias("w"),
                          F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) & 63 as int))").alias("m"))
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return out.view(np.uint64)


def _set(hashes, bits):
    slot = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def shingle_counts(texts, bits, widths):
    """(h, n): how often the shingles whose bit is set occur in all texts; summed in the task first."""

    def run(batches):
        held, size = [], 0

        def out():
            found, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([c for _, c in held])).astype(np.int64)
            return found, counts

        for part in slices(batches):
            rows = []
            for text in part.column(0).to_pylist():
                hashes = word_hashes(encode(text), PLAIN)[0]
                for width in widths:
                    h = shingles(hashes, width)
                    rows.append(h[_set(h, bits)])
            found, counts = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.empty(0, np.uint64), [])
            held.append((found, counts))
            size += len(found)
            if size > GATHERED:
                held = [out()]
                size = len(held[0][0])
                if size > GATHERED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in held[0]], ["h", "n"])
                    held, size = [], 0
        if held:
            found, counts = out()
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


_FOUND = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                    ("found", pa.list_(pa.struct([("pos", pa.int64()), ("h", pa.int64()), ("low", pa.int64()),
                                                  ("around", pa.string())])))])
_KIND = "id long, text_hash long, n_words long, found array<struct<pos:long,h:long,low:long,around:string>>"


def prefix_places(rows, bits, widths, window):
    """(id, text_hash, n_words, found): every place of a prefix shingle with the words of the windows over it."""

    def run(batches):
        for part in slices(batches):
            made = []
            for name, mark, text in zip(*(c.to_pylist() for c in part.columns)):
                hashes, starts, ends, data = word_hashes(encode(text), PLAIN)
                found = []
                for width in widths:
                    h = shingles(hashes, width)
                    for pos in np.flatnonzero(_set(h, bits)).tolist():
                        low, high = max(0, pos - window + 1), min(len(hashes), pos + window)
                        words = [data[a:b] for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist())]
                        found.append({"pos": pos, "h": int(h[pos].view(np.int64)), "low": low,
                                      "around": b" ".join(words).decode("utf-8", "surrogatepass")})
                made.append({"id": name, "text_hash": mark, "n_words": len(hashes), "found": found})
            yield pa.RecordBatch.from_pylist(made, _FOUND)

    return rows.mapInArrow(run, _KIND)


def contamination(docs, items, id_column="doc_id", text_column="text", item_column="item_id", item_text="text",
                  window=WINDOW, shingle=SHINGLE):
    """One row per row of docs: (id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated).

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.  A null or empty text has no words.
    Rows that repeat, or share an id, are judged one by one.  Items that repeat count once per id; an item
    without id marks words as hit but is not counted.  `text_hash` (xxhash64 of the text) tells rows that
    share an id apart.  Other columns are not read.
    """
    made = settle(windows(items, item_column, item_text, window, shingle), "windows")
    widths = sorted(r["width"] for r in made.select("width").distinct().collect())  # at most `shingle` numbers
    texts = docs.select(F.col(text_column).cast("string").alias("text"))
    counts = shingle_counts(texts, bitmap(made.select("h")), widths)
    tokens = made.select("words", "length", "width", "offset", "h").distinct()
    rarest = (tokens.join(counts, "h").groupBy("words", "length", "width")
              .agg(F.count("*").alias("held"), F.min(F.struct("n", "h", "offset")).alias("x")))
    # a window with a shingle that no text holds occurs nowhere
    prefixes = settle(rarest.where("held = length - width + 1").select("words", "length", "x.h", "x.offset"), "prefixes")

    named = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("text_hash"),
                        F.col(text_column).cast("string").alias("text"))
    places = prefix_places(named, bitmap(prefixes), widths, window)
    places = settle(places.withColumn("rid", F.monotonically_increasing_id()), "places")

    found = places.where(F.size("found") > 0).select("rid", "n_words", F.explode("found").alias("x")).select(
        "rid", "n_words", "x.*")
    start = (F.col("pos") - F.col("offset")).alias("start")
    fits = found.join(prefixes, "h").select("*", start).where("start >= 0 AND start + length <= n_words")
    held = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("low") + 1).cast("int"), F.col("length")), " ")
    hits = fits.where(held == F.col("words")).select("rid", "start", "length", "words")

    spans = hits.select("rid", "start", "length").distinct().groupBy("rid").agg(
        F.collect_list(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("s"))
    spans = spans.select("rid", F.size(F.array_distinct(F.flatten("s"))).cast("long").alias("n_hit"))
    owners = made.where("item IS NOT NULL").select("words", "item").distinct()
    named_items = hits.select("rid", "words").distinct().join(owners, "words").select("rid", "item").distinct()
    listed = named_items.groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = places.select("rid", "id", "text_hash", "n_words").join(spans, "rid", "left").join(listed, "rid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))

"""Repeated passages: runs of words that stand in two places, wherever in a line they begin.

Every window of `words` words has an anchor: of its shorter runs of words the one with the smallest hash (the first of
equals).  Equal windows have equal anchors, and neighbouring windows mostly share theirs, so few anchors stand for all
windows.  Only anchors found more than once go on.  Places of an anchor whose windows are all the same are one class;
where an anchor has several classes, the windows of one place of each are compared by their hashes.  So every window
looks up the first place of its like, nothing is paired, and neighbouring windows add up to whole passages.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.llm.common import settle, slices
from plumbline.llm.words import WHITE, encode, run_hashes, word_hashes

WORDS = 50

_ANCHORS = "id long, th long, i int, n int, a long, c long"
_PLACES = "th long, i int, last int, a long, c long, h array<long>, begins array<int>, ends array<int>, fid long, fth long, fi int"
_PLACES_NAMES = [x.split()[0] for x in _PLACES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()),
          pa.int64(), pa.int64(), pa.int32()]


def anchored(marks, words):
    """Word hashes -> (first window, number of windows, anchor, all their words) of neighbouring windows with one anchor.

    Anchors are shorter than windows by three eighths: longer ones are more, shorter ones have more classes.
    """
    reach = max(1, words * 3 // 8)
    width = words - reach + 1
    windows = len(marks) - words + 1
    if windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    of = run_hashes(marks)
    at = np.arange(windows + reach - 1)
    low = of(at, at + width)
    size = 1
    while size < reach:  # the least of `size` runs from every place on
        step = min(size, reach - size)
        at = np.where(low[step:] < low[:-step], at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        size += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, windows))
    return first, count, low[first], of(first, first + count + words - 1)


def _anchors(docs, id_column, text_column, words):
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def run(batches):
        for part in slices(batches):
            made = [anchored(word_hashes(encode(text), WHITE)[0], words) for text in part.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made]))
            first, count, anchor, content = (np.concatenate(x) for x in zip(*made))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(row), part.column(1).take(row), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                 pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], ["id", "th", "i", "n", "a", "c"])

    return rows.where("text IS NOT NULL").mapInArrow(run, _ANCHORS)


def _places(docs, text_column, asked, words):
    """asked (th, i, n, a, c, open, hashed, fid, fth, fi) -> characters, and hashes where asked for, from the texts that hold them.

    Open ones get the places of all windows.  Of the others, whose first place is known, neighbours that are repeated from
    neighbouring places are one row, with the begin of its first window and the end of its last.
    """
    text = F.col(text_column).cast("string")
    names = ["i", "n", "a", "c", "open", "hashed", "fid", "fth", "fi"]
    asked = asked.groupBy("th").agg(F.collect_set(F.struct(*names)).alias("asked")).hint("merge")
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).where("text IS NOT NULL")
    # these tables grow with the texts: merge joins at every size, nothing is sent to all tasks
    joined = texts.join(asked.select("th").hint("merge"), "th", "left_semi").dropDuplicates(["th"]).join(asked, "th")

    def run(batches):
        for part in slices(batches, 64):
            out = []
            for th, text, asked in zip(*(c.to_pylist() for c in part.columns)):
                data = encode(text)
                marks, starts, ends, _ = word_hashes(data, WHITE)
                of = run_hashes(marks)
                chars = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80, dtype=np.int32)))
                begins, ends = chars[starts].astype(np.int32), chars[ends].astype(np.int32)
                held = None
                for i, n, a, c, opened, hashed, *first in sorted((tuple(x.values()) for x in asked), key=lambda x: x[0]):
                    last = i + n - 1
                    if opened:
                        windows = np.arange(i, last + 1)
                        h = of(windows, windows + words).view(np.int64) if hashed else None
                        out.append((th, i, last, a, c, h, begins[i:last + 1], ends[i + words - 1:last + words], None, None, None))
                        continue
                    line = (*first[:2], first[2] - i)
                    if held and held[0] == line and held[1][2] == i - 1:
                        held[1][2], held[1][7] = last, ends[last + words - 1:last + words]
                    else:
                        held = line, [th, i, last, None, None, None, begins[i:i + 1], ends[last + words - 1:last + words], *first]
                        out.append(held[1])
            columns = list(zip(*out)) if out else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _PLACES_NAMES)

    return joined.select("th", "text", "asked").mapInArrow(run, _PLACES)


def _twice(low, high, words):
    """Two places that are not the same, nor overlap in one text."""
    same = F.col(f"{low}.id").eqNullSafe(F.col(f"{high}.id")) & (F.col(f"{low}.th") == F.col(f"{high}.th"))
    return ~same | (F.col(f"{high}.i") - F.col(f"{low}.i") >= words)


def _moved(place, by):
    return F.struct(*[F.col(f"{place}.{c}").alias(c) for c in ("none", "id", "th")], (F.col(f"{place}.i") + by).alias("i"))


def repeated_passages(docs, id_column="doc_id", text_column="text", words=WORDS):
    """One row per passage that is repeated: (id, word, begin, end, n_words, kept_id, kept_word, removed).

    A passage is a longest run of neighbouring windows of `words` words (between ASCII white space, A-Z lower-cased)
    that stand elsewhere, too, and whose first places in the order (id, text hash, word; null ids last) neighbour each
    other in one text.  kept_id and kept_word name that first place; `removed` is false for itself, and for windows that
    overlap it.  `word` counts the text's words before the passage, `begin` and `end` are characters.  Windows are told apart by
    64-bit hashes of their words beside those of their anchors.  Places of one text count as two if they do not overlap.
    Rows that repeat id and text are one.  A null text has no passages.  Other columns are not read.
    """
    number = F.count("*").over(Window.partitionBy("a"))
    found = settle(_anchors(docs, id_column, text_column, words).withColumn("often", number).where("often > 1").drop("often"), "anchors")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th", "i")
    classes = settle(found.groupBy("a", "c").agg(
        F.min(place).alias("low"), F.max(place).alias("high"), F.min(F.struct("th", "i")).alias("one")), "classes")
    several = classes.groupBy("a").agg(F.count("*").alias("classes")).where("classes > 1").hint("merge")
    # the windows of an anchor's only class are repeated all or none
    classes = classes.join(several, "a", "left").withColumn("open", F.col("classes").isNotNull()).drop("classes")
    classes = settle(classes.where(F.col("open") | _twice("low", "high", words)), "classes")
    known = [F.when(~F.col("open"), F.col(f"low.{x}")).alias(f"f{x}") for x in ("id", "th", "i")]
    hashed = F.col("open") & (F.col("one") == F.struct("th", "i"))
    members = found.join(classes.select("a", "c", "open", "one", "low").hint("merge"), ["a", "c"]).select(
        "th", "i", "n", "a", "c", "open", hashed.alias("hashed"), *known)
    places = settle(_places(docs, text_column, settle(members, "members"), words), "places")

    like = Window.partitionBy("a", "h")
    windows = places.where("h IS NOT NULL").select("a", "c", F.posexplode("h").alias("j", "h")).join(
        classes.where("open").select("a", "c", "low", "high").hint("merge"), ["a", "c"])
    windows = windows.withColumns({"first": F.min(_moved("low", F.col("j"))).over(like), "last": F.max(_moved("high", F.col("j"))).over(like)})
    windows = windows.where(_twice("first", "last", words)).select("a", "c", "j", _moved("first", -F.col("j")).alias("first"))
    run = F.row_number().over(Window.partitionBy("a", "c", "first").orderBy("j")) - F.col("j")
    some = windows.withColumn("run", run).groupBy("a", "c", "first", "run").agg(F.min("j").alias("j"), F.max("j").alias("k")).drop("run")
    some = places.where("a IS NOT NULL").select("th", "i", "a", "c", "begins", "ends").join(some.hint("merge"), ["a", "c"]).select(
        "th", (F.col("i") + F.col("j")).alias("word"), (F.col("i") + F.col("k")).alias("last"), F.expr("begins[j]").alias("begin"),
        F.expr("ends[k]").alias("end"), F.col("first.id").alias("fid"), F.col("first.th").alias("fth"), (F.col("first.i") - F.col("i")).alias("by"))
    every = places.where("a IS NULL").select(
        "th", F.col("i").alias("word"), "last", F.expr("begins[0]").alias("begin"), F.expr("ends[0]").alias("end"), "fid", "fth",
        (F.col("fi") - F.col("i")).alias("by"))
    # what holds for a text holds for all rows that have it
    held = some.unionByName(every).join(found.select("id", "th").distinct().hint("merge"), "th")
    own = F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")) & (F.col("by") > -words)
    held = held.select(
        "id", "th", "word", "last", "begin", "end", (~own).alias("removed"), F.when(own, F.col("id")).otherwise(F.col("fid")).alias("kept_id"),
        F.when(own, F.col("th")).otherwise(F.col("fth")).alias("kept_th"), F.when(own, F.lit(0)).otherwise(F.col("by")).alias("shift"))
    line = ["id", "th", "kept_id", "kept_th", "shift", "removed"]
    order = Window.partitionBy(*line).orderBy("word")
    apart = F.coalesce(F.col("word") > F.lag("last").over(order) + 1, F.lit(False)).cast("int")
    whole = held.withColumn("apart", apart).withColumn("passage", F.sum("apart").over(order)).groupBy(*line, "passage").agg(
        F.min("word").alias("word"), F.max("last").alias("last"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    long = lambda c: c.cast("long")
    return whole.select(
        "id", long(F.col("word")).alias("word"), long(F.col("begin")).alias("begin"), long(F.col("end")).alias("end"),
        long(F.col("last") - F.col("word") + words).alias("n_words"), "kept_id", long(F.col("word") + F.col("shift")).alias("kept_word"), "removed")

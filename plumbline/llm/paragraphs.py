"""Substring dedup of paragraphs: MinHash banding, exact Jaccard, components.

A paragraph is a line of at least `words` words, or the shortest run of shorter lines, from a start line, that has as many.
Start lines are chosen by content, `APART` words from one another, so a passage has the same paragraphs wherever it stands,
and two overlapping paragraphs of one text share too little to be alike.  Equal paragraphs are one class.  Bands of MinHash
values of the classes' shingle sets put similar ones into buckets; buckets with the same members are one.  In every bucket all
pairs are verified by exact Jaccard in blocks; a large one is first compared with its lowest member, and only what is not like
that one is compared with all.  Shingle sets are made from the texts that hold them, once per class.  Of each
component of verified links the first in the order (document, paragraph) stays and the others are to be removed.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.common import ceil_div, settle, slices
from plumbline.llm.components import components
from plumbline.llm.runs import forest
from plumbline.llm.words import WHITE, encode, shingles, word_hashes

SHINGLE = 5
SIMILAR = 0.8
#: At a Jaccard of 0.8 a pair misses all 24 bands of 5 values with a probability below 0.0001.
BANDS, ROWS = 24, 5
#: The same for paragraphs, 10 bands of 3: missed with a probability below 0.001, and half the keys to shuffle.
KEYS, KEY_ROWS = 10, 3
#: Shortest paragraph, in words.
WORDS = 50
#: Words between two starts of runs: over a fifth of the longest run, 2 (WORDS - 1).
APART = 20
BLOCK = 256
_RNG = np.random.default_rng(17)
_MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _values(found, count):
    """`count` random hash values of every shingle hash."""
    h = found[:, None] * _MULTIPLY[:count] + _ADD[:count]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _keys(low, bands, rows):
    """Minima (..., bands * rows) -> one 64-bit key per band."""
    low = low.reshape(*low.shape[:-1], bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), low.shape[:-1]).copy()
    for j in range(rows):
        key = (key ^ low[..., j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def bands_of(found, bands=BANDS, rows=ROWS):
    """Distinct shingle hashes -> one 64-bit key per band."""
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 14):
        np.minimum(low, _values(found[at:at + (1 << 14)], bands * rows).min(axis=0), out=low)
    return _keys(low, bands, rows)


def spans_of(counts, hashes, words=WORDS, apart=APART):
    """Lines' numbers of words and hashes -> (first line, last line) of every paragraph.

    A line of `words` words is a paragraph.  Any other line with words may start a run: lines of `apart` words or more do, and
    others if their hash is the least (the first of equals) among the starts within `apart` words, where the longer lines come
    first.  A run ends where it has `words` words; it holds no long line, and one that meets one or the end before is none.
    """
    n = len(counts)
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    rank = [(c < apart, h if c < apart else 0, i) for i, (c, h) in enumerate(zip(counts, hashes))]
    out = []
    for i, c in enumerate(counts):
        if c >= words:
            out.append((i, i))
        elif c:
            j = i
            while j < n and counts[j] < words and before[j + 1] - before[i] < words:
                j += 1
            if j == n or counts[j] >= words:
                continue
            first = True
            if c < apart:
                k = i - 1
                while first and k >= 0 and before[i] - before[k] < apart:
                    first = not 0 < counts[k] < words or rank[i] < rank[k]
                    k -= 1
                k = i + 1
                while first and k < n and before[k] - before[i] < apart:
                    first = not 0 < counts[k] < words or rank[i] < rank[k]
                    k += 1
            if first:
                out.append((i, j))
    return out


_FOUND = pa.schema([("id", pa.int64()), ("paragraph", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()),
                    ("n_words", pa.int64()), ("content", pa.binary()), ("text_hash", pa.int64()), ("bands", pa.list_(pa.int64()))])
#: Shingles whose hash values are made at once.
_SLICE = 1 << 13


def _of_text(text, words, shingle):
    """(rows, band keys) of a text's paragraphs: (first line, begin, end, words, content)."""
    data = encode(text)
    marks, starts, ends, plain = word_hashes(data, WHITE)
    if len(marks) < shingle:
        return [], np.empty((0, KEYS), np.uint64)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    sums = np.concatenate(([0], np.searchsorted(starts, breaks), [len(marks)]))  # words before every line
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(marks)))
    hashes = ((total[sums[1:]] - total[sums[:-1]]) & np.uint64((1 << 63) - 1)).tolist()
    spans = spans_of(np.diff(sums).tolist(), hashes, words)
    sums = sums.tolist()
    spans = [(i, j) for i, j in spans if sums[j + 1] - sums[i] >= shingle]
    if not spans:
        return [], np.empty((0, KEYS), np.uint64)
    lengths = np.array([len(line) for line in text.split("\n")])
    offsets = np.concatenate(([0], np.cumsum(lengths + 1))).tolist()
    every = shingles(marks, shingle)
    low = np.full((len(spans), KEYS * KEY_ROWS), np.iinfo(np.uint64).max, np.uint64)
    rows = []
    place = 0
    while place < len(spans):  # paragraphs of a stretch of the text, so that memory does not follow its length
        begin = sums[spans[place][0]]
        last = place
        while last + 1 < len(spans) and sums[spans[last + 1][1] + 1] - begin <= _SLICE:
            last += 1
        if last == place and sums[spans[place][1] + 1] - begin > _SLICE:
            i, j = spans[place]
            for a in range(sums[i], sums[j + 1] - shingle + 1, _SLICE):
                part = every[a:min(a + _SLICE, sums[j + 1] - shingle + 1)]
                np.minimum(low[place], _values(part, KEYS * KEY_ROWS).min(axis=0), out=low[place])
        else:
            high = sums[spans[last][1] + 1] - shingle + 1
            values = _values(every[begin:high], KEYS * KEY_ROWS)
            for k in range(place, last + 1):
                i, j = spans[k]
                low[k] = values[sums[i] - begin:sums[j + 1] - shingle + 1 - begin].min(axis=0)
        place = last + 1
    for i, j in spans:
        octets = plain[starts[sums[i]]:ends[sums[j + 1] - 1]]
        rows.append((i, offsets[i], offsets[j + 1] - 1, sums[j + 1] - sums[i], hashlib.md5(b" ".join(octets.split())).digest()))
    return rows, _keys(low, KEYS, KEY_ROWS)


def paragraphs(docs, id_column="doc_id", text_column="text", words=WORDS, shingle=SHINGLE):
    """(id, paragraph, begin, end, n_words, content, text_hash, bands) of every paragraph; places count characters.

    `paragraph` is the first line's number, `content` the md5 of its words, `text_hash` the xxhash64 of the whole text.
    """
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))

    def run(batches):
        for part in slices(batches):
            made, keys = [], []
            for name, mark, text in zip(*(c.to_pylist() for c in part.columns)):
                found, bands = _of_text(text or "", words, shingle)
                made += [(name, *f, mark) for f in found]
                keys.append(bands)
            columns = [list(c) for c in zip(*made)] if made else [[]] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns, _FOUND.types)]
            flat = np.concatenate(keys).view(np.int64).ravel() if made else np.empty(0, np.int64)
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * KEYS, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(arrays, schema=_FOUND)

    return rows.mapInArrow(run, "id long, paragraph long, begin long, end long, n_words long, content binary, text_hash long, bands array<long>")


def _sets(docs, text_column, wanted, shingle):
    """wanted (rep, text_hash, begin, end, content) -> (rep, set) from the texts that hold them.

    Texts that repeat are read once.  A text of the same hash that is another one is told by the paragraph's content.
    """
    text = F.col(text_column).cast("string")
    asked = wanted.groupBy("text_hash").agg(F.collect_list(F.struct("rep", "begin", "end", "content")).alias("asked"))
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).where("text IS NOT NULL")
    # these tables grow with the texts: merge joins at every size, nothing is sent to all tasks
    asked = asked.hint("merge")
    joined = texts.join(asked.select("text_hash").hint("merge"), "text_hash", "left_semi").dropDuplicates(["text_hash"]).join(asked, "text_hash")

    def run(batches):
        for part in slices(batches, 64):
            out = [[], []]
            for text, asked in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                known = {}
                for x in asked:
                    place = x["begin"], x["end"]
                    if place not in known:
                        octets = encode(text[place[0]:place[1]])
                        same = hashlib.md5(b" ".join(octets.translate(WHITE).split())).digest() == x["content"]
                        known[place] = np.unique(shingles(word_hashes(octets, WHITE)[0], shingle)).tobytes() if same else None
                    if known[place] is not None:
                        out[0].append(x["rep"])
                        out[1].append(known[place])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["rep", "set"])

    return joined.select("text_hash", "text", "asked").mapInArrow(run, "rep long, set binary")


def _with_pivot(batches, similar):
    """Groups (g, low, rep, set) of a bucket's rows, the pivot's own first -> (g, rep, like the pivot)."""
    last, pivot = None, None
    for batch in batches:
        out = [[], [], []]
        for g, i, rep, found in zip(*(c.to_pylist() for c in batch.columns)):
            found = np.frombuffer(found, np.uint64)
            if last != (g, i):
                last, pivot = (g, i), found  # sorted: the pivot stands first in every block
            shared = len(np.intersect1d(found, pivot, assume_unique=True))
            out[0].append(g)
            out[1].append(rep)
            out[2].append(shared >= similar * (len(found) + len(pivot) - shared))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["g", "rep", "near"])


def _bucket_links(docs, text_column, classes, keyed, shingle, similar, block):
    """Links (a, b) whose components are those of all pairs of that similarity in a common bucket.

    classes: (rep, text_hash, begin, end, content); keyed: (rep, key).
    """
    held = keyed.repartition("key")  # dealt once for both uses
    shared = held.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n"),
                                     F.bit_xor(F.xxhash64("rep")).alias("x")).where("low <> high")
    # buckets with the same members are one
    kept = settle(shared.groupBy("n", "x", "low", "high").agg(F.min("key").alias("key")).select("key", "n", "low"), "buckets")
    members = settle(held.join(kept.hint("merge"), "key").withColumnRenamed("key", "g"), "members")
    # the texts are moved once, whatever the buckets' sizes: a second pass for the large ones would move all texts again
    wanted = classes.join(members.select("rep").hint("merge"), "rep", "left_semi")
    sets = settle(_sets(docs, text_column, wanted, shingle), "sets").hint("merge")
    zero = F.lit(0).cast("long")
    places = ["rep", "g", "i", "j"]
    dealt = members.where(F.col("n") <= block).withColumns({"i": zero, "j": zero}).select(*places)
    links = None
    if members.where(F.col("n") > block).limit(1).count():
        large = members.where(F.col("n") > block)
        blocks = ceil_div(F.col("n"), block)
        own = F.pmod(F.xxhash64("rep"), blocks)
        # a large bucket's members meet its lowest in blocks, each with a copy of it
        pivots = large.where("rep = low").withColumn("i", F.explode(F.sequence(zero, blocks - 1)))
        meet = large.where("rep <> low").withColumn("i", own).unionByName(pivots)
        order = (F.col("rep") == F.col("low")).alias("low_first")
        told = settle(meet.select("g", "i", order, "rep").join(sets, "rep").repartition("g", "i").sortWithinPartitions(
            "g", "i", F.desc("low_first"), "rep").select("g", "i", "rep", "set").mapInArrow(
                lambda b: _with_pivot(b, similar), "g long, rep long, near boolean").distinct(), "pivots")
        named = large.select("g", "low").distinct()
        links = told.where("near").join(named, "g").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
        # the others meet all members, blocks of one with blocks of the other
        left = told.where("NOT near").select("g", "rep")
        counts = left.groupBy("g").agg(ceil_div(F.count("*"), block).alias("parts"))
        probes = large.join(left, ["g", "rep"]).join(counts, "g").withColumns(
            {"i": F.pmod(F.xxhash64("rep"), F.col("parts")), "j": F.explode(F.sequence(zero, blocks - 1))})
        all_ = large.join(counts, "g").withColumns({"j": own, "i": F.explode(F.sequence(zero, F.col("parts") - 1))})
        both = probes.select(*places).unionByName(all_.select(*places)).distinct()
        dealt = dealt.unionByName(both)
    found = dealt.join(sets, "rep").select("g", "i", "j", "rep", "set").repartition("g", "i", "j").sortWithinPartitions(
        "g", "i", "j").mapInArrow(lambda b: _verify(b, similar), "a long, b long")
    return found if links is None else found.unionByName(links)


def _of_lines(classes, shingle, make, kind, column):
    """(rep, column): what `make` gives for the distinct shingle hashes of every class's line."""

    def run(batches):
        for part in slices(batches, 1024):
            made = [make(np.unique(shingles(word_hashes(encode(line), WHITE)[0], shingle))) for line in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, kind)], ["rep", column])

    return classes.mapInArrow(run, f"rep long, {column} {'binary' if kind == pa.binary() else 'array<long>'}")


def _verify(batches, similar):
    """Groups of (group, i, j): exact Jaccard of all pairs, links as a spanning forest."""
    held, last = [], None

    def close():
        reps = np.array([r for r, _ in held])
        sets = [np.frombuffer(s, np.uint64) for _, s in held]
        sizes = np.array([len(s) for s in sets])
        if len(sets) <= 4:
            near = []
            for i, a in enumerate(sets):
                for j in range(i):
                    shared = len(np.intersect1d(a, sets[j], assume_unique=True))
                    if shared >= similar * (len(a) + len(sets[j]) - shared):
                        near.append((j, i))
            if near:
                nodes, roots = forest(*np.array(near).T, reps)
                if len(nodes):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])
            return
        found, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, len(found), 4096):  # shingles in slices: the matrix stays small
            a, b = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(sets), min(4096, len(found) - at)), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            common += part @ part.T
        union = sizes[:, None] + sizes[None, :] - common
        x, y = np.nonzero(np.triu(common >= similar * union, 1))
        if len(x):
            nodes, roots = forest(x, y, reps)
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])

    for batch in batches:
        for g, i, j, rep, found in zip(*(c.to_pylist() for c in batch.columns)):
            if (g, i, j) != last:
                if len(held) > 1:
                    yield from close()
                held, last = [], (g, i, j)
            held.append((rep, found))
    if len(held) > 1:
        yield from close()


def alike(lines, shingle=SHINGLE, similar=SIMILAR, block=BLOCK):
    """(rep, line) -> links (a, b) between reps whose components are those of all pairs of that similarity found by bands.

    Lines shorter than a shingle have no links.
    """
    bands = settle(_of_lines(lines, shingle, lambda h: bands_of(h).view(np.int64) if len(h) else [], pa.list_(pa.int64()), "bands"), "bands")

    keyed = bands.select("rep", F.explode("bands").alias("key"))  # a key starts from its band's number
    lowest = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("c")).where("c > 1")
    # a merge join at every size: Spark takes the exploded keys for one per line
    collided = keyed.join(lowest.hint("merge"), "key").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    near = components(collided.distinct())
    roots = near.select(F.col("component").alias("rep"), F.col("component").alias("g")).distinct()
    groups = near.select(F.col("node").alias("rep"), F.col("component").alias("g")).unionByName(roots)
    sizes = groups.groupBy("g").agg(ceil_div(F.count("*"), block).alias("nb"))
    spread = groups.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")))
    dealt = spread.select("g", "rep", "own", F.explode(F.expr("sequence(0L, nb - 1)")).alias("other"))
    dealt = dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep")
    # shingle sets of candidates only: most classes collide with none
    candidates = lines.join(groups.select("rep").distinct(), "rep", "left_semi")
    sets = settle(_of_lines(candidates, shingle, lambda h: h.tobytes(), pa.binary(), "set"), "sets")
    dealt = dealt.join(sets, "rep").select("g", "i", "j", "rep", "set")
    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(
        lambda b: _verify(b, similar), "a long, b long")


def repeated_paragraphs(docs, id_column="doc_id", text_column="text", words=WORDS, shingle=SHINGLE, similar=SIMILAR,
                        block=BLOCK):
    """One row per paragraph that has a like: (id, paragraph, begin, end, n_words, kept_id, kept_paragraph, removed).

    Alike: a Jaccard similarity of at least `similar` over distinct word shingles, or a chain of such.  The first
    paragraph of a chain by (id, paragraph) stays (`removed` false, kept_id its own); null ids come last.  Paragraphs are long lines and
    runs of shorter ones (see `spans_of`); those of one text may overlap.  Documents without a
    repeated paragraph do not appear.  A null or empty text has no paragraphs.  Rows that repeat a document repeat its
    paragraphs: rows at the first place of all stay together.  Other columns are not read.
    """
    found = paragraphs(docs, id_column, text_column, words, shingle)
    found = settle(found.withColumn("pid", F.monotonically_increasing_id()), "paragraphs")  # the numbers are written, so they stay
    place = F.struct(F.col("id").isNull().alias("none"), "id", "paragraph")
    classes = settle(found.groupBy("content").agg(
        F.min("pid").alias("rep"), F.min(place).alias("first"), F.count("*").alias("n"),
        F.min(F.struct("text_hash", "begin", "end")).alias("at")).select("content", "rep", "first", "n", "at.*"), "classes")
    several = classes.where("n > 1").select("content", "rep").hint("merge")
    copies = found.select("content", "pid").join(several, "content").where("pid <> rep").select("pid").hint("merge")
    keyed = found.select("pid", "bands").join(copies, "pid", "left_anti").select(F.col("pid").alias("rep"), F.explode("bands").alias("key"))
    links = _bucket_links(docs, text_column, classes.select("rep", "text_hash", "begin", "end", "content"), keyed, shingle, similar, block)
    linked = components(links)

    named = classes.join(linked.hint("merge"), classes["rep"] == linked["node"], "left").select(
        "content", "first", "n", F.coalesce("component", "rep").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("all"))
    known = named.join(firsts.where("all > 1").hint("merge"), "component").select(
        F.col("content").alias("content_"), F.col("kept.id").alias("kept_id"), F.col("kept.paragraph").alias("kept_paragraph"))
    out = found.select("id", "paragraph", "begin", "end", "n_words", "content").join(
        known.hint("merge"), F.col("content") == F.col("content_"))
    stays = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("paragraph") == F.col("kept_paragraph"))
    return out.select("id", "paragraph", "begin", "end", "n_words", "kept_id", "kept_paragraph", (~stays).alias("removed"))

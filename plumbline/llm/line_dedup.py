"""Line dedup by winnowing, in DataFrame functions only.

Lines are hashed.  Of every `lines` neighbouring lines the one with the smallest hash (the last of equals) is a
fingerprint, and so is every line of `words` words or more.  Any run of `lines` lines that two places share therefore
shares a fingerprint at the same position of the run.  Fingerprints are counted; only those found more than once go
on.  A match is extended both ways through the windows of `lines` lines over its fingerprint: the window that begins
earliest in the order (id, text hash, line) stays, later ones are deleted, and overlapping windows add up to whole runs.
So a line goes exactly when it lies in a run of `lines` lines, or is itself a line of `words` words, that stands
somewhere earlier.  Nothing is paired: every window looks up the first place of its like.
"""

from pyspark.sql import functions as F

from plumbline.llm.common import settle

LINES = 3
WORDS = 50


def _lined(docs, id_column, text_column):
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("d"), F.xxhash64(text).alias("th"),
                       F.split(text, "\n", -1).alias("lines"))


def repeated_lines(docs, id_column="doc_id", text_column="text", lines=LINES, words=WORDS):
    """(d, th, gone): sorted line numbers to delete, for the texts (id, text hash) that lose lines."""
    rows = _lined(docs, id_column, text_column).where("lines IS NOT NULL").select(
        "d", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("lines", lambda x: F.size(F.array_remove(F.split(x, " "), "")) >= words).alias("long"))
    minima = F.expr(f"""
        transform(if(size(h) >= {lines}, sequence(0, size(h) - {lines}), cast(array() as array<int>)),
                  s -> s + {lines} - cast(array_position(reverse(slice(h, s + 1, {lines})),
                                                         array_min(slice(h, s + 1, {lines}))) as int))""")
    alone = F.expr("filter(transform(long, (x, i) -> if(x, i, -1)), i -> i >= 0)")
    rows = rows.select("d", "th", "h", "long", F.array_union(minima, alone).alias("chosen"))
    # a window's key is two hashes of its line hashes; a long line is a window of its own, too
    around = F.expr(f"""
        transform(chosen, p -> named_struct('f', h[p], 'windows', concat(
            transform(filter(sequence(p - {lines - 1}, p), s -> s >= 0 AND s <= size(h) - {lines}),
                      s -> named_struct('s', s, 'l', {lines}, 'k', xxhash64(slice(h, s + 1, {lines})),
                                        'k2', hash(slice(h, s + 1, {lines})))),
            if(long[p], array(named_struct('s', p, 'l', 1, 'k', h[p], 'k2', hash(h[p]))),
               cast(array() as array<struct<s:int,l:int,k:bigint,k2:int>>)))))""")
    marked = rows.select("d", "th", F.explode(around).alias("x")).select("d", "th", "x.f", "x.windows")
    marked = settle(marked, "fingerprints")

    often = marked.groupBy("f").agg(F.count("*").alias("c")).where("c > 1").select("f")
    spots = marked.join(often, "f", "left_semi").select("d", "th", F.explode("windows").alias("w"))
    spots = spots.select("d", "th", "w.*")
    first = spots.groupBy("l", "k", "k2").agg(F.min(F.struct("d", "th", "s")).alias("first"), F.count("*").alias("c"))
    # a merge join at every size: Spark takes the exploded windows for one per fingerprint
    later = spots.join(first.where("c > 1").hint("merge"), ["l", "k", "k2"]).where(F.struct("d", "th", "s") > F.col("first"))
    gone = later.select("d", "th", F.explode(F.expr("sequence(s, s + l - 1)")).alias("line")).distinct()
    return gone.groupBy("d", "th").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def dedup_lines(docs, id_column="doc_id", text_column="text", lines=LINES, words=WORDS, removed="lines_removed"):
    """docs with later repeated runs of lines deleted from their text, and the number of lines deleted.

    All rows and columns stay, whatever the columns are called (`removed` must be a new name).  A null text stays null,
    with none removed.  A text that loses all lines becomes empty.  Rows that repeat id and text are one place and
    are treated alike; rows that share an id are ordered by the hash of their texts; null ids come first.
    """
    gone = settle(repeated_lines(docs, id_column, text_column, lines, words), "gone").select(
        F.col("d").alias("d_"), F.col("th").alias("th_"), F.col("gone").alias("gone_"))
    text = F.col(text_column).cast("string")
    # a sort-merge join at every size: the deleted lines grow with the texts, so they are never sent to all tasks
    joined = docs.join(gone.hint("merge"), F.col(id_column).cast("long").eqNullSafe(F.col("d_")) & (F.xxhash64(text) == F.col("th_")), "left")
    lines_of = F.split(text, "\n", -1)
    before = F.concat(F.array(F.lit(-1)), F.col("gone_"))
    after = F.concat(F.col("gone_"), F.array(F.size(lines_of)))
    # what stays between two deleted lines, so that a text is copied once however many lines it loses
    between = F.zip_with(before, after, lambda a, b: F.slice(lines_of, a + 2, b - a - 1))
    kept = F.array_join(F.flatten(between), "\n")
    return joined.select(*[F.when(F.col("gone_").isNotNull(), kept).otherwise(F.col(c)).alias(c) if c == text_column
                           else F.col(f"`{c}`") for c in docs.columns],
                         F.coalesce(F.size("gone_"), F.lit(0)).cast("long").alias(removed))

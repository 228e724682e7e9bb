"""Ranked lexical search by the Best Position Algorithm.

The terms of all texts are counted once; only those that a query holds become postings, which are written and stay where
they are: a task that reads a part of them is a shard.  In a shard every term has an impact list (postings by falling impact)
and the same postings by document for direct access.  A query reads its lists in step from the top.  Every document met is
scored at once by direct accesses, which also mark the places where it stands in the other lists.  A list's best position
is where its places seen from the top first break off; the impacts there add up to the most that an unseen document can
score.  As direct accesses fill places ahead of the reading, this bound lies below the one of the last places read.  A query
stops when the bound is strictly below the k-th score, so no tie is lost.  The k best of every shard are ranked again.

Queries are dealt into blocks whose terms fit a task, one pass over the texts for each; usually there is one.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.llm.common import settle, slices
from plumbline.llm.words import PLAIN, encode, segments

BEST = 10
#: Postings of a shard: what a task holds at once.
SHARD = 1 << 20
#: Bytes of query terms in one block of queries.
BLOCK_BYTES = 1 << 24
#: Places read from every list in the first step; each step reads as many as all before it.
DEPTH = 16


def term_counts(text):
    """Counter of a text's terms as bytes, A-Z in lower case; long texts are cut between terms."""
    counts = Counter()
    for _, piece in segments(encode(text).translate(PLAIN)):
        counts.update(piece.split())
    return counts


def query_terms(items, id_column="item_id", text_column="text"):
    """(key, item, term): the distinct terms of every distinct query; queries without terms are absent."""
    rows = items.select(F.col(id_column).cast("long").alias("item"), F.col(text_column).cast("string").alias("text")).distinct()
    rows = rows.withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("item").cast("string"), F.lit("-")), "text"), 256))

    def run(batches):
        for part in slices(batches, 16):
            made = [(key, item, term) for item, text, key in zip(*(c.to_pylist() for c in part.columns))
                    for term in term_counts(text)]
            columns = zip(*made) if made else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))],
                                             ["key", "item", "term"])

    return rows.mapInArrow(run, "key string, item long, term binary")


def postings(docs, terms, id_column, text_column):
    """(id, text_hash, n, codes, counts) of every text with a term; codes are places in `terms`."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"),
                       F.col(text_column).cast("string").alias("text"))
    code = {t: i for i, t in enumerate(terms)}
    names = ["id", "text_hash", "n", "codes", "counts"]

    def run(batches):
        for part in slices(batches):
            ids, marks, totals, ends, codes, counts = [], [], [], [0], [], []
            for name, mark, text in zip(*(c.to_pylist() for c in part.columns)):
                found = term_counts(text)
                if not found:
                    continue
                shared = found.keys() & code.keys()
                ids.append(name)
                marks.append(mark)
                totals.append(sum(found.values()))
                codes += [code[t] for t in shared]
                counts += [found[t] for t in shared]
                ends.append(len(codes))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(totals, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(codes, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names)

    return rows.mapInArrow(run, "id long, text_hash long, n long, codes array<int>, counts array<long>")


class Shard:
    """Impact lists of one shard: rows, impacts by falling impact and by row."""

    def __init__(self, rows, codes, impacts, n_terms):
        by_row = np.lexsort((rows, codes))
        codes, self.rows, self.impacts = codes[by_row], rows[by_row], impacts[by_row]
        self.ends = np.searchsorted(codes, np.arange(n_terms + 1))
        fall = np.lexsort((self.rows, -self.impacts, codes))
        self.top_rows, self.top_impacts = self.rows[fall], self.impacts[fall]
        self.place = np.empty(len(fall), np.int64)  # of a posting by row in its impact list
        self.place[fall] = np.arange(len(fall))
        self.place -= self.ends[codes]

    def best(self, terms, k, n_rows, order, depth=DEPTH):
        """Rows and scores of the k best: by score, then by `order` of the rows; scores above 0 only."""
        spans = [(a, b) for a, b in zip(self.ends[terms], self.ends[terms + 1]) if b > a]
        marks = [np.zeros(b - a + 1, bool) for a, b in spans]
        position = [0] * len(spans)  # places seen without a gap
        seen, score = np.zeros(n_rows, bool), np.zeros(n_rows, np.int64)
        met, at = np.empty(0, np.int64), 0
        while spans:
            read = np.concatenate([self.top_rows[a + at:min(b, a + at + depth)] for a, b in spans])
            new = np.unique(read[~seen[read]])
            seen[new] = True
            bound = 0
            for i, (a, b) in enumerate(spans):
                held = self.rows[a:b]
                spot = np.searchsorted(held, new)
                hit = spot < len(held)
                hit[hit] = held[spot[hit]] == new[hit]
                spot = spot[hit]
                score[new[hit]] += self.impacts[a + spot]
                marks[i][self.place[a + spot]] = True
                p = position[i] = position[i] + int(np.argmin(marks[i][position[i]:]))  # the last mark stays unset
                bound += int(self.top_impacts[a + p]) if a + p < b else 0
            met = np.concatenate([met, new])
            if len(met) > k:
                met = met[np.lexsort((order[met], -score[met]))[:k]]
            if not bound or len(met) == k and bound < score[met[-1]]:
                break
            at, depth = at + depth, at + depth
        met = met[score[met] > 0]
        met = met[np.lexsort((order[met], -score[met]))]
        return met, score[met]


def _shards(batches, size):
    """Batches of (id, text_hash, n, codes, counts) gathered to about `size` postings."""
    held, total = [], 0
    for part in slices(batches, 4096):
        held.append(part)
        total += len(part.column(3).flatten())
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def impacts_of(weights, counts, lengths, n_texts, n_terms):
    """w * ((10^9 tf) div (1000 tf + 8 m)) with m = 100 - 90 + (90 n N) div L, in 64-bit integers."""
    m = 10 + (90 * lengths * n_texts) // max(n_terms, 1)
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def _search(batches, weights, queries, n_texts, n_terms, k, size):
    names = ["key", "item", "id", "text_hash", "score"]
    for table in _shards(batches, size):
        table = table.combine_chunks()
        codes = table.column("codes").combine_chunks()
        held = np.diff(codes.offsets.to_numpy())
        rows = np.repeat(np.arange(table.num_rows), held)
        flat = codes.flatten().to_numpy().astype(np.int64)
        counts = table.column("counts").combine_chunks().flatten().to_numpy()
        lengths = table.column("n").to_numpy()
        impacts = impacts_of(weights[flat], counts, lengths[rows], n_texts, n_terms)
        shard = Shard(rows, flat, impacts, len(weights))
        ids = np.array([i if i is not None else (1 << 63) - 1 for i in table.column("id").to_pylist()], np.int64)
        marks = table.column("text_hash").to_numpy()
        order = np.empty(table.num_rows, np.int64)
        order[np.lexsort((marks, ids))] = np.arange(table.num_rows)
        made = []
        for key, item, terms in queries:
            found, scores = shard.best(terms, k, table.num_rows, order)
            made += [(key, item, i, s) for i, s in zip(found.tolist(), scores.tolist())]
        if made:
            keys, items, found, scores = zip(*made)
            found = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(items, pa.int64()), table.column("id").combine_chunks().take(found),
                 table.column("text_hash").combine_chunks().take(found), pa.array(scores, pa.int64())], names)


def _statistics(found, n_codes):
    """(texts with a term, their terms, texts that hold each code): sums over all texts, `n_codes` numbers come back."""
    n_texts, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_texts + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")
    weights = np.zeros(n_codes, np.int64)
    table = held.select("code", weight).toArrow()
    weights[table.column("code").to_numpy()] = table.column("w").to_numpy()
    return n_texts, n_terms, weights


def search(docs, items, id_column="doc_id", text_column="text", item_column="item_id", item_text="text", k=BEST,
           shard=SHARD, block_bytes=BLOCK_BYTES):
    """(item, rank, id, text_hash, score): the k highest-scoring texts of every item, ranks from 1.

    Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case.  A null or empty text has none, and an item
    without terms, or none that a text holds, has no rows.  Equal scores rank by id (null last), then by xxhash64 of the text.
    Rows of docs that repeat are texts of their own and rank side by side.  Rows of items that repeat count once; items that
    share an id but not the text are ranked one by one, under the same id.  An item's distinct terms must fit a task.
    Other columns are not read.
    """
    spark = docs.sparkSession
    terms = settle(query_terms(items, item_column, item_text), "terms")
    total = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    parts = []
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        found = mine.groupBy("key", "item").agg(F.collect_list("term").alias("terms")).toArrow().to_pylist()  # block_bytes
        if not found:
            continue
        code = {t: i for i, t in enumerate(sorted({t for row in found for t in row["terms"]}))}
        queries = [(row["key"], row["item"], np.array(sorted(code[t] for t in row["terms"]))) for row in found]
        held = settle(postings(docs, list(code), id_column, text_column), "postings")
        n_texts, n_terms, weights = _statistics(held, len(code))
        parts.append(held.mapInArrow(
            lambda b, a=(weights, queries, n_texts, n_terms, k, shard): _search(b, *a),
            "key string, item long, id long, text_hash long, score long"))
    if not parts:
        return spark.createDataFrame([], "item long, rank int, id long, text_hash long, score long")
    near = parts[0]
    for more in parts[1:]:
        near = near.unionByName(more)
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "text_hash")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item", F.col("rank").cast("int").alias("rank"), "id", "text_hash", "score")

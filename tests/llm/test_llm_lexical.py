import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_data import awkward, frame, prose, row

from plumbline.llm import lexical


def terms(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain(rows, items, k):
    held = [(r[0], Counter(terms(r[1]))) for r in rows if terms(r[1])]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in set(items):
        scores = []
        for name, counts in held:
            m = 100 - 90 + (90 * sum(counts.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in set(terms(text)) if t in counts)
            if score > 0:
                scores.append((-score, name is None, name or 0))
        for rank, (score, none, name) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if none else name, -score] += 1
    return out


ITEMS = [(1, prose(1, 2)), (2, prose(9, 3, 30)), (2, prose(9, 3, 30)), (3, None), (4, ""), (5, "..., -"), (6, "a"), (7, "notfound"),
         (None, prose(2, 1)), (8, "ONE one ab"), (8, "ab CD"), (9, prose(1) + prose(2) + prose(3, 40))]


@pytest.mark.parametrize("shard,block,k", [(1 << 20, 1 << 24, 10), (25, 600, 3), (1, 1 << 24, 1)])
def test_ranks_equal_full_scores(spark, shard, block, k):
    rows = awkward() + [row(100 + i, prose(i % 9, 1 + i % 4)) for i in range(40)]
    bench = spark.createDataFrame([(i, t, "c", 1) for i, t in ITEMS], "item_id long, text string, h string, doc_id int")
    found = lexical.search(frame(spark, rows), bench.repartition(2), k=k, shard=shard, block_bytes=block).drop("text_hash")
    assert Counter(map(tuple, found.collect())) == plain(rows, ITEMS, k)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    docs = frame(spark, awkward())
    assert lexical.search(docs.limit(0), bench).count() == 0
    assert lexical.search(docs, bench.limit(0)).count() == 0
    assert lexical.search(docs.where("text IS NULL"), bench).count() == 0


def test_stops_before_the_end_of_the_lists():
    """With falling impacts the unread rest cannot reach the best: direct accesses stay few."""
    rng = np.random.default_rng(5)
    n, n_terms = 5000, 6
    rows = np.tile(np.arange(n), n_terms)
    codes = np.repeat(np.arange(n_terms), n)
    impacts = (1000 * rng.pareto(1.0, n * n_terms)).astype(np.int64)
    shard = lexical.Shard(rows, codes, impacts, n_terms)
    read = []
    score = np.zeros(n, np.int64)
    np.add.at(score, rows, impacts)
    order = rng.permutation(n)

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop)
            return super().__getitem__(key)

    shard.top_rows = shard.top_rows.view(Watched)
    found, scores = shard.best(np.arange(n_terms), 10, n, order)
    want = np.lexsort((order, -score))[:10]
    assert found.tolist() == want.tolist() and scores.tolist() == score[want].tolist()
    assert max(read[-n_terms:]) - 5 * n < n // 2  # the last list was not read to its end


def test_equal_scores_at_the_end_of_the_list():
    """The bound must be strictly below the k-th score: a later tie with an earlier order is found."""
    rows, codes = np.arange(200), np.zeros(200, np.int64)
    shard = lexical.Shard(rows, codes, np.full(200, 7), 1)
    found, scores = shard.best(np.array([0]), 3, 200, np.arange(200)[::-1].copy(), depth=1)
    assert found.tolist() == [199, 198, 197] and scores.tolist() == [7, 7, 7]

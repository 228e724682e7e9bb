import hashlib
import re
from collections import Counter

import pytest
from llm_data import awkward, frame, prose, row

from plumbline.llm import decontaminate


def words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(rows, items, size=10):
    out = []
    for r in rows:
        w, hit, held = words(r[1]), set(), set()
        for item, text in items:
            v = words(text)
            n = min(size, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == v[s:s + n]:
                        hit.update(range(at, at + n))
                        held.add(item)
        held = sorted(str(i) for i in held if i is not None)
        out.append((r[0], len(w), len(hit), len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def got(spark, rows, items):
    bench = spark.createDataFrame([(i, t, "c", 1) for i, t in items], "item_id long, text string, h string, doc_id int")
    return Counter(map(tuple, decontaminate.contamination(frame(spark, rows), bench.repartition(2)).drop("text_hash").collect()))


ITEMS = [(1, prose(1, 3)), (2, prose(1, 2)), (10, "One"), (11, "ab cd"), (12, "a a a"), (3, None), (4, ""), (5, "..., "),
         (1, prose(1, 3)), (None, prose(2, 2)), (20, "Never seen words at all here"), (21, prose(3, 1, 40)), (100, "AB\x00cd-ab, cd ab")]


def test_awkward_rows(spark):
    rows = [*awkward(), row(30, "x " * 7 + "…" + prose(1, 1).upper() + " tail"), row(31, prose(3, 1, 40)[:90])]
    assert got(spark, rows, ITEMS) == plain(rows, ITEMS)


@pytest.mark.parametrize("items", [[], [(1, None)], [(7, "one")]])
def test_few_items(spark, items):
    assert got(spark, awkward(), items) == plain(awkward(), items)


def test_hot_passage_and_many_like_items(spark):
    shared = " ".join(f"w{i}" for i in range(14))
    rows = [row(i, f"own{i} {shared} end{i} {shared}") for i in range(200)] + [row(500, "w1 w2 w3 " * 50)]
    items = [(i, f"{shared} q{i}") for i in range(25)]
    assert got(spark, rows, items) == plain(rows, items)


def test_small_bitmap_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.bitmap, "__defaults__", (64,))
    assert got(spark, awkward(), ITEMS) == plain(awkward(), ITEMS)


def test_empty_table(spark):
    assert got(spark, [], ITEMS) == Counter()

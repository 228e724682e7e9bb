import random
from collections import Counter

import pytest
import xxhash
from llm_data import awkward, frame, row

from plumbline.llm import line_dedup


def plain(rows, lines=3, words=50):
    """Delete lines of runs that stand earlier by (id, text hash, line); equal (id, text) are one place."""

    def key(r):
        h = xxhash.xxh64_intdigest(r[1].encode(), 42)
        return (r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h)

    first, out = {}, []
    texts = sorted({key(r): r[1] for r in rows if r[1] is not None}.items())
    gone = {}
    for k, text in texts:
        parts = text.split("\n")
        for i in range(len(parts)):
            spans = [lines] if i + lines <= len(parts) else []
            if sum(w != "" for w in parts[i].split(" ")) >= words:
                spans.append(1)
            for n in spans:
                body = (n, *parts[i:i + n])
                if body in first:
                    gone.setdefault(k, set()).update(range(i, i + n))
                else:
                    first[body] = True
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0))
        else:
            lost = gone.get(key(r), set())
            out.append((r[0], "\n".join(p for i, p in enumerate(r[1].split("\n")) if i not in lost), len(lost)))
    return Counter(out)


def got(spark, rows, **options):
    df = line_dedup.dedup_lines(frame(spark, rows), **options)
    return Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in df.collect())


def test_awkward_rows(spark):
    assert got(spark, awkward()) == plain(awkward())


@pytest.mark.parametrize("lines,words", [(1, 50), (2, 3), (3, 4), (5, 50)])
def test_random_runs(spark, lines, words):
    rng = random.Random(lines)
    pool = ["a b c d e", "f g", "", "h i j k", "l", "m  n", " o p q"]
    rows = [row(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    assert got(spark, rows, lines=lines, words=words) == plain(rows, lines, words)


def test_rows_that_share_an_id(spark):
    rows = [row(1, "a\nb\nc\nd"), row(1, "x\na\nb\nc"), row(1, "a\nb\nc\nd"), row(None, "a\nb\nc"), row(0, "c\na\nb\nc")]
    assert got(spark, rows) == plain(rows)


def test_all_columns_stay_and_no_python_runs(spark):
    docs = frame(spark, awkward())
    df = line_dedup.dedup_lines(docs)
    assert df.columns == [*docs.columns, "lines_removed"]
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert df.drop("text", "lines_removed").exceptAll(docs.drop("text")).count() == 0


def test_hot_passage(spark):
    shared = "one two\nthree four\nfive six\nseven"
    rows = [row(i, f"own {i}\n{shared}\nend {i}") for i in range(400)]
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0

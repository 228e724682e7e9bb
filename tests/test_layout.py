"""Both plans of every scan agree with plain Python on interleaved, gappy profiles."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.plans.layout import (
    Layout, exact_quantiles, lag, last_known, lay, lead, next_known, row_number, running_max,
    running_min, running_sum,
)

PARTS = Layout(True, 7, 10)
WHOLE = Layout(False)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("hot", float(i), rng.choice([None, 1.0, 2.5, -3.0, rng.random()])) for i in range(90)]
    out += [(f"k{j}", float(i), rng.random()) for j in range(6) for i in range(j)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("layout", [WHOLE, PARTS])
def test_scans_match_python(spark, rows, layout):
    df = spark.createDataFrame(rows, "k string, z double, v double")
    v = F.col("v")
    got = lay(df, ["k"], ["z"], layout).scan(
        n=row_number(), low=running_min(v), high=running_max(v, exclusive=True),
        up=running_min(v, reverse=True), total=running_sum(F.when(v > 0, 1).otherwise(0)),
        before=lag(v), after=lead(v), known=last_known(v), coming=next_known(v, exclusive=True),
    ).df.collect()
    table = {}
    for k, z, x in rows:
        table.setdefault(k, []).append((z, x))
    expected = {}
    for k, items in table.items():
        items.sort()
        vals = [x for _, x in items]
        for i, (z, _) in enumerate(items):
            some = [x for x in vals[:i + 1] if x is not None]
            prior = [x for x in vals[:i] if x is not None]
            later = [x for x in vals[i + 1:] if x is not None]
            rest = [x for x in vals[i:] if x is not None]
            expected[k, z] = (
                i, min(some, default=None), max(prior, default=None), min(rest, default=None),
                sum(1 for x in vals[:i + 1] if x is not None and x > 0),
                vals[i - 1] if i else None, vals[i + 1] if i + 1 < len(vals) else None,
                some[-1] if some else None, later[0] if later else None,
            )
    assert len(got) == len(rows)
    names = ("n", "low", "high", "up", "total", "before", "after", "known", "coming")
    for row in got:
        assert tuple(row[c] for c in names) == expected[row.k, row.z]


@pytest.mark.parametrize("layout", [WHOLE, PARTS])
def test_exact_quantiles(spark, rows, layout):
    import numpy as np

    df = spark.createDataFrame(rows, "k string, z double, v double")
    got = exact_quantiles(df, ["k"], {"q": (F.col("v"), 0.3)}, layout, [F.count("*").alias("n")])
    for row in got.collect():
        vals = [x for k, _, x in rows if k == row.k and x is not None]
        assert row.q == pytest.approx(np.percentile(vals, 30), abs=1e-12)
        assert row.n == sum(1 for k, _, _ in rows if k == row.k)


def test_equal_positions_split_by_tie_break(spark):
    df = spark.createDataFrame([("a", 1.0, i) for i in range(60)], "k string, z double, i int")
    track = lay(df, ["k"], ["z", "i"], PARTS).scan(n=row_number())
    assert [r.n for r in track.df.orderBy("i").collect()] == list(range(60))
    assert track.df.select("_part").distinct().count() > 1


def test_layout_of_counts_the_largest_profile(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") < 70, 0).otherwise(1))
    assert not Layout.of(df, ["k"], 70).split
    assert Layout.of(df, ["k"], 69) == Layout(True, 2, 69)
    assert not Layout.of(df.limit(0), ["k"], 1).split


def test_tasks_follow_the_number_of_rows(spark, monkeypatch):
    from plumbline.plans import layout as plans

    rows = spark.range(400).selectExpr("id % 50 AS k", "id AS z")
    assert plans.deal(rows, ["k"], plans.Layout.of(rows, ["k"])) is rows
    monkeypatch.setattr(plans, "ROWS_PER_TASK", 20)
    found = plans.Layout.of(rows, ["k"])
    dealt = plans.deal(rows, ["k"], found)
    assert found.tasks == 20 and dealt.rdd.getNumPartitions() == 20
    scanned = plans.lay(dealt, ["k"], ["z"], found).scan(rn=plans.row_number()).df
    assert scanned._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(r.rn for r in scanned.collect()) == sorted(list(range(8)) * 50)

"""Joins whose sides grow with the texts send none of them to the driver, however small Spark takes them for."""

import random

import pytest

from plumbline.llm import components, line_dedup, paragraphs, simhash
from plumbline.llm.common import settle


@pytest.fixture
def sent(spark):
    """Rows of the largest table that a plan sends to all tasks, where Spark may send tables of 200 kB."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")

    def largest(df):
        df.write.format("noop").mode("overwrite").save()
        found, nodes = [0], [df._jdf.queryExecution().executedPlan()]
        df.collect()
        while nodes:
            node = nodes.pop()
            kind = node.getClass().getSimpleName()
            if kind == "BroadcastExchangeExec":
                found.append(node.metrics().apply("numOutputRows").value())
            if kind == "AdaptiveSparkPlanExec":
                nodes.append(node.executedPlan())
            elif kind.endswith("QueryStageExec"):
                nodes.append(node.plan())
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
        return max(found)

    yield largest
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_all_tables_are_not_sent(spark, sent):
    rng = random.Random(3)
    prints = [(rng.getrandbits(63), i) for i in range(4000)]
    prints += [(p ^ 5, 10_000 + i) for p, i in prints[:50]]
    links = simhash.near_links(settle(spark.createDataFrame(prints, "fp long, rep long"), "classes"))
    assert sent(links) <= 5_000
    assert {tuple(r) for r in links.collect()} == {(10_000 + i, i) for i in range(50)}


def test_bands_and_windows_are_not_sent(spark, sent, monkeypatch):
    rows = []
    monkeypatch.setattr(components, "settle", lambda df, name: rows.append(sent(df)) or settle(df, name))
    rng = random.Random(4)
    texts = [(i, "\n".join(f"line {rng.randrange(10 ** 9)} of some words" for _ in range(10))) for i in range(300)]
    texts += [(2000 + i, t) for i, t in texts]
    lines = settle(spark.createDataFrame([(i, t.replace("\n", " ") + f" {i}") for i, t in texts], "rep long, line string"), "texts")
    links = paragraphs.alike(lines)
    assert max(rows) <= 5_000 and sent(links) <= 5_000
    assert {tuple(r) for r in links.collect()} == {(2000 + i, i) for i in range(300)}
    gone = line_dedup.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sent(gone) <= 5_000
    assert sorted((r.d, len(r.gone)) for r in gone.collect()) == [(2000 + i, 10) for i in range(300)]


def test_many_links_are_not_sent(spark, sent, monkeypatch):
    edges = spark.range(1, 30_000).selectExpr("id a", "id % 7 b").coalesce(1)
    for few, merged in ((0, True), (100_000, False)):
        monkeypatch.setattr(components, "FEW", few)
        plans = []
        monkeypatch.setattr(components, "settle", lambda df, name: plans.append(df) or settle(df, name))
        got = dict(map(tuple, components.components(edges).collect()))
        assert got == {i: i % 7 for i in range(7, 30_000)}
        text = "".join(p._jdf.queryExecution().optimizedPlan().toString() for p in plans[1:])
        assert ("strategy=merge" in text) == merged

import zlib

import numpy as np
import pytest
from llm_data import awkward, frame, prose, row
from pyspark.sql import functions as F

from plumbline.llm import quality, queries

SF = "/root/testdata/sf0.1"


def test_pairwise_part_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    size = quality.BUCKETS + quality.STATISTICS
    x = np.zeros((2, size))
    x[:, rng.choice(size, 9, replace=False)] = rng.normal(size=(2, 9))
    w0, w, v = rng.normal(size=1), rng.normal(size=size), rng.normal(size=(size, 3))
    for row_, value in zip(x, quality.margin(x, (w0, w, v))):
        at = np.flatnonzero(row_)
        pairs = sum(v[i] @ v[j] * row_[i] * row_[j] for n, i in enumerate(at) for j in at[n + 1:])
        assert value == pytest.approx(w0[0] + row_ @ w + pairs)


def test_gradient_step_lowers_the_loss_and_features_follow_the_text():
    texts = [prose(i) for i in range(40)] + ["bad bad bad !! " * 20 + str(i) for i in range(40)]
    rows, y = [quality.features(t) for t in texts], [1] * 40 + [0] * 40
    fitted = quality.fit(rows, y, epochs=6, batch=16)
    got = quality.scores(rows, fitted)
    assert ((got >= 0.5) == np.array(y)).all()
    assert quality.features("")[2].sum() == 0
    assert len(quality.features("a b a")[0]) <= 2


def test_held_out_accuracy_on_given_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.QUERIES["op5_factorisation_machine"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 300
    assert (got["predicted"] == got["quality"]).mean() > 0.97
    assert (got["predicted"][got["quality"] == 1] == 1).mean() > 0.985
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()


def test_labels_of_held_out_rows_are_never_used(spark):
    docs = frame(spark, [row(i, prose(i) if i % 2 else "x! " * 30) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, t) for t in (labels, other))
    assert all((x == y).all() for x, y in zip(a["model"], b["model"]))


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(None, 1), (1, None), (3, 7)]])
def test_without_both_labels_all_rows_are_even(spark, labels):
    docs = frame(spark, awkward())
    fitted = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.score(docs, fitted).collect()
    assert len(got) == len(awkward()) and {r["score_"] for r in got} == {0.5}


def test_awkward_rows_keep_their_columns(spark):
    docs = frame(spark, awkward())
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in [*range(1, 14), 3]], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels, size_column="n_chars"), size_column="n_chars")
    assert got.columns == [*docs.columns, "score_"]
    assert got.drop("score_").exceptAll(docs).count() == 0 and got.count() == len(awkward())
    assert got.where("score_ >= 0 and score_ <= 1").count() == len(awkward())


def test_empty_table(spark):
    docs = frame(spark, [])
    fitted = quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert quality.score(docs, fitted).count() == 0

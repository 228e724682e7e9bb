import os
import subprocess
import sys

import pytest

import corpus_pipeline
from llm_data import awkward, frame, prose, row, table_folder
from test_llm_decontaminate import plain as plain_hits
from test_llm_lines import plain as plain_lines
from test_llm_simhash import plain_groups
from test_llm_tokens import check_packing

from plumbline.llm import quality, queries, simhash

JUNK = "BUY NOW!! " * 40


def rows():
    good = [r for r in awkward() if r[0] is not None]
    return good + [row(100 + i, prose(100 + i)) for i in range(40)] + [row(200 + i, JUNK + str(i)) for i in range(40)]


def tables(spark, tmp_path, docs):
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(40)],
                                   "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(105, 2)), (2, None)], "item_id long, text string")
    return table_folder(spark, tmp_path, documents=frame(spark, docs), labels=labels, benchmark=bench)


def test_stages_against_plain_python(spark, tmp_path):
    folder = tables(spark, tmp_path, rows())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fitted = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), size_column="n_chars")
    names = docs.columns
    now = [tuple(r) for r in docs.collect()]
    for stage, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, spark.createDataFrame(now, docs.schema).repartition(4), folder)
        got = [tuple(r) for r in out.collect()]
        if stage < 4:
            assert out.columns == names, name
        if stage == 0:
            keep = quality.scores([quality.features(r[1], r[4]) for r in now], fitted) >= 0.3
            want = [r for r, k in zip(now, keep) if k]
            assert {r[0] for r in got} >= set(range(100, 140)) and not {r[0] for r in got} & set(range(200, 240))
        elif stage == 1:
            made = plain_lines(now)
            assert sorted(map(str, got)) == sorted(str((r[0], t, *r[2:])) for r in now for t in [
                next(t for (i, t, _), _ in made.items() if i == r[0])])
            want = got
        elif stage == 2:
            kept = {i for i, _, c in plain_groups(now) if i == c}
            assert sorted(r[0] for r in got) == sorted(kept)
            want = got
        elif stage == 3:
            bad = {k[0] for k in plain_hits(now, [(1, prose(105, 2)), (2, None)]) if k[5]}
            assert 105 in bad
            want = [r for r in now if r[0] not in bad]
        else:
            check_packing(now, out.collect(), 1024)
            continue
        assert sorted(map(str, got)) == sorted(map(str, want)), name
        now = got


def test_run_and_query_agree_and_empty_tables_pass(spark, tmp_path):
    folder = tables(spark, tmp_path, rows())
    assert corpus_pipeline.run(spark, folder).count() == queries.QUERIES["pipeline"](spark, folder).count() > 40
    (tmp_path / "empty").mkdir()
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "empty", [])).count() == 0


def test_null_ids_and_all_awkward_rows_pass(spark, tmp_path):
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, awkward()))
    assert got.where("sequence_id IS NULL OR offset < 0").count() == 0 and got.count() > 5


def test_simhash_stage_keeps_one_of_each_group(spark):
    a, b, c = prose(41), prose(42), prose(43)
    docs = frame(spark, [row(5, a), row(2, a), row(2, a), row(None, a), row(None, b), row(None, b), row(None, c), row(9, None), row(8, "")])
    got = corpus_pipeline.keep_one_of_group(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(2, a), (None, b), (None, c), (8, "")], key=str)


def test_simhash_stage_drops_copies_of_jaccard_above_the_threshold(spark):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    rows, beyond = [], 0
    for i in range(40):
        one = prose(500 + i)
        two = " ".join(one.split()[:-7]) + " changed"
        a, b = shingles(one), shingles(two)
        assert len(a & b) >= 0.8 * len(a | b)
        beyond += (simhash.fingerprint(one) ^ simhash.fingerprint(two)).bit_count() > 4
        rows += [row(2 * i, one), row(2 * i + 1, two)]
    assert beyond > 5
    rows += [row(1000 + i, w) for i, w in enumerate(["few words", "other few words", "one"])] + [row(None, rows[1][1])]
    got = corpus_pipeline.keep_one_of_group(spark, frame(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == [*range(0, 80, 2), 1000, 1001, 1002]


@pytest.mark.parametrize("lost,operators", [("'plumbline.llm', 'corpus_pipeline'", False), ("'plumbline.llm'", False), ("'corpus_pipeline'", True)])
def test_entry_works_without_the_subpackage_or_the_pipeline(lost, operators):
    """The operators go with their folder; the pipeline goes with either, and alone it takes no operator along."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = (f"import sys; sys.modules.update(dict.fromkeys([{lost}]))\n"
            "import __spark_entry__ as e; names = set(e.queries())\n"
            f"assert any(k.startswith('op1') for k in names) == {operators} and 'pipeline' not in names\n"
            "assert set(e.oracle_sql()) <= names; print(len(names))")
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr

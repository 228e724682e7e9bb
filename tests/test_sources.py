"""Readers and sinks on small files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ert, ledger
from plumbline.sources import publish, readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_casts_of_two_header_variants(spark, tmp_path):
    write(tmp_path / "a/deep/AB1D_YSI_B_20220301.csv", "Depth (m),SpCond (uS/cm),Time (HH:mm:ss)\n2.0,300,10:00:01\n1.0,NaN,10:00:00\n")
    write(tmp_path / "a/AB1D_YSI_A_20220201.csv", "Depth (m),SpCond (uS/cm),Time (HH:mm:ss)\n5.0,310,09:00:00\n")
    write(tmp_path / "b/20220401_YSI_AB1D.csv", "Vertical Position m,Conductivity,Depth from GL (m) \n3.0,320,4.5\n")
    write(tmp_path / "b/field-notes.csv", "Vertical Position m,Conductivity,Depth from GL (m) \n9.0,1,10\n")
    casts = readers.read_casts(spark, {"a": (str(tmp_path / "a"), None), "b": (str(tmp_path / "b"), None)})
    rows = readers.casts_of(casts, "AB1D").collect()
    assert [(r.cast_date, r.suffix, r.depth_m) for r in rows] == [
        ("20220201", "A", 5.0), ("20220301", "B", 2.0), ("20220301", "B", 1.0), ("20220401", None, 3.0)]
    assert rows[2].sec_us_cm is None and rows[3].depth_gl_m == 4.5
    assert [r.depth_m for r in readers.casts_of(casts, "AB1D", probe="A").collect()] == [5.0]
    assert [r.file_name for r in readers.unparsed_casts(casts).collect()] == ["field-notes.csv"]
    assert [(r.cast_no, r.n_rows) for r in readers.cast_index(casts).orderBy("cast_no").collect()] == [(1, 1), (2, 2), (3, 1)]


def test_width_master(spark, tmp_path):
    write(tmp_path / "m.csv", "source_file,Depth [m],calibrated_cm,Diameter_auger_in\nX1_log,0.5,15.5,6\nX2_log_b,1.0,16,6\n")
    rows = readers.read_width_master(spark, str(tmp_path / "m.csv")).orderBy("well_id").collect()
    assert [(r.well_id, r.depth_m) for r in rows] == [("X1", 0.5), ("X2", 1.0)]
    write(tmp_path / "bad.csv", "source_file,Depth [m],calibrated_cm,Diameter_auger_in\nX1_log,-0.5,15.5,6\n")
    with pytest.raises(Exception, match="negative depth"):
        readers.read_width_master(spark, str(tmp_path / "bad.csv")).collect()
    write(tmp_path / "short.csv", "source_file,Depth [m]\nX1_log,0.5\n")
    with pytest.raises(ValueError, match="lacks columns"):
        readers.read_width_master(spark, str(tmp_path / "short.csv"))


def test_resistivity_files(spark, tmp_path):
    write(tmp_path / "robust_x_12.5.csv", "x_requested,x_extracted,depth,resist,resistlog10\n12.5,12.4,-1.5,20,1.3\n12.5,12.4,-3.0,10,1.0\n")
    rows = readers.read_ert(spark, str(tmp_path), "T1").orderBy("depth_bgl_m").collect()
    assert [(r.variant, r.x_name, r.x, r.depth_bgl_m) for r in rows] == [("robust", 12.5, 12.4, 1.5), ("robust", 12.5, 12.4, 3.0)]


def test_traces_error_lists_positions(spark):
    df = spark.createDataFrame([("t", 1.0), ("t", 2.0)], "transect string, x double")
    assert ert.require_traces(df, 2.0000001).count() == 1
    with pytest.raises(ValueError, match="1.0, 2.0"):
        ert.require_traces(df, 7)


def test_annotations_skip_comments(spark, tmp_path):
    write(tmp_path / "n.csv", "# header note\nwell,depth_ft,depth_m,kind,text\n#skip\nW1,10,3.0,lithology,sand\nW2,20,6.1,test,ok\n")
    assert [r.text for r in readers.read_annotations(spark, str(tmp_path / "n.csv"), "W1").collect()] == ["sand"]


def test_sweep_json_with_scalars_intervals_and_nan(spark, tmp_path):
    document = {"trial_1": {"df": {
        "n_breakpoints": {"0": 1, "1": 2}, "bic": {"0": -5.0, "1": float("nan")}, "rss": {"0": 1.0, "1": None},
        "converged": {"0": True, "1": False},
        "estimates": {"0": {"const": 2.0, "breakpoint1": {"estimate": 8.0, "confidence_interval": [7.0, 9.0]}}, "1": None}},
        "best_n_breakpoint_bic": 1}}
    write(tmp_path / "s.json", json.dumps(document, indent=1))
    one, two = readers.read_sweep_json(spark, str(tmp_path / "s.json")).orderBy("n_breakpoints").collect()
    assert one.estimates["const"]["estimate"] == 2.0 and one.estimates["breakpoint1"]["confidence_interval"] == [7.0, 9.0]
    assert one.bic == -5.0 and two.bic is None and two.rss is None and two.estimates is None and not two.converged


def test_failed_write_leaves_no_ledger_entry(spark, tmp_path):
    entry = spark.createDataFrame([tuple(str(i) for i in range(10))], ", ".join(f"{c} string" for c in ledger.LEDGER_COLUMNS))
    out, book = str(tmp_path / "out"), str(tmp_path / "book")
    ledger.write_and_register(spark.range(3), out, entry, book)
    with pytest.raises(Exception):
        ledger.write_and_register(spark.range(3), out, entry, book)
    assert spark.read.parquet(book).count() == 1


def test_text_export_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, None)], "k string, x double, y double")
    sinks.write_text_export(df, str(tmp_path / "t"), {"x": 4, "y": 4})
    row = spark.read.option("header", True).csv(str(tmp_path / "t")).first()
    assert row.x == "1.2346" and row.y is None
    profiles = spark.range(4).withColumns({"campaign": F.lit("2022_02"), "smoothing": F.when(F.col("id") < 2, "savgol").otherwise("lowess")})
    sinks.write_profiles(profiles, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("smoothing = 'savgol'").count() == 2


def test_folder_with_three_headers_and_broken_files(spark, tmp_path):
    write(tmp_path / "in/a/AB1D_YSI_A_20220201.csv", "Depth (m),SpCond (uS/cm),Time (HH:mm:ss)\n5.0,310,09:00:00\n4.0,bad,09:00:01\n")
    write(tmp_path / "in/b b/20220401_YSI_AB1D.csv", "﻿Vertical Position m,Conductivity,Depth from GL (m) \n3.0,320,4.5\n")
    write(tmp_path / "in/c/AB2D_YSI_B_20220301.csv", "\n\"sec_us_cm\",note,depth_m,depth_m\n1,\"x, y\",2.5,9\n")
    write(tmp_path / "in/c/AB3D_YSI_B_20220301.csv", "Battery,Depth (m)\n12,1.0\n")
    write(tmp_path / "in/c/AB4D_YSI_B_20220301.csv", "")
    (tmp_path / "in/c/AB5D_YSI_B_20220301.csv").write_bytes(b"\x00\x01\xff\xfe\n\x00")
    casts, odd = readers.read_cast_folder(spark, str(tmp_path / "in"))
    rows = {(r.well_id, r.depth_m): r for r in casts.collect()}
    assert set(rows) == {("AB1D", 5.0), ("AB1D", 4.0), ("AB1D", 3.0), ("AB2D", 2.5)}
    assert rows["AB1D", 4.0].sec_us_cm is None and rows["AB1D", 3.0].depth_gl_m == 4.5 and rows["AB2D", 2.5].sec_us_cm == 1.0
    reasons = {r.file_path.rsplit("/", 1)[1][:4]: r.reason for r in odd.collect()}
    assert reasons == {"AB3D": "no column for conductivity", "AB4D": "empty", "AB5D": "not text"}
    nothing, all_odd = readers.read_cast_folder(spark, str(tmp_path / "in/c"), aliases={**readers.ALIASES, "depth": ["no such"]})
    assert nothing.count() == 0 and all_odd.count() == 4


def test_files_are_read_a_fixed_number_of_times(spark, tmp_path):
    """Headers are found once and rows read once, however many headers there are; no scan guesses types."""
    for k in range(12):
        write(tmp_path / f"in/{k % 3}/AB{k}D_YSI_20220201.csv", f"Depth (m),note{k % 3},Conductivity\n{k}.5,1,30{k}\n")
    seen = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    casts, odd = readers.read_cast_folder(spark, str(tmp_path / "in"))
    assert casts._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert "Relation [" not in odd._jdf.queryExecution().optimizedPlan().toString()
    plain = readers.read_casts(spark, {"a": (str(tmp_path / "in/0"), None)})
    assert sorted((r.depth_m, r.sec_us_cm) for r in plain.collect()) == [(0.5, 300.0), (3.5, 303.0), (6.5, 306.0), (9.5, 309.0)]
    assert sorted((r.well_id, r.depth_m) for r in casts.collect()) == sorted((f"AB{k}D", k + 0.5) for k in range(12))
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - seen
    assert len(jobs) < 20


def test_named_files_have_all_rows_and_one_header(spark, tmp_path):
    rows = spark.range(1000).selectExpr("concat(id % 3, '/F', id % 60, '.csv') AS file", "id AS `Depth (m)`", "'a, \"b\"' AS `x, y`")
    assert sinks.write_named_files(rows, str(tmp_path / "out"), tasks=7) == 60
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(f"F{k}.csv" for k in range(60))
    back = spark.read.option("header", True).option("recursiveFileLookup", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == ["Depth (m)", "x, y"] and sorted(int(r[0]) for r in back.collect()) == list(range(1000))
    assert sinks.write_named_files(rows.limit(0), str(tmp_path / "none")) == 0


# ---- published versions

ENTRY = {c: c for c in ledger.LEDGER_COLUMNS}


def entries(spark, *runs):
    return spark.createDataFrame([tuple({**ENTRY, "run_id": r}[c] for c in ledger.LEDGER_COLUMNS) for r in runs],
                                 ", ".join(f"{c} string" for c in ledger.LEDGER_COLUMNS))


def test_a_failure_between_the_writes_leaves_neither(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    assert publish.manifest(spark, store) == {} and publish.read_published(spark, store, "output") is None
    assert ledger.publish_run(spark, store, "output", spark.range(3), entries(spark, "one")) == 1
    bad = entries(spark, "two").withColumn("notes", F.raise_error(F.lit("the ledger write fails")).cast("string"))
    with pytest.raises(Exception, match="ledger write fails"):
        ledger.publish_run(spark, store, "output", spark.range(50), bad)
    monkeypatch.setattr(publish, "_mark", lambda *a: (_ for _ in ()).throw(OSError("the driver dies")))
    with pytest.raises(OSError):
        ledger.publish_run(spark, store, "output", spark.range(60), entries(spark, "three"))
    monkeypatch.undo()
    assert publish.read_published(spark, store, "output").count() == 3
    assert [r.run_id for r in publish.read_published(spark, store, "ledger").collect()] == ["one"]
    assert ledger.publish_run(spark, store, "output", spark.range(5), entries(spark, "four"), mode="append") == 2
    assert publish.read_published(spark, store, "output").count() == 8
    assert sorted(r.run_id for r in publish.read_published(spark, store, "ledger").collect()) == ["four", "one"]
    assert publish.read_published(spark, store, "output", 1).count() == 3
    assert publish.drop_leftovers(spark, store) > 0
    assert publish.versions(spark, store) == [2] and publish.read_published(spark, store, "output").count() == 8
    with pytest.raises(ValueError):
        publish.read_published(spark, store, "output", 1)


def test_a_table_replaced_by_a_query_over_itself(spark, tmp_path):
    store = str(tmp_path / "store")
    publish.publish(spark, store, replace={"t": spark.range(10)})
    for _ in range(2):
        now = publish.read_published(spark, store, "t")
        publish.publish(spark, store, replace={"t": now.select((F.col("id") + 1).alias("id"))})
    assert publish.read_published(spark, store, "t").agg(F.min("id"), F.max("id"), F.count("*")).first() == (2, 11, 10)


def test_of_two_writers_one_fails(spark, tmp_path):
    store = str(tmp_path / "store")
    publish.publish(spark, store, replace={"t": spark.range(1)})
    publish.publish(spark, store, replace={"t": spark.range(2)}, base=1)
    with pytest.raises(publish.Conflict):
        publish.publish(spark, store, replace={"t": spark.range(3)}, base=1)
    assert publish.read_published(spark, store, "t").count() == 2

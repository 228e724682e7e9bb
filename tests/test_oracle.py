"""Registered queries against their SQL at the smallest scale, under both plans."""

import duckdb
import pandas as pd
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF

SHORT = [
    "cal_06_zone_table", "cal_01_interval_noise", "smo_03_pchip_baseline", "win_07_step_fill",
    "win_10_moving_average", "win_02_descent_filter", "smo_01_pchip_resample", "smo_04_savgol",
    "smo_05_segmented_savgol", "smo_06_lowess", "smo_07_isotonic", "agg_03_cluster_summary",
    "jon_02_best_match", "agg_12_well_summary", "jon_04_unmatched_zones", "win_15_transition_zone",
    "win_17_resistivity_zone", "bps_13_segment_regressions", "bps_14_model_segments",
    "dat_06_metadata_upsert", "jon_06_resolved_offsets", "jon_09_interpolated_resistivity",
    "txt_03_merged_notes", "src_05_file_names", "src_18_sweep_documents",
    "win_15_short_profiles", "bps_17_upper_limit", "smo_07_tied_depths", "smo_06_tied_depths", "bps_01_certified_sweep",
    "smo_10_stored_fits", "agg_06_delta_sensitivity", "snk_04_published_runs", "snk_05_published_upsert",
]
LONG = ["cal_05_sample_severity", "smo_07_isotonic", "smo_05_segmented_savgol", "smo_06_lowess", "txt_03_merged_notes",
        "smo_07_tied_depths", "smo_06_tied_depths"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def compare(spark, duck, name):
    df = queries()[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    duck.execute(oracle_sql()[name])
    want = pd.DataFrame(duck.fetchall(), columns=[d[0] for d in duck.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got)
    assert check.canonical(got) == check.canonical(want)


@pytest.mark.parametrize("name", SHORT)
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", LONG)
def test_long_profile_plan_matches_sql(spark, duck, name):
    spark.conf.set("spark.plumbline.rowsPerSplit", "400" if name.startswith("cal") else "25")
    try:
        compare(spark, duck, name)
    finally:
        spark.conf.unset("spark.plumbline.rowsPerSplit")


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0 and "peak_cm" in df.columns


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_wells_meet_counts_of_traces_and_not_their_rows(spark, duck):
    compare(spark, duck, "src_15_well_association")
    plan = queries()["src_15_well_association"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Join", 1)[1]  # below the join


def test_ill_conditioned_local_line_matches_sql(duck):
    """A cast of sf0.1 whose fit stands 1e-5 from a rounding step: lines are solved as the SQL has them."""
    from plumbline.operators.smooth import lowess_values
    from plumbline.workload import casts, views

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = 1368")
    con.execute("SET threads = 1")
    body = casts.CLEAN + "," + casts.lowess_sql("flat", "z", "sec", 0.3, 2)
    rows = con.execute(views.with_views(["cast_samples"], body + f" SELECT x, y, {casts.r('fit', 4)} FROM f2 JOIN l0 USING (well_id, campaign, i) ORDER BY i")).fetchall()
    x, y, want = (pd.Series(c).to_numpy(float) for c in zip(*rows))
    fit = lowess_values(x, y, 0.3, 1, 2)
    assert 64503.6469 in want and list((fit * 1e4 + 0.4999) // 1 / 1e4) == list(want)


def test_delta_sensitivity_looks_no_rank_up(spark):
    """Quartiles are read off the scan: the plan has no join and, for whole profiles, one shuffle."""
    plan = queries()["agg_06_delta_sensitivity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1

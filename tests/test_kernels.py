"""Hand-made edge cases per kernel: empty, short, tied, null and swapped input."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.numeric import hinge_value, overlap_length, shift_probe
from plumbline.operators import baseline, catalogue, clean, cluster, converge, datum, detect, geometry, ledger, noise, notes, smooth
from plumbline.sources import names, readers

SAMPLE = "k string, z double, v double"


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, float(i), v) for i, v in enumerate(values)], SAMPLE)


def column(df, name):
    return [r[name] for r in df.orderBy("k", "z").collect()]


def test_empty_and_tiny_profiles(spark):
    empty = frame(spark, [])
    assert baseline.running_minimum(empty, ["k"], "z", "v").count() == 0
    assert smooth.savgol(empty, ["k"], "z", "v").count() == 0
    one = frame(spark, [3.0])
    assert column(baseline.single_zone_baseline(one, ["k"], "z", "v", "pchip"), "baseline_cm") == [3.0]
    assert column(smooth.savgol(one, ["k"], "z", "v"), "v") == [3.0]
    assert column(smooth.lowess(one, ["k"], "z", "v"), "v") == [3.0]
    assert column(noise.moving_average(one, ["k"], "z", "v", 5), "smooth") == [3.0]


def test_step_baseline_fills_leading_and_invalid_rows(spark):
    df = frame(spark, [None, 5.0, None, 4.0, 6.0])
    got = column(baseline.single_zone_baseline(df, ["k"], "z", "v", "step"), "baseline_cm")
    assert got == [5.0, 5.0, 5.0, 4.0, 4.0]


def test_zone_with_fewer_than_two_valid_samples_is_excluded(spark):
    df = frame(spark, [20.0, 20.0, 1.0, 1.0, 20.0]).withColumns({"trim_depth_m": F.lit(2.0), "auger_in": F.lit(6.0)})
    rows = baseline.two_zone_baseline(df, ["k"], "z", "v")
    assert column(rows, "zone_label") == ["shallow", "shallow", "excluded", "excluded", "excluded"]
    assert column(rows, "baseline_cm")[2:] == [None, None, None]


def test_unknown_options_are_refused(spark):
    df = frame(spark, [1.0])
    with pytest.raises(ValueError):
        baseline.single_zone_baseline(df, ["k"], "z", "v", "cubic")
    with pytest.raises(ValueError):
        converge.check_options(rule="nearest")
    with pytest.raises(ValueError):
        cluster.cluster_depths(df, ["k"], "z", delta_m=0)
    with pytest.raises(ValueError):
        shift_probe(F.col("z"), method="other")


@pytest.mark.parametrize("flags, expected", [([True] * 4, [(0.0, 3.0, 4)]), ([False] * 4, []),
                                             ([True, False, True, True], [(2.0, 3.0, 2)])])
def test_runs_of_true(spark, flags, expected):
    df = spark.createDataFrame([("a", float(i), f) for i, f in enumerate(flags)], "k string, z double, f boolean")
    got = detect.runs_of_true(df, ["k"], "z", "f", 2).collect()
    assert [(r.run_start, r.run_end, r.n_points) for r in got] == expected


def test_gap_equal_to_delta_splits(spark):
    df = spark.createDataFrame([("a", z) for z in (1.0, 1.5, 1.9, 2.4)], "k string, z double")
    rows = cluster.cluster_depths(df, ["k"], "z", 0.5).orderBy("z").collect()
    assert [r.cluster_id for r in rows] == [0, 1, 1, 2]


def test_overlap_of_touching_and_swapped_intervals(spark):
    rows = [(1.0, 2.0, 2.0, 3.0), (4.0, 1.0, 2.0, 6.0), (1.0, 2.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(overlap_length(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [0.0, 2.0, 0.0]


def match_fixture(spark):
    clusters = spark.createDataFrame(
        [("w", 0, 1.0, 2.0, 1.5, 3), ("w", 1, 50.0, 51.0, 50.5, 2), ("w", 2, 9.0, 9.0, 9.0, 1)],
        "well_id string, cluster_id int, depth_min double, depth_max double, depth_median double, agreement int")
    zones = spark.createDataFrame(
        [("w", 1, 1.5, 2.5, 2.0, "mild", 9.0), ("w", 2, 0.0, 40.0, 20.0, "severe", 1.0), ("w", 3, 9.4, 9.6, 9.5, "mild", 2.0),
         ("x", 4, 1.0, 2.0, 1.5, "mild", 1.0)],
        "well_id string, zone_id int, z_bot double, z_top double, z_centre double, severity string, peak_excess_cm double")
    return clusters, zones


def test_matches_over_several_buckets_count_once(spark):
    clusters, zones = match_fixture(spark)
    pairs = sorted((r.cluster_id, r.zone_id) for r in converge.find_matches(clusters, zones).collect())
    assert pairs == [(0, 1), (0, 2), (2, 2), (2, 3)] or pairs == [(0, 1), (0, 2), (2, 3)]
    assert all(p != (1, 2) for p in pairs)


def test_priorities_and_scores(spark):
    clusters, zones = match_fixture(spark)
    matches = converge.find_matches(clusters, zones)
    pick = lambda p: {r.cluster_id: r.zone_id for r in converge.best_match(matches, priority=p).collect()}
    assert pick("overlap")[0] == 2 and pick("severity")[0] == 2 and pick("peak")[0] == 1
    scores = {r.cluster_id: r for r in converge.score_matches(matches, clusters).collect()}
    assert scores[0].score == 9.0 and scores[0].multi_match and scores[0].severities == "mild,severe"
    assert scores[1].score == 0.0 and scores[1].n_zones_matched == 0
    left = [r.zone_id for r in converge.unmatched_zones(zones, matches).collect()]
    assert left == [4]


def test_descent_filter_equals_the_sequential_rule(spark):
    import random

    rng = random.Random(5)
    z = [i * 0.01 + rng.uniform(-0.05, 0.05) for i in range(400)]
    df = spark.createDataFrame([("a", i, d) for i, d in enumerate(z)], "k string, seq int, z double")
    kept, deepest = [], None
    for i, d in enumerate(z):
        if deepest is None or d >= deepest - 0.002:
            kept.append(i)
            deepest = d if deepest is None else max(deepest, d)
    got = [r.seq for r in clean.descent_filter(df, ["k"], "z", "seq").orderBy("seq").collect()]
    assert got == kept


def test_negative_and_nan_depths_go(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (float("nan"),), (None,), (2.0,)], "depth_m double")
    assert sorted(r[0] for r in clean.drop_negative_depths(df).collect()) == [0.0, 2.0]


@pytest.mark.parametrize("window", [10, 11])
def test_savgol_reproduces_a_cubic(spark, window):
    values = [0.5 * t**3 - 4 * t**2 + t + 7 for t in range(40)]
    got = column(smooth.savgol(frame(spark, values), ["k"], "z", "v", window, 3), "v")
    assert max(abs(a - b) for a, b in zip(got, values)) < 1e-8


def test_profile_shorter_than_the_window_is_unchanged(spark):
    assert column(smooth.savgol(frame(spark, [1.0, 9.0, 2.0]), ["k"], "z", "v", 11), "v") == [1.0, 9.0, 2.0]


def test_segmented_savgol_keeps_a_jump(spark):
    values = [100.0] * 30 + [9000.0] * 30
    assert column(smooth.segmented_savgol(frame(spark, values), ["k"], "z", "v"), "v") == pytest.approx(values)


def test_lowess_reproduces_a_line(spark):
    values = [3.0 + 0.5 * i for i in range(50)]
    got = column(smooth.lowess(frame(spark, values), ["k"], "z", "v", 0.3), "v")
    assert got == pytest.approx(values)


def test_isotonic_is_monotone_and_keeps_the_mean(spark, long_profiles):
    values = [float((i * 37) % 23) for i in range(60)]
    whole = column(smooth.isotonic(frame(spark, values), ["k"], "z", "v"), "v")
    assert all(a <= b + 1e-12 for a, b in zip(whole, whole[1:]))
    assert sum(whole) == pytest.approx(sum(values))
    assert whole == pytest.approx(list(smooth.pool_adjacent(values, [1.0] * 60)))


def test_moving_average_reflects_ends_and_bumps_even_windows(spark):
    got = column(noise.moving_average(frame(spark, [1.0, 2.0, 4.0, 8.0]), ["k"], "z", "v", 2), "smooth")
    assert got == pytest.approx([5 / 3, 7 / 3, 14 / 3, 16 / 3])


def test_moving_average_longer_than_the_profile(spark):
    import numpy as np

    values = [1.0, 5.0, 2.0]
    padded = np.pad(values, 6, mode="reflect")
    want = [padded[i:i + 13].mean() for i in range(3)]
    assert column(noise.moving_average(frame(spark, values), ["k"], "z", "v", 13), "smooth") == pytest.approx(want)


def test_sign_normalisation_statuses(spark):
    df = spark.createDataFrame([("a", -2.0), ("a", -1.0), ("b", -1.0), ("b", 3.0), ("c", 0.0), ("c", 4.0)], "k string, z double")
    rows = {(r.k, r.z): r.sign_status for r in detect.normalise_signs(df, ["k"], "z").collect()}
    assert rows[("a", 2.0)] == "flipped" and rows[("b", -1.0)] == "mixed" and rows[("c", 4.0)] == "unchanged"


def test_transition_zone_special_cases(spark):
    rows = [("two", 1, 0.0, 2.0), ("two", 2, 5.0, 4.9), ("flat", 1, 0.0, 3.0), ("flat", 2, 1.0, 3.0), ("flat", 3, 2.0, 3.0),
            ("s", 1, 0.0, 2.5), ("s", 2, 5.0, 2.6), ("s", 3, 8.0, 4.7), ("s", 4, 10.0, 4.8)]
    df = spark.createDataFrame(rows, "well_id string, bp_index int, depth_m double, log10_sec double")
    out = {(r.well_id, r.bp_index): r for r in geometry.transition_zone(df, ["well_id"]).collect()}
    assert out["s", 2].is_top_of_mixing and out["s", 3].is_bottom_of_mixing and out["s", 1].mz_status == "ok"
    assert out["two", 1].is_top_of_mixing and not out["two", 1].is_bottom_of_mixing
    assert not out["two", 2].is_top_of_mixing and not out["two", 2].is_bottom_of_mixing
    assert out["flat", 1].mz_status == "flat" and not any(out["flat", i].is_top_of_mixing for i in (1, 2, 3))


@pytest.mark.parametrize("first,middle,last,bottom", [(2.5, 2.6, 4.9, False), (2.5, 4.7, 4.9, True), (4.9, 4.7, 2.0, True)])
def test_three_points_have_one_candidate(spark, first, middle, last, bottom):
    rows = [("s", 1, 0.0, first), ("s", 2, 5.0, middle), ("s", 3, 8.0, last)]
    df = spark.createDataFrame(rows, "well_id string, bp_index int, depth_m double, log10_sec double")
    out = {r.bp_index: r for r in geometry.transition_zone(df, ["well_id"]).collect()}
    assert [out[i].is_top_of_mixing for i in (1, 2, 3)] == [False, True, False]
    assert [out[i].is_bottom_of_mixing for i in (1, 2, 3)] == [False, bottom, False]


def test_two_points_and_chords_without_length(spark):
    rows = [("two", 1, 0.0, 4.8), ("two", 2, 5.0, 2.0), ("z", 1, 0.0, 2.0), ("z", 2, 1.0, 4.7), ("z", 3, 1.0, 4.7), ("z", 4, 2.0, 4.8)]
    df = spark.createDataFrame(rows, "well_id string, bp_index int, depth_m double, log10_sec double")
    out = {(r.well_id, r.bp_index): r for r in geometry.transition_zone(df, ["well_id"]).collect()}
    assert out["two", 1].is_top_of_mixing and out["two", 1].is_bottom_of_mixing
    angles = {(r.well_id, r.bp_index): r.turning_angle for r in geometry.turning_angles(df, ["well_id"]).collect()}
    assert angles["z", 2] == angles["z", 3] == 0.0 and angles["z", 1] is None


def test_resistivity_zone_of_three_points_has_no_bottom(spark):
    df = spark.createDataFrame([("e", 1.0, 90.0), ("e", 4.0, 80.0), ("e", 9.0, 2.0)], "t string, depth_bgl_m double, resist_ohm_m double")
    out = geometry.resistivity_zone(df, ["t"]).orderBy("depth_bgl_m").collect()
    assert [r.is_top_of_mixing for r in out] == [False, True, False] and not any(r.is_bottom_of_mixing for r in out)


def test_severity_limits_belong_to_the_higher_class(spark):
    rule = detect.DetectionRule(offset_cm=0.5, k_sigma=1.0, sigma_inst_cm=0.25, mild_max_excess_cm=2.0, moderate_max_excess_cm=5.0)
    rows = [("w", float(i), 10.0 + e, 10.0, "all") for i, e in enumerate([0.0, 2.0, 2.5, 3.0, 5.5])]
    df = spark.createDataFrame(rows, "k string, depth_m double, caliper_cm double, baseline_cm double, zone_label string")
    flagged = detect.flag_samples(df, rule)
    assert [r.severity_per_sample for r in flagged.orderBy("depth_m").collect()] == ["none", "mild", "moderate", "moderate", "severe"]
    zone = detect.zone_table(flagged, ["k"], rule).first()
    assert (zone.peak_excess_cm, zone.peak_excess_over_threshold_cm, zone.severity) == (5.5, 5.0, "severe")


def test_trailing_digits_give_the_trial(spark):
    df = spark.createDataFrame([("trial_3",), ("x_12",), ("7",), ("final",), (None,)], "n string")
    assert [r[0] for r in df.select(catalogue.trial_index(F.col("n"))).collect()] == [3, 12, 7, 1, 1]


def test_method_texts_and_output_names(spark):
    lit = F.lit
    row = spark.range(1).select(
        ledger.method_signature(lit("savgol"), lit(11), lit(3), segmented=lit(True), monotone=lit(False)).alias("a"),
        ledger.method_signature(lit("breakpoints"), size=lit(4), trial=lit(None).cast("int")).alias("b"),
        ledger.method_signature(lit("own"), beta=lit(2), alpha=lit("x")).alias("c"),
        ledger.output_filename(lit("W1D"), lit("2022/02"), lit("savgol_w11"), lit("smooth")).alias("d"),
    ).first()
    assert tuple(row) == ("savgol_w11_p3_segmented", "breakpoints_n4", "own_alphax_beta2", "W1D_2022-02_smooth_savgol_w11.csv")


def test_extractions_replace_manual_rows(spark):
    old = spark.createDataFrame([("a", 1.0, "manual"), ("b", 2.0, "manual"), ("c", 3.0, "computed"), ("d", 4.0, "manual")], "k string, vadose_m double, source string")
    new = spark.createDataFrame([("a", 9.0, "ok"), ("b", None, "no_samples"), ("d", 7.0, "inconsistent"), ("e", 5.0, "ok")], "k string, vadose_m double, offset_status string")
    got = {r.k: (r.vadose_m, r.source, r.action) for r in datum.upsert_offsets(old, new, ["k"]).collect()}
    assert got == {"a": (9.0, "computed", "updated"), "b": (2.0, "manual", "kept_manual"), "c": (3.0, "computed", "kept"),
                   "d": (7.0, "computed", "updated"), "e": (5.0, "computed", "added")}


def test_repeated_metadata_does_not_multiply_requests(spark):
    ask = spark.createDataFrame([("a", "x")], "well_id string, campaign string")
    known = spark.createDataFrame([("a", "x", 2.0), ("a", "x", 1.0), ("a", "y", 3.0)], "well_id string, campaign string, vadose_m double")
    none = spark.createDataFrame([], "well_id string, campaign string, offset_m double, offset_status string")
    assert [r.vadose_m for r in datum.resolve_offsets(ask, known, none, "y").collect()] == [1.0]


def test_no_top_candidate_is_a_status(spark):
    rows = [("s", 1, 0.0, 3.0), ("s", 2, 5.0, 3.1), ("s", 3, 8.0, 4.0), ("s", 4, 9.0, 4.1)]
    df = spark.createDataFrame(rows, "well_id string, bp_index int, depth_m double, log10_sec double")
    assert geometry.transition_zone(df, ["well_id"], top=10.0).first().mz_status == "no_top_candidate"


def test_elbow_skips_nulls_and_takes_the_first_tie(spark):
    curve = [("a", 0, 10.0), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 1.0), ("a", 4, 0.0), ("b", 0, 1.0), ("b", 1, 1.0), ("b", 2, 1.0)]
    df = spark.createDataFrame(curve, "k string, n_breakpoints int, bic double")
    got = {r.k: r.elbow for r in geometry.elbow(df, ["k"], "bic").collect()}
    assert got == {"a": 1, "b": 0}


def test_hinge_value(spark):
    df = spark.createDataFrame([(1.0, 0.5, [2.0, -1.0], [1.0, 3.0]), (1.0, 0.5, [], [])], "c double, a double, b array<double>, p array<double>")
    got = [r[0] for r in df.select(hinge_value(F.lit(4.0), F.col("c"), F.col("a"), F.col("b"), F.col("p"))).collect()]
    assert got == [8.0, 3.0]


@pytest.mark.parametrize("token, expected", [("3.5", (3.5, 3.5)), ("4 m", (4.0, 4.0)), ("1-2.5", (1.0, 2.5)), ("1 – 2", (1.0, 2.0)),
                                             ("1—2 m", (1.0, 2.0)), ("deep", (None, None)), ("", (None, None)), (None, (None, None))])
def test_depth_tokens(spark, token, expected):
    top, bottom = notes.parse_depth(F.col("t"))
    assert tuple(spark.createDataFrame([(token,)], "t string").select(top, bottom).first()) == expected


def test_continuations_join_and_orphans_drop(spark):
    rows = [("s", 1, None, "orphan"), ("s", 2, "3.0", "cavity. "), ("s", 3, None, "wide"), ("s", 4, "5-6", "end.")]
    df = spark.createDataFrame(rows, "sheet string, row_no int, depth_token string, note string")
    got = notes.merge_continuations(df, ["sheet"]).orderBy("entry").collect()
    assert [(r.depth_top, r.note) for r in got] == [(3.0, "cavity; wide"), (5.0, "end.")]


def test_alias_resolution(spark):
    assert readers.resolve_column(["x", "Depth (m)"], "depth") == "Depth (m)"
    assert readers.resolve_column(["DEPTH (M)", "depth_m"], "depth") == "depth_m"
    assert readers.resolve_column(["DEPTH (M)"], "depth") == "DEPTH (M)"
    with pytest.raises(ValueError):
        readers.resolve_column(["speed"], "depth")


def test_names(spark):
    df = spark.createDataFrame([("AB12D_YSI_A_20220201.csv",), ("20220201_YSI_AB12S.csv",), ("readme.txt",),
                                ("AB12_D_YSI_20220201.csv",), ("AB12D_YSI_20220201_B.csv",)], "n string")
    rows = df.select(*[c.alias(k) for k, c in names.parse_cast_name(F.col("n")).items()]).collect()
    assert [r.well_id for r in rows] == ["AB12D", "AB12S", None, "AB12D", "AB12D"]
    assert [r.suffix for r in rows] == ["A", None, None, None, "B"] and rows[1].cast_date == "20220201"
    variant, x = names.parse_ert_name(F.lit("inv_x_robust_x_-12.5.csv"))
    assert tuple(spark.range(1).select(variant, x).first()) == ("inv_x_robust", -12.5)


def test_flag_samples_saturation_forces_severe(spark):
    df = frame(spark, [31.0, 16.0, 15.0]).withColumn("baseline_cm", F.when(F.col("z") < 2, 15.0))
    rule = detect.DetectionRule(moderate_max_excess_cm=100.0)
    assert column(detect.flag_samples(df, rule, "v"), "severity_per_sample") == ["severe", "mild", "none"]


def test_severity_runs_pad_by_half_the_spacing(spark):
    df = spark.createDataFrame([("a", z, s) for z, s in ((1.0, "mild"), (2.0, "mild"), (3.0, "none"), (4.0, "severe"))], "k string, z double, s string")
    got = {(r.s, r.run_top, r.run_bottom) for r in detect.severity_runs(df, ["k"], "z", "s").collect()}
    assert got == {("mild", 0.5, 2.5), ("severe", 3.5, 4.5)}


def test_nan_is_not_greatest(spark):
    from plumbline.functions.numeric import clean_nan

    df = clean_nan(spark.createDataFrame([(math.nan,), (1.0,)], "v double"), "v")
    assert df.where("v >= 1").count() == 1


def test_savgol_keeps_the_place_of_nulls(spark):
    values = [float(i * i) if i != 12 else None for i in range(30)]
    got = [r.v for r in smooth.savgol(frame(spark, values), ["k"], "z", "v", 7, 2).orderBy("z").collect()]
    for i, v in enumerate(got):
        start = max(0, min(i - 3, 23))
        assert (v is None) == (start <= 12 < start + 7)
        assert v is None or abs(v - i * i) < 1e-8


@pytest.mark.parametrize("spacing,step", [("p95", 3.7), ("median", 1.0), ("mean", 2.0), ("min", 1.0)])
def test_spacing_of_the_grid(spark, spacing, step):
    from plumbline.operators.resample import resample

    df = spark.createDataFrame([("a", z, z) for z in (0.0, 1.0, 2.0, 6.0)], SAMPLE)
    got = [r.z for r in resample(df, ["k"], "z", "v", "linear", spacing=spacing).orderBy("z").collect()]
    assert got[1] == pytest.approx(step)


def test_fence_can_be_switched_off(spark):
    from plumbline.plans.layout import lay

    df = frame(spark, [10.0, 10.1, 10.2, 10.1, 5.0])
    valid = lambda k: [r.is_valid for r in baseline.valid_samples(lay(df, ["k"], ["z"]), "v", F.lit(4.0), k).df.orderBy("z").collect()]
    assert valid(1.5) == [True] * 4 + [False] and valid(None) == [True] * 5


def test_rows_at_one_depth_have_one_order(spark):
    rows = [("a", 1.0, float(v)) for v in (5, 3, 4)] + [("a", 2.0, 2.0)]
    runs = [column(baseline.running_minimum(spark.createDataFrame(x, SAMPLE), ["k"], "z", "v"), "running_min") for x in (rows, rows[::-1])]
    assert sorted(runs[0]) == sorted(runs[1]) == [2.0, 3.0, 3.0, 3.0]


def test_pool_of_a_size_range(spark):
    df = spark.createDataFrame([("w", "savgol", "trial_1", n, [float(i) for i in range(n)]) for n in (1, 2, 3)],
                               "well_id string, smoothing string, trial string, n_breakpoints int, psis array<double>")
    assert {r.n_breakpoints for r in cluster.pool_breakpoints(df, ["well_id"], sizes=(2, 3)).collect()} == {2, 3}


def test_notes_without_text_open_no_entry(spark):
    rows = [("s", 1, "1", " sand. "), ("s", 2, "2", None), ("s", 3, None, "wet "), ("s", 4, "0.5", "clay"), ("s", 5, None, "  ")]
    df = spark.createDataFrame(rows, "sheet string, row_no int, depth_token string, note string")
    got = notes.merge_continuations(df, ["sheet"], replacements={"clay": "loam"}).orderBy("position").collect()
    assert [(r.entry, r.depth_top, r.note) for r in got] == [(2, 0.5, "loam"), (1, 1.0, "sand; wet")]


def test_lowess_with_vanishing_residuals_is_the_same_in_both_plans(spark):
    from plumbline.plans.layout import Layout

    df = frame(spark, [2.0 * i + (9.0 if i == 17 else 0.0) for i in range(40)])
    whole = column(smooth.lowess(df, ["k"], "z", "v", 0.2), "v")
    split = column(smooth.lowess(df, ["k"], "z", "v", 0.2, layout=Layout(True, 4, 12)), "v")
    assert split == pytest.approx(whole, abs=1e-6)
    assert whole[5] == pytest.approx(10.0, abs=1e-6)


@pytest.mark.parametrize("points,refused", [
    ([(0.0, 5.0), (5.0, 2.0)], True), ([(0.0, 2.0), (5.0, 5.0)], False),
    ([(0.0, 2.0), (5.0, 4.9), (8.0, 5.0)], True), ([(0.0, 2.0), (5.0, 2.1), (8.0, 5.0)], False)])
def test_an_upper_limit_rules_the_only_candidate_out(spark, points, refused):
    rows = [("s", i + 1, z, y) for i, (z, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "well_id string, bp_index int, depth_m double, log10_sec double")
    out = geometry.transition_zone(df, ["well_id"], bottom=100.0, top=1000.0).collect()
    assert {r.mz_status for r in out} == {"no_top_candidate" if refused else "ok"}
    assert sum(r.is_top_of_mixing for r in out) == (0 if refused else 1)
    assert sum(r.is_bottom_of_mixing for r in out) == (0 if refused else 1)


def test_resampled_values_equal_their_sql_before_rounding(spark):
    import duckdb
    from conftest import SF
    from plumbline.workload import casts, views

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    sql = views.with_views(["cast_samples"], casts.CLEAN + casts.PCHIP + "SELECT well_id, campaign, grid_index, g, sec FROM pc")
    grid, _ = casts._grid(spark, SF)
    got = {tuple(r) for r in grid.select("well_id", "campaign", "grid_index", "depth_m", "sec_us_cm").collect()}
    assert got == set(con.execute(sql).fetchall())


def test_blend_rounds_once(spark):
    import math

    from plumbline.functions.numeric import blend

    rows = [(0.1 * i, 0.37 * i * i + 0.01, (0.95 * i) % 1.0) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "a double, b double, s double")
    got = [r[0] for r in df.select(blend(F.col("a"), F.col("b"), F.col("s"))).collect()]
    assert sorted(got) == sorted(math.fma(a, 1 - s, b * s) for a, b, s in rows)

"""Plans for long profiles against plain Python: monotone fits, quantiles, local fits, interval cells, gap scans, the sweep's index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import certificate, cluster, converge, isotonic_long, lowess_long, smooth, sweep, sweep_long
from plumbline.plans import layout as plans
from plumbline.plans.layout import Layout, exact_quantiles


def shapes():
    rng = random.Random(4)
    return {
        "falling": [100.0 - i for i in range(90)], "rising": [float(i) for i in range(90)], "saw": [float(i % 15) for i in range(90)],
        "noise": [rng.gauss(0, 1) for _ in range(90)], "steps": [float(i // 20) + rng.choice([0.0, 0.5]) for i in range(90)],
        "same": [3.0] * 40, "one": [5.0], "valley": [abs(45.0 - i) for i in range(90)],
    }


@pytest.mark.parametrize("per_task", [7, 20, 400])
def test_monotone_fit_of_long_profiles(spark, per_task):
    rows = [(k, float(i // 3), v) for k, values in shapes().items() for i, v in enumerate(values)]  # three rows per depth
    df = spark.createDataFrame(rows, "k string, z double, v double").repartition(5)
    got = smooth.isotonic(df, ["k"], "z", "v", out="fit", layout=Layout(True, 1 + len(rows) // per_task, per_task))
    found = {}
    for r in got.orderBy("k", "z", "v").collect():
        found.setdefault(r.k, []).append((r.z, r.v, r.fit, r.was_changed))
    for k in shapes():
        mine = sorted((z, v) for name, z, v in rows if name == k)
        want = smooth.pool_adjacent([v for _, v in mine], [1.0] * len(mine))
        assert [x[:2] for x in found[k]] == mine
        assert [x[2] for x in found[k]] == pytest.approx(list(want), abs=1e-9)
        assert [x[3] for x in found[k]] == [abs(a - b) > 1e-9 for a, (_, b) in zip(want, mine)]


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    """Equal depths follow their values, whichever way the rows come."""
    rows = [("a", 1.0, 5.0), ("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 3.0, 9.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, z double, v double").coalesce(1)
        got = smooth.isotonic(df, ["k"], "z", "v", out="fit").orderBy("z", "v").collect()
        assert [r.fit for r in got] == [2.0, 4.0, 4.0, 9.0]
        near = smooth.lowess(df, ["k"], "z", "v", 1.0, out="fit").orderBy("z", "v").collect()
        assert [r.v for r in near] == [2.0, 5.0, 3.0, 9.0]


def test_narrowed_quantiles(spark, monkeypatch):
    """Brackets from coarse sketches: the exact ranks must still be found, also among equal values."""
    monkeypatch.setattr(plans, "ACCURACY", 60)
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1) for _ in range(2000)], "b": [float(rng.randint(0, 3)) for _ in range(1500)], "c": [7.0], "d": [1.0, 2.0],
              "e": [float(i) for i in range(61)] + [None] * 5, "f": [None, None], "g": [4.0] * 300 + [rng.random() for _ in range(300)]}
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, v double").repartition(4)
    fractions = {"low": 0.05, "q1": 0.25, "mid": 0.5, "q3": 0.75, "high": 0.99}
    wanted = {n: (F.col("v"), q) for n, q in fractions.items()} | {"double": (F.col("v") * 2, 0.5)}
    got = exact_quantiles(df, ["k"], wanted, Layout(True, 4, 10), [F.count("*").alias("n")])
    for r in got.collect():
        known = [v for v in groups[r.k] if v is not None]
        assert r.n == len(groups[r.k])
        for n, q in fractions.items():
            want = np.quantile(known, q) if known else None
            assert (r[n] is None) == (want is None) and (want is None or r[n] == pytest.approx(want, abs=1e-12))
        assert r.double is None if not known else r.double == pytest.approx(2 * np.quantile(known, 0.5))


@pytest.mark.parametrize("degree", [1, 2])
def test_power_sums_equal_direct_sums(monkeypatch, degree):
    rng = np.random.default_rng(1)
    for x in (np.sort(rng.uniform(0, 50, 700)), np.sort(np.concatenate([rng.uniform(0, 1, 350), rng.uniform(100, 101, 350)])),
              np.sort(np.round(rng.uniform(0, 40, 700))), np.sort(rng.exponential(1, 700) ** 3)):
        y = np.sin(x) + rng.normal(0, 0.1, len(x)) + 30
        for frac in (0.05, 0.4, 1.0):
            monkeypatch.setattr(smooth, "DIRECT", 10**9)
            want = smooth.lowess_values(x, y, frac, degree, 2)
            monkeypatch.setattr(smooth, "DIRECT", 4)
            assert smooth.lowess_values(x, y, frac, degree, 2) == pytest.approx(want, rel=1e-8)


def test_long_lowess_over_power_sums(spark, monkeypatch):
    monkeypatch.setattr(lowess_long, "DIRECT", 4)
    rng = np.random.default_rng(3)
    x, y = np.sort(rng.uniform(0, 9, 120)), rng.normal(0, 1, 120)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "k string, z double, v double")
    got = smooth.lowess(df, ["k"], "z", "v", 0.5, layout=Layout(True, 4, 31)).orderBy("z").collect()
    assert [r.v for r in got] == pytest.approx(list(smooth.lowess_values(x, y, 0.5)), rel=1e-8, abs=1e-10)


@pytest.mark.parametrize("rule", ["overlap", "center_distance", "hybrid"])
def test_interval_cells_find_every_pair(spark, rule):
    rng = random.Random(6)
    sizes = (0.0, 0.3, 1.0, 4.0, 17.0, 300.0, 10_000.0)
    clusters, zones = [], []
    for i in range(120):
        a = rng.uniform(-400, 400)
        clusters.append((rng.choice("ab"), i, a, a + rng.choice(sizes), a + rng.uniform(0, 1)))
        b = rng.choice([rng.uniform(-400, 400), float(rng.randint(-20, 20) * 16)])
        top = b + rng.choice(sizes)
        zones.append((rng.choice("ab"), i, b, top, (b + top) / 2, "mild", 1.0))
    left = spark.createDataFrame(clusters, "well_id string, cluster_id int, depth_min double, depth_max double, depth_median double")
    right = spark.createDataFrame(zones, "well_id string, zone_id int, z_bot double, z_top double, z_centre double, severity string, peak_excess_cm double")
    got = [(r.well_id, r.cluster_id, r.zone_id) for r in converge.find_matches(left, right, rule=rule, tolerance_m=0.5).collect()]
    want = set()
    for w, c, lo, hi, mid in clusters:
        for v, z, b, t, centre, _, _ in zones:
            shared, near = min(hi, t) - max(lo, b) > 0, abs(mid - centre) <= 0.5
            if w == v and {"overlap": shared, "center_distance": near, "hybrid": shared or near}[rule]:
                want.add((w, c, z))
    assert len(got) == len(set(got)) and set(got) == want


def test_a_long_interval_is_tens_of_rows(spark):
    one = spark.createDataFrame([("a", 0.7, 10_000.2), ("b", 3.0, 3.0)], "k string, lo double, hi double")
    got = {r.k: r["count"] for r in converge._in_cells(one, ["k"], "lo", "hi", 1.0, "own").groupBy("k").count().collect()}
    assert got["a"] < 120 and got["b"] <= 4


@pytest.mark.parametrize("layout", [Layout(False), Layout(True, 3, 20)])
def test_one_gap_scan_gives_the_tables_of_every_delta(spark, layout):
    rng = random.Random(8)
    rows = [(w, i, rng.choice(["savgol", "lowess"]), rng.randint(1, 4), round(rng.uniform(0, 12), 1)) for i in range(90) for w in ("a", "b")]
    rows += [("c", 1, "savgol", 1, 3.0)]
    df = spark.createDataFrame(rows, "well_id string, record_id int, smoothing string, n_breakpoints int, depth_bgl_m double")
    deltas = (1.0, 0.3, 0.1)
    got = cluster.robustness_sensitivity(df, ["well_id"], deltas, layout=layout)
    want = None
    for d in deltas:
        one = cluster.robustness(df, ["well_id"], d)
        want = one if want is None else want.unionByName(one)
    shape = lambda t: sorted((r.well_id, r.delta_m, r.cluster_id, *(round(x, 9) for x in (r.depth_median, r.depth_min, r.depth_max, r.depth_iqr)),
                              r.n_savgol, r.n_lowess, r.persistence, r.agreement, r.n_bp_total, r.wide_flag) for r in t.collect())
    assert shape(got) == shape(want)


# ---- the sweep's index and its proofs

X = np.linspace(0.0, 30.0, 400)
Y = 2.5 + 0.01 * X + 0.25 * np.maximum(0, X - 8) - 0.22 * np.maximum(0, X - 16) + np.random.default_rng(0).normal(0, 0.01, 400)


def profile(spark, n=1):
    rows = [("a", float(x), float(y)) for x, y in zip(np.linspace(0.0, 30.0, 400 * n), np.repeat(Y, n))]
    return spark.createDataFrame(rows, "well_id string, depth_m double, log10_sec double")


def test_index_answers_are_the_sums_beyond_a_breakpoint(spark, monkeypatch):
    monkeypatch.setattr(sweep_long, "BLOCK", 16)
    monkeypatch.setattr(sweep_long, "ENTRY", 4)
    rows = profile(spark).select("well_id", F.col("depth_m").alias("_x"), F.col("log10_sec").alias("_y"))
    scaled, scale = sweep_long._scaled(rows, ["well_id"], Layout(True, 3, 150))
    index = sweep_long.Index(scaled, ["well_id"], [(0, 0)])
    psi = [0.001, 0.31, 0.3125, 0.77, 0.999]
    task = scale.withColumns({"trial": F.lit("t"), "seed": F.lit(0), "n_breakpoints": F.lit(5), "restart": F.lit(0),
                              "psi": F.array(*[F.lit(p) for p in psi])})
    u = (X - X[0]) / (X[-1] - X[0])
    v = (Y - Y.mean()) / Y.std()
    names = ["well_id", *sweep_long.FIT, "restart"]
    for weighted in (False, True):
        parts = index.fetch(task, names, weighted).first()["parts"]
        held = sweep_long.Held(parts, 0, 0 if weighted else -1)
        weights = sweep.bootstrap_weights(400, 0, 0) if weighted else np.ones(400)
        want = sweep.tails_at(u, sweep.running_sums(u, v, weights), np.array([psi]))[0]
        assert held.moments(np.array(psi)) == pytest.approx(want, abs=1e-8)
        assert len(parts) <= len(psi) + 1 and max(len(p["u"]) for p in parts) <= 16
        assert held.moments(np.array([0.5])) is None


def test_rows_read_do_not_follow_the_length(spark, monkeypatch):
    monkeypatch.setattr(sweep_long, "BLOCK", 16)
    read = {}
    fetch = sweep_long.Index.fetch

    def watched(self, fits, names, weighted=False):
        found = fetch(self, fits, names, weighted).checkpoint()
        rows = found.select(F.explode("parts").alias("p")).agg(F.sum(F.size("p.u"))).first()[0]
        per_fit = rows / max(fits.count(), 1)
        read.setdefault(size, []).append(per_fit)
        return found

    monkeypatch.setattr(sweep_long.Index, "fetch", watched)
    for size in (1, 4):
        fits = sweep.sweep(profile(spark, size), ["well_id"], sizes=(2,), trials=1, restarts=2, layout=Layout(True, 4, 100))
        assert fits.first().converged
    assert max(read[1] + read[4]) <= 3 * 16


def test_certificates_hold_and_catch_wrong_fits(spark):
    df = profile(spark)
    fits = sweep.sweep(df, ["well_id"], sizes=(0, 1, 2, 3), trials=1, restarts=5)
    proved = certificate.certify(df, fits, ["well_id"]).collect()
    assert all(r.certified for r in proved) and sum(r.converged for r in proved) >= 3
    line = np.polyfit(X, Y, 1)
    assert proved[0].line_rss == pytest.approx(((Y - np.polyval(line, X)) ** 2).sum())
    solved = fits.where("converged AND n_breakpoints = 2")
    wrong = {
        "psis": F.transform("psis", lambda p: p + 0.5), "betas": F.transform("betas", lambda b: b * 1.001), "const": F.col("const") + 0.001,
        "rss": F.col("rss") * 1.01, "bic": F.col("bic") + 1, "alpha1": F.col("alpha1") - 0.001, "n_breakpoints": F.lit(3),
    }
    for column, value in wrong.items():
        assert not certificate.certify(df, solved.withColumn(column, value), ["well_id"]).first().certified, column
    lost = solved.withColumns({"converged": F.lit(False), "status": F.lit("unfit"), "rss": F.lit(None).cast("double"), "psis": F.lit(None).cast("array<double>")})
    assert not certificate.certify(df, lost, ["well_id"]).first().certified


def test_a_segment_of_one_row_is_no_fit():
    """Its breakpoint could be anywhere before the second row."""
    x, y = np.arange(10.0), np.array([5.0, 1, 2, 3, 4, 5, 6, 7, 8, 9])
    steps = sweep.muggeo_steps(sweep.tails_at(x / 9, sweep.running_sums(x / 9, y), np.array([[0.05], [0.5]])), np.array([[0.05], [0.5]]))
    assert steps["identified"].tolist() == [False, True]
    found = sweep.fit_size(x, y, 1, [0, 1], 5, 1e-5, 0.01)
    assert all(f["status"] != "ok" or f["psis"][0] >= 1.0 for f in found)

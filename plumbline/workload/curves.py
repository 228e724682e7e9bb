"""Curve queries: breakpoints, slopes, transition zones, saved fits, segments."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import estimate_of, hinge_value, settle
from plumbline.operators import catalogue, geometry, segments, sweep
from plumbline.workload.registry import query, r
from plumbline.workload.views import breakpoints, caliper_log, fits, sized, table

KEYS = ["well_id"]
C = "CAST({} AS DOUBLE)".format
LIMIT = 20_000.0


def layout_of(spark, sf):
    return sized(spark, sf, "breakpoints")


def settled(df, reals, others=()):
    return df.select(*others, *[settle(F.col(c)).alias(c) for c in reals])


CHORDS = """
ch AS (SELECT *, lead(depth_m) OVER w AS z1, lead(log10_sec) OVER w AS y1, pow(10, log10_sec) AS s0, pow(10, lead(log10_sec) OVER w) AS s1
  FROM breakpoints WINDOW w AS (PARTITION BY well_id ORDER BY bp_index))
"""


@query("win_13_chord_slopes", "WITH " + CHORDS.strip() + f"""
SELECT well_id, bp_index AS pair_idx, {r('depth_m')} AS depth_top, {r('z1')} AS depth_bottom, {r('(y1-log10_sec)/(z1-depth_m)')} AS slope_log10,
 {r('(s1-s0)/(z1-depth_m)', 5)} AS slope_linear_us_cm_per_m, CAST(sign(y1-log10_sec) AS INT) AS slope_sign, CASE WHEN z1 > depth_m THEN 'ok' ELSE 'not_ascending' END AS pair_status FROM ch WHERE z1 IS NOT NULL""", ["breakpoints"])
def chord_slopes(spark, sf):
    out = geometry.chord_slopes(breakpoints(spark, sf), KEYS, layout=layout_of(spark, sf))
    return out.select("well_id", "pair_idx", *[settle(F.col(c)).alias(c) for c in ("depth_top", "depth_bottom", "slope_log10")],
                      settle(F.col("slope_linear_us_cm_per_m"), 5).alias("slope_linear_us_cm_per_m"), "slope_sign", "pair_status")


def angle_sql(source, index, z, y, keys="well_id"):
    """CTE ang: rows of `source` with a (turning angle), n, and first and last flags."""
    w = f"PARTITION BY {keys} ORDER BY {index}"
    return f"""
sc AS (SELECT *, ({z} - min({z}) OVER k)/nullif(max({z}) OVER k - min({z}) OVER k, 0) AS sx, ({y} - min({y}) OVER k)/nullif(max({y}) OVER k - min({y}) OVER k, 0) AS sy,
  count(*) OVER k AS n, row_number() OVER (PARTITION BY {keys} ORDER BY {index}) AS rn FROM {source} WINDOW k AS (PARTITION BY {keys})),
uv AS (SELECT *, sx - lag(sx) OVER w AS ux, sy - lag(sy) OVER w AS uy, lead(sx) OVER w - sx AS vx, lead(sy) OVER w - sy AS vy FROM sc WINDOW w AS ({w})),
cosine AS (SELECT *, (ux*vx+uy*vy)/nullif(sqrt(ux*ux+uy*uy)*sqrt(vx*vx+vy*vy), 0) AS cv FROM uv),
ang AS (SELECT *, CASE WHEN cv IS NOT NULL THEN acos(greatest(-1, least(1, cv))) WHEN ux + uy + vx + vy IS NOT NULL THEN 0 END AS a FROM cosine)
"""


@query("win_14_turning_angles", "WITH " + angle_sql("breakpoints", "bp_index", "depth_m", "log10_sec").strip() + f"""
SELECT well_id, bp_index, {r('a', 5)} AS turning_angle FROM ang""", ["breakpoints"])
def turning_angles(spark, sf):
    out = geometry.turning_angles(breakpoints(spark, sf), KEYS, layout=layout_of(spark, sf))
    return out.select("well_id", "bp_index", settle(F.col("turning_angle"), 5).alias("turning_angle"))


def zone_sql(source, keys, bottom, top):
    """CTEs from `source` to mz (t, b, n, no: a lone candidate above `top`) and fl (flags and status of every point)."""
    value = "pow(10, log10_sec)"
    first = f"PARTITION BY {keys} ORDER BY a DESC, bp_index"
    return angle_sql(source, "bp_index", "depth_m", "log10_sec", keys).strip() + f""",
top AS (SELECT {keys}, bp_index AS t FROM (SELECT *, row_number() OVER ({first}) AS k FROM ang WHERE a IS NOT NULL AND {value} < {C(top)}) q WHERE k = 1),
bot AS (SELECT {keys}, bp_index AS b FROM (SELECT *, row_number() OVER ({first}) AS k FROM ang LEFT JOIN top USING ({keys})
  WHERE a IS NOT NULL AND {value} >= {C(bottom)} AND bp_index IS DISTINCT FROM t) q WHERE k = 1),
one AS (SELECT *, n = 2 AND rn = 1 OR n = 3 AND a IS NOT NULL AS lone FROM ang),
fin AS (SELECT {keys}, max(bp_index) FILTER (lone AND {value} < {C(top)}) AS o, bool_or(lone AND {value} >= {C(top)}) AS no,
  max(bp_index) FILTER (lone AND {value} >= {C(bottom)}) AS e, max(n) AS n, count(a) AS bent FROM one GROUP BY {keys}),
mz AS (SELECT {keys}, coalesce(o, t) AS t, CASE WHEN no THEN NULL WHEN o IS NULL THEN b ELSE e END AS b, n, no, bent
  FROM fin LEFT JOIN top USING ({keys}) LEFT JOIN bot USING ({keys})),
fl AS (SELECT p.*, coalesce(p.bp_index = t, false) AS is_top_of_mixing, coalesce(p.bp_index = b, false) AS is_bottom_of_mixing,
  CASE WHEN n < 2 THEN 'too_few_points' WHEN no OR t IS NULL AND bent > 0 THEN 'no_top_candidate'
       WHEN b IS NULL THEN 'no_bottom_candidate' ELSE 'ok' END AS mz_status FROM {source} p JOIN mz USING ({keys}))
"""


ZONE = "WITH " + zone_sql("breakpoints", "well_id", LIMIT, 150_000)


def _flags(spark, sf):
    return geometry.transition_zone(breakpoints(spark, sf), KEYS, bottom=LIMIT, top=150_000.0, layout=layout_of(spark, sf))


@query("win_15_transition_zone", ZONE + "SELECT well_id, bp_index, is_top_of_mixing, is_bottom_of_mixing, mz_status FROM fl", ["breakpoints"])
def transition_zone(spark, sf):
    return _flags(spark, sf).select("well_id", "bp_index", "is_top_of_mixing", "is_bottom_of_mixing", "mz_status")


#: Limits that some points pass and some do not: 10**log10_sec lies between 316 and 63,000.
SHORT_BOTTOM, SHORT_TOP = 1_000.0, 3_000.0


def _short(points):
    """Profiles of three points and what is left over: every point of every well, in pieces."""
    return points.withColumn("piece", F.floor((F.col("bp_index") - 1) / 3).cast("int"))


@query("win_15_short_profiles", "WITH pieces AS (SELECT *, (bp_index - 1) // 3 AS piece FROM breakpoints)," + zone_sql(
    "pieces", "well_id, piece", SHORT_BOTTOM, SHORT_TOP) + """
SELECT well_id, piece, bp_index, is_top_of_mixing, is_bottom_of_mixing, mz_status FROM fl""", ["breakpoints"])
def short_zones(spark, sf):
    """One, two and three points per profile under an upper limit of TOP."""
    rows = _short(breakpoints(spark, sf))
    out = geometry.transition_zone(rows, ["well_id", "piece"], bottom=SHORT_BOTTOM, top=SHORT_TOP, layout=layout_of(spark, sf))
    return out.select("well_id", "piece", "bp_index", "is_top_of_mixing", "is_bottom_of_mixing", "mz_status")


@query("win_15_upper_limit", "WITH " + zone_sql("breakpoints", "well_id", LIMIT, SHORT_TOP) + """
SELECT well_id, bp_index, is_top_of_mixing, is_bottom_of_mixing, mz_status FROM fl""", ["breakpoints"])
def limited_zones(spark, sf):
    """Whole profiles under an upper limit of TOP that rules points out."""
    out = geometry.transition_zone(breakpoints(spark, sf), KEYS, bottom=LIMIT, top=SHORT_TOP, layout=layout_of(spark, sf))
    return out.select("well_id", "bp_index", "is_top_of_mixing", "is_bottom_of_mixing", "mz_status")


@query("win_16_promoted_flags", ZONE + """
SELECT well_id, bp_index, is_top_of_mixing AND bp_index < n AS is_top_of_mixing, is_bottom_of_mixing AND bp_index < n AS is_bottom_of_mixing FROM fl JOIN (SELECT well_id, n FROM mz) q USING (well_id)""", ["breakpoints"])
def promoted_flags(spark, sf):
    points = breakpoints(spark, sf)
    pairs = geometry.flag_pairs(points, KEYS, bottom=LIMIT, top=150_000.0, layout=layout_of(spark, sf))
    out = geometry.promote_pair_flags(points, pairs, KEYS)
    return out.select("well_id", "bp_index", "is_top_of_mixing", "is_bottom_of_mixing")


@query("win_18_elbow", f"""
WITH f AS (SELECT well_id, trial, n_breakpoints AS n, bic FROM fits WHERE bic IS NOT NULL),
e AS (SELECT well_id, trial, min(n) AS n0, max(n) AS n9, arg_min(bic, n) AS b0, arg_max(bic, n) AS b9 FROM f GROUP BY well_id, trial),
d AS (SELECT f.*, coalesce(abs((n9-n0)*(bic-b0) - (b9-b0)*(n-n0))/nullif(sqrt((n9-n0)*(n9-n0) + (b9-b0)*(b9-b0)), 0), 0) AS dist FROM f JOIN e USING (well_id, trial))
SELECT well_id, trial, n AS elbow, {r('dist')} AS elbow_distance FROM (SELECT *, row_number() OVER (PARTITION BY well_id, trial ORDER BY dist DESC, n) AS k FROM d) t WHERE k = 1""", ["fits"])
def elbow(spark, sf):
    return settled(geometry.elbow(fits(spark, sf), ["well_id", "trial"], "bic"), ["elbow_distance"], ["well_id", "trial", "elbow"])


@query("win_19_delta_bic", f"""
WITH u AS (SELECT well_id, trial, n_breakpoints AS n, bic FROM fits WHERE bic IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY well_id, trial ORDER BY bic, n) AS k FROM u)
SELECT b.well_id, b.trial, b.n AS n_opt, {r('u.bic - b.bic')} AS delta_bic FROM b LEFT JOIN u ON u.well_id = b.well_id AND u.trial = b.trial AND u.n = b.n + 1 WHERE k = 1""", ["fits"])
def delta_bic(spark, sf):
    from plumbline.operators.cluster import bic_summary

    return settled(bic_summary(fits(spark, sf), ["well_id", "trial"]), ["delta_bic"], ["well_id", "trial", "n_opt"])


def model_sql(x, psis="psis", betas="betas"):
    return (
        f"const + alpha1*({x}) + coalesce(list_sum(list_transform(range(1, len({psis})+1), "
        f"lambda q: {betas}[q]*greatest(({x}) - {psis}[q], 0))), 0)"
    )


@query("prj_10_hinge_model", f"""
SELECT well_id, trial, n_breakpoints, {r(model_sql(C(4)))} AS y_at_4, {r(f'pow(10, {model_sql(C(2.5))})', 4)} AS sec_at_2_5 FROM fits""", ["fits"])
def hinge_model(spark, sf):
    at = lambda x: hinge_value(F.lit(x), F.col("const"), F.col("alpha1"), F.col("betas"), F.col("psis"))
    return fits(spark, sf).select(
        "well_id", "trial", "n_breakpoints", settle(at(4.0)).alias("y_at_4"),
        settle(F.pow(F.lit(10.0), at(2.5)), 4).alias("sec_at_2_5"),
    )


@query("prj_11_estimates", f"""
SELECT well_id, trial, n_breakpoints, {r('const')} AS const, {r('psis[2]')} AS second_position, {r('ci_high[2]')} AS second_ci_high,
 {r('list_sum(psis)', 5)} AS position_sum, {r('list_sum(betas)', 5)} AS beta_sum FROM fits WHERE converged""", ["fits"])
def estimates(spark, sf):
    mapped = sweep.with_estimates(fits(spark, sf).where("converged")).drop("const", "alpha1", "psis", "betas", "ci_low", "ci_high")
    out = segments.unpack_estimates(mapped)
    total = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, v: s + v))
    return out.select(
        "well_id", "trial", "n_breakpoints", settle(F.col("const")).alias("const"),
        settle(estimate_of(F.col("estimates"), "breakpoint2")).alias("second_position"),
        settle(F.try_element_at("ci_high", F.lit(2))).alias("second_ci_high"),
        settle(total("psis"), 5).alias("position_sum"), settle(total("betas"), 5).alias("beta_sum"),
    )


@query("bps_02_seed_discovery", f"""
WITH g AS (SELECT well_id, n_breakpoints, min(seed) AS s0, max(seed) AS s9, min(seed) FILTER (converged) AS seed_used, arg_min(rss, seed) FILTER (converged) AS rss FROM fits GROUP BY well_id, n_breakpoints)
SELECT well_id, n_breakpoints, seed_used, {r('rss')} AS rss, CAST(coalesce(seed_used, s9) - s0 + 1 AS INT) AS n_tried, CASE WHEN seed_used IS NULL THEN 'no_convergence' ELSE 'ok' END AS status FROM g""", ["fits"])
def seed_discovery(spark, sf):
    out = sweep.discover_seed(fits(spark, sf), KEYS)
    return out.select("well_id", "n_breakpoints", "seed_used", settle(F.col("rss")).alias("rss"),
                      F.size("seeds_tried").alias("n_tried"), "status")


EXPLODED = """
ex AS (SELECT *, unnest(range(1, n_breakpoints+1)) AS p FROM fits)
"""


@query("bps_03_breakpoint_rows", "WITH " + EXPLODED.strip() + f"""
SELECT well_id, trial, n_breakpoints, CAST(p AS INT) AS bp_index, {r('psis[p]')} AS x_position, {r(model_sql('psis[p]'))} AS y_position, {r('ci_low[p]')} AS ci_lower, {r('ci_high[p]')} AS ci_upper FROM ex""", ["fits"])
def breakpoint_rows(spark, sf):
    out = segments.breakpoint_rows(fits(spark, sf), KEYS, ("trial", "n_breakpoints"))
    return settled(out, ["x_position", "y_position", "ci_lower", "ci_upper"], ["well_id", "trial", "n_breakpoints", "bp_index"])


@query("bps_04_breakpoints_at_size", f"""
WITH pick AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY bic, trial) AS k FROM fits WHERE n_breakpoints = 2 AND bic IS NOT NULL),
ex AS (SELECT *, unnest(range(1, 3)) AS p FROM pick WHERE k = 1),
v AS (SELECT concat('S', CAST(c_custkey AS VARCHAR)) AS well_id, {C(1)} + {C(0.25)}*(c_custkey % 8) AS vadose_m FROM customer WHERE c_acctbal > 0)
SELECT well_id, trial, CAST(p AS INT) AS bp_index, {r('psis[p]')} AS depth_m, {r(model_sql('psis[p]'))} AS log10_sec, {r('ci_high[p]-ci_low[p]')} AS ci_width,
 {r('psis[p]+vadose_m')} AS depth_bgl_m, {r('bic')} AS bic FROM ex LEFT JOIN v USING (well_id)""", ["fits"])
def breakpoints_at_size(spark, sf):
    offsets = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("well_id"),
        (1.0 + 0.25 * (F.col("c_custkey") % 8)).alias("vadose_m"),
    )
    out = segments.breakpoints_at(fits(spark, sf), KEYS, 2, "best_bic", offsets)
    return settled(out, ["depth_m", "log10_sec", "ci_width", "depth_bgl_m", "bic"], ["well_id", "trial", F.col("bp_index").cast("int").alias("bp_index")])


@query("bps_05_best_trial", f"""
SELECT well_id, n_breakpoints, trial, {r('bic')} AS bic FROM (SELECT *, row_number() OVER (PARTITION BY well_id, n_breakpoints ORDER BY bic, trial) AS k FROM fits WHERE bic IS NOT NULL) t WHERE k = 1""", ["fits"])
def best_trial(spark, sf):
    return settled(segments.best_trial_for_size(fits(spark, sf), KEYS), ["bic"], ["well_id", "n_breakpoints", "trial"])


@query("bps_06_metric_curve", f"SELECT well_id, trial, n_breakpoints, {r('bic')} AS bic, {r('rss')} AS rss, converged FROM fits", ["fits"])
def metric_curve(spark, sf):
    return settled(segments.metric_curve(fits(spark, sf), KEYS), ["bic", "rss"], ["well_id", "trial", "n_breakpoints", "converged"])


def elbow_sql(metric, name):
    return f"""
{name}_e AS (SELECT well_id, trial, min(n_breakpoints) AS n0, max(n_breakpoints) AS n9, arg_min({metric}, n_breakpoints) AS b0, arg_max({metric}, n_breakpoints) AS b9 FROM fits WHERE {metric} IS NOT NULL GROUP BY well_id, trial),
{name}_d AS (SELECT f.well_id, f.trial, n_breakpoints AS n, coalesce(abs((n9-n0)*({metric}-b0) - (b9-b0)*(n_breakpoints-n0))/nullif(sqrt((n9-n0)*(n9-n0) + (b9-b0)*(b9-b0)), 0), 0) AS dist
  FROM fits f JOIN {name}_e e ON f.well_id = e.well_id AND f.trial = e.trial WHERE {metric} IS NOT NULL),
{name} AS (SELECT well_id, trial, n AS elbow FROM (SELECT *, row_number() OVER (PARTITION BY well_id, trial ORDER BY dist DESC, n) AS k FROM {name}_d) t WHERE k = 1)"""


@query("bps_08_select_trial", "WITH " + elbow_sql("bic", "bend").strip() + f""",
votes AS (SELECT well_id, elbow, count(*) AS votes, min(trial) AS first FROM bend GROUP BY well_id, elbow),
modal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY votes DESC, first) AS k FROM votes) t WHERE k = 1),
means AS (SELECT well_id, trial, avg(bic) AS m FROM fits GROUP BY well_id, trial)
SELECT well_id, elbow, votes, trial, {r('m')} AS mean_metric FROM (SELECT b.well_id, b.elbow, votes, b.trial, m, row_number() OVER (PARTITION BY b.well_id ORDER BY m, b.trial) AS k
 FROM bend b JOIN modal ON b.well_id = modal.well_id AND b.elbow = modal.elbow JOIN means ON means.well_id = b.well_id AND means.trial = b.trial) t WHERE k = 1""", ["fits"])
def select_trial(spark, sf):
    return settled(segments.select_trial(fits(spark, sf), KEYS), ["mean_metric"], ["well_id", "elbow", "votes", "trial"])


@query("bps_09_trial_optima", "WITH " + elbow_sql("bic", "eb").strip() + "," + elbow_sql("rss", "er") + """,
lo AS (SELECT well_id, trial, n_breakpoints AS n FROM (SELECT *, row_number() OVER (PARTITION BY well_id, trial ORDER BY bic, n_breakpoints) AS k FROM fits WHERE bic IS NOT NULL) t WHERE k = 1)
SELECT lo.well_id, lo.trial, n AS min_bic_n, eb.elbow AS best_n_bic, er.elbow AS best_n_rss FROM lo LEFT JOIN eb USING (well_id, trial) LEFT JOIN er USING (well_id, trial)""", ["fits"])
def trial_optima(spark, sf):
    return segments.trial_optima(fits(spark, sf), KEYS)


# The saved fit of the smallest BIC of every well against the width log of that well.
BEST = """best AS (SELECT well_id, n_breakpoints AS size, const, alpha1, betas, psis FROM (
  SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY bic, n_breakpoints, trial) AS k FROM fits WHERE converged AND bic IS NOT NULL) t WHERE k = 1)"""
SAMPLES = f"""
WITH {BEST},
sm AS (SELECT c.well_id, 2 + 2*size AS p, depth_m AS x, caliper_cm AS y, CASE WHEN psis IS NOT NULL THEN CAST(1 + len(list_filter(psis, lambda p: depth_m > p)) AS INT) END AS segment, {model_sql('depth_m')} AS yhat FROM caliper_log c LEFT JOIN best USING (well_id))
"""


def _best_fit(spark, sf):
    row = F.struct(F.col("n_breakpoints").alias("size"), "const", "alpha1", "betas", "psis")
    found = fits(spark, sf).where("converged and bic is not null").groupBy("well_id").agg(
        F.min_by(row, F.struct("bic", "n_breakpoints", "trial")).alias("best")
    )
    return found.select("well_id", "best.*")


def _samples(spark, sf):
    return caliper_log(spark, sf).select("well_id", "seq", "depth_m", "caliper_cm")


@query("bps_10_global_metrics", SAMPLES + f""",
q AS (SELECT well_id, sum((y-yhat)*(y-yhat)) AS rss, sum((y-my)*(y-my)) AS tss, count(*) AS n, max(p) AS p FROM (SELECT *, avg(y) OVER (PARTITION BY well_id) AS my FROM sm) t GROUP BY well_id)
SELECT well_id, n, {r('rss', 4)} AS rss, {r('tss', 4)} AS tss, {r('1 - rss/nullif(tss,0)')} AS r2, {r(f'1 - (rss/nullif(tss,0))*({C(1)}*(n-1))/(n-p-1)')} AS r2_adjusted FROM q WHERE rss IS NOT NULL""", ["caliper_log", "fits"])
def global_metrics(spark, sf):
    rows = _samples(spark, sf).join(_best_fit(spark, sf), "well_id").withColumns({
        "yhat": hinge_value(F.col("depth_m"), F.col("const"), F.col("alpha1"), F.col("betas"), F.col("psis")),
        "predictors": 2 + 2 * F.col("size"),
    })
    out = segments.global_metrics(rows, KEYS, "caliper_cm", "yhat", "predictors")
    return out.select("well_id", "n", settle(F.col("rss"), 4).alias("rss"), settle(F.col("tss"), 4).alias("tss"),
                      settle(F.col("r2")).alias("r2"), settle(F.col("r2_adjusted")).alias("r2_adjusted"))


@query("bps_12_assigned_segments", SAMPLES + f"SELECT well_id, {r('x')} AS depth_m, segment FROM sm", ["caliper_log", "fits"])
def assigned_segments(spark, sf):
    out = segments.assign_segments(_samples(spark, sf), _best_fit(spark, sf), KEYS)
    return out.select("well_id", settle(F.col("depth_m")).alias("depth_m"), "segment")


@query("bps_13_segment_regressions", SAMPLES + f""",
ln AS (SELECT well_id, segment, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept, avg(y) AS my, max(y)-min(y) AS rg FROM sm WHERE segment IS NOT NULL GROUP BY well_id, segment),
rs AS (SELECT sm.*, slope, icept, my, rg, y - (slope*x + icept) AS e FROM sm JOIN ln USING (well_id, segment))
SELECT well_id, segment, count(*) AS n, {r('max(slope)', 5)} AS slope, {r('max(icept)', 5)} AS intercept, {r('sqrt(avg(e*e))')} AS rms, {r('100*sqrt(avg(e*e))/nullif(max(rg),0)', 5)} AS rms_pct_range,
 {r('100*sqrt(avg((e/nullif(y,0))*(e/nullif(y,0))))', 5)} AS rms_pct_value, {r('1 - sum(e*e)/nullif(sum((y-my)*(y-my)),0)', 5)} AS r2 FROM rs GROUP BY well_id, segment""", ["caliper_log", "fits"])
def segment_regressions(spark, sf):
    cut = segments.assign_segments(_samples(spark, sf), _best_fit(spark, sf), KEYS)
    out = segments.segment_regressions(cut, KEYS, "depth_m", "caliper_cm")
    five = [settle(F.col(c), 5).alias(c) for c in ("slope", "intercept", "rms_pct_range", "rms_pct_value", "r2")]
    return out.select("well_id", "segment", "n", settle(F.col("rms")).alias("rms"), *five)


@query("bps_14_model_segments", f"""
WITH ex AS (SELECT *, list_concat([{C(0)}], psis, [{C(30)}]) AS cuts, unnest(range(1, len(psis)+2)) AS s FROM fits WHERE converged)
SELECT well_id, trial, n_breakpoints, CAST(s AS INT) AS segment, {r('cuts[s]')} AS x_start, {r('cuts[s+1]')} AS x_end, {r('alpha1 + coalesce(list_sum(betas[1:s-1]), 0)')} AS slope,
 {r(model_sql('cuts[s]'))} AS y_start, {r(model_sql('cuts[s+1]'))} AS y_end FROM ex""", ["fits"])
def model_segments(spark, sf):
    rows = fits(spark, sf).where("converged").withColumns({"x_min": F.lit(0.0), "x_max": F.lit(30.0)})
    keys = ["well_id", "trial", "n_breakpoints"]
    return settled(segments.model_segments(rows, keys), ["x_start", "x_end", "slope", "y_start", "y_end"], [*keys, "segment"])


@query("bps_15_model_quality", SAMPLES + f""",
rs AS (SELECT *, y - yhat AS e, avg(y) OVER (PARTITION BY well_id, segment) AS my, max(y) OVER (PARTITION BY well_id, segment) - min(y) OVER (PARTITION BY well_id, segment) AS rg FROM sm WHERE segment IS NOT NULL)
SELECT well_id, segment, count(*) AS n, {r('100*sqrt(avg(e*e))/nullif(max(rg),0)', 4)} AS rms_pct_range, {r('1 - sum(e*e)/nullif(sum((y-my)*(y-my)),0)', 3)} AS r2 FROM rs GROUP BY well_id, segment""", ["caliper_log", "fits"])
def model_quality(spark, sf):
    out = segments.model_quality_per_segment(_samples(spark, sf), _best_fit(spark, sf), KEYS, "depth_m", "caliper_cm")
    return out.select("well_id", "segment", "n", settle(F.col("rms_pct_range"), 4).alias("rms_pct_range"), settle(F.col("r2"), 3).alias("r2"))


@query("bps_16_trial_comparison", f"""
WITH t AS (SELECT well_id, trial, bic, psis[1] AS p0, psis[3] AS p9 FROM fits WHERE n_breakpoints = 3)
SELECT well_id, count(*) AS n_trials, {r('min(bic)')} AS bic_min, {r('max(bic)')} AS bic_max, {r('max(p0)-min(p0)')} AS first_spread, {r('max(p9)-min(p9)')} AS last_spread FROM t GROUP BY well_id""", ["fits"])
def trial_comparison(spark, sf):
    out = segments.trial_agreement(fits(spark, sf), KEYS, 3)
    return settled(out, ["bic_min", "bic_max", "first_spread", "last_spread"], ["well_id", "n_trials"])


# Jobs: one per user; every third brings its own lower limit, the rest inherit the root's.
JOBS = f"""
jobs AS (SELECT concat('W', CAST(user_id // 4 AS VARCHAR), chr(CAST(65 + user_id % 4 AS INT))) AS well_id, CASE WHEN user_id % 3 = 0 THEN {C(10000)} END AS own FROM (SELECT DISTINCT user_id FROM events) u)
"""


def _jobs(spark, sf):
    user = F.col("user_id")
    return table(spark, sf, "events").select("user_id").distinct().select(
        F.concat(F.lit("W"), F.floor(user / 4).cast("string"), F.char(user % 4 + 65)).alias("well_id"),
        F.when(user % 3 == 0, 10_000.0).alias("bottom"), F.lit(None).cast("double").alias("top"),
        F.lit(None).cast("string").alias("trial"),
    )


@query("src_19_job_settings", "WITH " + JOBS.strip() + f"SELECT well_id, coalesce(own, {C(LIMIT)}) AS bottom, {C(150000)} AS top, 'trial_1' AS trial FROM jobs")
def job_settings(spark, sf):
    return catalogue.job_settings(_jobs(spark, sf), {"bottom": LIMIT}, {"bottom": 40_000.0, "top": 150_000.0, "trial": "trial_1"})


@query("bps_17_job_slopes", "WITH " + JOBS.strip() + "," + angle_sql("breakpoints", "bp_index", "depth_m", "log10_sec") + f""",
lim AS (SELECT well_id, coalesce(own, {C(LIMIT)}) AS lower FROM jobs),
top AS (SELECT well_id, bp_index AS t FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY a DESC, bp_index) AS k FROM ang WHERE a IS NOT NULL) q WHERE k = 1),
bot AS (SELECT well_id, bp_index AS b FROM (SELECT ang.*, row_number() OVER (PARTITION BY ang.well_id ORDER BY a DESC, bp_index) AS k FROM ang JOIN lim USING (well_id) LEFT JOIN top USING (well_id)
  WHERE a IS NOT NULL AND pow(10, log10_sec) >= lower AND bp_index IS DISTINCT FROM t) q WHERE k = 1),
one AS (SELECT ang.*, lower, n = 2 AND rn = 1 OR n = 3 AND a IS NOT NULL AS lone FROM ang JOIN lim USING (well_id)),
fin AS (SELECT well_id, max(bp_index) FILTER (lone) AS o, max(bp_index) FILTER (lone AND pow(10, log10_sec) >= lower) AS e, count(*) AS n FROM one GROUP BY well_id)
SELECT lim.well_id, coalesce(n, 0) AS n_points, coalesce(o, t) AS top_index, CASE WHEN o IS NULL THEN b ELSE e END AS bottom_index FROM lim LEFT JOIN fin USING (well_id) LEFT JOIN top USING (well_id) LEFT JOIN bot USING (well_id)""", ["breakpoints"])
def job_slopes(spark, sf):
    jobs = catalogue.job_settings(_jobs(spark, sf), {"bottom": LIMIT}, {"bottom": 40_000.0})
    rows = breakpoints(spark, sf).join(jobs.select("well_id", F.col("bottom").alias("lower")), "well_id")
    flagged = geometry.transition_zone(rows, KEYS, bottom=F.col("lower"), layout=layout_of(spark, sf))
    found = flagged.groupBy("well_id").agg(
        F.count("*").alias("n_points"),
        F.max(F.when(F.col("is_top_of_mixing"), F.col("bp_index"))).alias("top_index"),
        F.max(F.when(F.col("is_bottom_of_mixing"), F.col("bp_index"))).alias("bottom_index"),
    )
    return jobs.select("well_id").join(found, "well_id", "left").fillna(0, ["n_points"])


@query("bps_17_upper_limit", "WITH " + JOBS.strip() + f""",
pieces AS (SELECT b.*, (bp_index - 1) // 3 AS piece, coalesce(own, {C(LIMIT)}) AS lower FROM breakpoints b JOIN jobs USING (well_id)),
""" + zone_sql("pieces", "well_id, piece", "lower", SHORT_TOP).replace("CAST(lower AS DOUBLE)", "lower") + """
SELECT well_id, piece, count(*) AS n_points, max(bp_index) FILTER (is_top_of_mixing) AS top_index,
  max(bp_index) FILTER (is_bottom_of_mixing) AS bottom_index, max(mz_status) AS mz_status FROM fl GROUP BY well_id, piece""", ["breakpoints"])
def limited_job_slopes(spark, sf):
    """Jobs whose settings carry an upper limit of TOP, over short profiles."""
    jobs = catalogue.job_settings(_jobs(spark, sf), {"bottom": LIMIT, "top": SHORT_TOP}, {"bottom": 40_000.0, "top": 150_000.0})
    limits = jobs.select("well_id", F.col("bottom").alias("lower"), F.col("top").alias("upper"))
    rows = _short(breakpoints(spark, sf)).join(limits, "well_id")
    flagged = geometry.transition_zone(rows, ["well_id", "piece"], bottom=F.col("lower"), top=F.col("upper"), layout=layout_of(spark, sf))
    return flagged.groupBy("well_id", "piece").agg(
        F.count("*").alias("n_points"),
        F.max(F.when(F.col("is_top_of_mixing"), F.col("bp_index"))).alias("top_index"),
        F.max(F.when(F.col("is_bottom_of_mixing"), F.col("bp_index"))).alias("bottom_index"), F.max("mz_status").alias("mz_status"),
    )


@query("bps_18_canonical_summary", ZONE + f"""
SELECT fl.well_id, fl.bp_index, {r('p.depth_m')} AS depth_wt_m, {r(f"p.depth_m + {C(2)} + {C(0.5)}*length(fl.well_id)")} AS depth_bgl_m,
 is_top_of_mixing AND fl.bp_index < mz.n AS is_top_of_mixing, is_bottom_of_mixing AND fl.bp_index < mz.n AS is_bottom_of_mixing, CASE WHEN mz.n > 1 THEN 'ok' ELSE 'artefacts_differ' END AS check_status
FROM fl JOIN breakpoints p ON fl.well_id = p.well_id AND fl.bp_index = p.bp_index JOIN mz ON mz.well_id = fl.well_id""", ["breakpoints"])
def canonical_summary(spark, sf):
    points = breakpoints(spark, sf)
    pairs = geometry.flag_pairs(points, KEYS, bottom=LIMIT, top=150_000.0, layout=layout_of(spark, sf))
    offsets = points.select("well_id").distinct().withColumn("vadose_m", F.lit(2.0) + 0.5 * F.length("well_id"))
    out = segments.breakpoint_summary(points, pairs, offsets, KEYS, KEYS)
    return settled(out, ["depth_wt_m", "depth_bgl_m"], ["well_id", "bp_index", "is_top_of_mixing", "is_bottom_of_mixing", "check_status"])

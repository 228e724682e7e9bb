"""Width-log queries: sources, noise, baselines, detection."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import settle
from plumbline.operators import baseline, detect, noise
from plumbline.sources import readers
from plumbline.workload.registry import query, r
from plumbline.workload.shared_sql import hermite, pchip_knots
from plumbline.workload.views import caliper_log, sized, stored, table

KEYS = ["well_id"]


def auger_floor():
    return F.col("auger_in") * F.lit(baseline.INCH_CM)


RULE = detect.DetectionRule()


def layout_of(spark, sf):
    return sized(spark, sf, "caliper_log")


# Shared SQL: validity, zones and running minimum per zone (x: rows, b: baselines).
FLAGGED = f"""
WITH fences AS (SELECT well_id, quantile_cont(caliper_cm, 0.25) AS q1, quantile_cont(caliper_cm, 0.75) AS q3
  FROM caliper_log WHERE caliper_cm >= auger_in*CAST(2.54 AS DOUBLE) GROUP BY well_id),
x AS (SELECT c.*, coalesce(caliper_cm >= auger_in*CAST(2.54 AS DOUBLE) AND caliper_cm >= q1 - CAST(1.5 AS DOUBLE)*(q3-q1), false) AS is_valid,
  CASE WHEN depth_m < trim_depth_m THEN 'shallow' ELSE 'deep' END AS zone FROM caliper_log c LEFT JOIN fences f USING (well_id)),
good AS (SELECT well_id, zone FROM x WHERE is_valid GROUP BY well_id, zone HAVING count(*) >= 2),
y AS (SELECT x.*, CASE WHEN good.zone IS NULL THEN 'excluded' ELSE x.zone END AS zone_label,
  CASE WHEN is_valid AND good.zone IS NOT NULL THEN caliper_cm END AS v FROM x LEFT JOIN good ON x.well_id = good.well_id AND x.zone = good.zone),
m AS (SELECT *, min(v) OVER (PARTITION BY well_id, zone ORDER BY depth_m) AS cm,
  min(v) OVER (PARTITION BY well_id, zone ORDER BY depth_m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM y),
knots AS (SELECT well_id, zone, depth_m AS ax, v AS ay FROM m WHERE v IS NOT NULL AND (pm IS NULL OR v < pm)),
lo AS (SELECT m.*, k.ax AS x0, k.ay AS y0 FROM m ASOF LEFT JOIN knots k ON m.well_id = k.well_id AND m.zone = k.zone AND m.depth_m >= k.ax),
hi AS (SELECT lo.*, k.ax AS x1, k.ay AS y1 FROM lo ASOF LEFT JOIN knots k ON lo.well_id = k.well_id AND lo.zone = k.zone AND lo.depth_m <= k.ax),
b AS (SELECT *, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x1 = x0 THEN y0
   ELSE y0 + (y1-y0)*(depth_m-x0)/(x1-x0) END AS baseline_cm FROM hi),
t AS (SELECT *, baseline_cm + CAST(0.5 AS DOUBLE) + CAST({RULE.k_sigma * RULE.sigma_inst_cm!r} AS DOUBLE) AS threshold_cm,
   caliper_cm - (baseline_cm + CAST(0.5 AS DOUBLE)) AS excess_cm FROM b),
d AS (SELECT *, coalesce(caliper_cm > threshold_cm, false) AS is_anomaly FROM t),
s AS (SELECT *, CASE WHEN NOT is_anomaly THEN 'none' WHEN caliper_cm >= 30 THEN 'severe' WHEN excess_cm < 2 THEN 'mild'
   WHEN excess_cm < 5 THEN 'moderate' ELSE 'severe' END AS severity_per_sample FROM d)
"""

ZONE_SQL = FLAGGED + """,
dz AS (SELECT well_id, quantile_cont(g, 0.5) AS dz FROM (SELECT well_id, lead(depth_m) OVER (PARTITION BY well_id ORDER BY depth_m) - depth_m AS g FROM s) GROUP BY well_id),
isl AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY depth_m) - row_number() OVER (PARTITION BY well_id, is_anomaly ORDER BY depth_m) AS g FROM s),
runs AS (SELECT well_id, g, min(depth_m) AS lo_z, max(depth_m) AS hi_z, max(caliper_cm) AS peak_cm, count(*) AS n_points,
   count(*) FILTER (caliper_cm >= 30) AS n_saturated, count(*) FILTER (severity_per_sample='mild') AS n_pp_mild,
   count(*) FILTER (severity_per_sample='moderate') AS n_pp_moderate, count(*) FILTER (severity_per_sample='severe') AS n_pp_severe,
   string_agg(DISTINCT zone_label, '+' ORDER BY zone_label) AS sub_zone, max(auger_in)*CAST(2.54 AS DOUBLE) AS nominal FROM isl WHERE is_anomaly GROUP BY well_id, g),
z AS (SELECT runs.*, pk.baseline_cm AS pb, pk.threshold_cm AS pt FROM runs JOIN dz USING (well_id) JOIN LATERAL (
   SELECT baseline_cm, threshold_cm FROM isl i WHERE i.well_id = runs.well_id AND i.g = runs.g AND i.is_anomaly AND i.caliper_cm = runs.peak_cm ORDER BY depth_m LIMIT 1) pk ON true
   WHERE n_points >= greatest(1, round_even(CAST(0.05 AS DOUBLE)/dz, 0)))
"""


def _flagged(spark, sf):
    return detect.analyse_logs(caliper_log(spark, sf), KEYS, RULE, layout=layout_of(spark, sf))


@query("cal_06_zone_table", ZONE_SQL + f"""
SELECT well_id, {r('lo_z')} AS depth_shallow, {r('hi_z')} AS depth_deep, {r('peak_cm')} AS peak_cm, {r('pb')} AS baseline_at_peak_cm,
 {r('peak_cm - pb')} AS peak_excess_cm, {r('peak_cm - pb - CAST(0.5 AS DOUBLE)')} AS peak_excess_over_threshold_cm, n_saturated,
 n_pp_mild, n_pp_moderate, n_pp_severe, sub_zone FROM z""", ["caliper_log"])
def zone_table(spark, sf):
    zones = detect.zone_table(_flagged(spark, sf), KEYS, RULE, nominal=auger_floor(), layout=layout_of(spark, sf))
    reals = ["depth_shallow", "depth_deep", "peak_cm", "baseline_at_peak_cm", "peak_excess_cm",
             "peak_excess_over_threshold_cm"]
    return zones.select(
        "well_id", *[settle(F.col(c)).alias(c) for c in reals],
        "n_saturated", "n_pp_mild", "n_pp_moderate", "n_pp_severe", "sub_zone",
    )


@query("cal_09_zone_output", ZONE_SQL + f"""
SELECT well_id, {r('hi_z')} AS z_top, {r('lo_z')} AS z_bot, {r('(lo_z+hi_z)/2')} AS z_centre, {r('hi_z-lo_z')} AS thickness_m,
 CASE WHEN n_saturated > 0 THEN 'severe' WHEN peak_cm - pb - CAST(0.5 AS DOUBLE) < 2 THEN 'mild' WHEN peak_cm - pb - CAST(0.5 AS DOUBLE) < 5 THEN 'moderate' ELSE 'severe' END AS severity,
 CAST(0.5 AS DOUBLE) AS offset_cm, CAST(3 AS DOUBLE) AS k_sigma, CAST(0.1 AS DOUBLE) AS sigma_inst_cm,
 CAST(2 AS DOUBLE) AS mild_max_excess_cm, CAST(5 AS DOUBLE) AS moderate_max_excess_cm, {r('peak_cm-nominal')} AS peak_excess_vs_nominal_cm FROM z""", ["caliper_log"])
def zone_output(spark, sf):
    zones = detect.zone_table(_flagged(spark, sf), KEYS, RULE, nominal=auger_floor(), layout=layout_of(spark, sf))
    return zones.select(
        "well_id", *[settle(F.col(c)).alias(c) for c in ("z_top", "z_bot", "z_centre", "thickness_m")],
        "severity", "offset_cm", "k_sigma", "sigma_inst_cm", "mild_max_excess_cm",
        "moderate_max_excess_cm",
        settle(F.col("peak_excess_vs_nominal_cm")).alias("peak_excess_vs_nominal_cm"),
    )


@query("src_07_width_master", f"""
SELECT split_part(source_file, '_', 1) AS well_id, {r('depth_m')} AS depth_m, {r('caliper_cm')} AS caliper_cm, auger_in
FROM (SELECT concat(well_id, '_log_', CAST(seq AS VARCHAR)) AS source_file, * FROM caliper_log) t""", ["caliper_log"])
def width_master(spark, sf):
    log = caliper_log(spark, sf)
    raw = log.select(
        F.concat("well_id", F.lit("_log_"), F.col("seq").cast("string")).alias("source_file"),
        F.col("depth_m").alias("Depth [m]"), F.col("caliper_cm").alias("calibrated_cm"),
        F.col("auger_in").alias("Diameter_auger_in"),
    )
    out = readers.read_width_master(spark, stored(raw, "csv"))
    return out.select("well_id", settle(F.col("depth_m")).alias("depth_m"), settle(F.col("caliper_cm")).alias("caliper_cm"), "auger_in")


@query("src_08_sample_scan", FLAGGED + f"""
SELECT well_id, count(*) AS n_rows, count(baseline_cm) AS n_baseline, {r('max(threshold_cm)')} AS max_threshold FROM s GROUP BY well_id""", ["caliper_log"])
def sample_scan(spark, sf):
    rows = readers.read_table(spark, stored(detect.sample_table(_flagged(spark, sf), KEYS), "parquet"), [
        "well_id", "depth_m", "caliper_cm", "baseline_cm", "threshold_cm",
        "excess_from_threshold_cm", "severity_per_sample", "zone_label"], "samples")
    return rows.groupBy("well_id").agg(
        F.count("*").alias("n_rows"), F.count("baseline_cm").alias("n_baseline"),
        settle(F.max("threshold_cm")).alias("max_threshold"),
    )


@query("win_04_running_minimum", f"""
SELECT well_id, seq, {r('min(caliper_cm) OVER (PARTITION BY well_id ORDER BY depth_m)')} AS cummin_down,
 {r('min(caliper_cm) OVER (PARTITION BY well_id ORDER BY depth_m DESC)')} AS cummin_up FROM caliper_log""", ["caliper_log"])
def running_minimum(spark, sf):
    log = caliper_log(spark, sf)
    layout = layout_of(spark, sf)
    down = baseline.running_minimum(log, KEYS, "depth_m", "caliper_cm", layout=layout)
    both = baseline.running_minimum(
        down.withColumnRenamed("running_min", "down"), KEYS, "depth_m", "caliper_cm", "bottom_up", layout
    )
    return both.select("well_id", "seq", settle(F.col("down")).alias("cummin_down"), settle(F.col("running_min")).alias("cummin_up"))


@query("win_05_anchors", f"""
SELECT well_id, seq, {r('caliper_cm')} AS caliper_cm FROM (SELECT *, min(caliper_cm) OVER (PARTITION BY well_id ORDER BY depth_m
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM caliper_log) t WHERE pm IS NULL OR caliper_cm < pm""", ["caliper_log"])
def anchor_rows(spark, sf):
    rows = baseline.anchors(caliper_log(spark, sf), KEYS, "depth_m", "caliper_cm", layout=layout_of(spark, sf)).where("is_anchor")
    return rows.select("well_id", "seq", settle(F.col("caliper_cm")).alias("caliper_cm"))


@query("win_06_anchor_interpolation", f"""
WITH m AS (SELECT *, min(caliper_cm) OVER (PARTITION BY well_id ORDER BY depth_m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM caliper_log),
k AS (SELECT well_id, depth_m AS ax, caliper_cm AS ay FROM m WHERE pm IS NULL OR caliper_cm < pm),
lo AS (SELECT m.*, k.ax AS x0, k.ay AS y0 FROM m ASOF LEFT JOIN k ON m.well_id = k.well_id AND m.depth_m >= k.ax),
hi AS (SELECT lo.*, k.ax AS x1, k.ay AS y1 FROM lo ASOF LEFT JOIN k ON lo.well_id = k.well_id AND lo.depth_m <= k.ax)
SELECT well_id, seq, {r('CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x1=x0 THEN y0 ELSE y0+(y1-y0)*(depth_m-x0)/(x1-x0) END')} AS baseline_cm FROM hi""", ["caliper_log"])
def anchor_interpolation(spark, sf):
    rows = baseline.single_zone_baseline(
        caliper_log(spark, sf), KEYS, "depth_m", "caliper_cm", "linear", "bottom_up", layout=layout_of(spark, sf)
    )
    return rows.select("well_id", "seq", settle(F.col("baseline_cm")).alias("baseline_cm"))


STEP_SQL = f"""
SELECT well_id, seq, zone_label, {r('coalesce(cm, fv)')} AS baseline_cm FROM (
 SELECT *, first_value(v IGNORE NULLS) OVER (PARTITION BY well_id, zone ORDER BY depth_m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fv FROM m) t"""


@query("win_07_step_fill", FLAGGED.split("knots AS")[0].rstrip().rstrip(",") + STEP_SQL, ["caliper_log"])
def step_fill(spark, sf):
    rows = baseline.two_zone_baseline(caliper_log(spark, sf), KEYS, kind="step", layout=layout_of(spark, sf))
    return rows.select("well_id", "seq", "zone_label", settle(F.col("baseline_cm")).alias("baseline_cm"))


@query("win_08_runs_of_true", f"""
SELECT well_id, {r('min(depth_m)')} AS run_start, {r('max(depth_m)')} AS run_end, count(*) AS n_points FROM (
 SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY depth_m) - row_number() OVER (PARTITION BY well_id, caliper_cm > 15.4 ORDER BY depth_m) AS g
 FROM caliper_log) t WHERE caliper_cm > 15.4 GROUP BY well_id, g HAVING count(*) >= 2""", ["caliper_log"])
def runs_of_true(spark, sf):
    log = caliper_log(spark, sf).withColumn("wide", F.col("caliper_cm") > 15.4)
    runs = detect.runs_of_true(log, KEYS, "depth_m", "wide", 2, layout=layout_of(spark, sf))
    return runs.select("well_id", settle(F.col("run_start")).alias("run_start"), settle(F.col("run_end")).alias("run_end"), "n_points")


@query("win_09_severity_runs", FLAGGED + f""",
dz AS (SELECT well_id, quantile_cont(g, 0.5) AS dz FROM (SELECT well_id, lead(depth_m) OVER (PARTITION BY well_id ORDER BY depth_m) - depth_m AS g FROM s) GROUP BY well_id),
isl AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY depth_m) - row_number() OVER (PARTITION BY well_id, severity_per_sample ORDER BY depth_m) AS g FROM s)
SELECT well_id, severity_per_sample, {r('min(depth_m) - max(dz)/2')} AS run_top, {r('max(depth_m) + max(dz)/2')} AS run_bottom, count(*) AS n_points
FROM isl JOIN dz USING (well_id) WHERE severity_per_sample <> 'none' GROUP BY well_id, severity_per_sample, g""", ["caliper_log"])
def severity_runs(spark, sf):
    runs = detect.severity_runs(_flagged(spark, sf), KEYS, "depth_m", "severity_per_sample", layout=layout_of(spark, sf))
    return runs.select("well_id", "severity_per_sample", settle(F.col("run_top")).alias("run_top"),
                       settle(F.col("run_bottom")).alias("run_bottom"), "n_points")


# Reflected centred mean: every offset j in -h..h reads index |i+j|, mirrored at the far end.
MEAN_SQL = """
n0 AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY depth_m) - 1 AS i, count(*) OVER (PARTITION BY well_id) AS n FROM {source}),
off AS (SELECT n0.well_id, n0.i, n0.n, unnest(range(-h, h+1)) AS j FROM n0 JOIN half USING (well_id)),
pos AS (SELECT well_id, i, CASE WHEN abs(i+j) > n-1 THEN 2*(n-1) - abs(i+j) ELSE abs(i+j) END AS q FROM off),
ma AS (SELECT pos.well_id, pos.i, avg(n0.caliper_cm) AS trend FROM pos JOIN n0 ON n0.well_id = pos.well_id AND n0.i = pos.q GROUP BY pos.well_id, pos.i)
"""


@query("win_10_moving_average", "WITH half AS (SELECT well_id, CASE WHEN trim_depth_m = 5 THEN 10 ELSE 7 END AS h FROM caliper_log GROUP BY well_id, trim_depth_m)," + MEAN_SQL.format(source="caliper_log") + f"""
SELECT n0.well_id, seq, {r('trend')} AS smooth_cm FROM n0 JOIN ma ON n0.well_id = ma.well_id AND n0.i = ma.i""", ["caliper_log"])
def moving_average(spark, sf):
    points = F.when(F.col("trim_depth_m") == 5, 20).otherwise(15)
    rows = noise.moving_average(caliper_log(spark, sf), KEYS, "depth_m", "caliper_cm", points, "smooth_cm", layout=layout_of(spark, sf))
    return rows.select("well_id", "seq", settle(F.col("smooth_cm")).alias("smooth_cm"))


@query("win_11_lag1_autocorrelation", f"""
SELECT well_id, {r('sum(d*dn)/sum(d*d)')} AS lag1_autocorr FROM (
 SELECT well_id, d, lead(d) OVER (PARTITION BY well_id ORDER BY depth_m) AS dn FROM (
  SELECT *, caliper_cm - avg(caliper_cm) OVER (PARTITION BY well_id) AS d FROM caliper_log) a) b GROUP BY well_id""", ["caliper_log"])
def autocorrelation(spark, sf):
    rows = noise.lag1_autocorrelation(caliper_log(spark, sf), KEYS, "depth_m", "caliper_cm", layout=layout_of(spark, sf))
    return rows.select("well_id", settle(F.col("lag1_autocorr")).alias("lag1_autocorr"))


PCHIP_BASELINE = FLAGGED.split("lo AS")[0] + pchip_knots("knots", "well_id, zone", "ax", "ay") + f""",
one AS (SELECT * FROM pk WHERE kn < kc OR kc = 1),
num AS (SELECT m.*, greatest(1, (SELECT count(*) FROM knots k WHERE k.well_id = m.well_id AND k.zone = m.zone AND k.ax <= m.depth_m)) AS seen FROM m),
val AS (SELECT num.*, one.x, one.y, one.d, one.x1, one.y1, one.d1 FROM num LEFT JOIN one ON num.well_id = one.well_id AND num.zone = one.zone
  AND one.kn = least(seen, greatest(kc-1, 1)))
"""


@query("smo_03_pchip_baseline", PCHIP_BASELINE + f"""
SELECT well_id, seq, zone_label, {r(f"CASE WHEN x1 IS NULL THEN y ELSE {hermite('depth_m')} END")} AS baseline_cm FROM val""", ["caliper_log"])
def pchip_baseline(spark, sf):
    rows = baseline.two_zone_baseline(caliper_log(spark, sf), KEYS, kind="pchip", layout=layout_of(spark, sf))
    return rows.select("well_id", "seq", "zone_label", settle(F.col("baseline_cm")).alias("baseline_cm"))


NOISE_SQL = """
WITH part AS (SELECT * FROM caliper_log WHERE depth_m BETWEEN 2 AND 12),
gap AS (SELECT well_id, quantile_cont(g, 0.5) AS dz FROM (SELECT well_id, lead(depth_m) OVER (PARTITION BY well_id ORDER BY depth_m) - depth_m AS g FROM part) GROUP BY well_id),
pts AS (SELECT well_id, dz, greatest(1, CAST(round_even(CAST(1 AS DOUBLE)/dz, 0) AS BIGINT)) AS w0 FROM gap),
half AS (SELECT well_id, dz, CASE WHEN w0 % 2 = 0 THEN w0+1 ELSE w0 END AS w, (CASE WHEN w0 % 2 = 0 THEN w0 ELSE w0-1 END)//2 AS h FROM pts),
""" + MEAN_SQL.format(source="part") + """,
res AS (SELECT n0.well_id, n0.i, caliper_cm, caliper_cm - trend AS q FROM n0 JOIN ma ON n0.well_id = ma.well_id AND n0.i = ma.i),
cen AS (SELECT *, q - avg(q) OVER (PARTITION BY well_id) AS d, abs(q - median(q) OVER (PARTITION BY well_id)) AS ad FROM res),
nxt AS (SELECT *, lead(d) OVER (PARTITION BY well_id ORDER BY i) AS dn FROM cen),
noise AS (SELECT well_id, count(*) AS n, avg(caliper_cm) AS cal_mean, stddev_samp(caliper_cm) AS cal_std, stddev_samp(q) AS s_std,
 median(ad)*CAST(1.4826 AS DOUBLE) AS s_mad, avg(q) AS q_mean, sum(d*dn)/sum(d*d) AS lag1 FROM nxt GROUP BY well_id)
"""


def _noise(spark, sf):
    return noise.noise_in_interval(caliper_log(spark, sf), KEYS, "depth_m", "caliper_cm", 2, 12, 1.0, layout=layout_of(spark, sf))


@query("cal_01_interval_noise", NOISE_SQL + f"""
SELECT well_id, n, {r('dz')} AS median_dz_m, w AS detrend_window_pts, {r('cal_mean')} AS cal_mean_cm, {r('cal_std')} AS cal_std_cm, {r('s_std')} AS sigma_std_cm,
 {r('s_mad')} AS sigma_mad_cm, {r('q_mean')} AS residual_mean_cm, {r('lag1')} AS lag1_autocorr, CASE WHEN n < 3 THEN 'too_few_samples' ELSE 'ok' END AS noise_status
FROM noise JOIN half USING (well_id)""", ["caliper_log"])
def interval_noise(spark, sf):
    reals = ["median_dz_m", "cal_mean_cm", "cal_std_cm", "sigma_std_cm", "sigma_mad_cm", "residual_mean_cm", "lag1_autocorr"]
    return _noise(spark, sf).select(
        "well_id", "n", "detrend_window_pts", "noise_status", *[settle(F.col(c)).alias(c) for c in reals]
    )


@query("cal_02_noise_comparison", NOISE_SQL + f"""
SELECT a.well_id AS reference, b.well_id AS target, {r('sqrt(greatest(0, b.s_std*b.s_std - a.s_std*a.s_std))', 5)} AS sigma_excess
FROM noise a JOIN noise b ON CAST(substr(b.well_id, 2) AS BIGINT) = CAST(substr(a.well_id, 2) AS BIGINT) + 1""", ["caliper_log"])
def noise_comparison(spark, sf):
    pairs = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("reference"),
        F.concat(F.lit("S"), (F.col("s_suppkey") + 1).cast("string")).alias("target"),
    )
    rows = noise.compare_noise(_noise(spark, sf), pairs)
    return rows.select("reference", "target", settle(F.col("sigma_excess"), 5).alias("sigma_excess"))


@query("cal_03_validity_mask", FLAGGED + "SELECT well_id, seq, is_valid FROM s", ["caliper_log"])
def validity(spark, sf):
    return baseline.two_zone_baseline(caliper_log(spark, sf), KEYS, layout=layout_of(spark, sf)).select("well_id", "seq", "is_valid")


@query("cal_04_two_zone_baseline", FLAGGED + f"SELECT well_id, seq, zone_label, {r('baseline_cm')} AS baseline_cm FROM s", ["caliper_log"])
def two_zone(spark, sf):
    rows = baseline.two_zone_baseline(caliper_log(spark, sf), KEYS, layout=layout_of(spark, sf))
    return rows.select("well_id", "seq", "zone_label", settle(F.col("baseline_cm")).alias("baseline_cm"))


@query("cal_05_sample_severity", FLAGGED + f"SELECT well_id, seq, {r('threshold_cm')} AS threshold_cm, {r('excess_cm')} AS excess_cm, is_anomaly, severity_per_sample FROM s", ["caliper_log"])
def sample_severity(spark, sf):
    return _flagged(spark, sf).select(
        "well_id", "seq", settle(F.col("threshold_cm")).alias("threshold_cm"),
        settle(F.col("excess_cm")).alias("excess_cm"), "is_anomaly", "severity_per_sample",
    )


@query("cal_07_log_counts", FLAGGED + """
SELECT well_id, count(*) AS n_samples, count(*) FILTER (caliper_cm < auger_in*CAST(2.54 AS DOUBLE)) AS n_below_auger,
 count(*) FILTER (is_valid) AS n_valid, count(*) FILTER (is_anomaly) AS n_anomaly FROM s GROUP BY well_id""", ["caliper_log"])
def log_counts(spark, sf):
    return detect.log_counts(_flagged(spark, sf), KEYS, auger_floor())


@query("cal_08_sample_output", FLAGGED + f"""
SELECT well_id, {r('depth_m')} AS depth_m, {r('caliper_cm')} AS caliper_cm, {r('baseline_cm')} AS baseline_cm, {r('threshold_cm')} AS threshold_cm,
 {r('caliper_cm - threshold_cm')} AS excess_from_threshold_cm, severity_per_sample, zone_label FROM s""", ["caliper_log"])
def sample_output(spark, sf):
    rows = detect.sample_table(_flagged(spark, sf), KEYS)
    return rows.select("well_id", *[settle(F.col(c)).alias(c) for c in rows.columns[1:-2]], *rows.columns[-2:])


@query("cal_10_severity_counts", ZONE_SQL + """,
g AS (SELECT well_id, CASE WHEN n_saturated > 0 THEN 'severe' WHEN peak_cm - pb - CAST(0.5 AS DOUBLE) < 2 THEN 'mild' WHEN peak_cm - pb - CAST(0.5 AS DOUBLE) < 5 THEN 'moderate' ELSE 'severe' END AS sv FROM z)
SELECT well_id, count(*) FILTER (sv='mild') AS mild, count(*) FILTER (sv='moderate') AS moderate, count(*) FILTER (sv='severe') AS severe FROM g GROUP BY well_id""", ["caliper_log"])
def severity_counts(spark, sf):
    return detect.severity_counts(detect.zone_table(_flagged(spark, sf), KEYS, RULE, nominal=auger_floor(), layout=layout_of(spark, sf)), KEYS)


@query("prj_06_sign_normalisation", f"""
WITH t AS (SELECT well_id, seq, CASE CAST(substr(well_id,2) AS BIGINT) % 3 WHEN 0 THEN -depth_m WHEN 1 THEN depth_m ELSE depth_m - 5 END AS z FROM caliper_log),
m AS (SELECT *, min(z) OVER (PARTITION BY well_id) AS lo, max(z) OVER (PARTITION BY well_id) AS hi FROM t)
SELECT well_id, seq, {r('CASE WHEN hi <= 0 AND lo < 0 THEN -z ELSE z END')} AS depth_m, CASE WHEN hi <= 0 AND lo < 0 THEN 'flipped' WHEN lo < 0 THEN 'mixed' ELSE 'unchanged' END AS sign_status FROM m""", ["caliper_log"])
def sign_normalisation(spark, sf):
    kind = F.substring("well_id", 2, 20).cast("long") % 3
    log = caliper_log(spark, sf).withColumn(
        "depth_m", F.when(kind == 0, -F.col("depth_m")).when(kind == 1, F.col("depth_m")).otherwise(F.col("depth_m") - 5)
    )
    rows = detect.normalise_signs(log, KEYS, "depth_m", layout=layout_of(spark, sf))
    return rows.select("well_id", "seq", settle(F.col("depth_m")).alias("depth_m"), "sign_status")


@query("prj_17_outlier_flag", """
WITH f AS (SELECT well_id, quantile_cont(caliper_cm, 0.25) AS q1, quantile_cont(caliper_cm, 0.75) AS q3 FROM caliper_log
 WHERE caliper_cm >= auger_in*CAST(2.54 AS DOUBLE) GROUP BY well_id)
SELECT well_id, seq, coalesce(caliper_cm < auger_in*CAST(2.54 AS DOUBLE) AND caliper_cm < q1 - CAST(1.5 AS DOUBLE)*(q3-q1), false) AS is_outlier
FROM caliper_log LEFT JOIN f USING (well_id)""", ["caliper_log"])
def outlier_flag(spark, sf):
    rows = detect.outlier_flags(caliper_log(spark, sf), KEYS, "caliper_cm", auger_floor(), layout=layout_of(spark, sf))
    return rows.select("well_id", "seq", "is_outlier")

"""Cluster and convergence queries."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import overlap_length, settle
from plumbline.operators import cluster, converge
from plumbline.sources.readers import read_table
from plumbline.workload.registry import query, r
from plumbline.workload.views import bp_records, fits, sized, stored, zones

KEYS = ["well_id"]
C = "CAST({} AS DOUBLE)".format


def layout_of(spark, sf):
    return sized(spark, sf, "bp_records")


def settled(df, reals, others=()):
    return df.select(*others, *[settle(F.col(c)).alias(c) for c in reals])


def clusters_sql(delta, source="bp_records", extra="", prefix=""):
    """CTEs cl (record, cluster_id) and cs (cluster summary) for one delta."""
    k = f"well_id{extra}"
    return f"""
{prefix}lagged AS (SELECT *, depth_bgl_m - lag(depth_bgl_m) OVER (PARTITION BY {k} ORDER BY depth_bgl_m, record_id) AS gap FROM {source}),
{prefix}cl AS (SELECT *, CAST(sum(CASE WHEN gap >= {delta} THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY depth_bgl_m, record_id) AS INT) AS cluster_id FROM {prefix}lagged),
{prefix}cs AS (SELECT {k}, cluster_id, quantile_cont(depth_bgl_m, 0.5) AS depth_median, min(depth_bgl_m) AS depth_min, max(depth_bgl_m) AS depth_max,
  quantile_cont(depth_bgl_m, 0.75) - quantile_cont(depth_bgl_m, 0.25) AS depth_iqr,
  count(DISTINCT n_breakpoints) FILTER (smoothing='savgol') AS n_savgol, count(DISTINCT n_breakpoints) FILTER (smoothing='lowess') AS n_lowess,
  count(*) AS n_bp_total FROM {prefix}cl GROUP BY {k}, cluster_id),
{prefix}clusters AS (SELECT *, n_savgol + n_lowess AS persistence, least(n_savgol, n_lowess) AS agreement FROM {prefix}cs)
"""


CLUSTERS = "WITH " + clusters_sql(C(0.5)).strip()
SUMMARY = ["depth_median", "depth_min", "depth_max", "depth_iqr", "cluster_diameter_m"]
COUNTS = ["n_savgol", "n_lowess", "persistence", "agreement", "wide_flag", "n_bp_total"]
SUMMARY_SQL = f"""cluster_id, {r('depth_median')} AS depth_median, {r('depth_min')} AS depth_min, {r('depth_max')} AS depth_max, {r('depth_iqr')} AS depth_iqr,
 {r('depth_max-depth_min')} AS cluster_diameter_m, n_savgol, n_lowess, persistence, agreement, depth_max-depth_min > 2 AS wide_flag, n_bp_total"""


def _clusters(spark, sf):
    return cluster.robustness(bp_records(spark, sf), KEYS, layout=layout_of(spark, sf))


@query("win_12_single_linkage", CLUSTERS + "SELECT well_id, record_id, cluster_id FROM cl", ["bp_records"])
def single_linkage(spark, sf):
    rows = cluster.cluster_depths(bp_records(spark, sf), KEYS, tie=["record_id"], layout=layout_of(spark, sf))
    return rows.select("well_id", "record_id", "cluster_id")


@query("src_09_cluster_scan", CLUSTERS + "SELECT well_id, count(*) AS n_clusters, max(agreement) AS best_agreement FROM clusters GROUP BY well_id", ["bp_records"])
def cluster_scan(spark, sf):
    table = read_table(spark, stored(_clusters(spark, sf), "parquet"), [
        "well_id", "delta_m", "cluster_id", "depth_median", "depth_min", "depth_max", "agreement"], "clusters")
    return table.groupBy("well_id").agg(F.count("*").alias("n_clusters"), F.max("agreement").alias("best_agreement"))


@query("agg_02_pooled_breakpoints", f"""
SELECT well_id, smoothing, n_breakpoints, CAST(p AS INT) AS bp_index, {r('psis[p]')} AS depth_bgl_m FROM (
 SELECT well_id, smoothing, n_breakpoints, psis, unnest(range(1, n_breakpoints+1)) AS p FROM fits WHERE trial = 'trial_1') t""", ["fits"])
def pooled_breakpoints(spark, sf):
    return settled(cluster.pool_breakpoints(fits(spark, sf), KEYS), ["depth_bgl_m"], ["well_id", "smoothing", "n_breakpoints", "bp_index"])


@query("agg_02_largest_sizes", """
SELECT well_id, smoothing, max(n_breakpoints) AS n_max, count(DISTINCT n_breakpoints) AS n_sizes FROM bp_records GROUP BY well_id, smoothing""", ["bp_records"])
def largest_sizes(spark, sf):
    return cluster.largest_sizes(bp_records(spark, sf), KEYS)


@query("agg_03_cluster_summary", CLUSTERS + f"SELECT well_id, {SUMMARY_SQL} FROM clusters", ["bp_records"])
def cluster_summary(spark, sf):
    return settled(_clusters(spark, sf), SUMMARY, ["well_id", "cluster_id", *COUNTS])


@query("agg_04_bic_summary", f"""
WITH u AS (SELECT well_id, smoothing, n_breakpoints AS n, min(bic) AS bic FROM fits WHERE trial = 'trial_1' AND bic IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY well_id, smoothing ORDER BY bic, n) AS k FROM u)
SELECT b.well_id, b.smoothing, b.n AS n_opt, {r('b.bic')} AS bic_opt, {r('u.bic - b.bic')} AS delta_bic FROM b LEFT JOIN u ON u.well_id = b.well_id AND u.smoothing = b.smoothing AND u.n = b.n + 1 WHERE k = 1""", ["fits"])
def bic_summary(spark, sf):
    out = cluster.bic_summary(fits(spark, sf).where("trial = 'trial_1'"), ["well_id", "smoothing"])
    return settled(out, ["bic_opt", "delta_bic"], ["well_id", "smoothing", "n_opt"])


RANKED = CLUSTERS + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY agreement DESC, persistence DESC, depth_median, cluster_id) AS rank FROM clusters)
"""


@query("agg_04_robust_depths", RANKED + f"""
SELECT well_id, string_agg(printf('%.2f', {r('depth_median', 2)}), ', ' ORDER BY rank) AS top_depths FROM rk WHERE rank <= 3 GROUP BY well_id""", ["bp_records"])
def robust_depths(spark, sf):
    return cluster.robust_depths(_clusters(spark, sf), KEYS, layout=layout_of(spark, sf))


@query("agg_05_robustness", CLUSTERS + f"SELECT well_id, {C(0.5)} AS delta_m, {SUMMARY_SQL} FROM clusters", ["bp_records"])
def robustness(spark, sf):
    return settled(_clusters(spark, sf), SUMMARY, ["well_id", "delta_m", "cluster_id", *COUNTS])


SENSITIVITY = "WITH grid AS (SELECT *, unnest([CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE)]) AS delta_m FROM bp_records)," + clusters_sql("delta_m", "grid", ", delta_m")


def _sensitivity(spark, sf):
    return cluster.robustness_sensitivity(bp_records(spark, sf), KEYS, layout=layout_of(spark, sf))


@query("agg_06_delta_sensitivity", SENSITIVITY + f"SELECT well_id, delta_m, {SUMMARY_SQL} FROM clusters", ["bp_records"])
def delta_sensitivity(spark, sf):
    return settled(_sensitivity(spark, sf), SUMMARY, ["well_id", "delta_m", "cluster_id", *COUNTS])


@query("agg_07_clusters_per_delta", SENSITIVITY + """
SELECT delta_m, count(*) AS n_clusters, count(*) FILTER (agreement >= 2) AS n_agreed, count(DISTINCT well_id) AS n_wells FROM clusters GROUP BY delta_m""", ["bp_records"])
def clusters_per_delta(spark, sf):
    return _sensitivity(spark, sf).groupBy("delta_m").agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col("agreement") >= 2).alias("n_agreed"),
        F.count_distinct("well_id").alias("n_wells"),
    )


@query("agg_08_top_clusters", RANKED + f"SELECT well_id, cluster_id, CAST(rank AS INT) AS rank, {r('depth_median')} AS depth_median, agreement, persistence FROM rk WHERE rank <= 5", ["bp_records"])
def top_clusters(spark, sf):
    out = cluster.ranked_clusters(_clusters(spark, sf), KEYS, 5, layout=layout_of(spark, sf))
    return settled(out, ["depth_median"], ["well_id", "cluster_id", "rank", "agreement", "persistence"])


@query("agg_09_depth_histogram", f"""
SELECT smoothing, CAST(CASE WHEN depth_bgl_m = 10 THEN 19 ELSE floor(depth_bgl_m/{C(0.5)}) END AS BIGINT) AS bin, count(*) AS n,
 {r(f'max(CASE WHEN depth_bgl_m = 10 THEN 19 ELSE floor(depth_bgl_m/{C(0.5)}) END)*{C(0.5)}')} AS bin_start FROM bp_records GROUP BY 1, 2""", ["bp_records"])
def depth_histogram(spark, sf):
    out = cluster.depth_histogram(bp_records(spark, sf), ["smoothing"], "depth_bgl_m", 0.5, 0.0, 10.0)
    return settled(out, ["bin_start"], ["smoothing", "bin", "n"])


@query("set_02_stacked_deltas", "WITH " + ",".join(
    clusters_sql(C(d), prefix=f"d{i}_") for i, d in enumerate((0.3, 1.0))
).strip() + "\n" + " UNION ALL ".join(
    f"SELECT well_id, {C(d)} AS delta_m, cluster_id, {r('depth_median')} AS depth_median, persistence FROM d{i}_clusters" for i, d in enumerate((0.3, 1.0))
), ["bp_records"])
def stacked_deltas(spark, sf):
    rows = bp_records(spark, sf)
    layout = layout_of(spark, sf)
    first, second = (cluster.robustness(rows, KEYS, d, layout=layout) for d in (0.3, 1.0))
    return settled(first.unionByName(second), ["depth_median"], ["well_id", "delta_m", "cluster_id", "persistence"])


@query("set_03_contract_order", RANKED + "SELECT well_id, cluster_id, row_number() OVER (ORDER BY agreement DESC, persistence DESC, well_id, cluster_id) AS position FROM clusters", ["bp_records"])
def contract_order(spark, sf):
    from plumbline.plans.layout import finish, lay, row_number

    order = F.struct(-F.col("agreement"), -F.col("persistence"), "well_id", "cluster_id")
    rows = _clusters(spark, sf).select(F.lit(1).alias("all"), "well_id", "cluster_id", order.alias("place"))
    done = finish(lay(rows, ["all"], ["place"]).scan(position=row_number()))
    return done.select("well_id", "cluster_id", (F.col("position") + 1).alias("position"))


@query("set_04_ranked_head", CLUSTERS + f"""
SELECT well_id, cluster_id, agreement, persistence, {r('depth_median')} AS depth_median FROM clusters ORDER BY agreement DESC, persistence DESC, well_id, cluster_id LIMIT 15""", ["bp_records"])
def ranked_head(spark, sf):
    out = _clusters(spark, sf).orderBy(F.desc("agreement"), F.desc("persistence"), "well_id", "cluster_id").limit(15)
    return settled(out, ["depth_median"], ["well_id", "cluster_id", "agreement", "persistence"])


PAIRED = CLUSTERS + f""",
pr AS (SELECT c.well_id, c.cluster_id, c.agreement, z.*, greatest(0, least(greatest(depth_min, depth_max), greatest(z_bot, z_top)) - greatest(least(depth_min, depth_max), least(z_bot, z_top))) AS ov,
  abs(depth_median - z_centre) AS cd FROM clusters c JOIN (SELECT well_id AS zw, * EXCLUDE (well_id) FROM zones) z ON c.well_id = z.zw),
mt AS (SELECT *, CASE severity WHEN 'mild' THEN {C(1)} WHEN 'moderate' THEN {C(2)} WHEN 'severe' THEN {C(3)} ELSE {C(0)} END AS w FROM pr WHERE ov > 0 OR cd <= {C(0.5)})
"""


def _matches(spark, sf, rule="hybrid"):
    return converge.find_matches(_clusters(spark, sf), zones(spark, sf), KEYS, rule)


@query("src_10_zone_numbers", "SELECT well_id, z_bot, z_top, CAST(row_number() OVER (PARTITION BY well_id ORDER BY z_bot, z_top, zone_id) AS INT) AS zone_id FROM zones".replace("z_bot, z_top, CAST", f"{r('z_bot')} AS z_bot, {r('z_top')} AS z_top, CAST"), ["zones"])
def zone_numbers(spark, sf):
    rows = zones(spark, sf).withColumnRenamed("zone_id", "source_row")
    out = converge.number_zones(rows, KEYS, tie=("source_row",), layout=layout_of(spark, sf))
    return settled(out, ["z_bot", "z_top"], ["well_id", "zone_id"])


@query("prj_08_eligible_rows", CLUSTERS + """
SELECT 'cluster' AS side, well_id, CAST(cluster_id AS BIGINT) AS id FROM clusters WHERE agreement >= 1
UNION ALL SELECT 'zone', well_id, zone_id FROM zones WHERE severity IN ('moderate', 'severe')""", ["bp_records", "zones"])
def eligible_rows(spark, sf):
    left, right = converge.eligible(_clusters(spark, sf), zones(spark, sf), 1, ["moderate", "severe"])
    return left.select(F.lit("cluster").alias("side"), "well_id", F.col("cluster_id").cast("long").alias("id")).unionByName(
        right.select(F.lit("zone").alias("side"), "well_id", F.col("zone_id").alias("id"))
    )


@query("prj_12_overlap_length", f"""
SELECT zone_id, {r('greatest(0, least(z_top, z_centre) - greatest(z_bot, z_centre - thickness_m))')} AS overlap_m,
 {r(f'greatest(0, least(z_top, {C(7)}) - greatest(z_bot, {C(3)}))')} AS window_m FROM zones""", ["zones"])
def overlap(spark, sf):
    c = F.col
    return zones(spark, sf).select(
        "zone_id",
        settle(overlap_length(c("z_top"), c("z_bot"), c("z_centre") - c("thickness_m"), c("z_centre"))).alias("overlap_m"),
        settle(overlap_length(c("z_bot"), c("z_top"), F.lit(7.0), F.lit(3.0))).alias("window_m"),
    )


@query("prj_13_centre_distance", PAIRED + f"SELECT well_id, cluster_id, zone_id, {r('cd')} AS center_distance_m FROM pr WHERE cd <= {C(0.5)}", ["bp_records", "zones"])
def centre_distance(spark, sf):
    return settled(_matches(spark, sf, "center_distance"), ["center_distance_m"], ["well_id", "cluster_id", "zone_id"])


@query("jon_01_interval_matches", PAIRED + f"SELECT well_id, cluster_id, zone_id, severity, {r('ov')} AS overlap_m, {r('cd')} AS center_distance_m FROM mt", ["bp_records", "zones"])
def interval_matches(spark, sf):
    return settled(_matches(spark, sf), ["overlap_m", "center_distance_m"], ["well_id", "cluster_id", "zone_id", "severity"])


@query("jon_01_overlap_rule", PAIRED + f"SELECT well_id, cluster_id, zone_id, {r('ov')} AS overlap_m FROM pr WHERE ov > 0", ["bp_records", "zones"])
def overlap_rule(spark, sf):
    return settled(_matches(spark, sf, "overlap"), ["overlap_m"], ["well_id", "cluster_id", "zone_id"])


BEST = PAIRED + ",\n" + ",\n".join(
    f"b_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id, cluster_id ORDER BY {order}) AS k FROM mt) t WHERE k = 1)"
    for name, order in {
        "overlap": "ov DESC, cd, zone_id", "severity": "w DESC, ov DESC, cd, zone_id", "peak": "peak_excess_cm DESC, ov DESC, cd, zone_id",
    }.items()
) + "\n"


@query("jon_02_best_match", BEST + " UNION ALL ".join(
    f"SELECT '{p}' AS priority, well_id, cluster_id, zone_id, severity, {r('ov')} AS overlap_m FROM b_{p}" for p in converge.PRIORITIES
), ["bp_records", "zones"])
def best_match(spark, sf):
    out = converge.best_matches(_matches(spark, sf), KEYS)
    return settled(out, ["overlap_m"], ["priority", "well_id", "cluster_id", "zone_id", "severity"])


SCORED = BEST.rstrip() + f""",
sc AS (SELECT well_id, cluster_id, count(*) AS n, max(w) AS mw, min(severity) FILTER (w = top) AS ms, string_agg(DISTINCT severity, ',' ORDER BY severity) AS sv FROM (
  SELECT *, max(w) OVER (PARTITION BY well_id, cluster_id) AS top FROM mt) t GROUP BY well_id, cluster_id),
cm AS (SELECT c.well_id, c.cluster_id, c.agreement, coalesce(n, 0) AS n_zones_matched, coalesce(n > 1, false) AS multi_match, ms AS max_severity, sv AS severities,
  c.agreement*coalesce(mw, {C(0)}) AS score FROM clusters c LEFT JOIN sc USING (well_id, cluster_id))
"""


@query("jon_03_cluster_scores", SCORED + f"SELECT well_id, cluster_id, agreement, n_zones_matched, multi_match, max_severity, severities, {r('score')} AS score FROM cm", ["bp_records", "zones"])
def cluster_scores(spark, sf):
    clusters = _clusters(spark, sf)
    out = converge.score_matches(converge.find_matches(clusters, zones(spark, sf), KEYS), clusters, KEYS)
    return settled(out, ["score"], ["well_id", "cluster_id", "agreement", "n_zones_matched", "multi_match", "max_severity", "severities"])


@query("jon_04_unmatched_zones", PAIRED + f"""
SELECT well_id, zone_id, severity, {r('z_centre')} AS z_centre FROM zones WHERE severity IN ('moderate', 'severe') AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.zone_id = zones.zone_id)""", ["bp_records", "zones"])
def unmatched_zones(spark, sf):
    out = converge.unmatched_zones(zones(spark, sf), _matches(spark, sf), KEYS, "moderate")
    return settled(out, ["z_centre"], ["well_id", "zone_id", "severity"])


@query("jon_05_convergence", SCORED + f"""
SELECT cm.well_id, cm.cluster_id, cm.n_zones_matched, {r('cm.score')} AS score, b.zone_id, coalesce(b.severity, '') AS severity, {r('b.ov')} AS overlap_m,
 {r('b.z_top - b.z_bot')} AS thickness_m, coalesce(b.w, {C(0)}) AS severity_weight, b.zone_id IS NOT NULL AS has_match, coalesce(b.ov > 0, false) AS is_overlap, coalesce(b.cd <= {C(0.5)}, false) AS is_near FROM cm LEFT JOIN b_overlap b USING (well_id, cluster_id)""", ["bp_records", "zones"])
def convergence(spark, sf):
    matched, _, _ = converge.convergence(_clusters(spark, sf), zones(spark, sf), KEYS)
    return settled(matched, ["score", "overlap_m", "thickness_m"], [
        "well_id", "cluster_id", "n_zones_matched", "zone_id", "severity", "severity_weight", "has_match", "is_overlap", "is_near"])


@query("agg_12_well_summary", SCORED + f"""
SELECT well_id, count(*) AS n_clusters, count(*) FILTER (n_zones_matched > 0) AS n_converging, {r(f'count(*) FILTER (n_zones_matched > 0)/CAST(count(*) AS DOUBLE)')} AS fraction_converging,
 count(*) FILTER (max_severity='mild') AS n_mild, count(*) FILTER (max_severity='moderate') AS n_moderate, count(*) FILTER (max_severity='severe') AS n_severe,
 {r('max(score)')} AS max_score, {r('coalesce(avg(score) FILTER (n_zones_matched > 0), 0)')} AS mean_score FROM cm GROUP BY well_id""", ["bp_records", "zones"])
def well_summary(spark, sf):
    _, summary, _ = converge.convergence(_clusters(spark, sf), zones(spark, sf), KEYS)
    return settled(summary, ["fraction_converging", "max_score", "mean_score"],
                   ["well_id", "n_clusters", "n_converging", "n_mild", "n_moderate", "n_severe"])


@query("agg_13_depth_extents", f"""
SELECT well_id, {r(f'min(d) - {C(1)}')} AS depth_low, {r(f'max(d) + {C(1)}')} AS depth_high FROM (
 SELECT well_id, depth_bgl_m AS d FROM bp_records UNION ALL SELECT well_id, z_top FROM zones UNION ALL SELECT well_id, z_bot FROM zones) t GROUP BY well_id""", ["bp_records", "zones"])
def depth_extents(spark, sf):
    z = zones(spark, sf)
    out = converge.depth_extents([
        bp_records(spark, sf).select("well_id", F.col("depth_bgl_m").alias("depth_m")),
        z.select("well_id", F.col("z_top").alias("depth_m")), z.select("well_id", F.col("z_bot").alias("depth_m")),
    ], KEYS, 1.0)
    return settled(out, ["depth_low", "depth_high"], ["well_id"])

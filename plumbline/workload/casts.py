"""Cast queries: names and columns, cleaning, resampling, smoothing."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import log10_positive, settle
from plumbline.operators import catalogue, certificate, clean, cluster, datum, resample, smooth, sweep
from plumbline.sources import names, readers
from plumbline.workload.registry import query, r
from plumbline.workload.shared_sql import hermite, pchip_knots
from plumbline.workload.views import cast_samples, fits, sized, stored, table

KEYS = ["well_id", "campaign"]
C = "CAST({} AS DOUBLE)".format


def layout_of(spark, sf):
    return sized(spark, sf, "cast_samples")


def settled(df, reals, others=()):
    return df.select(*others, *[settle(F.col(c)).alias(c) for c in reals])


# Cleaning as SQL: adj (shifted, non-negative), desc0 (kept), flat (one row per depth).
CLEAN = f"""
WITH adj AS (SELECT * FROM (SELECT well_id, campaign, seq, sec_us_cm, CASE WHEN depth_m >= {C(0.001)} THEN depth_m + {C(0.272)} ELSE depth_m END AS z FROM cast_samples) t WHERE z >= 0),
mark AS (SELECT *, max(z) OVER (PARTITION BY well_id, campaign ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM adj),
flat AS (SELECT well_id, campaign, z, avg(sec_us_cm) AS sec FROM mark WHERE m IS NULL OR z >= m - {C(0.002)} GROUP BY well_id, campaign, z)
"""
GRID = """,
ext AS (SELECT well_id, campaign, min(z) AS z0, max(z) AS z9, quantile_cont(g, 0.95) AS dz FROM (
  SELECT *, lead(z) OVER (PARTITION BY well_id, campaign ORDER BY z) - z AS g FROM flat) t GROUP BY well_id, campaign),
grid AS (SELECT well_id, campaign, k AS grid_index, z0 + k*((z0+dz)-z0) AS g FROM (
  SELECT *, unnest(range(0, CAST(floor((z9-z0)/dz) AS BIGINT) + 2)) AS k FROM ext WHERE dz > 0) t WHERE z0 + k*((z0+dz)-z0) <= z9)
"""
PCHIP = GRID + "," + pchip_knots("flat", "well_id, campaign", "z", "sec") + f""",
pc AS (SELECT grid.well_id, grid.campaign, grid_index, g, CASE WHEN x1 IS NULL THEN y ELSE {hermite('g')} END AS sec
  FROM grid ASOF JOIN pk ON grid.well_id = pk.well_id AND grid.campaign = pk.campaign AND grid.g >= pk.x)
"""


def _clean(spark, sf):
    layout = layout_of(spark, sf)
    return clean.clean_casts(cast_samples(spark, sf), KEYS, layout=layout), layout


def _grid(spark, sf, kind="pchip"):
    flat, layout = _clean(spark, sf)
    return resample.resample(flat, KEYS, kind=kind, layout=layout), layout


@query("src_02_alias_coalesce", f"""
SELECT well_id, seq, {r('depth_m')} AS depth_m, {r('sec_us_cm')} AS sec_us_cm FROM cast_samples""", ["cast_samples"])
def alias_coalesce(spark, sf):
    rows = cast_samples(spark, sf)
    even = F.col("seq") % 2 == 0
    two = rows.where(even).select("well_id", "seq", F.col("depth_m").alias("Depth (m)"), F.col("sec_us_cm").alias("spcond us/cm"))
    other = rows.where(~even).select("well_id", "seq", F.col("depth_m").alias("Vertical Position m"), F.col("sec_us_cm").alias("Conductivity"))
    both = two.unionByName(other, allowMissingColumns=True)
    return both.select(
        "well_id", "seq", settle(readers.coalesce_aliases(both, "depth")).alias("depth_m"),
        settle(readers.coalesce_aliases(both, "conductivity")).alias("sec_us_cm"),
    )


@query("src_03_standard_names", f"""
SELECT well_id, seq, {r('depth_m')} AS depth_m, {r('sec_us_cm')} AS sec_us_cm FROM cast_samples""", ["cast_samples"])
def standard_names(spark, sf):
    raw = cast_samples(spark, sf).withColumnsRenamed({"depth_m": "DEPTH (M)", "sec_us_cm": "SpCond uS/cm"})
    return settled(readers.standardise(raw), ["depth_m", "sec_us_cm"], ["well_id", "seq"])


NAMED = """
named AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('W', CAST(user_id AS VARCHAR), 'D_YSI_A_', strftime(ts, '%Y%m%d'), '.csv')
 WHEN 1 THEN concat('W', CAST(user_id AS VARCHAR), 'S_CTD_', strftime(ts, '%Y%m%d'), '.csv')
 WHEN 2 THEN concat(strftime(ts, '%Y%m%d'), '_YSI_W', CAST(user_id AS VARCHAR), 'D_B.csv')
 ELSE concat('notes-', CAST(event_id AS VARCHAR), '.txt') END AS file_name FROM events)
"""


def _named(spark, sf):
    day, user = F.date_format("ts", "yyyyMMdd"), F.col("user_id").cast("string")
    kind = F.col("event_id") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("W"), user, F.lit("D_YSI_A_"), day, F.lit(".csv")))
        .when(kind == 1, F.concat(F.lit("W"), user, F.lit("S_CTD_"), day, F.lit(".csv")))
        .when(kind == 2, F.concat(day, F.lit("_YSI_W"), user, F.lit("D_B.csv")))
        .otherwise(F.concat(F.lit("notes-"), F.col("event_id").cast("string"), F.lit(".txt")))
    )
    return table(spark, sf, "events").select("event_id", name.alias("file_name"))


@query("src_05_file_names", "WITH " + NAMED.strip() + """
SELECT file_name, event_id, CASE WHEN event_id % 4 < 2 THEN regexp_extract(file_name, '^(W\\d+)', 1) WHEN event_id % 4 = 2 THEN regexp_extract(file_name, '_(W\\d+)', 1) END AS site,
 CASE event_id % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'S' WHEN 2 THEN 'D' END AS well_type, CASE event_id % 4 WHEN 0 THEN 'YSI' WHEN 1 THEN 'CTD' WHEN 2 THEN 'YSI' END AS instrument,
 CASE event_id % 4 WHEN 0 THEN 'A' WHEN 2 THEN 'B' END AS suffix, CASE WHEN event_id % 4 < 3 THEN regexp_extract(file_name, '(\\d{8})', 1) END AS cast_date,
 CASE WHEN event_id % 4 < 2 THEN regexp_extract(file_name, '^(W\\d+[DS])', 1) WHEN event_id % 4 = 2 THEN regexp_extract(file_name, '_(W\\d+D)', 1) END AS well_id FROM named""")
def file_names(spark, sf):
    return _named(spark, sf).withColumns(names.parse_cast_name(F.col("file_name")))


@query("src_06_well_id_parts", """
SELECT DISTINCT well_id, substr(well_id, 1, length(well_id)-1) AS site, right(well_id, 1) AS well_type FROM cast_samples""", ["cast_samples"])
def well_id_parts(spark, sf):
    site, kind = names.split_well_id(F.col("well_id"))
    return cast_samples(spark, sf).select("well_id", site.alias("site"), kind.alias("well_type")).distinct()


@query("src_21_companions", """
WITH w AS (SELECT DISTINCT site, well_id FROM cast_samples)
SELECT a.site, a.well_id, b.well_id AS companion FROM w a JOIN w b ON a.site = b.site AND a.well_id <> b.well_id""", ["cast_samples"])
def companions(spark, sf):
    return catalogue.companions(cast_samples(spark, sf).select("site", "well_id").distinct())


@query("win_01_chronological_order", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%H:%M:%S'), extract('microseconds' FROM ts) % 1000000, event_id) - 1 AS seq, 'by_time' AS order_status FROM events""")
def chronological_order(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", F.date_format("ts", "HH:mm:ss").alias("time"),
        (F.date_format("ts", "SSSSSS").cast("double") / 1e6).alias("time_frac"),
    )
    out = clean.chronological(rows, ["user_id"], "time", "time_frac", ["event_id"], layout=layout_of(spark, sf))
    return out.select("user_id", "event_id", "seq", "order_status")


@query("win_02_descent_filter", CLEAN + f"""
SELECT well_id, campaign, seq, {r('z')} AS depth_m FROM mark WHERE m IS NULL OR z >= m - {C(0.002)}""", ["cast_samples"])
def descent(spark, sf):
    rows = clean.drop_negative_depths(clean.adjust_depth(cast_samples(spark, sf)))
    return settled(clean.descent_filter(rows, KEYS, "depth_m", "seq", layout=layout_of(spark, sf)), ["depth_m"], [*KEYS, "seq"])


@query("win_02_descent_statistics", CLEAN + f"""
SELECT well_id, campaign, count(*) AS n_total, count(*) FILTER (m IS NULL OR z >= m - {C(0.002)}) AS n_kept, count(*) FILTER (z < m - {C(0.002)}) AS n_removed,
 {r(f'count(*) FILTER (z < m - {C(0.002)})*{C(100)}/count(*)')} AS pct_removed, {r('max(greatest(coalesce(m - z, 0), 0))')} AS max_reversal_m FROM mark GROUP BY well_id, campaign""", ["cast_samples"])
def descent_statistics(spark, sf):
    rows = clean.drop_negative_depths(clean.adjust_depth(cast_samples(spark, sf)))
    out = clean.descent_statistics(rows, KEYS, "depth_m", "seq", layout=layout_of(spark, sf))
    return settled(out, ["pct_removed", "max_reversal_m"], [*KEYS, "n_total", "n_kept", "n_removed"])


@query("win_03_step_statistics", CLEAN + f"""
SELECT well_id, campaign, {r('quantile_cont(g, 0.95)')} AS dz_p95, {r('quantile_cont(g, 0.5)')} AS dz_median, {r('avg(g)')} AS dz_mean, {r('min(g)')} AS dz_min FROM (
 SELECT *, lead(z) OVER (PARTITION BY well_id, campaign ORDER BY z) - z AS g FROM flat) t WHERE g IS NOT NULL GROUP BY well_id, campaign""", ["cast_samples"])
def step_statistics(spark, sf):
    flat, layout = _clean(spark, sf)
    out = resample.step_statistics(flat, KEYS, "depth_m", layout)
    return settled(out, ["dz_p95", "dz_median", "dz_mean", "dz_min"], KEYS)


@query("prj_01_non_negative_depths", f"SELECT well_id, seq, {r('depth_m')} AS depth_m FROM cast_samples WHERE depth_m >= 0", ["cast_samples"])
def non_negative(spark, sf):
    return settled(clean.drop_negative_depths(cast_samples(spark, sf)), ["depth_m"], ["well_id", "seq"])


@query("prj_02_probe_offset", f"""
SELECT well_id, seq, {r(f'CASE WHEN depth_m >= {C(0.001)} THEN depth_m + {C(0.272)} ELSE depth_m END')} AS depth_m, {r(f'depth_m + {C(0.272)}')} AS depth_all_m FROM cast_samples""", ["cast_samples"])
def probe_offset(spark, sf):
    rows = cast_samples(spark, sf)
    both = clean.adjust_depth(rows.withColumn("all_m", F.col("depth_m")), "all_m", method="YSI")
    return clean.adjust_depth(both).select(
        "well_id", "seq", settle(F.col("depth_m")).alias("depth_m"), settle(F.col("all_m")).alias("depth_all_m")
    )


@query("prj_03_log10", f"SELECT well_id, seq, {r('CASE WHEN sec_us_cm > 300 THEN log10(sec_us_cm - 300) END')} AS log10_sec FROM cast_samples", ["cast_samples"])
def log10_column(spark, sf):
    rows = cast_samples(spark, sf).withColumn("sec_us_cm", F.col("sec_us_cm") - 300)
    return settled(clean.add_log10(rows), ["log10_sec"], ["well_id", "seq"])


# Offsets per well and campaign, for wells with an even user number only.
VADOSE = f"""
vadose AS (SELECT well_id, '2022_02' AS campaign, {C(1)} + {C(0.25)}*(uid % 16) AS vadose_m FROM (
 SELECT DISTINCT concat('W', CAST(user_id // 4 AS VARCHAR), chr(CAST(65 + user_id % 4 AS INT))) AS well_id, user_id AS uid FROM events) t)
"""


def _vadose(spark, sf):
    user = F.col("user_id")
    well = F.concat(F.lit("W"), F.floor(user / 4).cast("string"), F.char(user % 4 + 65))
    return table(spark, sf, "events").select("user_id").distinct().select(
        well.alias("well_id"), F.lit("2022_02").alias("campaign"), (1.0 + 0.25 * (user % 16)).alias("vadose_m")
    )


@query("prj_04_below_ground", "WITH " + VADOSE.strip() + f"""
SELECT c.well_id, seq, {r('depth_m + vadose_m')} AS depth_bgl_m FROM cast_samples c JOIN vadose v USING (well_id, campaign)""", ["cast_samples"])
def below_ground(spark, sf):
    joined = cast_samples(spark, sf).join(_vadose(spark, sf), KEYS)
    return settled(clean.add_below_ground(joined), ["depth_bgl_m"], ["well_id", "seq"])


@query("prj_05_conditional_below_ground", "WITH " + VADOSE.strip() + f"""
SELECT c.well_id, seq, {r('depth_m + vadose_m')} AS depth_bgl_m FROM cast_samples c LEFT JOIN vadose v USING (well_id, campaign)""", ["cast_samples"])
def conditional_below_ground(spark, sf):
    joined = datum.attach_offset(cast_samples(spark, sf), _vadose(spark, sf))
    return settled(clean.add_below_ground(joined), ["depth_bgl_m"], ["well_id", "seq"])


@query("prj_07_conductivity_floor", f"SELECT well_id, seq, {r('sec_us_cm')} AS sec_us_cm FROM cast_samples WHERE sec_us_cm >= 280", ["cast_samples"])
def conductivity_floor(spark, sf):
    return settled(clean.above_floor(cast_samples(spark, sf), floor=280.0), ["sec_us_cm"], ["well_id", "seq"])


@query("agg_01_duplicate_depths", f"SELECT well_id, campaign, {r('depth_m')} AS depth_m, {r('avg(sec_us_cm)')} AS sec_us_cm, count(*) AS frequency FROM cast_samples GROUP BY well_id, campaign, depth_m", ["cast_samples"])
def duplicate_depths(spark, sf):
    rows = cast_samples(spark, sf)
    means = clean.average_duplicates(rows, KEYS)
    report = clean.duplicate_report(rows, KEYS)
    out = means.join(report, [*KEYS, "depth_m"], "left").fillna(1, ["frequency"])
    return settled(out, ["depth_m", "sec_us_cm"], [*KEYS, "frequency"])


BALANCE = """
SELECT well_id, campaign, '{label}' AS stage, max(n) AS max_count, {median} AS median_count, {ratio} AS imbalance, count(*) AS n_bins FROM (
 SELECT well_id, campaign, least(9, CAST(floor((v - lo)/((hi-lo)/CAST(10 AS DOUBLE))) AS BIGINT)) AS b, count(*) AS n FROM (
  SELECT *, min(v) OVER (PARTITION BY well_id, campaign) AS lo, max(v) OVER (PARTITION BY well_id, campaign) AS hi FROM {source}) t GROUP BY ALL) u GROUP BY well_id, campaign"""


@query("agg_10_sampling_balance", CLEAN + GRID + BALANCE.format(
    label="raw", source="(SELECT well_id, campaign, z AS v FROM flat) q", median=r("median(n)"), ratio=r("max(n)/median(n)"),
), ["cast_samples"])
def sampling_balance(spark, sf):
    flat, layout = _clean(spark, sf)
    out = cluster.sampling_balance(flat, KEYS, "depth_m", 10, layout).withColumn("stage", F.lit("raw"))
    return settled(out, ["median_count", "imbalance"], [*KEYS, "stage", "max_count", "n_bins"])


@query("agg_11_profile_diagnostics", CLEAN + f""",
raw AS (SELECT well_id, campaign, count(*) AS n_raw FROM cast_samples GROUP BY well_id, campaign),
cnt AS (SELECT well_id, campaign, count(*) AS n_nn, count(*) FILTER (m IS NULL OR z >= m - {C(0.002)}) AS n_desc FROM mark GROUP BY well_id, campaign),
fl AS (SELECT well_id, campaign, count(*) AS n_flat, min(z) AS z0, max(z) AS z9, min(sec) AS s0, max(sec) AS s9 FROM flat GROUP BY well_id, campaign)
SELECT well_id, campaign, n_raw, coalesce(n_nn, 0) AS n_non_negative, coalesce(n_desc, 0) AS n_descending, coalesce(n_flat, 0) AS n_distinct,
 {r('z0')} AS depth_min, {r('z9')} AS depth_max, {r('s0')} AS sec_min, {r('s9')} AS sec_max, {r('log10(s9) - log10(s0)')} AS log_range
FROM raw LEFT JOIN cnt USING (well_id, campaign) LEFT JOIN fl USING (well_id, campaign)""", ["cast_samples"])
def profile_diagnostics(spark, sf):
    samples = cast_samples(spark, sf)
    layout = layout_of(spark, sf)
    counts = clean.cleaning_counts(samples, KEYS, layout=layout)
    flat = clean.clean_casts(samples, KEYS, layout=layout)
    ranges = flat.groupBy(*KEYS).agg(
        F.min("depth_m").alias("depth_min"), F.max("depth_m").alias("depth_max"),
        F.min("sec_us_cm").alias("sec_min"), F.max("sec_us_cm").alias("sec_max"),
    ).withColumn("log_range", log10_positive(F.col("sec_max")) - log10_positive(F.col("sec_min")))
    out = counts.join(ranges, KEYS, "left")
    return settled(out, ["depth_min", "depth_max", "sec_min", "sec_max", "log_range"],
                   [*KEYS, "n_raw", "n_non_negative", "n_descending", "n_distinct"])


@query("agg_14_site_overlay", "WITH " + VADOSE.strip() + f"""
SELECT site, campaign, count(DISTINCT well_id) AS n_casts, bool_or(vadose_m IS NULL) AS any_fallback,
 bool_or(right(well_id,1)='A') AS has_type_a, bool_or(right(well_id,1)='B') AS has_type_b, {r('min(depth_m + coalesce(vadose_m, 1))')} AS depth_low, {r('max(depth_m + coalesce(vadose_m, 1))')} AS depth_high
FROM cast_samples LEFT JOIN vadose USING (well_id, campaign) GROUP BY site, campaign""", ["cast_samples"])
def site_overlay(spark, sf):
    rows = cast_samples(spark, sf)
    casts = rows.groupBy("site", *KEYS).agg(F.min("depth_m").alias("z0"), F.max("depth_m").alias("z9"))
    casts = datum.attach_offset(casts, _vadose(spark, sf))
    known = F.coalesce(F.col("vadose_m"), F.lit(1.0))
    kind = F.right("well_id", F.lit(1))
    return casts.groupBy("site", "campaign").agg(
        F.count("*").alias("n_casts"), F.bool_or(F.col("vadose_m").isNull()).alias("any_fallback"),
        F.bool_or(kind == "A").alias("has_type_a"), F.bool_or(kind == "B").alias("has_type_b"),
        settle(F.min(F.col("z0") + known)).alias("depth_low"), settle(F.max(F.col("z9") + known)).alias("depth_high"),
    )


@query("smo_01_pchip_resample", CLEAN + PCHIP + f"SELECT well_id, campaign, grid_index, {r('g')} AS depth_m, {r('sec', 5)} AS sec_us_cm FROM pc", ["cast_samples"])
def pchip_resample(spark, sf):
    grid, _ = _grid(spark, sf)
    return grid.select(*KEYS, "grid_index", settle(F.col("depth_m")).alias("depth_m"), settle(F.col("sec_us_cm"), 5).alias("sec_us_cm"))


@query("smo_02_linear_resample", CLEAN + GRID + f""",
kn AS (SELECT *, lead(z) OVER (PARTITION BY well_id, campaign ORDER BY z) AS z1, lead(sec) OVER (PARTITION BY well_id, campaign ORDER BY z) AS s1 FROM flat)
SELECT grid.well_id, grid.campaign, grid_index, {r('g')} AS depth_m, {r('CASE WHEN z1 IS NULL THEN sec ELSE sec + (s1-sec)*(g-z)/(z1-z) END', 5)} AS sec_us_cm
FROM grid ASOF JOIN kn ON grid.well_id = kn.well_id AND grid.campaign = kn.campaign AND grid.g >= kn.z""", ["cast_samples"])
def linear_resample(spark, sf):
    grid, _ = _grid(spark, sf, "linear")
    return grid.select(*KEYS, "grid_index", settle(F.col("depth_m")).alias("depth_m"), settle(F.col("sec_us_cm"), 5).alias("sec_us_cm"))


def _matrix_sql(window, order):
    rows = ", ".join(
        f"({i}, {j}, CAST({float(h)!r} AS DOUBLE))"
        for i, row in enumerate(smooth.hat_matrix(window, order)) for j, h in enumerate(row)
    )
    return f"hat(p, j, h) AS (VALUES {rows})"


SAVGOL = f""",
{_matrix_sql(11, 3)},
ix AS (SELECT *, row_number() OVER (PARTITION BY well_id, campaign ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY well_id, campaign) AS n FROM flat),
st AS (SELECT *, greatest(0, least(i-5, n-11)) AS s FROM ix),
sg AS (SELECT st.well_id, st.campaign, st.z, sum(h*b.sec) AS fit FROM st JOIN hat ON hat.p = st.i - st.s
  JOIN ix b ON b.well_id = st.well_id AND b.campaign = st.campaign AND b.i = st.s + hat.j WHERE st.n >= 11 GROUP BY ALL)
"""


@query("smo_04_savgol", CLEAN + SAVGOL + f"""
SELECT ix.well_id, ix.campaign, {r('ix.z')} AS depth_m, {r('coalesce(fit, sec)', 5)} AS sec_us_cm FROM ix LEFT JOIN sg ON ix.well_id = sg.well_id AND ix.campaign = sg.campaign AND ix.z = sg.z""", ["cast_samples"])
def savgol(spark, sf):
    flat, layout = _clean(spark, sf)
    out = smooth.savgol(flat, KEYS, "depth_m", "sec_us_cm", 10, 3, layout=layout)
    return out.select(*KEYS, settle(F.col("depth_m")).alias("depth_m"), settle(F.col("sec_us_cm"), 5).alias("sec_us_cm"))


def segmented_sql(source, z, v, window, factor, floor):
    """CTEs ending in `seg`: source rows with `fit` where the segmented filter smooths."""
    h, k = window // 2, "well_id, campaign"
    return f"""
{_matrix_sql(window, 3)},
g0 AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {z}) - 1 AS r0, abs(lead({v}) OVER (PARTITION BY {k} ORDER BY {z}) - {v}) AS jump FROM {source}),
gm AS (SELECT {k}, greatest(quantile_cont(jump, 0.5)*{C(factor)}, {C(floor)}) AS lim FROM g0 GROUP BY {k}),
hit AS (SELECT g0.{k.split(', ')[0]}, g0.campaign, r0 AS d FROM g0 JOIN gm USING ({k}) WHERE jump > lim),
g1 AS (SELECT g0.*, EXISTS (SELECT 1 FROM hit WHERE hit.well_id = g0.well_id AND hit.campaign = g0.campaign AND g0.r0 BETWEEN d - {h} AND d + {h} + 1) AS guard FROM g0),
g2 AS (SELECT *, r0 - row_number() OVER (PARTITION BY {k}, guard ORDER BY r0) AS isl FROM g1),
g3 AS (SELECT *, row_number() OVER (PARTITION BY {k}, guard, isl ORDER BY r0) - 1 AS i, count(*) OVER (PARTITION BY {k}, guard, isl) AS n FROM g2),
g4 AS (SELECT *, greatest(0, least(i-{h}, n-{window})) AS s FROM g3),
gf AS (SELECT g4.well_id, g4.campaign, g4.r0, sum(h*b.{v}) AS fit FROM g4 JOIN hat ON hat.p = g4.i - g4.s
  JOIN g3 b ON b.well_id = g4.well_id AND b.campaign = g4.campaign AND b.guard = g4.guard AND b.isl = g4.isl AND b.i = g4.s + hat.j
  WHERE g4.n >= {window} AND NOT g4.guard GROUP BY g4.well_id, g4.campaign, g4.r0),
seg AS (SELECT g3.*, coalesce(gf.fit, g3.{v}) AS fit FROM g3 LEFT JOIN gf USING (well_id, campaign, r0))
"""


@query("smo_05_segmented_savgol", CLEAN + "," + segmented_sql("flat", "z", "sec", 7, 6, 1000) + f"SELECT well_id, campaign, {r('z')} AS depth_m, {r('fit', 5)} AS sec_us_cm FROM seg", ["cast_samples"])
def segmented_savgol(spark, sf):
    flat, layout = _clean(spark, sf)
    out = smooth.segmented_savgol(flat, KEYS, "depth_m", "sec_us_cm", 7, 3, 6.0, 1000.0, layout=layout)
    return out.select(*KEYS, settle(F.col("depth_m")).alias("depth_m"), settle(F.col("sec_us_cm"), 5).alias("sec_us_cm"))


def lowess_sql(source, z, v, frac, passes):
    """CTEs ending in f{passes}: first and robust passes of degree-1 LOWESS."""
    k = "well_id, campaign"
    out = f"""
l0 AS (SELECT {k}, {z} AS x, {v} AS y, row_number() OVER (PARTITION BY {k} ORDER BY {z}, {v}) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {source}),
l1 AS (SELECT *, least(n, greatest(CAST(floor({C(frac)}*n) AS BIGINT), 3)) AS k FROM l0),
lk AS (SELECT a.{k.split(', ')[0]}, a.campaign, a.x + b.x AS sx FROM l1 a JOIN l1 b ON a.well_id = b.well_id AND a.campaign = b.campaign AND b.i = a.i + a.k),
l2 AS (SELECT l1.*, (SELECT count(*) FROM lk WHERE lk.well_id = l1.well_id AND lk.campaign = l1.campaign AND lk.sx < 2*l1.x) AS lo FROM l1),
l3 AS (SELECT l2.well_id, l2.campaign, l2.i, l2.y AS y0, b.i AS j, b.x - l2.x AS dx, b.y, max(abs(b.x - l2.x)) OVER (PARTITION BY l2.well_id, l2.campaign, l2.i) AS reach
  FROM l2 JOIN l2 b ON b.well_id = l2.well_id AND b.campaign = l2.campaign AND b.i >= l2.lo AND b.i < l2.lo + l2.k),
l4 AS (SELECT *, pow(greatest(0, 1 - pow(abs(dx)/CASE WHEN reach > 0 THEN reach ELSE 1 END, 3)), 3) AS w0, dx/CASE WHEN reach > 0 THEN reach ELSE 1 END AS u FROM l3),
r0 AS (SELECT {k}, i AS j, {C(1)} AS rw FROM l0)"""
    for turn in range(passes + 1):
        out += f""",
s{turn} AS (SELECT l4.well_id, l4.campaign, l4.i, max(y0) AS y0, sum(w0*rw) AS s, sum(w0*rw*u) AS su, sum(w0*rw*u*u) AS suu, sum(w0*rw*y) AS sy, sum(w0*rw*u*y) AS suy
  FROM l4 JOIN r{turn} USING (well_id, campaign, j) GROUP BY l4.well_id, l4.campaign, l4.i),
f{turn} AS (SELECT *, CASE WHEN abs(s*suu - su*su) > {C(1e-12)}*s*s THEN (suu*sy - su*suy)/(s*suu - su*su) ELSE y0 END AS fit FROM s{turn})"""
        if turn < passes:
            out += f""",
m{turn} AS (SELECT {k}, 6*quantile_cont(abs(y0 - fit), 0.5) AS spread FROM f{turn} GROUP BY {k}),
r{turn + 1} AS (SELECT {k}, i AS j, pow(greatest(0, 1 - pow((y0 - fit)/spread, 2)), 2) AS rw FROM f{turn} JOIN m{turn} USING ({k}))"""
    return out


@query("smo_06_lowess", CLEAN + "," + lowess_sql("flat", "z", "sec", 0.3, 2) + f"""
SELECT l0.well_id, l0.campaign, {r('x')} AS depth_m, {r('fit', 4)} AS sec_us_cm FROM f2 JOIN l0 USING (well_id, campaign, i)""", ["cast_samples"])
def lowess(spark, sf):
    flat, layout = _clean(spark, sf)
    out = smooth.lowess(flat, KEYS, "depth_m", "sec_us_cm", 0.3, 1, 2, layout=layout)
    return out.select(*KEYS, settle(F.col("depth_m")).alias("depth_m"), settle(F.col("sec_us_cm"), 4).alias("sec_us_cm"))


@query("smo_07_isotonic", CLEAN + f""",
c AS (SELECT *, row_number() OVER (PARTITION BY well_id, campaign ORDER BY z) AS i, sum(sec) OVER (PARTITION BY well_id, campaign ORDER BY z) AS cs FROM flat),
jk AS (SELECT a.well_id, a.campaign, a.i AS j, b.i AS k, (b.cs - a.cs + a.sec)/(b.i - a.i + 1) AS m FROM c a JOIN c b ON a.well_id = b.well_id AND a.campaign = b.campaign AND b.i >= a.i),
mm AS (SELECT well_id, campaign, k AS i, min(m) OVER (PARTITION BY well_id, campaign, j ORDER BY k DESC) AS lo FROM jk),
g AS (SELECT well_id, campaign, i, max(lo) AS fit FROM mm GROUP BY ALL)
SELECT well_id, campaign, {r('z')} AS depth_m, {r('fit', 4)} AS sec_us_cm, abs(fit - sec) > {C(1e-9)} AS was_changed FROM g JOIN c USING (well_id, campaign, i)""", ["cast_samples"])
def isotonic(spark, sf):
    flat, layout = _clean(spark, sf)
    out = smooth.isotonic(flat, KEYS, "depth_m", "sec_us_cm", layout=layout)
    return out.select(*KEYS, settle(F.col("depth_m")).alias("depth_m"), settle(F.col("sec_us_cm"), 4).alias("sec_us_cm"), "was_changed")


# Depths rounded to half a metre, so that several samples share one: their order must follow the values.
TIED = f"""
WITH tied AS (SELECT well_id, campaign, floor(depth_m*{C(2)})/{C(2)} AS z, sec_us_cm AS sec FROM cast_samples)"""


def _tied(spark, sf):
    half = F.floor(F.col("depth_m") * 2.0).cast("double") / 2.0
    return cast_samples(spark, sf).select(*KEYS, half.alias("z"), F.col("sec_us_cm").alias("sec"))


@query("smo_07_tied_depths", TIED + f""",
c AS (SELECT *, row_number() OVER w AS i, sum(sec) OVER (w ROWS UNBOUNDED PRECEDING) AS cs FROM tied WINDOW w AS (PARTITION BY well_id, campaign ORDER BY z, sec)),
jk AS (SELECT a.well_id, a.campaign, a.i AS j, b.i AS k, (b.cs - a.cs + a.sec)/(b.i - a.i + 1) AS m FROM c a JOIN c b ON a.well_id = b.well_id AND a.campaign = b.campaign AND b.i >= a.i),
mm AS (SELECT well_id, campaign, k AS i, min(m) OVER (PARTITION BY well_id, campaign, j ORDER BY k DESC) AS lo FROM jk),
g AS (SELECT well_id, campaign, i, max(lo) AS fit FROM mm GROUP BY ALL)
SELECT well_id, campaign, {r('z')} AS depth_m, {r('sec')} AS sec_us_cm, {r('fit', 4)} AS fit_us_cm FROM g JOIN c USING (well_id, campaign, i)""", ["cast_samples"])
def isotonic_tied(spark, sf):
    """Monotone fit where depths repeat."""
    out = smooth.isotonic(_tied(spark, sf), KEYS, "z", "sec", out="fit", layout=layout_of(spark, sf))
    return out.select(*KEYS, settle(F.col("z")).alias("depth_m"), settle(F.col("sec")).alias("sec_us_cm"), settle(F.col("fit"), 4).alias("fit_us_cm"))


@query("smo_06_tied_depths", TIED + "," + lowess_sql("tied", "z", "sec", 0.4, 1) + f"""
SELECT l0.well_id, l0.campaign, {r('x')} AS depth_m, {r('y')} AS sec_us_cm, {r('fit', 3)} AS fit_us_cm FROM f1 JOIN l0 USING (well_id, campaign, i)""", ["cast_samples"])
def lowess_tied(spark, sf):
    """LOWESS where depths repeat, also all those of a window."""
    out = smooth.lowess(_tied(spark, sf), KEYS, "z", "sec", 0.4, 1, 1, out="fit", layout=layout_of(spark, sf))
    return out.select(*KEYS, settle(F.col("z")).alias("depth_m"), settle(F.col("sec")).alias("sec_us_cm"), settle(F.col("fit"), 3).alias("fit_us_cm"))


@query("smo_08_savgol_profiles", CLEAN + PCHIP + "," + segmented_sql("pc", "g", "sec", 11, 20, 1000) + f"""
SELECT well_id, campaign, grid_index, {r('g')} AS depth_m, {r('fit', 4)} AS sec_us_cm, {r('CASE WHEN fit > 0 THEN log10(fit) END')} AS log10_sec FROM seg""", ["cast_samples"])
def savgol_profiles(spark, sf):
    out = smooth.savgol_profiles(cast_samples(spark, sf), KEYS, layout=layout_of(spark, sf))
    return out.select(*KEYS, "grid_index", settle(F.col("depth_m")).alias("depth_m"),
                      settle(F.col("sec_us_cm"), 4).alias("sec_us_cm"), settle(F.col("log10_sec")).alias("log10_sec"))


@query("smo_09_lowess_profiles", CLEAN + PCHIP + "," + lowess_sql("pc", "g", "sec", 0.3, 2) + f""",
c AS (SELECT well_id, campaign, x, fit AS sec, row_number() OVER w AS i, sum(fit) OVER w AS cs FROM f2 JOIN l0 USING (well_id, campaign, i) WINDOW w AS (PARTITION BY well_id, campaign ORDER BY x)),
jk AS (SELECT a.well_id, a.campaign, a.i AS j, b.i AS k, (b.cs - a.cs + a.sec)/(b.i - a.i + 1) AS m FROM c a JOIN c b ON a.well_id = b.well_id AND a.campaign = b.campaign AND b.i >= a.i),
mm AS (SELECT well_id, campaign, k AS i, min(m) OVER (PARTITION BY well_id, campaign, j ORDER BY k DESC) AS lo FROM jk),
g9 AS (SELECT well_id, campaign, i, max(lo) AS fit FROM mm GROUP BY ALL)
SELECT well_id, campaign, i - 1 AS grid_index, {r('x')} AS depth_m, {r('CASE WHEN fit > 0 THEN log10(fit) END', 5)} AS log10_sec FROM g9 JOIN c USING (well_id, campaign, i)""", ["cast_samples"])
def lowess_profiles(spark, sf):
    out = smooth.lowess_profiles(cast_samples(spark, sf), KEYS, frac=0.3, layout=layout_of(spark, sf))
    return out.select(*KEYS, "grid_index", settle(F.col("depth_m")).alias("depth_m"), settle(F.col("log10_sec"), 5).alias("log10_sec"))


@query("smo_10_window_sensitivity")
def window_sensitivity(spark, sf):
    grid, layout = _grid(spark, sf)
    out = smooth.window_sensitivity(
        grid, KEYS, (7, 11, 15), layout=layout
    )
    return settled(out, ["depth_median", "cluster_diameter_m"], [*KEYS, "window", "cluster_id", "persistence", "n_bp_total"])


def _smoothed(spark, sf):
    return smooth.savgol_profiles(cast_samples(spark, sf), KEYS, layout=layout_of(spark, sf))


@query("bps_01_model_sweep")
def model_sweep(spark, sf):
    fits = sweep.sweep(_smoothed(spark, sf), KEYS, layout=layout_of(spark, sf))
    return fits.select(*KEYS, "trial", "n_breakpoints", "converged", "status", "rss", "bic")


@query("bps_01_straight_lines", CLEAN + f""",
ln AS (SELECT well_id, campaign, regr_slope(log10(sec), z) AS b, regr_intercept(log10(sec), z) AS a, count(*) AS n, count(DISTINCT sec) AS ns FROM flat WHERE sec > 0 GROUP BY well_id, campaign),
rs AS (SELECT well_id, campaign, max(a) AS a, max(b) AS b, max(n) AS n, sum(pow(log10(sec) - a - b*z, 2)) AS rss FROM flat JOIN ln USING (well_id, campaign) WHERE sec > 0 GROUP BY well_id, campaign)
SELECT well_id, campaign, n AS n_obs, {r('a', 5)} AS const, {r('b', 5)} AS alpha1, {r('rss', 5)} AS rss, {r('n*ln(rss/n) + 2*ln(n)', 4)} AS bic FROM rs WHERE n >= 3""", ["cast_samples"])
def straight_lines(spark, sf):
    flat, layout = _clean(spark, sf)
    fits = sweep.sweep(clean.add_log10(flat), KEYS, sizes=(0,), trials=1, layout=layout).where("converged")
    five = [settle(F.col(c), 5).alias(c) for c in ("const", "alpha1", "rss")]
    return fits.select(*KEYS, "n_obs", *five, settle(F.col("bic"), 4).alias("bic"))


@query("bps_11_warm_refit")
def warm_refit(spark, sf):
    smoothed = _smoothed(spark, sf)
    fits = sweep.sweep(smoothed, KEYS, layout=layout_of(spark, sf))
    return sweep.refit(smoothed, fits, KEYS, layout=layout_of(spark, sf)).select(*KEYS, "trial", "n_breakpoints", "converged", "rss")


def proof_sql(source, keys, trials=3, most=10):
    """One row per profile, trial and size: what plain regression knows of it, and that its fit must prove itself.

    `source` has x and y.  Every fit must be certified: breakpoints in order, normal equations, residual sum, BIC.
    """
    return f"""
shape AS (SELECT {keys}, count(*) AS n, max(x) > min(x) AND max(y) > min(y) AS bent,
  greatest(regr_syy(y, x) - coalesce(regr_sxy(y, x)*regr_sxy(y, x)/nullif(regr_sxx(y, x), 0), 0), 0) AS line FROM {source} GROUP BY {keys}),
sizes AS (SELECT t, k FROM range(1, {trials + 1}) a(t), range(0, {most + 1}) b(k))
SELECT {keys}, concat('trial_', CAST(t AS VARCHAR)) AS trial, CAST(k AS INT) AS n_breakpoints, n AS n_obs, n >= 2*k + 3 AND bent AS possible,
  {r('line', 4)} AS line_rss, true AS certified FROM shape, sizes"""


def _kept(fits):
    """Fits written once: their proof reads them more than once, and would run the sweep again each time."""
    return fits.sparkSession.read.parquet(stored(fits, "parquet"))


def _proved(certified, keys):
    return certified.select(*keys, "trial", "n_breakpoints", "n_obs", "possible", settle(F.col("line_rss"), 4).alias("line_rss"), "certified")


_SMOOTHED = CLEAN + PCHIP + "," + segmented_sql("pc", "g", "sec", 11, 20, 1000) + """,
xy AS (SELECT well_id, campaign, g AS x, log10(fit) AS y FROM seg WHERE fit > 0)"""


@query("bps_01_certified_sweep", _SMOOTHED + "," + proof_sql("xy", "well_id, campaign"), ["cast_samples"])
def certified_sweep(spark, sf):
    """Every fit of the sweep with its proof."""
    profiles, layout = stored(_smoothed(spark, sf), "parquet"), layout_of(spark, sf)
    profiles = spark.read.parquet(profiles)
    return _proved(certificate.certify(profiles, _kept(sweep.sweep(profiles, KEYS, layout=layout)), KEYS), KEYS)


@query("bps_11_certified_refit", _SMOOTHED + "," + proof_sql("xy", "well_id, campaign"), ["cast_samples"])
def certified_refit(spark, sf):
    """Warm refits of all converged fits: proved, and no worse than what they began from; the others prove that there is nothing."""
    profiles, layout = spark.read.parquet(stored(_smoothed(spark, sf), "parquet")), layout_of(spark, sf)
    fits = _kept(sweep.sweep(profiles, KEYS, layout=layout))
    again = _kept(sweep.refit(profiles, fits, KEYS, layout=layout))
    names = [*KEYS, "trial", "seed", "n_breakpoints"]
    begun = fits.where("converged").select(*names, F.col("rss").alias("begun"))
    both = again.join(begun, names).withColumn("kept", F.col("converged") & (F.col("rss") <= F.col("begun") * (1 + 1e-3) + 1e-9))
    rest = fits.where("NOT converged").withColumn("kept", F.lit(True))
    proved = certificate.certify(profiles, both.drop("begun").unionByName(rest), KEYS)
    return _proved(proved.withColumn("certified", F.col("certified") & F.col("kept")), KEYS)


WINDOWS = (7, 11, 15)


def _windows_sql():
    """CTEs ending in xy: the resampled profiles smoothed with every window."""
    out = "ix AS (SELECT *, row_number() OVER (PARTITION BY well_id, campaign ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY well_id, campaign) AS n FROM pc)"
    parts = []
    for w in WINDOWS:
        out += f""",
{_matrix_sql(w, 3).replace('hat(', f'hat{w}(', 1)},
st{w} AS (SELECT *, greatest(0, least(i - {w // 2}, n - {w})) AS s FROM ix),
sg{w} AS (SELECT a.well_id, a.campaign, a.g, sum(h*b.sec) AS fit FROM st{w} a JOIN hat{w} ON hat{w}.p = a.i - a.s
  JOIN ix b ON b.well_id = a.well_id AND b.campaign = a.campaign AND b.i = a.s + hat{w}.j WHERE a.n >= {w} GROUP BY ALL)"""
        parts.append(f"SELECT ix.well_id, ix.campaign, {w} AS window, ix.g AS x, coalesce(fit, sec) AS v FROM ix LEFT JOIN sg{w} ON ix.well_id = sg{w}.well_id AND ix.campaign = sg{w}.campaign AND ix.g = sg{w}.g")
    return out + ", xy AS (SELECT well_id, campaign, \"window\", x, log10(v) AS y FROM (" + " UNION ALL ".join(parts).replace("AS window", 'AS "window"') + ") u WHERE v > 0)"


@query("smo_10_certified_windows", CLEAN + PCHIP + "," + _windows_sql() + "," + proof_sql("xy", 'well_id, campaign, "window"', 1, 6), ["cast_samples"])
def certified_windows(spark, sf):
    """The fits of the window scan with their proofs."""
    grid, layout = _grid(spark, sf)
    group = [*KEYS, "window"]
    profiles = spark.read.parquet(stored(smooth.window_profiles(grid, KEYS, WINDOWS, layout=layout), "parquet"))
    fits = _kept(sweep.sweep(profiles, group, max_breakpoints=6, trials=1, layout=layout))
    return _proved(certificate.certify(profiles, fits, group), group)


@query("smo_10_stored_fits", """
WITH stored AS (SELECT well_id, CASE trial WHEN 'trial_1' THEN 7 WHEN 'trial_2' THEN 11 ELSE 15 END AS w, n_breakpoints, psis FROM fits WHERE converged),
rec AS (SELECT well_id, w, n_breakpoints, p, psis[p] AS depth FROM (SELECT *, unnest(range(1, n_breakpoints + 1)) AS p FROM stored) t),
gap AS (SELECT *, CASE WHEN depth - lag(depth) OVER v >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS opens FROM rec
  WINDOW v AS (PARTITION BY well_id, w ORDER BY depth, n_breakpoints, p)),
cl AS (SELECT *, sum(opens) OVER (PARTITION BY well_id, w ORDER BY depth, n_breakpoints, p ROWS UNBOUNDED PRECEDING) AS c FROM gap)
SELECT well_id, w AS "window", CAST(c AS INT) AS cluster_id, """ + f"{r('quantile_cont(depth, 0.5)')} AS depth_median, {r('max(depth) - min(depth)')} AS cluster_diameter_m," + """
  count(DISTINCT n_breakpoints) AS persistence, count(*) AS n_bp_total FROM cl GROUP BY well_id, w, c""", ["fits"])
def stored_windows(spark, sf):
    """The window scan's clusters from saved fits: each trial stands for the window it was smoothed with."""
    saved = fits(spark, sf).withColumn("window", F.when(F.col("trial") == "trial_1", 7).when(F.col("trial") == "trial_2", 11).otherwise(15))
    out = smooth.window_robustness(saved, ["well_id"], layout=sized(spark, sf, "fits"))
    return settled(out, ["depth_median", "cluster_diameter_m"], ["well_id", "window", "cluster_id", "persistence", "n_bp_total"])


@query("bps_07_profile_accessor", CLEAN + "," + VADOSE.strip() + f"""
SELECT f.well_id, f.campaign, {r('z')} AS depth_m, {r('sec', 5)} AS sec_us_cm, {r('z + vadose_m')} AS depth_bgl_m FROM flat f LEFT JOIN vadose v ON f.well_id = v.well_id AND f.campaign = v.campaign""", ["cast_samples"])
def profile_accessor(spark, sf):
    flat, _ = _clean(spark, sf)
    rows = datum.attach_offset(flat, _vadose(spark, sf))
    out = clean.add_below_ground(rows)
    return out.select(*KEYS, settle(F.col("depth_m")).alias("depth_m"), settle(F.col("sec_us_cm"), 5).alias("sec_us_cm"),
                      settle(F.col("depth_bgl_m")).alias("depth_bgl_m"))

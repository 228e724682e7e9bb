"""Datum, ledger, catalogue, note and resistivity queries, and the file round trips."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import settle
from plumbline.operators import catalogue, datum, ert, geometry, ledger, notes as note_ops, sweep
from plumbline.sources import names, publish, readers, sinks
from plumbline.workload import views
from plumbline.workload.registry import query, r
from plumbline.workload.views import breakpoints, cast_samples, ert_samples, fits, shared_folder, stored, table

C = "CAST({} AS DOUBLE)".format


def settled(df, reals, others=()):
    return df.select(*others, *[settle(F.col(c)).alias(c) for c in reals])


# ---- datum: a cast per (user, day); ground depth is offset by a well constant, with faults

OFFSETS = f"""
cs AS (SELECT site, well_id, campaign, CAST(seq // 20 AS BIGINT) AS cast_no, depth_m, CASE WHEN seq // 20 = 2 THEN NULL ELSE depth_m + {C(1)} + {C(0.5)}*length(well_id) + CASE WHEN seq // 20 = 1 THEN seq*{C(0.01)} ELSE 0 END END AS gl FROM cast_samples),
ex AS (SELECT site, well_id, campaign, cast_no, quantile_cont(gl - depth_m, 0.5) AS offset_m, stddev_pop(gl - depth_m) AS sd, count(gl - depth_m) AS n, count(gl) AS ng FROM cs GROUP BY ALL),
st AS (SELECT *, CASE WHEN ng = 0 THEN 'missing_ground_depth' WHEN sd > {C(0.01)} THEN 'inconsistent' ELSE 'ok' END AS offset_status FROM ex)
"""
CAST_KEYS = ["site", "well_id", "campaign", "cast_no"]


def _ground_casts(spark, sf):
    rows = cast_samples(spark, sf)
    number = F.floor(F.col("seq") / 20)
    drift = F.when(number == 1, F.col("seq") * 0.01).otherwise(0.0)
    ground = F.col("depth_m") + 1.0 + 0.5 * F.length("well_id") + drift
    return rows.select(
        "site", "well_id", "campaign", number.alias("cast_no"), "depth_m",
        F.when(number != 2, ground).alias("depth_gl_m"),
    )


def _offsets(spark, sf):
    return datum.extract_offsets(_ground_casts(spark, sf), CAST_KEYS, layout=views.sized(spark, sf, "cast_samples"))


@query("dat_01_extracted_offsets", "WITH " + OFFSETS.strip() + f"SELECT site, well_id, campaign, cast_no, {r('offset_m')} AS offset_m, {r('sd')} AS offset_std_m, n AS n_samples, offset_status FROM st", ["cast_samples"])
def extracted_offsets(spark, sf):
    return settled(_offsets(spark, sf), ["offset_m", "offset_std_m"], [*CAST_KEYS, "n_samples", "offset_status"])


@query("dat_02_trimmed_aliases", f"SELECT well_id, seq, {r('depth_m + 1')} AS depth_gl_m, {r('depth_m')} AS vertical_m FROM cast_samples", ["cast_samples"])
def trimmed_aliases(spark, sf):
    raw = cast_samples(spark, sf).select(
        "well_id", "seq", (F.col("depth_m") + 1).alias(" DEPTH FROM GL (M) "), F.col("depth_m").alias("vertical position M")
    )
    pick = lambda concept: F.col(f"`{readers.resolve_column(raw.columns, concept, readers.DATUM_ALIASES, trim=True)}`")
    return raw.select("well_id", "seq", settle(pick("ground_depth")).alias("depth_gl_m"), settle(pick("vertical")).alias("vertical_m"))


@query("dat_03_latest_cast", "WITH " + OFFSETS.strip() + """
SELECT site, well_id, campaign, max(cast_no) AS cast_no, arg_max(offset_status, cast_no) AS offset_status FROM st GROUP BY site, well_id, campaign""", ["cast_samples"])
def latest_cast(spark, sf):
    out = datum.latest_cast(_offsets(spark, sf), ["site", "well_id", "campaign"], "cast_no", "offset_status")
    return out.select("site", "well_id", "campaign", "cast_no", "offset_status")


META = f"SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '2022_02' ELSE '2022_08' END AS campaign, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {C(1)} + {C(0.25)}*(c_custkey % 12) END AS vadose_m, CASE WHEN c_acctbal < 1000 THEN 'manual' ELSE 'computed' END AS source FROM customer"


def _metadata(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("M"), F.floor(key / 4).cast("string")).alias("site"), F.char(key % 4 + 65).alias("well_type"),
        F.when(key % 2 == 0, "2022_02").otherwise("2022_08").alias("campaign"),
        F.when(key % 5 != 0, 1.0 + 0.25 * (key % 12)).alias("vadose_m"),
        F.when(F.col("c_acctbal") < 1000, "manual").otherwise("computed").alias("source"),
    )


WELL = "concat('M', CAST(c_custkey // 4 AS VARCHAR), chr(CAST(65 + c_custkey % 4 AS INT)))"


@query("src_11_well_metadata", f"SELECT {WELL} AS well_id, {r('vadose_m')} AS vadose_m, source FROM ({META}) t")
def well_metadata(spark, sf):
    return settled(datum.well_metadata(_metadata(spark, sf)), ["vadose_m"], ["well_id", "source"])


@query("dat_04_default_campaign", f"SELECT {WELL} AS well_id, '2022_02' AS campaign FROM ({META}) t")
def default_campaign(spark, sf):
    old = _metadata(spark, sf).drop("campaign")
    return datum.well_metadata(datum.with_campaign(old)).select("well_id", "campaign")


@query("dat_05_extraction_issues", "WITH " + OFFSETS.strip() + """,
seen AS (SELECT DISTINCT concat(well_id, '-', CAST(cast_no AS VARCHAR)) AS file, CASE WHEN cast_no = 3 THEN NULL ELSE site END AS site, offset_status FROM st)
SELECT file, CASE WHEN site IS NULL THEN 'unparseable_name' ELSE offset_status END AS reason FROM seen WHERE site IS NULL OR offset_status <> 'ok'""", ["cast_samples"])
def extraction_issues(spark, sf):
    found = _offsets(spark, sf).withColumn("file", F.concat("well_id", F.lit("-"), F.col("cast_no").cast("string")))
    seen = found.select("file", F.when(F.col("cast_no") != 3, F.col("site")).alias("site"), "campaign")
    return datum.extraction_issues(seen, found.select("file", "offset_status"), "file")


UPSERT = f"""
WITH old AS (SELECT {WELL} AS well_id, campaign, vadose_m, source FROM ({META}) t WHERE c_mktsegment <> 'MACHINERY'),
new AS (SELECT {WELL} AS well_id, campaign, {C(9)} + c_custkey % 7 AS v, CASE c_custkey % 5 WHEN 0 THEN 'no_samples' WHEN 1 THEN 'inconsistent' ELSE 'ok' END AS st FROM ({META}) t WHERE c_mktsegment <> 'BUILDING'),
j AS (SELECT coalesce(old.well_id, new.well_id) AS well_id, coalesce(old.campaign, new.campaign) AS campaign, old.vadose_m AS o, old.source AS os, old.well_id IS NOT NULL AS has, v,
  coalesce(old.source = 'manual', false) AND old.vadose_m IS NOT NULL AS man FROM old FULL JOIN (SELECT * FROM new WHERE st IN ('ok', 'inconsistent')) new ON old.well_id = new.well_id AND old.campaign = new.campaign)
SELECT well_id, campaign, {r('coalesce(v, o)')} AS vadose_m, CASE WHEN v IS NOT NULL THEN 'computed' ELSE os END AS source,
 CASE WHEN NOT has THEN 'added' WHEN v IS NOT NULL THEN 'updated' WHEN man THEN 'kept_manual' ELSE 'kept' END AS action FROM j"""


def _upsert_sides(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    well = F.concat(F.lit("M"), F.floor(F.col("c_custkey") / 4).cast("string"), F.char(F.col("c_custkey") % 4 + 65))
    wells = datum.well_metadata(_metadata(spark, sf)).join(customers.withColumn("well_id", well), "well_id")
    extracted = wells.where("c_mktsegment <> 'BUILDING'").select(
        "well_id", "campaign", (9.0 + F.col("c_custkey") % 7).alias("vadose_m"),
        F.when(F.col("c_custkey") % 5 == 0, "no_samples").when(F.col("c_custkey") % 5 == 1, "inconsistent")
        .otherwise("ok").alias("offset_status"),
    )
    existing = wells.where("c_mktsegment <> 'MACHINERY'").select("well_id", "campaign", "vadose_m", "source")
    return existing, extracted


def _upserted(spark, sf):
    return datum.upsert_offsets(*_upsert_sides(spark, sf), ["well_id", "campaign"])


@query("dat_06_metadata_upsert", UPSERT)
def metadata_upsert(spark, sf):
    return settled(_upserted(spark, sf), ["vadose_m"], ["well_id", "campaign", "source", "action"])


@query("snk_05_metadata_rewrite", UPSERT)
def metadata_rewrite(spark, sf):
    folder = shared_folder(spark)
    sinks.write_table(_upserted(spark, sf), folder)
    return settled(spark.read.parquet(folder), ["vadose_m"], ["well_id", "campaign", "source", "action"])


@query("snk_05_published_upsert", UPSERT)
def published_upsert(spark, sf):
    """The metadata table replaced by an upsert over itself."""
    store = shared_folder(spark)
    existing, extracted = _upsert_sides(spark, sf)
    publish.publish(spark, store, replace={"metadata": existing})
    before = publish.read_published(spark, store, "metadata")
    publish.publish(spark, store, replace={"metadata": datum.upsert_offsets(before, extracted, ["well_id", "campaign"])})
    back = publish.read_published(spark, store, "metadata")
    return settled(back, ["vadose_m"], ["well_id", "campaign", "source", "action"])


@query("jon_06_resolved_offsets", "WITH " + OFFSETS.strip() + f""",
req AS (SELECT well_id, campaign, max(cast_no) AS last_cast FROM st GROUP BY well_id, campaign),
exp AS (SELECT DISTINCT well_id, CASE WHEN length(well_id) % 2 = 0 THEN campaign ELSE '2022_02' END AS campaign, {C(3)} + length(well_id) AS v FROM st WHERE right(well_id, 1) IN ('A', 'C')),
cmp AS (SELECT well_id, campaign, offset_m FROM st WHERE cast_no = 0 AND offset_status = 'ok' AND site NOT LIKE '%3'),
f AS (SELECT well_id, v FROM exp WHERE campaign = '2022_02')
SELECT req.well_id, req.campaign, {r('coalesce(exp.v, offset_m, f.v)')} AS vadose_m, CASE WHEN exp.v IS NOT NULL THEN 'explicit' WHEN offset_m IS NOT NULL THEN 'computed' WHEN f.v IS NOT NULL THEN 'fallback' ELSE 'unresolved' END AS vadose_source,
 exp.v IS NULL AND offset_m IS NULL AND f.v IS NOT NULL AS is_fallback
FROM req LEFT JOIN exp ON exp.well_id = req.well_id AND exp.campaign = req.campaign LEFT JOIN cmp ON cmp.well_id = req.well_id AND cmp.campaign = req.campaign LEFT JOIN f ON f.well_id = req.well_id""", ["cast_samples"])
def resolved_offsets(spark, sf):
    found = _offsets(spark, sf)
    requests = found.select("well_id", "campaign").distinct()
    campaign = F.when(F.length("well_id") % 2 == 0, F.col("campaign")).otherwise("2022_02")
    explicit = found.where(F.right("well_id", F.lit(1)).isin("A", "C")).select(
        "well_id", campaign.alias("campaign"), (3.0 + F.length("well_id")).alias("vadose_m")
    ).distinct()
    computed = found.where("cast_no = 0 and site not like '%3'")
    out = datum.resolve_offsets(requests, explicit, computed, "2022_02")
    return settled(out, ["vadose_m"], ["well_id", "campaign", "vadose_source", "is_fallback"])


@query("jon_07_offset_by_campaign", f"""
WITH m AS (SELECT concat('S', CAST(c_custkey AS VARCHAR)) AS well_id, campaign, vadose_m FROM ({META}) t)
SELECT f.well_id, f.campaign, f.trial, f.n_breakpoints, {r('vadose_m')} AS vadose_m FROM fits f LEFT JOIN m USING (well_id, campaign)""", ["fits"])
def offset_by_campaign(spark, sf):
    key = F.col("c_custkey")
    meta = table(spark, sf, "customer").select(
        F.concat(F.lit("S"), key.cast("string")).alias("well_id"),
        F.when(key % 2 == 0, "2022_02").otherwise("2022_08").alias("campaign"),
        F.when(key % 5 != 0, 1.0 + 0.25 * (key % 12)).alias("vadose_m"),
    )
    return settled(datum.attach_offset(fits(spark, sf), meta), ["vadose_m"], ["well_id", "campaign", "trial", "n_breakpoints"])


# ---- ledger: one entry per order

LEDGER = """
lg AS (SELECT concat('run', CAST(o_orderkey AS VARCHAR)) AS run_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE WHEN o_orderstatus = 'F' THEN 'sweep' ELSE 'smooth' END AS stage,
 concat('S', CAST(o_custkey AS VARCHAR)) AS well_id, CASE o_orderkey % 3 WHEN 0 THEN 'savgol' WHEN 1 THEN 'lowess' ELSE 'raw' END AS method, o_orderkey % 20 + 5 AS window, o_orderkey % 3 + 1 AS passes FROM orders)
"""


def _ledger(spark, sf):
    key = F.col("o_orderkey")
    method = F.when(key % 3 == 0, "savgol").when(key % 3 == 1, "lowess").otherwise("raw")
    window, passes = key % 20 + 5, key % 3 + 1
    params = ledger.canonical_params({"window": window, "method": method, "passes": passes})
    return table(spark, sf, "orders").select(
        F.concat(F.lit("run"), key.cast("string")).alias("run_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "F", "sweep").otherwise("smooth").alias("stage"),
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("well_id"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"),
        ledger.method_signature(method, window, F.lit(3), F.lit("0.05"), passes).alias("method_signature"),
        F.concat(F.lit("in-"), key.cast("string")).alias("input_file"), F.concat(F.lit("out-"), key.cast("string")).alias("output_file"),
        params.alias("params_json"), F.lit("").alias("notes"),
    )


@query("prj_14_parameter_ids", "WITH " + LEDGER.strip() + """
SELECT run_id, params_json, substr(sha1(params_json), 1, 8) AS short_id FROM (
 SELECT run_id, concat('{"method":"', method, '","passes":', CAST(passes AS VARCHAR), ',"window":', CAST("window" AS VARCHAR), '}') AS params_json FROM lg) t""")
def parameter_ids(spark, sf):
    return _ledger(spark, sf).select("run_id", "params_json", ledger.run_id(F.col("params_json")).alias("short_id"))


@query("prj_15_method_signature", "WITH " + LEDGER.strip() + """
SELECT run_id, CASE method WHEN 'savgol' THEN concat('savgol_w', CAST("window" AS VARCHAR), '_p3') WHEN 'lowess' THEN concat('lowess_f0.05_it', CAST(passes AS VARCHAR)) ELSE concat('raw_frac0.05_order3_passes', CAST(passes AS VARCHAR), '_window', CAST("window" AS VARCHAR)) END AS method_signature,
 CASE method WHEN 'savgol' THEN concat('breakpoints_n', CAST(passes AS VARCHAR), CASE WHEN "window" > 12 THEN '_segmented' ELSE '' END) ELSE concat(CASE method WHEN 'lowess' THEN 'convergence_d0.5' ELSE 'raw_delta0.5_size' || CAST(passes AS VARCHAR) END, CASE WHEN "window" > 12 THEN '_segmented' ELSE '' END) END AS stage_signature,
 concat(well_id, '_', stage, '_', method, '.csv') AS output_name FROM lg""")
def method_signature(spark, sf):
    method = F.split_part("method_signature", F.lit("_"), F.lit(1))
    wide, number = F.get_json_object("params_json", "$.window").cast("int") > 12, F.get_json_object("params_json", "$.passes")
    kind = F.when(method == "savgol", "breakpoints").when(method == "lowess", "convergence").otherwise(method)
    return _ledger(spark, sf).select(
        "run_id", "method_signature",
        ledger.method_signature(kind, size=number, delta=F.lit("0.5"), segmented=wide).alias("stage_signature"),
        ledger.output_filename(F.col("well_id"), F.lit(None).cast("string"), method, F.col("stage")).alias("output_name"),
    )


@query("prj_16_name_repair", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y_%m') ELSE strftime(o_orderdate, '%Y_%m') END AS campaign,
 CASE WHEN o_orderkey % 7 = 6 THEN 1 ELSE CAST(o_orderkey % 7 AS INT) END AS trial_index FROM orders""")
def name_repair(spark, sf):
    key = F.col("o_orderkey")
    month = F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyy_MM"))
    number = (key % 7).cast("string")
    trial = (
        F.when(key % 7 == 6, "final").when(key % 7 > 3, number)
        .otherwise(F.concat(F.when(key % 2 == 0, "trial_").otherwise("x_"), number))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", catalogue.normalise_campaign(month).alias("campaign"), catalogue.trial_index(trial).alias("trial_index")
    )


@query("src_20_ledger_scan", "WITH " + LEDGER.strip() + "SELECT stage, count(*) AS n_runs, min(timestamp) AS first_run, max(timestamp) AS last_run FROM lg GROUP BY stage")
def ledger_scan(spark, sf):
    rows = readers.read_table(spark, stored(_ledger(spark, sf), "parquet"), ledger.LEDGER_COLUMNS, "ledger")
    return rows.groupBy("stage").agg(F.count("*").alias("n_runs"), F.min("timestamp").alias("first_run"), F.max("timestamp").alias("last_run"))


@query("src_24_latest_artefact", "WITH " + LEDGER.strip() + """
SELECT well_id, stage, run_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY well_id, stage ORDER BY timestamp DESC, run_id DESC) AS k FROM lg) t WHERE k = 1""")
def latest_artefact(spark, sf):
    return ledger.latest_artefact(_ledger(spark, sf), ["well_id", "stage"]).select("well_id", "stage", "run_id", "timestamp")


@query("snk_04_ledger_append", "WITH " + LEDGER.strip() + "SELECT stage, method, count(*) AS n_runs FROM lg GROUP BY stage, method")
def ledger_append(spark, sf):
    folder, entries = shared_folder(spark), _ledger(spark, sf)
    output = entries.groupBy("well_id").agg(F.count("*").alias("n"))
    ledger.write_and_register(output, f"{folder}/output", entries.where("stage = 'sweep'"), f"{folder}/ledger")
    ledger.append_run(entries.where("stage = 'smooth'"), f"{folder}/ledger")
    method = F.split_part("method_signature", F.lit("_"), F.lit(1))
    return spark.read.parquet(f"{folder}/ledger").groupBy("stage", method.alias("method")).agg(F.count("*").alias("n_runs"))


@query("snk_04_published_runs", "WITH " + LEDGER.strip() + """
SELECT stage, method, count(*) AS n_runs FROM lg GROUP BY stage, method UNION ALL SELECT 'output', NULL, count(DISTINCT well_id) FROM lg""")
def published_runs(spark, sf):
    """Results and their ledger rows as versions of one store."""
    store, entries = shared_folder(spark), _ledger(spark, sf)
    output = entries.groupBy("well_id").agg(F.count("*").alias("n"))
    ledger.publish_run(spark, store, "output", output, entries.where("stage = 'sweep'"))
    ledger.publish_run(spark, store, "output", output, entries.where("stage = 'smooth'"))
    method = F.split_part("method_signature", F.lit("_"), F.lit(1))
    runs = publish.read_published(spark, store, "ledger").groupBy("stage", method.alias("method")).agg(F.count("*").alias("n_runs"))
    kept = publish.read_published(spark, store, "output")
    return runs.unionByName(kept.agg(F.lit("output").alias("stage"), F.lit(None).cast("string").alias("method"), F.count_distinct("well_id").alias("n_runs")))


# ---- catalogue

@query("src_22_available_runs", """
WITH p AS (SELECT DISTINCT '2022_02' AS campaign, concat('S', CAST(c_custkey AS VARCHAR)) AS well_id, 'savgol' AS smoothing FROM customer),
s AS (SELECT campaign, well_id, smoothing, max(n_breakpoints) AS max_n, count(DISTINCT trial) AS n_trials FROM fits GROUP BY ALL)
SELECT p.*, max_n, coalesce(n_trials, 0) AS n_trials, max_n IS NOT NULL AS has_sweep FROM p LEFT JOIN s USING (campaign, well_id, smoothing)""", ["fits"])
def available_runs(spark, sf):
    profiles = table(spark, sf, "customer").select(
        F.lit("2022_02").alias("campaign"), F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("well_id"), F.lit("savgol").alias("smoothing")
    )
    return catalogue.available_runs(profiles, fits(spark, sf))


@query("src_23_missing_parts", """
WITH w AS (SELECT c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k, bool_or(o_orderstatus='F') AS f, bool_or(o_orderstatus='O') AS o, bool_or(o_orderstatus='P') AS p FROM orders GROUP BY 1),
j AS (SELECT w.k, coalesce(f, false) AS f, coalesce(o, false) AS o, coalesce(p, false) AS p FROM w LEFT JOIN o USING (k))
SELECT k AS well, concat_ws(',', CASE WHEN NOT f THEN 'raw' END, CASE WHEN NOT o THEN 'smooth' END, CASE WHEN NOT p THEN 'sweep' END) AS missing, f AND o AND p AS is_complete FROM j""")
def missing_parts(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "well")
    have = lambda status: orders.where(F.col("o_orderstatus") == status).select("well")
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("well"))
    return catalogue.missing_parts(wanted, {"raw": have("F"), "smooth": have("O"), "sweep": have("P")}, ["well"])


@query("jon_10_task_grid", """
SELECT well_id, smoothing, CAST(n AS INT) AS n_breakpoints FROM (SELECT DISTINCT well_id FROM cast_samples) w, (VALUES ('savgol'), ('lowess')) m(smoothing), range(1, 6) g(n)""", ["cast_samples"])
def task_grid(spark, sf):
    return catalogue.task_grid(cast_samples(spark, sf).select("well_id").distinct(), ["savgol", "lowess"], range(1, 6))


# ---- notes

TYPOS = {" de ": " DE ", "ou": "OU", " DE OU": " du "}


@query("txt_01_literal_repairs", """
SELECT conv_id, turn, trim(replace(replace(replace(text, ' de ', ' DE '), 'ou', 'OU'), ' DE OU', ' du ')) AS note FROM conversations""")
def literal_repairs(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", note_ops.fix_text(F.col("text"), TYPOS).alias("note"))


PARSED = """
pn AS (SELECT *, TRY_CAST(nullif(regexp_extract(depth_token, '^(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) AS dt, TRY_CAST(nullif(regexp_extract(depth_token, '-(\\d+(\\.\\d+)?)$', 1), '') AS DOUBLE) AS db FROM notes)
"""


@query("txt_02_depth_tokens", "WITH " + PARSED.strip() + "SELECT sheet, row_no, dt AS depth_top, coalesce(db, dt) AS depth_bottom FROM pn", ["notes"])
def depth_tokens(spark, sf):
    top, bottom = note_ops.parse_depth(F.col("depth_token"))
    return views.notes(spark, sf).select("sheet", "row_no", top.alias("depth_top"), bottom.alias("depth_bottom"))


MERGED = "WITH " + PARSED.strip() + f""",
tn AS (SELECT sheet, row_no, dt, db, regexp_replace(note, '^\\s+|\\s+$', '', 'g') AS note FROM pn),
gp AS (SELECT *, count(dt) OVER (PARTITION BY sheet ORDER BY row_no) AS entry FROM tn WHERE length(note) > 0),
lx AS (SELECT *, lead(entry) OVER (PARTITION BY sheet ORDER BY row_no) IS DISTINCT FROM entry AS is_last FROM gp),
mg AS (SELECT sheet, CAST(entry AS INT) AS entry, min(dt) AS depth_top, max(coalesce(db, dt)) AS depth_bottom,
 string_agg(CASE WHEN is_last THEN note ELSE regexp_replace(note, '[. ]+$', '') END, '; ' ORDER BY row_no) AS note FROM lx WHERE entry > 0 GROUP BY sheet, entry)
"""


@query("txt_03_merged_notes", MERGED + f"SELECT *, {r('(depth_top+depth_bottom)/2')} AS centre, CAST(row_number() OVER (PARTITION BY sheet ORDER BY (depth_top+depth_bottom)/2, entry) AS INT) AS position FROM mg", ["notes"])
def merged_notes(spark, sf):
    out = note_ops.merge_continuations(views.notes(spark, sf), ["sheet"], layout=views.sized(spark, sf, "notes"))
    return out.withColumn("centre", settle(F.col("centre")))


@query("src_17_note_table", "SELECT sheet, count(*) AS n_rows, count(depth_token) AS n_depths, max(length(note)) AS longest FROM notes GROUP BY sheet", ["notes"])
def note_table(spark, sf):
    folder = stored(views.notes(spark, sf), "parquet")
    rows = readers.read_table(spark, folder, ["sheet", "row_no", "depth_token", "note"], "notes")
    return rows.groupBy("sheet").agg(F.count("*").alias("n_rows"), F.count("depth_token").alias("n_depths"), F.max(F.length("note")).cast("long").alias("longest"))


@query("prj_09_centre_window", MERGED + "SELECT sheet, entry, note FROM mg WHERE (depth_top+depth_bottom)/2 BETWEEN 2 AND 6 AND depth_top < depth_bottom", ["notes"])
def centre_window(spark, sf):
    out = note_ops.merge_continuations(views.notes(spark, sf), ["sheet"], layout=views.sized(spark, sf, "notes"))
    out = out.withColumn("kind", F.when(F.col("depth_top") < F.col("depth_bottom"), "note").otherwise("conductivity"))
    return note_ops.centre_between(out, 2, 6, ["conductivity"]).select("sheet", "entry", "note")


ANNOTATED = f"""
an AS (SELECT concat('W', CAST(user_id AS VARCHAR)) AS well_id, event_id, floor(value*10)/{C(10)} AS depth_m, CASE WHEN event_type IN ('click', 'view') THEN 'lithology' ELSE 'test' END AS kind, props AS text FROM events)
"""


def _annotations(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("well_id"), "event_id",
        (F.floor(F.col("value") * 10).cast("double") / 10.0).alias("depth_m"),
        F.when(F.col("event_type").isin("click", "view"), "lithology").otherwise("test").alias("kind"), F.col("props").alias("text"),
    )


@query("win_20_extended_intervals", "WITH " + ANNOTATED.strip() + f""",
nx AS (SELECT *, CASE WHEN kind = 'lithology' THEN lead(depth_m) OVER (PARTITION BY well_id, kind ORDER BY depth_m, event_id) ELSE depth_m END AS bt FROM an)
SELECT well_id, event_id, kind, {r('depth_m')} AS depth_top, {r('bt')} AS depth_bottom, {r('(depth_m + coalesce(bt, depth_m))/2')} AS centre FROM nx""")
def extended_intervals(spark, sf):
    out = note_ops.extend_intervals(_annotations(spark, sf), ["well_id"], tie=["event_id"], layout=views.sized(spark, sf, "cast_samples"))
    return settled(out, ["depth_top", "depth_bottom", "centre"], ["well_id", "event_id", "kind"])


@query("src_16_annotation_scan", "WITH " + ANNOTATED.strip() + f"SELECT well_id, kind, count(*) AS n, {r('min(depth_m)')} AS first_depth FROM an GROUP BY well_id, kind")
def annotation_scan(spark, sf):
    folder = shared_folder(spark)
    rows = _annotations(spark, sf).select(F.col("well_id").alias("well"), "depth_m", "kind", "text")
    rows.write.option("header", True).csv(folder)
    out = readers.read_annotations(spark, folder)
    return settled(
        out.groupBy(F.col("well").alias("well_id"), "kind").agg(F.count("*").alias("n"), F.min("depth_m").alias("first_depth")),
        ["first_depth"], ["well_id", "kind", "n"],
    )


@query("set_01_stacked_annotations", "WITH " + ANNOTATED.strip() + f"""
SELECT well_id, kind, count(*) AS n, {r('min(centre)')} AS first_centre, {r('max(centre)')} AS last_centre FROM (
 SELECT well_id, depth_m AS centre, CASE WHEN kind = 'test' THEN 'in_situ' ELSE kind END AS kind FROM an
 UNION ALL SELECT concat('W', CAST(sheet AS VARCHAR)), CAST(row_no AS DOUBLE), 'video' FROM notes) t GROUP BY well_id, kind""", ["notes"])
def stacked_annotations(spark, sf):
    rows = _annotations(spark, sf).select("well_id", F.col("depth_m").alias("centre"), "text", "kind")
    video = views.notes(spark, sf).select(
        F.concat(F.lit("W"), F.col("sheet").cast("string")).alias("well_id"), F.col("row_no").cast("double").alias("centre"), F.col("note").alias("text")
    )
    parts = {"lithology": rows.where("kind = 'lithology'").drop("kind"), "test": rows.where("kind = 'test'").drop("kind"), "video": video}
    out = note_ops.stack_annotations(parts, {"test": "in_situ"})
    return settled(
        out.groupBy("well_id", "kind").agg(F.count("*").alias("n"), F.min("centre").alias("first_centre"), F.max("centre").alias("last_centre")),
        ["first_centre", "last_centre"], ["well_id", "kind", "n"],
    )


# ---- resistivity

ERT_KEYS = ["transect", "x"]


@query("src_12_resistivity_profiles", f"""
SELECT transect, x, {r('-depth')} AS depth_bgl_m, {r('resist_ohm_m')} AS resist_ohm_m, CASE WHEN max(x) OVER (PARTITION BY transect) - min(x) OVER (PARTITION BY transect) <= {C(1e-9)} THEN 'ok' ELSE 'x_varies' END AS x_status FROM ert_samples""", ["ert_samples"])
def resistivity_profiles(spark, sf):
    raw = ert_samples(spark, sf).select(
        F.col("x").alias("x_requested"), F.col("x").alias("x_extracted"), "depth", F.col("resist_ohm_m").alias("resist"),
        F.log10("resist_ohm_m").alias("resistlog10"), "transect",
    )
    rows = readers.read_ert(spark, stored(raw, "csv", by="transect"), F.col("transect"))
    checked = rows.join(ert.constant_position(rows, ["transect"]), "transect")
    return settled(checked, ["depth_bgl_m", "resist_ohm_m"], ["transect", "x", "x_status"])


@query("src_13_trace_filter", f"SELECT transect, x, {r('-depth')} AS depth_bgl_m FROM ert_samples WHERE abs(x - 20) <= {C(1e-6)} AND transect IN ('Brand#1', 'Brand#2', 'Brand#3')", ["ert_samples"])
def trace_filter(spark, sf):
    rows = ert.select_traces(ert_samples(spark, sf), 20.0000001, ["Brand#1", "Brand#2", "Brand#3"])
    return settled(ert.to_positive_depth(rows), ["depth_bgl_m"], ["transect", "x"])


@query("src_14_trace_names", """
SELECT p_partkey, concat('T_x_', p_brand) AS variant, CAST(p_size AS DOUBLE) + 0.5 AS x FROM part""".replace("+ 0.5", "+ CAST(0.5 AS DOUBLE)"))
def trace_names(spark, sf):
    name = F.concat(F.lit("T_x_"), "p_brand", F.lit("_x_"), F.col("p_size").cast("string"), F.lit(".5.csv"))
    variant, x = names.parse_ert_name(name)
    return table(spark, sf, "part").select("p_partkey", variant.alias("variant"), x.alias("x"))


ASSOC = f"""
aw AS (SELECT concat('E', CAST(s_suppkey AS VARCHAR)) AS well_id, concat('Brand#', CAST(1 + s_suppkey % 30 AS VARCHAR)) AS transect, CAST(s_suppkey % 5 * 10 AS DOUBLE) AS x FROM supplier)
"""


def _association(spark, sf):
    key = F.col("s_suppkey")
    raw = table(spark, sf, "supplier").select(
        F.concat(F.lit(" E"), key.cast("string")).alias("well_id"),
        F.concat(F.lit("Brand#"), (1 + key % 30).cast("string"), F.lit(" ")).alias("transect"), (key % 5 * 10).alias("x"),
    )
    return ert.trim_association(raw)


@query("src_15_well_association", "WITH " + ASSOC.strip() + f"""
SELECT aw.well_id, aw.transect, aw.x, count(depth) AS n_rows FROM aw LEFT JOIN ert_samples e ON e.transect = aw.transect AND e.x = aw.x GROUP BY ALL""", ["ert_samples"])
def well_association(spark, sf):
    # rows are counted per trace before wells meet them: wells times rows of a trace would grow with their product
    traces = ert_samples(spark, sf).groupBy(*ERT_KEYS).agg(F.count("depth").alias("n"))
    joined = _association(spark, sf).join(traces, ERT_KEYS, "left")
    return joined.groupBy("well_id", *ERT_KEYS).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_rows"))


RHO_LIMIT = 40.0


def _rho_zone():
    from plumbline.workload.curves import angle_sql

    return "WITH lg AS (SELECT transect, x, -depth AS z, resist_ohm_m AS rho, log10(resist_ohm_m) AS lr FROM ert_samples)," + angle_sql("lg", "z", "z", "lr", "transect, x") + f""",
ok AS (SELECT *, CASE WHEN n >= 3 THEN a END AS aa FROM ang),
top AS (SELECT transect, x, rn AS t FROM (SELECT *, row_number() OVER (PARTITION BY transect, x ORDER BY aa DESC, rn) AS k FROM ok WHERE aa IS NOT NULL) q WHERE k = 1),
bot AS (SELECT transect, x, rn AS b FROM (SELECT ok.*, row_number() OVER (PARTITION BY ok.transect, ok.x ORDER BY aa DESC, rn) AS k FROM ok LEFT JOIN top USING (transect, x) WHERE aa IS NOT NULL AND rho <= {C(RHO_LIMIT)} AND rn IS DISTINCT FROM t) q WHERE k = 1),
fin AS (SELECT transect, x, max(n) AS n FROM ok GROUP BY transect, x)
SELECT ok.transect, ok.x, CAST(rn AS INT) AS bp_index, coalesce(rn = t, false) AS is_top_of_mixing, coalesce(rn = b, false) AS is_bottom_of_mixing,
 CASE WHEN fin.n < 3 THEN 'too_few_points' WHEN b IS NULL THEN 'no_bottom_candidate' ELSE 'ok' END AS mz_status
FROM ok JOIN fin USING (transect, x) LEFT JOIN top USING (transect, x) LEFT JOIN bot USING (transect, x)"""


@query("win_17_resistivity_zone", _rho_zone(), ["ert_samples"])
def resistivity_zone(spark, sf):
    rows = ert.to_positive_depth(ert_samples(spark, sf))
    out = geometry.resistivity_zone(rows, ERT_KEYS, bottom=RHO_LIMIT, layout=views.sized(spark, sf, "ert_samples"))
    return out.select(*ERT_KEYS, "bp_index", "is_top_of_mixing", "is_bottom_of_mixing", "mz_status")


@query("jon_09_interpolated_resistivity", f"""
WITH pts AS (SELECT p_brand AS transect, CAST(p_size % 5 * 10 AS DOUBLE) AS x, p_partkey, {C(0.01)}*(p_retailprice - {C(900)}) + {C(0.3)} AS z FROM part),
cv AS (SELECT transect, x, -depth AS z, resist_ohm_m AS v FROM ert_samples),
lo AS (SELECT pts.*, cv.z AS z0, cv.v AS v0 FROM pts ASOF LEFT JOIN cv ON pts.transect = cv.transect AND pts.x = cv.x AND pts.z >= cv.z),
hi AS (SELECT lo.*, cv.z AS z1, cv.v AS v1 FROM lo ASOF LEFT JOIN cv ON lo.transect = cv.transect AND lo.x = cv.x AND lo.z <= cv.z)
SELECT p_partkey, {r('CASE WHEN z0 IS NULL THEN v1 WHEN z1 IS NULL THEN v0 WHEN z1 = z0 THEN v0 ELSE v0 + (v1-v0)*(z-z0)/(z1-z0) END')} AS resist_ohm_m FROM hi""", ["ert_samples"])
def interpolated_resistivity(spark, sf):
    points = table(spark, sf, "part").select(
        F.col("p_brand").alias("transect"), (F.col("p_size") % 5 * 10).cast("double").alias("x"), "p_partkey",
        (0.01 * (F.col("p_retailprice") - 900) + 0.3).alias("depth_bgl_m"),
    )
    curve = ert.to_positive_depth(ert_samples(spark, sf))
    out = ert.interpolate_at(points, curve, ERT_KEYS, tie=["p_partkey"])
    return settled(out, ["resist_ohm_m"], ["p_partkey"])


@query("jon_08_method_comparison", "WITH " + ASSOC.strip() + """,
jb AS (SELECT concat('E', CAST(c_custkey AS VARCHAR)) AS well_id FROM customer),
pf AS (SELECT concat('E', CAST(l_suppkey AS VARCHAR)) AS well_id, count(*) AS n_samples FROM lineitem GROUP BY 1),
sl AS (SELECT concat('E', CAST(o_custkey AS VARCHAR)) AS well_id, count(*) AS n_pairs FROM orders GROUP BY 1),
tr AS (SELECT transect, x, count(*) AS n_trace FROM ert_samples GROUP BY 1, 2),
j AS (SELECT * FROM jb LEFT JOIN aw USING (well_id) LEFT JOIN pf USING (well_id) LEFT JOIN sl USING (well_id) LEFT JOIN tr USING (transect, x)),
rs AS (SELECT *, CASE WHEN transect IS NULL THEN 'no_association' WHEN n_samples IS NULL THEN 'no_profile' WHEN n_pairs IS NULL THEN 'no_slopes' WHEN n_trace IS NULL THEN 'no_trace' END AS reason FROM j)
SELECT well_id, n_samples, n_pairs, n_trace, reason, CASE WHEN reason IS NULL THEN 'ok' ELSE 'skipped' END AS status FROM rs""", ["ert_samples"])
def method_comparison(spark, sf):
    well = lambda c: F.concat(F.lit("E"), F.col(c).cast("string")).alias("well_id")
    out = ert.comparison(
        table(spark, sf, "customer").select(well("c_custkey")), _association(spark, sf),
        table(spark, sf, "lineitem").groupBy(well("l_suppkey")).agg(F.count("*").alias("n_samples")),
        table(spark, sf, "orders").groupBy(well("o_custkey")).agg(F.count("*").alias("n_pairs")),
        ert_samples(spark, sf).groupBy(*ERT_KEYS).agg(F.count("*").alias("n_trace")),
    )
    return out.select("well_id", "n_samples", "n_pairs", "n_trace", "reason", "status")


# ---- file round trips: rows derived from the tables are written, then read by the source

CAST_FILES = """
SELECT concat(well_id) AS well_id, count(*) AS n_rows, {0} AS depth_sum, '20220201' AS cast_date FROM cast_samples GROUP BY well_id"""


#: Folders over which the files of a variant are dealt, so that they are listed by as many tasks.
SHELVES = 64


def _cast_file(stem):
    """Path of a cast's file below its variant's folder."""
    name = F.concat(stem, F.lit("_YSI_20220201.csv"))
    return F.concat(F.pmod(F.hash(name), F.lit(SHELVES)).cast("string"), F.lit("/"), name).alias("file")


def _kept_samples(spark, sf):
    """The samples, written once for the variants that are cut from them, and how many tasks write a variant's files."""
    layout = views.sized(spark, sf, "cast_samples")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, layout.tasks)
    return spark.read.parquet(stored(cast_samples(spark, sf), "parquet")), tasks


def _cast_files(spark, sf):
    """Two header variants of the casts as CSV files, one per cast."""
    folder, (rows, tasks) = shared_folder(spark), _kept_samples(spark, sf)
    file = _cast_file(F.col("well_id"))
    first = rows.where("campaign = '2022_02'").select(file, F.col("depth_m").alias("Depth (m)"), F.col("sec_us_cm").alias("SpCond (uS/cm)"))
    second = rows.where("campaign = '2022_08'").select(file, F.col("depth_m").alias("Vertical Position m"), F.col("sec_us_cm").alias("Conductivity"))
    kinds = {"a": first, "b": second}
    written = [n for n, part in kinds.items() if sinks.write_named_files(part, f"{folder}/{n}", tasks=tasks)]
    return readers.read_casts(spark, {n: (f"{folder}/{n}", None) for n in written})


@query("src_01_raw_cast_files", CAST_FILES.format(r("sum(depth_m)", 3)), ["cast_samples"])
def raw_cast_files(spark, sf):
    return _cast_files(spark, sf).groupBy("well_id", "cast_date").agg(
        F.count("*").alias("n_rows"), settle(F.sum("depth_m"), 3).alias("depth_sum")
    )


@query("src_04_cast_index", f"""
SELECT well_id, '20220201' AS cast_date, 'YSI' AS instrument, CAST(1 AS INT) AS cast_no, count(*) AS n_rows, {r('min(depth_m)')} AS depth_min, {r('max(depth_m)')} AS depth_max FROM cast_samples GROUP BY well_id""", ["cast_samples"])
def cast_index(spark, sf):
    out = readers.cast_index(_cast_files(spark, sf))
    return settled(out, ["depth_min", "depth_max"], ["well_id", "cast_date", "instrument", "cast_no", "n_rows"])


@query("src_01_mixed_headers", f"""
WITH c AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'a' WHEN seq % 3 = 1 THEN 'b' ELSE 'c' END AS variant FROM cast_samples)
SELECT well_id, '20220201' AS cast_date, 'read' AS outcome, count(*) AS n_rows, {r('sum(depth_m)', 3)} AS depth_sum FROM c GROUP BY well_id
UNION ALL SELECT site, NULL, 'no column for conductivity', NULL, NULL FROM cast_samples GROUP BY site""", ["cast_samples"])
def mixed_headers(spark, sf):
    """One folder with three header variants, and files per site that lack a column: read in one call."""
    folder, (rows, tasks) = shared_folder(spark), _kept_samples(spark, sf)
    heads = {"a": ("Depth (m)", "SpCond (uS/cm)"), "b": ("vertical position M", "Corrected Conductivity"), "c": ("time", "depth_m", "sec_us_cm")}
    for k, (variant, names) in enumerate(heads.items()):
        part = rows.where(F.col("seq") % 3 == k).select(_cast_file(F.col("well_id")), F.lit("10:00").alias("time"), "depth_m", "sec_us_cm")
        part = part.select("file", *[F.col(c).alias(n) for c, n in zip(["time", "depth_m", "sec_us_cm"][-len(names):], names)])
        sinks.write_named_files(part, f"{folder}/in/{variant}", tasks=tasks)
    lost = rows.groupBy(_cast_file(F.col("site"))).agg(F.max("depth_m").alias("Depth (m)"), F.count("*").alias("Battery"))
    sinks.write_named_files(lost, f"{folder}/in/lost", tasks=tasks)
    casts, odd = readers.read_cast_folder(spark, f"{folder}/in")
    read = casts.groupBy("well_id", "cast_date").agg(
        F.lit("read").alias("outcome"), F.count("*").alias("n_rows"), settle(F.sum("depth_m"), 3).alias("depth_sum"))
    site = F.regexp_extract("file_path", "([^/_]+)_[^/]*$", 1)
    left = odd.select(site.alias("well_id"), F.lit(None).cast("string").alias("cast_date"), F.col("reason").alias("outcome"),
                      F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("double").alias("depth_sum"))
    return read.unionByName(left.distinct())


@query("src_18_sweep_documents", f"""
SELECT well_id, trial, n_breakpoints, {r('bic')} AS bic, {r('rss')} AS rss, converged, {r('CASE WHEN converged THEN const END')} AS const, {r('CASE WHEN converged THEN psis[1] END')} AS first_position FROM fits""", ["fits"])
def sweep_documents(spark, sf):
    folder = shared_folder(spark)
    documents = sinks.sweep_documents(sweep.with_estimates(fits(spark, sf)), ["well_id"])
    documents.write.parquet(folder)
    out = readers.explode_sweep(spark.read.parquet(folder))
    pick = lambda name: settle(F.try_element_at("estimates", F.lit(name))["estimate"])
    return out.select(
        "well_id", "trial", "n_breakpoints", settle(F.col("bic")).alias("bic"), settle(F.col("rss")).alias("rss"), "converged",
        pick("const").alias("const"), pick("breakpoint1").alias("first_position"),
    )


@query("snk_01_profile_table", f"SELECT well_id, campaign, 'raw' AS smoothing, seq, {r('depth_m')} AS depth_m FROM cast_samples", ["cast_samples"])
def profile_table(spark, sf):
    folder = shared_folder(spark)
    sinks.write_profiles(cast_samples(spark, sf).withColumn("smoothing", F.lit("raw")), folder)
    back = spark.read.schema("site string, well_id string, seq long, depth_m double, sec_us_cm double, campaign string, smoothing string").parquet(folder)
    return settled(back, ["depth_m"], ["well_id", "campaign", "smoothing", "seq"])


@query("snk_02_sweep_table", f"SELECT well_id, trial, n_breakpoints, {r('alpha1')} AS alpha1, {r('list_sum(psis)', 5)} AS position_sum FROM fits WHERE converged", ["fits"])
def sweep_table(spark, sf):
    from plumbline.operators.segments import unpack_estimates

    folder = shared_folder(spark)
    sinks.write_table(sweep.with_estimates(fits(spark, sf)).drop("psis", "alpha1", "betas", "const", "ci_low", "ci_high"), folder)
    back = unpack_estimates(spark.read.parquet(folder).where("converged"))
    total = F.when(F.size("psis") > 0, F.aggregate("psis", F.lit(0.0), lambda s, v: s + v))
    return back.select("well_id", "trial", "n_breakpoints", settle(F.col("alpha1")).alias("alpha1"), settle(total, 5).alias("position_sum"))


@query("snk_03_text_export", f"SELECT well_id, bp_index, printf('%.4f', depth_m) AS depth_m, printf('%.3f', {r('log10_sec', 3)}) AS log10_sec FROM breakpoints", ["breakpoints"])
def text_export(spark, sf):
    folder = shared_folder(spark)
    rows = breakpoints(spark, sf).withColumn("log10_sec", settle(F.col("log10_sec"), 3))
    sinks.write_text_export(rows, folder, {"depth_m": 4, "log10_sec": 3})
    return spark.read.option("header", True).schema("well_id string, bp_index int, depth_m string, log10_sec string").csv(folder)

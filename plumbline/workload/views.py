"""Profile tables derived from the given tables: a Spark builder and its SQL text each.

Every view reads all rows of its base table, so its size grows with the data.
"""

import uuid

from pyspark.sql import functions as F

from plumbline.functions.numeric import settle
from plumbline.plans.layout import Layout, deal, lay, row_number
from plumbline.plans.session import ensure_checkpoint_dir

# Base table and profile key of each view.
PROFILE_KEYS = {
    "cast_samples": ("events", ("user_id",)),
    "breakpoints": ("events", ("user_id",)),
    "caliper_log": ("lineitem", ("l_suppkey",)),
    "bp_records": ("orders", ("o_custkey",)),
    "zones": ("orders", ("o_custkey",)),
    "fits": ("orders", ("o_custkey",)),
    "ert_samples": ("part", ("p_brand", "p_size % 5")),
    "notes": ("conversations", ("conv_id",)),
}
_SIZES = {}


def shared_folder(spark):
    """A fresh folder beside the checkpoints, where every executor can write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def stored(df, kind, by=None):
    """Write rows derived from the tables as files for a reader; returns their folder."""
    folder = f"{shared_folder(df.sparkSession)}.{kind}"
    writer = df.hint("rebalance", by).write.partitionBy(by) if by else df.write
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(folder)
    return folder


def sized(spark, sf, view):
    """Layout of a view's profiles, counted once per session on the narrow base column."""
    name, keys = PROFILE_KEYS[view]
    limit = spark.conf.get("spark.plumbline.rowsPerSplit", "")
    key = (spark.sparkContext.applicationId, sf, name, keys, limit)
    if key not in _SIZES:
        base = table(spark, sf, name).selectExpr(*[f"{k} AS k{i}" for i, k in enumerate(keys)])
        _SIZES[key] = Layout.of(base, base.columns)
    return _SIZES[key]


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _site():
    return F.concat(F.lit("W"), F.floor(F.col("user_id") / 4).cast("string"))


def cast_samples(spark, sf):
    """One cast per user of `events`: depth noisily descending, conductivity rising."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    layout = sized(spark, sf, "cast_samples")
    events = events.withColumn("well_id", F.concat(_site(), F.char(F.col("user_id") % 4 + 65)))
    rows = lay(deal(events, ["well_id"], layout), ["well_id"], ["ts", "event_id"], layout).scan(rn=row_number()).df
    step = (F.col("rn") + 1).cast("double") * 0.25 - 1.0 + F.col("value") / 100.0
    rows = rows.withColumn("depth_m", F.floor(step * 100.0).cast("double") / F.lit(100.0))
    d4 = F.col("depth_m") * F.col("depth_m") * F.col("depth_m") * F.col("depth_m")
    return rows.select(
        _site().alias("site"), "well_id",
        F.when(F.col("user_id") % 2 == 0, "2022_02").otherwise("2022_08").alias("campaign"),
        (F.col("rn") + 1).alias("seq"), "depth_m",
        (300 + 50000.0 * d4 / (d4 + 4096.0) + (F.col("value") - 50.0)).alias("sec_us_cm"),
    )


CAST_SAMPLES = """
SELECT site, well_id, campaign, seq, depth_m,
 300 + CAST(50000 AS DOUBLE)*d4/(d4+CAST(4096 AS DOUBLE)) + (value - CAST(50 AS DOUBLE)) AS sec_us_cm FROM (
 SELECT *, depth_m*depth_m*depth_m*depth_m AS d4 FROM (
  SELECT concat('W', CAST(user_id // 4 AS VARCHAR)) AS site, concat('W', CAST(user_id // 4 AS VARCHAR), chr(CAST(65 + user_id % 4 AS INT))) AS well_id,
   CASE WHEN user_id % 2 = 0 THEN '2022_02' ELSE '2022_08' END AS campaign, rn AS seq, value,
   floor((CAST(rn AS DOUBLE)*CAST(0.25 AS DOUBLE) - CAST(1 AS DOUBLE) + value/CAST(100 AS DOUBLE))*CAST(100 AS DOUBLE))/CAST(100 AS DOUBLE) AS depth_m
  FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) a) b) c
"""


def caliper_log(spark, sf):
    """One width log per supplier of `lineitem`, with wash-outs and sub-nominal rows."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount",
             "l_tax", "l_shipdate", "l_quantity"]
    layout = sized(spark, sf, "caliper_log")
    lines = table(spark, sf, "lineitem").select("l_suppkey", _text("S", "l_suppkey").alias("well_id"), *order)
    rows = lay(deal(lines, ["well_id"], layout), ["well_id"], order, layout).scan(rn=row_number()).df
    width = (
        15.0 + F.col("l_tax") * 10.0
        + F.when(F.col("l_discount") >= 0.08, F.col("l_quantity") / 3.0).otherwise(0.0)
        - F.when(F.col("l_quantity") < 2, 2.0).otherwise(0.0)
    )
    return rows.select(
        "well_id", (F.col("rn") + 1).alias("seq"),
        settle((F.col("rn") + 1).cast("double") * 0.03, 2).alias("depth_m"),
        width.alias("caliper_cm"), F.lit(6.0).alias("auger_in"),
        F.when(F.col("l_suppkey") % 2 == 0, 5.0).otherwise(7.0).alias("trim_depth_m"),
    )


CALIPER_LOG = """
SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS well_id, rn AS seq,
 floor(CAST(rn AS DOUBLE)*CAST(0.03 AS DOUBLE)*CAST(100 AS DOUBLE)+CAST(0.4999 AS DOUBLE))/CAST(100 AS DOUBLE) AS depth_m,
 CAST(15 AS DOUBLE) + l_tax*CAST(10 AS DOUBLE) + CASE WHEN l_discount >= CAST(0.08 AS DOUBLE) THEN l_quantity/CAST(3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  - CASE WHEN l_quantity < 2 THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS caliper_cm,
 CAST(6 AS DOUBLE) AS auger_in, CASE WHEN l_suppkey % 2 = 0 THEN CAST(5 AS DOUBLE) ELSE CAST(7 AS DOUBLE) END AS trim_depth_m
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
  l_extendedprice, l_discount, l_tax, l_shipdate, l_quantity) AS rn FROM lineitem) a
"""


def bp_records(spark, sf):
    """Breakpoints pooled over methods and sizes: one per order, wells are customers."""
    price, ten = F.col("o_totalprice"), F.lit(10.0)
    return table(spark, sf, "orders").select(
        _text("S", "o_custkey").alias("well_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "savgol").otherwise("lowess").alias("smoothing"),
        (F.col("o_orderkey") % 15 + 1).cast("int").alias("n_breakpoints"),
        F.col("o_orderkey").alias("record_id"),
        settle(price - ten * F.floor(price / ten).cast("double"), 3).alias("depth_bgl_m"),
    )


BP_RECORDS = f"""
SELECT concat('S', CAST(o_custkey AS VARCHAR)) AS well_id,
 CASE WHEN o_orderkey % 2 = 0 THEN 'savgol' ELSE 'lowess' END AS smoothing,
 CAST(1 + o_orderkey % 15 AS INT) AS n_breakpoints, o_orderkey AS record_id,
 floor((o_totalprice - CAST(10 AS DOUBLE)*floor(o_totalprice/CAST(10 AS DOUBLE)))*CAST(1000 AS DOUBLE)+CAST(0.4999 AS DOUBLE))/CAST(1000 AS DOUBLE) AS depth_bgl_m
FROM orders
"""


def breakpoints(spark, sf):
    """Curve knots per well: one per metre of depth below the surface, means of its samples."""
    z = F.col("depth_m")
    d4 = z * z * z * z
    means = cast_samples(spark, sf).where(z >= 0).groupBy("well_id", F.floor(z).alias("b")).agg(
        settle(F.avg(z), 4).alias("depth_m"),
        settle(F.avg(2.5 + 2.3 * d4 / (d4 + 4096.0)), 6).alias("log10_sec"),
    )
    rows = lay(means, ["well_id"], ["depth_m"], sized(spark, sf, "breakpoints")).scan(i=row_number()).df
    return rows.select("well_id", (F.col("i") + 1).cast("int").alias("bp_index"), "depth_m", "log10_sec")


BREAKPOINTS = """
SELECT well_id, CAST(row_number() OVER (PARTITION BY well_id ORDER BY depth_m) AS INT) AS bp_index, depth_m, log10_sec FROM (
 SELECT well_id, floor(avg(depth_m)*CAST(10000 AS DOUBLE)+CAST(0.4999 AS DOUBLE))/CAST(10000 AS DOUBLE) AS depth_m,
  floor(avg(CAST(2.5 AS DOUBLE) + CAST(2.3 AS DOUBLE)*depth_m*depth_m*depth_m*depth_m/(depth_m*depth_m*depth_m*depth_m+CAST(4096 AS DOUBLE)))*CAST(1000000 AS DOUBLE)+CAST(0.4999 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS log10_sec
 FROM cast_samples s WHERE depth_m >= 0 GROUP BY well_id, floor(depth_m)) t
"""


def zones(spark, sf):
    """Anomaly zones: one per order, wells are customers."""
    price, ten = F.col("o_totalprice") * 7.0, F.lit(10.0)
    length = F.lit(0.25) * (F.col("o_orderkey") % 4 + 1).cast("double")
    start = settle(price - ten * F.floor(price / ten).cast("double"), 2)
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        _text("S", "o_custkey").alias("well_id"), key.alias("zone_id"), start.alias("z_bot"),
        (start + length).alias("z_top"), (start + length / 2).alias("z_centre"),
        length.alias("thickness_m"),
        F.when(key % 6 == 0, "severe").when(key % 3 == 0, "moderate").otherwise("mild").alias("severity"),
        (key % 17).cast("double").alias("peak_excess_cm"),
    )


ZONES = """
SELECT concat('S', CAST(o_custkey AS VARCHAR)) AS well_id, o_orderkey AS zone_id, za AS z_bot, za + zl AS z_top,
 za + zl/2 AS z_centre, zl AS thickness_m,
 CASE WHEN o_orderkey % 6 = 0 THEN 'severe' WHEN o_orderkey % 3 = 0 THEN 'moderate' ELSE 'mild' END AS severity,
 CAST(o_orderkey % 17 AS DOUBLE) AS peak_excess_cm
FROM (SELECT *, floor((o_totalprice*CAST(7 AS DOUBLE) - CAST(10 AS DOUBLE)*floor(o_totalprice*CAST(7 AS DOUBLE)/CAST(10 AS DOUBLE)))*CAST(100 AS DOUBLE)+CAST(0.4999 AS DOUBLE))/CAST(100 AS DOUBLE) AS za,
 CAST(0.25 AS DOUBLE)*CAST(1 + o_orderkey % 4 AS DOUBLE) AS zl FROM orders) a
"""


def ert_samples(spark, sf):
    """Resistivity profiles: brand is the transect, size class the position along it."""
    part = table(spark, sf, "part").select("p_brand", "p_size", "p_partkey", "p_retailprice")
    part = part.select(
        F.col("p_brand").alias("transect"), (F.col("p_size") % 5 * 10).cast("double").alias("x"),
        "p_partkey", "p_retailprice",
    )
    rows = lay(part, ["transect", "x"], ["p_partkey"], sized(spark, sf, "ert_samples")).scan(rn=row_number()).df
    n = (F.col("rn") + 1).cast("double")
    return rows.select(
        "transect", "x", (-0.5 * n).alias("depth"),
        (1.0 + F.col("p_retailprice") / (1.0 + n * n)).alias("resist_ohm_m"),
    )


ERT_SAMPLES = """
SELECT transect, x, CAST(-0.5 AS DOUBLE)*CAST(rn AS DOUBLE) AS depth,
 CAST(1 AS DOUBLE) + p_retailprice/(CAST(1 AS DOUBLE)+CAST(rn AS DOUBLE)*CAST(rn AS DOUBLE)) AS resist_ohm_m
FROM (SELECT p_brand AS transect, CAST(p_size % 5 * 10 AS DOUBLE) AS x, p_retailprice,
 row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey) AS rn FROM part) a
"""


def _frac(x):
    return x - F.floor(x).cast("double")


def fits(spark, sf):
    """Saved sweep rows: one per order, wells are customers, three trials of growing size."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    rows = lay(orders, ["o_custkey"], ["o_orderkey"], sized(spark, sf, "fits")).scan(rn=row_number()).df
    p, n = F.col("o_totalprice") / 1000.0, F.floor(F.col("rn") / 3).cast("int")
    bic = 1000.0 - 120.0 * F.col("n") + 13.0 * F.col("n") * F.col("n") + _frac(p * 7.0) * 50.0
    each = lambda f: F.transform(F.col("_i"), f)
    real = lambda i: i.cast("double")
    return rows.withColumn("n", n).withColumn(
        "_i", F.when(F.col("n") >= 1, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    ).select(
        _text("S", "o_custkey").alias("well_id"), F.lit("2022_02").alias("campaign"),
        F.lit("savgol").alias("smoothing"),
        F.concat(F.lit("trial_"), (F.col("rn") % 3 + 1).cast("string")).alias("trial"),
        (F.col("rn") % 3).cast("int").alias("seed"), F.col("n").alias("n_breakpoints"),
        (F.col("o_orderkey") % 11 != 10).alias("converged"),
        F.when(F.col("o_orderkey") % 11 != 10, bic).alias("bic"),
        (10.0 / (1.0 + F.col("n")) + _frac(p)).alias("rss"),
        (2.0 + _frac(p)).alias("const"), (0.1 * _frac(p * 3.0)).alias("alpha1"),
        each(lambda i: real(i) * 1.5 + _frac(p * real(i))).alias("psis"),
        each(lambda i: _frac(p * (real(i) + 1.0)) - 0.5).alias("betas"),
        each(lambda i: real(i) * 1.5 + _frac(p * real(i)) - 0.1).alias("ci_low"),
        each(lambda i: real(i) * 1.5 + _frac(p * real(i)) + 0.2 * _frac(p * real(i))).alias("ci_high"),
    )


def _sql_frac(x):
    return f"({x} - floor({x}))"


_P, _I = "p", "CAST(i AS DOUBLE)"
_PSI = f"{_I}*CAST(1.5 AS DOUBLE) + {_sql_frac(f'p*{_I}')}"
FITS = f"""
SELECT concat('S', CAST(o_custkey AS VARCHAR)) AS well_id, '2022_02' AS campaign, 'savgol' AS smoothing,
 concat('trial_', CAST(rn % 3 + 1 AS VARCHAR)) AS trial, CAST(rn % 3 AS INT) AS seed, n AS n_breakpoints, o_orderkey % 11 <> 10 AS converged,
 CASE WHEN o_orderkey % 11 <> 10 THEN CAST(1000 AS DOUBLE) - CAST(120 AS DOUBLE)*n + CAST(13 AS DOUBLE)*n*n + {_sql_frac('p*CAST(7 AS DOUBLE)')}*CAST(50 AS DOUBLE) END AS bic,
 CAST(10 AS DOUBLE)/(CAST(1 AS DOUBLE)+n) + {_sql_frac('p')} AS rss, CAST(2 AS DOUBLE) + {_sql_frac('p')} AS const,
 CAST(0.1 AS DOUBLE)*{_sql_frac('p*CAST(3 AS DOUBLE)')} AS alpha1,
 list_transform(range(1, n+1), lambda i: {_PSI}) AS psis,
 list_transform(range(1, n+1), lambda i: {_sql_frac(f'p*({_I}+CAST(1 AS DOUBLE))')} - CAST(0.5 AS DOUBLE)) AS betas,
 list_transform(range(1, n+1), lambda i: {_PSI} - CAST(0.1 AS DOUBLE)) AS ci_low,
 list_transform(range(1, n+1), lambda i: {_PSI} + CAST(0.2 AS DOUBLE)*{_sql_frac(f'p*{_I}')}) AS ci_high
FROM (SELECT *, CAST(rn // 3 AS INT) AS n FROM (SELECT o_custkey, o_orderkey, o_totalprice/CAST(1000 AS DOUBLE) AS p,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders) a) b
"""


def notes(spark, sf):
    """Depth-token notes per conversation; every third row continues the one before."""
    turn = F.col("turn").cast("string")
    token = (
        F.when(F.col("turn") % 3 == 1, F.lit(None))
        .when(F.col("turn") % 3 == 2, F.concat(turn, F.lit(".5 m")))
        .otherwise(F.concat(turn, F.lit(".0-"), (F.col("turn") + 1).cast("string"), F.lit(".5")))
    )
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("sheet"), F.col("turn").alias("row_no"),
        token.alias("depth_token"), F.col("text").alias("note"),
    )


NOTES = """
SELECT conv_id AS sheet, turn AS row_no, CASE WHEN turn % 3 = 1 THEN NULL WHEN turn % 3 = 2 THEN concat(CAST(turn AS VARCHAR), '.5 m')
 ELSE concat(CAST(turn AS VARCHAR), '.0-', CAST(turn+1 AS VARCHAR), '.5') END AS depth_token, text AS note FROM conversations
"""

SQL = {
    "cast_samples": ((), CAST_SAMPLES),
    "caliper_log": ((), CALIPER_LOG),
    "bp_records": ((), BP_RECORDS),
    "breakpoints": (("cast_samples",), BREAKPOINTS),
    "zones": ((), ZONES),
    "ert_samples": ((), ERT_SAMPLES),
    "notes": ((), NOTES),
    "fits": ((), FITS),
}


def with_views(using, body):
    """Prefix `body` with the views it reads as common table expressions."""
    names = []

    def add(name):
        needs, _ = SQL[name]
        for n in needs:
            add(n)
        if name not in names:
            names.append(name)

    for name in using:
        add(name)
    body = body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n][1].strip()})" for n in names)
    if not names:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

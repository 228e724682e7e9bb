"""Match depth clusters with anomaly zones of the same well, and score the matches."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import overlap_length
from plumbline.operators.detect import SEVERITIES
from plumbline.plans.layout import finish, lay, row_number

RULES = ("overlap", "center_distance", "hybrid")
PRIORITIES = ("overlap", "severity", "peak")
WEIGHTS = {"mild": 1.0, "moderate": 2.0, "severe": 3.0}
BUCKET_M = 1.0
ZONE_COLUMNS = ("zone_id", "z_bot", "z_top", "z_centre", "severity", "peak_excess_cm")


def check_options(rule="hybrid", priority="overlap", tolerance_m=0.5, weights=None, agreement_min=0):
    if rule not in RULES:
        raise ValueError(f"matching rule {rule!r} is not one of {RULES}")
    if priority not in PRIORITIES:
        raise ValueError(f"priority {priority!r} is not one of {PRIORITIES}")
    if tolerance_m < 0 or agreement_min < 0:
        raise ValueError("tolerance and minimum agreement must not be negative")
    if weights is not None and any(w < 0 for w in weights.values()):
        raise ValueError("severity weights must not be negative")


def eligible(clusters, zones, agreement_min=0, severities=None):
    """Clusters with enough agreement, zones of the wanted severities."""
    kept = zones if severities is None else zones.where(F.col("severity").isin(*severities))
    return clusters.where(F.col("agreement") >= agreement_min), kept


def _weight(column, weights):
    """Severity weight from a handful of parameter values; unknown labels weigh nothing."""
    out = F.lit(0.0)
    for label, w in sorted(weights.items()):
        out = F.when(column == label, F.lit(float(w))).otherwise(out)
    return out


#: Cells of one size that make up a cell of the next, and the number of sizes.
RADIX, SIZES = 16, 4


def _cells(low, high, bucket_m):
    """Cells (level, n) that tile an interval's buckets, large ones inside, and the larger cells around them.

    Cells of level l are RADIX ** l buckets wide.  An interval of any length has at most 2 (RADIX - 1) cells of a
    level, but for the largest, and three or so around them.
    """
    size = F.lit(float(bucket_m))
    cell = "array<struct<l:int,n:bigint>>"

    def run(level, first, past):
        return f"if({first} < {past}, transform(sequence({first}, {past} - 1), n -> named_struct('l', {level}, 'n', n)), cast(array() as {cell}))"

    up, down = f"({RADIX} * ceil(s.lo / {RADIX}))", f"({RADIX} * floor(s.hi / {RADIX}))"
    split = f"named_struct('lo', cast({up} as bigint), 'hi', cast({down} as bigint))"
    step = f"""if(s.lo >= s.hi, s, if(l = {SIZES - 1} OR {up} >= {down},
      named_struct('lo', 0L, 'hi', 0L, 'out', concat(s.out, {run('l', 's.lo', 's.hi')})),
      named_struct('lo', cast({up} div {RADIX} as bigint), 'hi', cast({down} div {RADIX} as bigint),
        'out', concat(s.out, {run('l', 's.lo', f'cast({up} as bigint)')}, {run('l', f'cast({down} as bigint)', 's.hi')}))))"""
    start = f"named_struct('lo', _first, 'hi', _past, 'out', cast(array() as {cell}))"
    tiles = F.expr(f"aggregate(sequence(0, {SIZES - 1}), {start}, (s, l) -> {step}, s -> s.out)")
    around = F.expr(f"""array_distinct(flatten(transform(_tiles, t -> transform(filter(sequence(1, {SIZES - 1}), l -> l > t.l),
      l -> named_struct('l', l, 'n', cast(floor(t.n / power({RADIX}, l - t.l)) as bigint))))))""")
    first = F.floor(low / size).cast("long")
    past = (F.floor(high / size) + 1).cast("long")
    return first, past, tiles, around


def _in_cells(df, columns, low, high, bucket_m, names):
    """Rows with their own cells (`_own`) and the cells around them, one row per cell."""
    first, past, tiles, around = _cells(F.col(low), F.col(high), bucket_m)
    rows = df.select(*columns, low, high, first.alias("_first"), past.alias("_past")).withColumn("_tiles", tiles)
    rows = rows.withColumn("_around", around)
    both = F.concat(F.transform("_tiles", lambda t: F.struct(t["l"].alias("l"), t["n"].alias("n"), F.lit(True).alias("own"))),
                    F.transform("_around", lambda t: F.struct(t["l"].alias("l"), t["n"].alias("n"), F.lit(False).alias("own"))))
    return rows.select(*columns, low, high, F.explode(both).alias("_c")).select(
        *columns, low, high, F.col("_c.l").alias("_level"), F.col("_c.n").alias("_cell"), F.col("_c.own").alias(names))


def find_matches(clusters, zones, keys=("well_id",), rule="hybrid", tolerance_m=0.5, bucket_m=BUCKET_M):
    """Pairs of cluster and zone that overlap, lie close by, or either.

    Both sides are tiled by depth cells of several sizes and joined on (well, cell): two intervals meet exactly where a cell
    of one is a cell of the other or lies around one of its cells.  A well with very many clusters and zones is many small
    joins, and an interval of any length is tens of rows.  A pair counts in the cell that holds the start of what it shares.
    """
    check_options(rule, tolerance_m=tolerance_m)
    keys = [*keys]
    near = 0.0 if rule == "overlap" else float(tolerance_m)
    # The centre rule compares centres: a zone's reach must include its stated centre.
    left = clusters.select(
        *keys, "cluster_id", "depth_min", "depth_max", "depth_median",
        (F.least("depth_min", "depth_max", "depth_median") - near).alias("_c_low"),
        (F.greatest("depth_min", "depth_max", "depth_median") + near).alias("_c_high"))
    right = zones.select(
        *keys, *ZONE_COLUMNS, F.least("z_bot", "z_top", "z_centre").alias("_z_low"),
        F.greatest("z_bot", "z_top", "z_centre").alias("_z_high"))
    # Cells that only lie around an interval must meet the other side's own cells, but not each other: a cluster's
    # stand in a room of their own, which zones enter with their own cells only.
    left = _in_cells(left, [*keys, "cluster_id", "depth_min", "depth_max", "depth_median"], "_c_low", "_c_high", bucket_m, "_c_own")
    left = left.withColumn("_room", F.when(F.col("_c_own"), 0).otherwise(1)).drop("_c_own")
    right = _in_cells(right, [*keys, *ZONE_COLUMNS], "_z_low", "_z_high", bucket_m, "_z_own")
    rooms = F.when(F.col("_z_own"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_room", F.explode(rooms)).drop("_z_own")
    overlap = overlap_length(F.col("depth_min"), F.col("depth_max"), F.col("z_bot"), F.col("z_top"))
    distance = F.abs(F.col("depth_median") - F.col("z_centre"))
    met = {
        "overlap": overlap > 0, "center_distance": distance <= tolerance_m,
        "hybrid": (overlap > 0) | (distance <= tolerance_m),
    }[rule]
    bucket = F.floor(F.greatest("_c_low", "_z_low") / F.lit(float(bucket_m)))
    first = F.floor(bucket / F.pow(F.lit(float(RADIX)), F.col("_level")))
    pairs = left.join(right, [*keys, "_level", "_cell", "_room"])
    return pairs.where((F.col("_cell") == first) & met).select(
        *keys, "cluster_id", *ZONE_COLUMNS, overlap.alias("overlap_m"),
        distance.alias("center_distance_m"),
    )


def _best(priority, weights):
    """Aggregate: the best zone of a cluster; it combines map-side, so busy clusters do too."""
    check_options(priority=priority)
    near = [F.col("overlap_m"), -F.col("center_distance_m"), -F.col("zone_id")]
    order = {
        "overlap": near,
        "severity": [_weight(F.col("severity"), weights), *near],
        "peak": [F.col("peak_excess_cm"), *near],
    }[priority]
    return F.max_by(F.struct(*ZONE_COLUMNS, "overlap_m", "center_distance_m"), F.struct(*order))


def best_match(matches, keys=("well_id",), priority="overlap", weights=WEIGHTS):
    """Best zone of every cluster."""
    best = matches.groupBy(*keys, "cluster_id").agg(_best(priority, weights).alias("_b"))
    return best.select(*keys, "cluster_id", "_b.*")


def best_matches(matches, keys=("well_id",), priorities=PRIORITIES, weights=WEIGHTS):
    """Best zone of every cluster by each priority, from one pass over the matches."""
    best = matches.groupBy(*keys, "cluster_id").agg(*[_best(p, weights).alias(p) for p in priorities])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("priority"), F.col(p).alias("_b")) for p in priorities]))
    return best.select(*keys, "cluster_id", each.alias("_e")).select(*keys, "cluster_id", "_e.priority", "_e._b.*")


def _scores(weights):
    w = _weight(F.col("severity"), weights)
    return [
        F.count("*").alias("n_zones_matched"), F.max(w).alias("max_weight"),
        F.min_by("severity", F.struct(-w, F.col("severity"))).alias("max_severity"),
        F.concat_ws(",", F.sort_array(F.collect_set("severity"))).alias("severities"),
    ]


def _scored(clusters, found, keys):
    scored = clusters.select(*keys, "cluster_id", "agreement").join(found, [*keys, "cluster_id"], "left")
    return scored.withColumns({
        "n_zones_matched": F.coalesce("n_zones_matched", F.lit(0)),
        "multi_match": F.coalesce(F.col("n_zones_matched") > 1, F.lit(False)),
        "score": F.col("agreement") * F.coalesce("max_weight", F.lit(0.0)),
    }).drop("max_weight")


def score_matches(matches, clusters, keys=("well_id",), weights=WEIGHTS):
    """Match count, strongest severity and agreement x weight of every cluster."""
    return _scored(clusters, matches.groupBy(*keys, "cluster_id").agg(*_scores(weights)), keys)


def unmatched_zones(zones, matches, keys=("well_id",), min_severity=None, weights=WEIGHTS):
    """Zones that no cluster matched, optionally only from a severity upward."""
    if min_severity is not None:
        zones = zones.where(_weight(F.col("severity"), weights) >= float(weights[min_severity]))
    used = matches.select(*keys, "zone_id").distinct()
    return zones.join(used, [*keys, "zone_id"], "left_anti").select(*keys, *ZONE_COLUMNS)


def well_summary(cluster_matches, keys=("well_id",), levels=SEVERITIES[1:]):
    """Converging clusters per well, with counts per severity and scores."""
    hit = F.col("n_zones_matched") > 0
    return cluster_matches.groupBy(*keys).agg(
        F.count("*").alias("n_clusters"), F.count_if(hit).alias("n_converging"),
        (F.count_if(hit) / F.count("*")).alias("fraction_converging"),
        *[F.count_if(F.col("max_severity") == s).alias(f"n_{s}") for s in levels],
        F.max("score").alias("max_score"),
        F.coalesce(F.avg(F.when(hit, F.col("score"))), F.lit(0.0)).alias("mean_score"),
    )


def convergence(clusters, zones, keys=("well_id",), rule="hybrid", priority="overlap",
                tolerance_m=0.5, agreement_min=0, severities=None, weights=WEIGHTS,
                min_unmatched=None):
    """Cluster matches, well summary and unmatched zones, as three DataFrames.

    One aggregate over the matches gives the scores and the best zone of every cluster.  The
    zone brings its thickness, its severity weight and how it matched; texts of clusters without
    a match are empty.
    """
    check_options(rule, priority, tolerance_m, weights, agreement_min)
    clusters, kept = eligible(clusters, zones, agreement_min, severities)
    matches = find_matches(clusters, kept, keys, rule, tolerance_m)
    found = matches.groupBy(*keys, "cluster_id").agg(*_scores(weights), _best(priority, weights).alias("_b"))
    scored = _scored(clusters, found, keys)
    cluster_matches = scored.select(*[c for c in scored.columns if c != "_b"], "_b.*").withColumns({
        "thickness_m": F.col("z_top") - F.col("z_bot"),
        "severity_weight": _weight(F.col("severity"), weights), "has_match": F.col("zone_id").isNotNull(),
        "is_overlap": F.coalesce(F.col("overlap_m") > 0, F.lit(False)),
        "is_near": F.coalesce(F.col("center_distance_m") <= tolerance_m, F.lit(False)),
        **{c: F.coalesce(c, F.lit("")) for c in ("severity", "max_severity", "severities")},
    })
    return (
        cluster_matches, well_summary(cluster_matches, keys),
        unmatched_zones(kept, matches, keys, min_unmatched, weights),
    )


def number_zones(zones, keys=("well_id",), tie=("peak_excess_cm",), layout=None):
    """zone_id from an explicit order: shallow end, then deep end, per well."""
    track = lay(zones, keys, ["z_bot", "z_top", *tie], layout).scan(zone_id=row_number())
    return finish(track.with_columns(zone_id=(F.col("zone_id") + 1).cast("int")))


def depth_extents(sources, keys, pad=0.0):
    """Common depth range of several (keys, depth) sources, padded on both sides."""
    first, *rest = sources
    stacked = first
    for other in rest:
        stacked = stacked.unionByName(other)
    return stacked.groupBy(*keys).agg(
        (F.min("depth_m") - pad).alias("depth_low"), (F.max("depth_m") + pad).alias("depth_high")
    )

"""Depth clusters of pooled breakpoints, and how stable they are."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import settle
from plumbline.plans.layout import (
    Layout, deal, exact_quantiles, finish, lag, last_known, lay, lead, next_known, row_number, running_sum,
)

METHODS = ("savgol", "lowess")
WIDE_M = 2.0
DELTAS = (0.3, 0.5, 1.0)
QUARTILES = {0.25: "_q1", 0.5: "depth_median", 0.75: "_q3"}


def cluster_depths(df, keys, z="depth_bgl_m", delta_m=0.5, tie=(), layout=None):
    """1-D single linkage: a gap of delta or more opens a new cluster; ids follow depth.

    `delta_m` is a number or the name of a column that is part of the keys.
    """
    if isinstance(delta_m, (int, float)):
        if delta_m <= 0:
            raise ValueError("delta_m must be positive")
        delta = F.lit(float(delta_m))
    else:
        delta = F.col(delta_m)
    track = lay(df, keys, [z, *tie], layout).scan(_before=lag(F.col(z)))
    opens = F.when(F.col(z) - F.col("_before") >= delta, 1).otherwise(0)
    track = track.scan(cluster_id=running_sum(opens))
    return finish(track.with_columns(cluster_id=F.col("cluster_id").cast("int")).on_drop("_before"))


def pool_breakpoints(fits, keys, trial="trial_1", z="depth_bgl_m", sizes=None):
    """Breakpoint records of one trial over all methods and sizes, or those from sizes[0] to sizes[1]."""
    wanted = F.col("trial") == trial
    if sizes is not None:
        wanted = wanted & F.col("n_breakpoints").between(*sizes)
    return (
        fits.where(wanted)
        .select(*keys, "smoothing", "n_breakpoints", F.posexplode("psis").alias("_p", z))
        .withColumn("bp_index", (F.col("_p") + 1).cast("int")).drop("_p")
    )


def largest_sizes(records, keys):
    """Largest fitted size per method, and which method and size combinations exist."""
    return records.groupBy(*keys, "smoothing").agg(
        F.max("n_breakpoints").alias("n_max"),
        F.count_distinct("n_breakpoints").alias("n_sizes"),
    )


def summarise_clusters(clustered, keys, z="depth_bgl_m", methods=METHODS, layout=None):
    """Position, spread and persistence of every cluster.

    Persistence adds up the sizes in which each method shows the cluster; agreement is
    the smallest of those counts.
    """
    group = [*keys, "cluster_id"]
    layout = layout or Layout.of(clustered, keys)
    # Model sizes are few, so their set is small; a set also spares the row expansion of
    # several distinct counts.
    sizes = [
        F.size(F.collect_set(F.when(F.col("smoothing") == m, F.col("n_breakpoints")))).cast("long").alias(f"n_{m}")
        for m in methods
    ]
    counts = [
        F.min(z).alias("depth_min"), F.max(z).alias("depth_max"), F.count("*").alias("n_bp_total"), *sizes,
    ]
    wanted = {"depth_median": (F.col(z), 0.5), "_q1": (F.col(z), 0.25), "_q3": (F.col(z), 0.75)}
    summary = exact_quantiles(clustered, group, wanted, layout, counts)
    return _shaped(summary, group, methods)


def _shaped(summary, group, methods):
    """Columns of a cluster table from its extremes, quartiles and counts."""
    each = [F.col(f"n_{m}") for m in methods]
    width = F.col("depth_max") - F.col("depth_min")
    return summary.select(
        *group, "depth_median", "depth_min", "depth_max",
        (F.col("_q3") - F.col("_q1")).alias("depth_iqr"),
        *[f"n_{m}" for m in methods],
        sum(each[1:], each[0]).alias("persistence"),
        (F.least(*each) if len(each) > 1 else each[0]).alias("agreement"),
        width.alias("cluster_diameter_m"), (width > WIDE_M).alias("wide_flag"), "n_bp_total",
    )


def bic_summary(curves, keys):
    """Lowest-BIC size per method and its BIC margin over one more breakpoint."""
    usable = curves.where(F.col("bic").isNotNull() & ~F.isnan("bic"))
    best = usable.groupBy(*keys).agg(
        F.min_by("n_breakpoints", F.struct("bic", "n_breakpoints")).alias("n_opt"),
        F.min("bic").alias("bic_opt"),
    )
    after = usable.select(
        *keys, (F.col("n_breakpoints") - 1).alias("n_opt"), F.col("bic").alias("bic_next")
    )
    return best.join(after, [*keys, "n_opt"], "left").withColumn(
        "delta_bic", F.col("bic_next") - F.col("bic_opt")
    )


def ranked_clusters(summary, keys, top=None, layout=None):
    """Clusters by agreement, then persistence, then depth; `top` keeps the first few."""
    order = F.struct(-F.col("agreement"), -F.col("persistence"), "depth_median", "cluster_id")
    track = lay(summary.withColumn("_rank_key", order), keys, ["_rank_key"], layout)
    ranked = finish(track.scan(rank=row_number()).on_drop("_rank_key"))
    ranked = ranked.withColumn("rank", (F.col("rank") + 1).cast("int"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def robust_depths(summary, keys, top=3, layout=None):
    """The best few cluster depths of a profile as text, best first."""
    return ranked_clusters(summary, keys, top, layout).groupBy(*keys).agg(
        F.concat_ws(", ", F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "depth_median"))),
            lambda s: F.format_string("%.2f", settle(s["depth_median"], 2)),
        )).alias("top_depths")
    )


def robustness(records, keys=("well_id",), delta_m=0.5, tie=("record_id",), layout=None):
    """Cluster table per profile at one delta."""
    clusters = cluster_depths(records, keys, delta_m=delta_m, tie=tie, layout=layout)
    summary = summarise_clusters(clusters, keys, layout=layout)
    return summary.withColumn("delta_m", F.lit(float(delta_m)))


def robustness_sensitivity(records, keys=("well_id",), deltas=DELTAS, tie=("record_id",), layout=None, z="depth_bgl_m",
                           methods=METHODS):
    """Cluster tables at several deltas from one scan of the gaps: delta is part of the key.

    A cluster at a delta is a run of clusters at the smallest one, as a gap that parts the larger parts the smaller.  So the
    records are scanned and aggregated once, at the smallest delta, and the few rows of that table are joined into runs for
    every delta.  The scan tells each record where its cluster begins and ends, so a record knows whether a median or quartile
    lies on it: no join looks ranks up, and with whole profiles nothing is shuffled behind the scan.
    """
    keys, deltas = [*keys], sorted({float(d) for d in deltas})
    if deltas[0] <= 0:
        raise ValueError("delta_m must be positive")
    layout = layout or Layout.of(records, keys)
    narrow = records.select(*keys, z, *[t for t in tie if t not in keys and t != z], "smoothing", "n_breakpoints")
    track = lay(deal(narrow, keys, layout), keys, [z, *tie], layout).scan(_before=lag(F.col(z)), _next=lead(F.col(z)), _rank=row_number())
    ids, ends = {}, {}
    for i, d in enumerate(deltas):
        opens = F.col("_before").isNull() | (F.col(z) - F.col("_before") >= d)
        closes = F.col("_next").isNull() | (F.col("_next") - F.col(z) >= d)
        ids[f"_id{i}"] = running_sum(F.when(F.col("_before").isNotNull() & opens, 1).otherwise(0))
        ends[f"_first{i}"] = last_known(F.when(opens, F.col("_rank")))
        ends[f"_last{i}"] = next_known(F.when(closes, F.col("_rank")))
    scanned = finish(track.scan(**ids, **ends))
    values = []
    for i in range(len(deltas)):
        top, step = F.col(f"_last{i}") - F.col(f"_first{i}"), F.col("_rank") - F.col(f"_first{i}")
        for q, name in QUARTILES.items():
            place = F.lit(q) * top
            values += [F.max(F.when(step == F.floor(place), F.col(z))).alias(f"_low{i}_{name}"),
                       F.max(F.when(step == F.ceil(place), F.col(z))).alias(f"_high{i}_{name}")]
    sizes = [F.collect_set(F.when(F.col("smoothing") == m, F.col("n_breakpoints"))).alias(f"_s_{m}") for m in methods]
    finest = scanned.groupBy(*keys, *ids).agg(
        F.min(z).alias("depth_min"), F.max(z).alias("depth_max"), F.count("*").alias("n_bp_total"), *sizes, *values)
    each = F.explode(F.array(*[
        F.struct(F.lit(d).alias("delta_m"), F.col(f"_id{i}").cast("int").alias("cluster_id"), *[
            F.col(f"{side}{i}_{name}").alias(f"{side}_{name}") for name in QUARTILES.values() for side in ("_low", "_high")])
        for i, d in enumerate(deltas)]))
    at = [F.max(f"_d.{side}_{name}").alias(f"{side}_{name}") for name in QUARTILES.values() for side in ("_low", "_high")]
    merged = finest.withColumn("_d", each).groupBy(*keys, "_d.delta_m", "_d.cluster_id").agg(
        F.min("depth_min").alias("depth_min"), F.max("depth_max").alias("depth_max"), F.sum("n_bp_total").alias("n_bp_total"),
        *[F.size(F.array_distinct(F.flatten(F.collect_list(f"_s_{m}")))).cast("long").alias(f"n_{m}") for m in methods], *at)
    for q, name in QUARTILES.items():
        place = F.lit(q) * (F.col("n_bp_total") - 1)
        share = place - F.floor(place)
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        merged = merged.withColumn(name, F.when(share == 0, low).otherwise((1 - share) * low + share * high))
    return _shaped(merged, [*keys, "delta_m", "cluster_id"], methods)


def depth_histogram(df, keys, z, width=0.5, low=None, high=None):
    """Counts per fixed-width bin; with `high`, that edge belongs to the last bin."""
    start = F.lit(0.0 if low is None else float(low))
    place = F.floor((F.col(z) - start) / F.lit(float(width)))
    if high is not None:
        last = F.lit(int(round((high - (low or 0.0)) / width)) - 1)
        place = F.when(F.col(z) == high, last).otherwise(place)
    return (
        df.withColumn("bin", place.cast("long")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
        .withColumn("bin_start", start + F.col("bin").cast("double") * F.lit(float(width)))
    )


def sampling_balance(df, keys, z, bins=20, layout=None):
    """Evenness of sampling over depth: largest over median count of the non-empty bins."""
    track = lay(df, keys, [z], layout).per_profile(_lo=F.min(z), _hi=F.max(z))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    place = F.coalesce(F.floor(F.try_divide(F.col(z) - F.col("_lo"), width)), F.lit(0))
    counts = (
        track.df.withColumn("bin", F.least(place, F.lit(bins - 1)))
        .groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    )
    return counts.groupBy(*keys).agg(
        F.max("n").alias("max_count"), F.percentile("n", 0.5).alias("median_count"),
        (F.max("n") / F.percentile("n", 0.5)).alias("imbalance"), F.count("*").alias("n_bins"),
    )

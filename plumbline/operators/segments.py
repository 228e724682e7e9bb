"""Breakpoints, segments and fit quality from saved sweep results."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import (
    estimate_of, hinge_value, interval_of, numbered_estimates,
)
from plumbline.operators.geometry import elbow


def breakpoint_rows(fits, keys, extra=()):
    """One row per breakpoint of each fit: position, model value, interval, 1-based index."""
    value = hinge_value(F.col("x_position"), F.col("const"), F.col("alpha1"), F.col("betas"), F.col("psis"))
    rows = fits.select(
        *keys, *extra, "const", "alpha1", "betas", "psis", "ci_low", "ci_high",
        F.posexplode("psis").alias("_p", "x_position"),
    )
    at = F.col("_p") + 1
    return rows.select(
        *keys, *extra, at.cast("int").alias("bp_index"), "x_position", value.alias("y_position"),
        F.try_element_at("ci_low", at).alias("ci_lower"), F.try_element_at("ci_high", at).alias("ci_upper"),
    )


def unpack_estimates(fits):
    """Arrays const, alpha1, betas, psis, ci_low, ci_high from the named-estimate map.

    A missing estimate stays null in its place; arrays are in numeric order.
    """
    est, n = F.col("estimates"), F.col("n_breakpoints")
    numbers = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))

    def end(place):
        return F.transform(numbers, lambda i: F.try_element_at(
            interval_of(est, F.concat(F.lit("breakpoint"), i.cast("string"))), F.lit(place)
        ))

    return fits.withColumns({
        "const": estimate_of(est, "const"), "alpha1": estimate_of(est, "alpha1"),
        "betas": numbered_estimates(est, "beta", n), "psis": numbered_estimates(est, "breakpoint", n),
        "ci_low": end(1), "ci_high": end(2),
    })


def best_trial_for_size(fits, keys, metric="bic"):
    """Lowest-BIC trial at each size; fits without a metric are left out."""
    usable = fits.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    index = F.regexp_extract("trial", r"(\d+)$", 1).cast("int")
    return usable.groupBy(*keys, "n_breakpoints").agg(
        F.min_by("trial", F.struct(F.col(metric), index)).alias("trial"),
        F.min(metric).alias(metric),
    )


def breakpoints_at(fits, keys, n, trial="trial_1", offsets=None, offset_keys=None):
    """Breakpoints at size n of one trial, or of the best trial (`best_bic`).

    Sorted by depth and numbered anew; with `offsets` (vadose_m per well and campaign)
    the below-ground depth is added.
    """
    chosen = fits.where((F.col("n_breakpoints") == n) & F.col("psis").isNotNull())
    if trial == "best_bic":
        best = best_trial_for_size(chosen, keys).select(*keys, "trial")
        chosen = chosen.join(best, [*keys, "trial"])
    else:
        chosen = chosen.where(F.col("trial") == trial)
    rows = breakpoint_rows(chosen, keys, ("trial", "n_breakpoints", "bic", "rss"))
    # A fit has n rows: number them inside the fit's own small array.
    body = F.struct("x_position", "y_position", "ci_lower", "ci_upper")
    packed = rows.groupBy(*keys, "trial", "n_breakpoints", "bic", "rss").agg(
        F.sort_array(F.collect_list(body)).alias("_rows")
    )
    out = packed.select(
        *keys, "trial", "n_breakpoints", "bic", "rss", F.posexplode("_rows").alias("_p", "_r")
    ).select(
        *keys, "trial", "n_breakpoints", "bic", "rss", (F.col("_p") + 1).alias("bp_index"),
        F.col("_r.x_position").alias("depth_m"), F.col("_r.y_position").alias("log10_sec"),
        F.col("_r.ci_lower").alias("ci_lower"), F.col("_r.ci_upper").alias("ci_upper"),
        (F.col("_r.ci_upper") - F.col("_r.ci_lower")).alias("ci_width"),
    )
    if offsets is not None:
        out = out.join(offsets, offset_keys or [*keys], "left").withColumn(
            "depth_bgl_m", F.col("depth_m") + F.col("vadose_m")
        )
    return out


def metric_curve(fits, keys):
    return fits.select(*keys, "trial", "n_breakpoints", "bic", "rss", "converged")


def trial_optima(fits, keys):
    """Per trial: size of lowest BIC, and the BIC and RSS elbows."""
    group = [*keys, "trial"]
    usable = fits.where(F.col("bic").isNotNull() & ~F.isnan("bic"))
    lowest = usable.groupBy(*group).agg(
        F.min_by("n_breakpoints", F.struct("bic", "n_breakpoints")).alias("min_bic_n")
    )
    bic = elbow(fits, group, "bic").select(*group, F.col("elbow").alias("best_n_bic"))
    rss = elbow(fits, group, "rss").select(*group, F.col("elbow").alias("best_n_rss"))
    return lowest.join(bic, group, "left").join(rss, group, "left")


def select_trial(fits, keys, metric="bic"):
    """Most frequent elbow size (first seen on ties), then its trial of lowest mean metric."""
    index = F.regexp_extract("trial", r"(\d+)$", 1).cast("int")
    bends = elbow(fits, [*keys, "trial"], metric).withColumn("_t", index)
    means = fits.groupBy(*keys, "trial").agg(F.avg(metric).alias("_mean"))
    votes = bends.groupBy(*keys, "elbow").agg(F.count("*").alias("_votes"), F.min("_t").alias("_first"))
    modal = votes.groupBy(*keys).agg(
        F.max_by("elbow", F.struct("_votes", -F.col("_first"))).alias("elbow"), F.max("_votes").alias("votes")
    )
    return (
        bends.join(modal, [*keys, "elbow"]).join(means, [*keys, "trial"])
        .groupBy(*keys, "elbow", "votes")
        .agg(F.min_by("trial", F.struct("_mean", "_t")).alias("trial"), F.min("_mean").alias("mean_metric"))
    )


def global_metrics(df, keys, y, yhat, p):
    """RSS, TSS, R2 and adjusted R2; undefined ratios are null.

    `p` is the number of predictors, or the name of a column that has it for each profile.
    """
    predictors = F.max(p) if isinstance(p, str) else F.lit(p)
    means = df.groupBy(*keys).agg(F.avg(y).alias("_mean"))
    rows = df.join(means, [*keys])
    sums = rows.groupBy(*keys).agg(
        F.sum((F.col(y) - F.col(yhat)) ** 2).alias("rss"),
        F.sum((F.col(y) - F.col("_mean")) ** 2).alias("tss"), F.count("*").alias("n"),
        predictors.alias("_p"),
    )
    r2 = 1 - F.try_divide(F.col("rss"), F.col("tss"))
    freedom = F.col("n") - F.col("_p") - 1
    adjusted = 1 - (1 - F.col("r2")) * F.try_divide((F.col("n") - 1).cast("double"), freedom)
    return sums.withColumn("r2", r2).withColumn("r2_adjusted", F.when(freedom > 0, adjusted)).drop("_p")


def assign_segments(samples, fits, keys, x="depth_m"):
    """Segment 1.. of each sample; a sample on a breakpoint belongs to the segment above it.

    Samples of profiles without a fit stay, with a null segment.
    """
    rows = samples.join(fits.select(*keys, "psis"), [*keys], "left")
    deeper = F.filter("psis", lambda p: F.col(x) > p)
    segment = F.when(F.col("psis").isNotNull(), F.size(deeper) + 1)
    return rows.withColumn("segment", segment).drop("psis")


def segment_regressions(segmented, keys, x="depth_m", y="log10_sec"):
    """Least-squares line per segment with RMS, RMS as % of range and of value, and R2.

    The second pass takes residuals from the fitted line, as the one-pass formula would
    lose digits; segments of one sample have no slope.
    Samples without a segment are left out.
    """
    group, segmented = [*keys, "segment"], segmented.where("segment is not null")
    lines = segmented.groupBy(*group).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.count("*").alias("n"), F.avg(y).alias("_mean"), (F.max(y) - F.min(y)).alias("_range"),
    )
    rows = segmented.join(lines, group)
    miss = F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))
    return _quality(rows.withColumn("_miss", miss), [*group, "slope", "intercept"], y)


def _quality(rows, group, y):
    sums = rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("_miss") ** 2)).alias("rms"),
        F.max("_range").alias("_range"), F.sum(F.col("_miss") ** 2).alias("_rss"),
        F.sum((F.col(y) - F.col("_mean")) ** 2).alias("_tss"),
        F.avg(F.try_divide(F.col("_miss"), F.col(y)) ** 2).alias("_relative"),
    )
    return sums.select(
        *group, "n", "rms",
        (100 * F.try_divide(F.col("rms"), F.col("_range"))).alias("rms_pct_range"),
        (100 * F.sqrt("_relative")).alias("rms_pct_value"),
        (1 - F.try_divide(F.col("_rss"), F.col("_tss"))).alias("r2"),
    )


def model_segments(fits, keys):
    """Model line of every segment: bounds, slope alpha + sum of betas above, end values.

    Needs x_min and x_max of the profile beside the fit arrays.
    """
    cuts = F.concat(F.array("x_min"), F.col("psis"), F.array("x_max"))
    rows = fits.select(
        *keys, "const", "alpha1", "betas", "psis", cuts.alias("_cuts"),
        F.explode(F.sequence(F.lit(1), F.size("psis") + 1)).alias("segment"),
    )
    start = F.try_element_at("_cuts", F.col("segment"))
    end = F.try_element_at("_cuts", F.col("segment") + 1)
    slope = F.col("alpha1") + F.aggregate(
        F.slice("betas", F.lit(1), F.col("segment") - 1), F.lit(0.0), lambda s, b: s + b
    )
    model = lambda x: hinge_value(x, F.col("const"), F.col("alpha1"), F.col("betas"), F.col("psis"))
    return rows.select(
        *keys, "segment", start.alias("x_start"), end.alias("x_end"), slope.alias("slope"),
        model(start).alias("y_start"), model(end).alias("y_end"),
    )


def model_quality_per_segment(samples, fits, keys, x="depth_m", y="log10_sec"):
    """R2 and RMS % of the global model within each segment; the last one is closed."""
    rows = samples.join(fits.select(*keys, "const", "alpha1", "betas", "psis"), [*keys])
    model = hinge_value(F.col(x), F.col("const"), F.col("alpha1"), F.col("betas"), F.col("psis"))
    rows = rows.withColumns({
        "segment": F.size(F.filter("psis", lambda p: F.col(x) > p)) + 1, "_miss": F.col(y) - model,
    })
    group = [*keys, "segment"]
    stats = rows.groupBy(*group).agg(F.avg(y).alias("_mean"), (F.max(y) - F.min(y)).alias("_range"))
    return _quality(rows.join(stats, group), group, y)


def compare_trials(fits, keys, n):
    """Per trial at size n: BIC, breakpoints found, first and last position, and spread."""
    rows = fits.where((F.col("n_breakpoints") == n) & F.col("psis").isNotNull())
    first, last = F.array_min("psis"), F.array_max("psis")
    return rows.select(
        *keys, "trial", "bic", F.size("psis").alias("n_found"), first.alias("first_position"),
        last.alias("last_position"), (last - first).alias("spread"),
    )


def trial_agreement(fits, keys, n):
    """Range over trials of the first and last breakpoint and of BIC."""
    each = compare_trials(fits, keys, n)
    return each.groupBy(*keys).agg(
        F.count("*").alias("n_trials"), F.min("bic").alias("bic_min"), F.max("bic").alias("bic_max"),
        (F.max("first_position") - F.min("first_position")).alias("first_spread"),
        (F.max("last_position") - F.min("last_position")).alias("last_spread"),
    )


def breakpoint_summary(breakpoints, slopes, offsets, keys, offset_keys, tolerance=1e-3):
    """Canonical rows: depths in both datums to 4 decimals, pair flags, artefact cross-check.

    The upper depth of each pair must equal its breakpoint's depth within the tolerance.
    """
    keys = [*keys]
    upper = slopes.select(
        *keys, F.col("pair_idx").alias("bp_index"), F.col("depth_top").alias("_other"),
        "is_top_of_mixing", "is_bottom_of_mixing",
    )
    gap = F.abs(F.col("depth_m") - F.col("_other"))
    joined = breakpoints.join(upper, [*keys, "bp_index"], "left").withColumn("_gap", gap)
    worst = joined.groupBy(*keys).agg(F.max("_gap").alias("max_abs_difference"))
    out = joined.join(worst, keys).join(offsets, offset_keys, "left")
    return out.select(
        *keys, "bp_index", F.round("depth_m", 4).alias("depth_wt_m"),
        F.round(F.col("depth_m") + F.col("vadose_m"), 4).alias("depth_bgl_m"),
        F.coalesce("is_top_of_mixing", F.lit(False)).alias("is_top_of_mixing"),
        F.coalesce("is_bottom_of_mixing", F.lit(False)).alias("is_bottom_of_mixing"),
        "max_abs_difference",
        F.when(F.col("max_abs_difference") <= tolerance, "ok").otherwise("artefacts_differ").alias("check_status"),
    )

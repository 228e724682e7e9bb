"""Profile smoothers: Savitzky-Golay (plain, segmented), LOWESS, isotonic."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.clean import add_log10, clean_casts
from plumbline.operators.isotonic_long import isotonic_long, pool_adjacent
from plumbline.operators.lowess_long import DIRECT, SCALE_FLOOR, PowerSums, local_values, lowess_long, tricube_moments
from plumbline.operators.resample import resample
from plumbline.plans.layout import (
    Layout, finish, lay, lead, next_known, row_number, running_max, running_sum, spread,
)
from plumbline.plans.session import ensure_checkpoint_dir


def odd_window(window):
    return window + 1 if window % 2 == 0 else window


def hat_matrix(window, order):
    """Least-squares polynomial fit of one window: smoothed values = H @ values."""
    t = np.arange(window, dtype=float) - window // 2
    a = np.vander(t / max(window // 2, 1), order + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def savgol(df, keys, z, v, window=11, order=3, out=None, layout=None):
    """Savitzky-Golay with end rows read off the first and last full window.

    Profiles shorter than the window stay as they are.  Rows whose window holds a null get
    null; rows at one depth follow the order of their values.
    """
    track = lay(df, keys, [z, v], layout).scan(_i=row_number()).per_profile(_n=F.count("*"))
    return finish(_savgol(track, [*keys], v, odd_window(window), order, out or v)).drop("_i", "_n")


def _window_powers(v, index, window, order):
    """Names and columns of a row's terms: its value times powers of its place, by which third run of rows it lies in.

    Places count from the middle of aligned runs of one window length, so they are at most one half; a window touches two
    such runs, and three classes tell them and their neighbours apart.  Sums of these terms over a window give all that a polynomial
    fit needs, and their number depends on the order alone.
    """
    run = F.floor(index / window)
    place = (index - run * window - window // 2) / F.lit(float(max(window // 2, 1)))
    terms = {}
    for third in range(3):
        for p in range(order + 1):
            power = F.lit(1.0) if p == 0 else F.pow(place, F.lit(float(p)))
            terms[f"_t{third}_{p}"] = F.when(run % 3 == third, F.col(v) * power).otherwise(F.when(F.col(v).isNull(), None).otherwise(0.0))
    return terms


def _about(sums, shifts, order):
    """Sums of value times (place - centre)^p over a window, from the sums of its runs' terms and the runs' shifts."""
    out = []
    for p in range(order + 1):
        total = None
        for third in range(3):
            inner = sums[f"_t{third}_0"]  # Horner's rule in the shift: sums of (term + shift)^p
            for q in range(1, p + 1):
                inner = inner * shifts[third] + F.lit(float(math.comb(p, q))) * sums[f"_t{third}_{q}"]
            total = inner if total is None else total + inner
        out.append(total)
    return out


def _savgol(track, group, v, window, order, out):
    """Smooth rows indexed _i of _n inside `group`, a refinement of the profile key.

    A window's fit is a matrix times the sums of its values by powers of their places.  The sums are moving ones, so a
    row carries a number of terms that follows the order and not the window's length.  Rows near an end read the fit of the
    first or last full window off at their own place.
    """
    if not window > order:
        raise ValueError("the window must be longer than the polynomial order")
    h = window // 2
    rows, parts, own = track.neighbourhood("_row" if "_row" in track.df.columns else "_i", window)
    if track.layout.split:
        parts = [*group, *[p for p in parts if p not in group]]
    else:
        parts = [*group]
    near = Window.partitionBy(*parts).orderBy("_i").rowsBetween(-h, h)
    every = Window.partitionBy(*parts)
    terms = _window_powers(v, F.col("_i"), window, order)
    rows = rows.withColumns({**terms, "_own": own})
    # a null makes the sums of every window that holds it null
    whole = F.count(F.when(F.col(v).isNull(), 1)).over(near) == 0
    rows = rows.withColumns({**{f"{t}s": F.sum(t).over(near) for t in terms}, "_whole": whole})
    sums = F.struct(*[F.when(F.col("_whole"), F.col(f"{t}s")).alias(t) for t in terms])
    rows = rows.withColumn("_sums", sums).drop(*terms, *[f"{t}s" for t in terms], "_whole")
    rows = rows.withColumns({
        "_head": F.max(F.when(F.col("_i") == h, F.col("_sums"))).over(every),
        "_tail": F.max(F.when(F.col("_i") == F.col("_n") - 1 - h, F.col("_sums"))).over(every),
    }).where("_own")
    # steps of their own, so that no expression is repeated inside another
    rows = rows.withColumn("_centre", F.greatest(F.lit(h), F.least(F.col("_i"), F.col("_n") - 1 - h)))
    rows = rows.withColumn("_run", F.floor(F.col("_centre") / window))
    step = lambda third: (third - F.col("_run") % 3 + 4) % 3 - 1  # -1, 0 or 1: the run before, this one, the next
    rows = rows.withColumns({
        "_used": F.when(F.col("_i") < h, F.col("_head")).when(F.col("_i") > F.col("_n") - 1 - h, F.col("_tail")).otherwise(F.col("_sums")),
        **{f"_shift{k}": ((F.col("_run") + step(k)) * window + h - F.col("_centre")) / F.lit(float(max(h, 1))) for k in range(3)}})
    moments = _about({t: F.col(f"_used.{t}") for t in terms}, [F.col(f"_shift{k}") for k in range(3)], order)
    rows = rows.withColumns({f"_m{p}": m for p, m in enumerate(moments)})
    # value at place t: t's powers times the inverse of the places' power sums times the moments
    places = (np.arange(window) - h) / max(h, 1)
    design = np.vander(places, order + 1, increasing=True)
    inverse = np.linalg.inv(design.T @ design)
    rows = rows.withColumn("_place", (F.col("_i") - F.col("_centre")) / F.lit(float(max(h, 1))))
    smooth = F.lit(0.0)
    for p in range(order, -1, -1):
        factor = F.lit(0.0)
        for q in range(order + 1):
            if inverse[p, q]:
                factor = factor + F.lit(float(inverse[p, q])) * F.col(f"_m{q}")
        smooth = smooth * F.col("_place") + factor
    rows = rows.withColumn(out, F.when(F.col("_n") >= window, smooth).otherwise(F.col(v)))
    return track.on(rows.drop(*[f"_shift{k}" for k in range(3)], *[f"_m{p}" for p in range(order + 1)], "_centre", "_run", "_place",
                              "_sums", "_head", "_tail", "_used", "_own", "_block"))


def segmented_savgol(df, keys, z, v, window=11, order=3, gradient_factor=20.0,
                     min_gradient=1000.0, out=None, layout=None):
    """Savitzky-Golay that leaves jumps alone.

    A step larger than max(median step * factor, floor) is a discontinuity.  Rows from
    half a window before it to half a window after it stay raw, and each stretch between
    guards is smoothed on its own when it is at least one window long.
    """
    window, h = odd_window(window), odd_window(window) // 2
    track = lay(df, keys, [z, v], layout).scan(_row=row_number(), _next=lead(F.col(v))).reorder("_row")
    track = track.with_columns(_jump=F.abs(F.col("_next") - F.col(v)))
    track = track.quantiles(_mid=(F.col("_jump"), 0.5))
    limit = F.greatest(F.col("_mid") * F.lit(float(gradient_factor)), F.lit(float(min_gradient)))
    hit = F.when(F.col("_jump") > limit, F.col("_row"))
    track = track.scan(_hit_before=running_max(hit), _hit_after=next_known(hit))
    guarded = F.coalesce(F.col("_row") - F.col("_hit_before") <= h + 1, F.lit(False)) | F.coalesce(
        F.col("_hit_after") - F.col("_row") <= h, F.lit(False)
    )
    track = track.with_columns(_guard=guarded)
    track = track.scan(_segment=running_sum(F.col("_guard").cast("int")))
    group = [*keys, "_guard", "_segment"]
    track = track.rekey(*group)
    track = track.scan(_i=row_number()).per_profile(_n=F.count("*"))
    track = track.with_columns(_n=F.when(F.col("_guard"), F.lit(0)).otherwise(F.col("_n")))
    done = _savgol(track.rekey(*keys), group, v, window, order, out or v)
    return finish(done).drop(
        "_i", "_n", "_row", "_next", "_jump", "_mid", "_hit_before", "_hit_after", "_guard", "_segment"
    )


def _tricube_fit(x, y, k, degree, robust):
    """One LOWESS pass over sorted x: local fits on the k nearest rows of each point."""
    n = len(x)
    # The window moves right while the row beyond its end is nearer than its first row.
    left = np.searchsorted(x[k:] + x[:n - k], 2 * x, side="left")
    out = np.empty(n)
    if k > DIRECT:
        power = PowerSums(x, robust, y, degree)
        for a in range(0, n, 1 << 16):
            low, at = left[a:a + (1 << 16)], x[a:a + (1 << 16)]
            reach = np.maximum(np.abs(x[low] - at), np.abs(x[low + k - 1] - at))
            out[a:a + (1 << 16)] = local_values(power.moments(low, low + k, at, reach), y[a:a + (1 << 16)], degree)
        return out
    step = max(1, 2_000_000 // k)
    for a in range(0, n, step):
        cols = left[a:a + step, None] + np.arange(k)
        dx = x[cols] - x[a:a + step, None]
        reach = np.maximum(np.abs(dx[:, 0]), np.abs(dx[:, -1]))
        moments = tricube_moments(dx, reach, robust[cols], y[cols], degree)
        out[a:a + step] = local_values(moments, y[a:a + step], degree)
    return out


def lowess_values(x, y, frac=0.05, degree=1, robust_passes=2):
    """LOWESS of one sorted profile; the robust scale is six median absolute residuals."""
    n = len(x)
    k = min(n, max(int(frac * n), degree + 2))
    if n < degree + 2:
        return y.copy()
    robust = np.ones(n)
    fit = _tricube_fit(x, y, k, degree, robust)
    for _ in range(robust_passes):
        scale = 6 * np.median(np.abs(y - fit)) + SCALE_FLOOR
        robust = np.clip(1 - ((y - fit) / scale) ** 2, 0, None) ** 2
        fit = _tricube_fit(x, y, k, degree, robust)
    return fit


def lowess(df, keys, z, v, frac=0.05, degree=1, robust_passes=2, out=None, layout=None):
    """Cleveland's LOWESS per profile; rows at one depth follow the order of their values.

    Whole profiles run in one grouped-map pass; see `lowess_long` for the others.
    """
    out = out or v
    layout = layout or Layout.of(df, keys)
    if not layout.split:
        def fit(pdf):
            pdf = pdf.sort_values([z, v], kind="stable")
            x, y = pdf[z].to_numpy(float), pdf[v].to_numpy(float)
            return pdf.assign(**{out: lowess_values(x, y, frac, degree, robust_passes)})

        return spread(df, keys).groupBy(*keys).applyInPandas(fit, _with_double(df.schema, out))
    return lowess_long(df, keys, z, v, frac, degree, robust_passes, out, layout)


def _with_double(schema, name):
    fields = [f for f in schema.fields if f.name != name]
    return T.StructType([*fields, T.StructField(name, T.DoubleType())]) if name not in schema.names else T.StructType(
        [T.StructField(f.name, T.DoubleType()) if f.name == name else f for f in schema.fields]
    )


def isotonic(df, keys, z, v, out=None, layout=None):
    """Non-decreasing fit in depth; was_changed marks rows moved by more than 1e-9.

    Rows at one depth follow the order of their values.  Whole profiles are pooled in one task; see
    `isotonic_long` for the others.
    """
    out = out or v
    layout = layout or Layout.of(df, keys)
    if layout.split:
        return isotonic_long(df, keys, z, v, out, layout)

    def fit(pdf):
        pdf = pdf.sort_values([z, v], kind="stable")
        y = pdf[v].to_numpy(float)
        new = pool_adjacent(y, np.ones(len(y)))
        return pdf.assign(**{out: new, "was_changed": np.abs(new - y) > 1e-9})

    schema = _with_double(df.schema, out).add("was_changed", T.BooleanType())
    return spread(df, keys).groupBy(*keys).applyInPandas(fit, schema)


def savgol_profiles(df, keys, z="depth_m", v="sec_us_cm", seq="seq", window=11, order=3,
                    segmented=True, dz=None, layout=None, **cleaning):
    """Clean, resample (PCHIP), smooth with Savitzky-Golay, take logarithms."""
    layout = layout or Layout.of(df, keys)
    grid = resample(
        clean_casts(df, keys, z, v, seq, layout=layout, **cleaning), keys, z, v, dz=dz, layout=layout
    )
    fit = segmented_savgol if segmented else savgol
    return add_log10(fit(grid, keys, z, v, window, order, layout=layout), v)


def lowess_profiles(df, keys, z="depth_m", v="sec_us_cm", seq="seq", frac=0.05, degree=1,
                    robust_passes=2, dz=None, layout=None, **cleaning):
    """Clean, resample (PCHIP), smooth with LOWESS, make monotone, take logarithms."""
    layout = layout or Layout.of(df, keys)
    grid = resample(
        clean_casts(df, keys, z, v, seq, layout=layout, **cleaning), keys, z, v, dz=dz, layout=layout
    )
    smooth = lowess(grid, keys, z, v, frac, degree, robust_passes, layout=layout)
    return add_log10(isotonic(smooth, keys, z, v, layout=layout).drop("was_changed"), v)


def window_profiles(grid, keys, windows, z="depth_m", v="sec_us_cm", order=3, layout=None):
    """The resampled profiles smoothed with every window, which is a column of the result."""
    keys = [*keys]
    layout = layout or Layout.of(grid, keys)
    ensure_checkpoint_dir(grid.sparkSession)
    grid = grid.checkpoint()  # else the casts are cleaned and resampled once for every window
    stacked = None
    for window in windows:
        one = savgol(grid, keys, z, v, window, order, layout=layout).withColumn("window", F.lit(window))
        stacked = one if stacked is None else stacked.unionByName(one)
    return add_log10(stacked, v)


def window_robustness(fits, keys, delta_m=0.5, layout=None):
    """Clusters of the breakpoints of all converged fits per profile and window."""
    from plumbline.operators.cluster import robustness

    group = [*keys, "window"]
    records = fits.where("converged").select(
        *group, F.lit("savgol").alias("smoothing"), "n_breakpoints",
        F.posexplode("psis").alias("record_id", "depth_bgl_m"),
    )
    return robustness(records, group, delta_m, tie=("n_breakpoints", "record_id"), layout=layout)


def window_sensitivity(grid, keys, windows, z="depth_m", v="sec_us_cm", order=3, delta_m=0.5,
                       layout=None, **sweep_options):
    """Robustness of breakpoints to the smoothing window: every window's own fits feed its clusters."""
    from plumbline.operators.sweep import sweep

    layout = layout or Layout.of(grid, keys)
    profiles = window_profiles(grid, keys, windows, z, v, order, layout)
    fits = sweep(profiles, [*keys, "window"], z, "log10_sec", layout=layout, **sweep_options)
    return window_robustness(fits, keys, delta_m, layout)

"""Curve geometry over breakpoints: chord slopes, turning angles, transition zones."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import turning_angle
from plumbline.plans.layout import finish, lag, lay, lead, row_number

BOTTOM_SEC = 40_000.0
TIE = 1e-12


def chord_slopes(df, keys, index="bp_index", z="depth_m", y="log10_sec", layout=None):
    """One row per pair of consecutive breakpoints, with slopes in log and linear units."""
    track = lay(df, keys, [index], layout).scan(_z=lead(F.col(z)), _y=lead(F.col(y)))
    dz = F.col("_z") - F.col(z)
    top, bottom = F.pow(F.lit(10.0), F.col(y)), F.pow(F.lit(10.0), F.col("_y"))
    slope = F.try_divide(F.col("_y") - F.col(y), dz)
    return track.df.where("_z is not null").select(
        *keys, F.col(index).alias("pair_idx"),
        F.col(z).alias("depth_top"), F.col("_z").alias("depth_bottom"),
        F.col(y).alias("log10_sec_top"), F.col("_y").alias("log10_sec_bottom"),
        top.alias("sec_top_us_cm"), bottom.alias("sec_bottom_us_cm"),
        slope.alias("slope_log10"),
        F.try_divide(bottom - top, dz).alias("slope_linear_us_cm_per_m"),
        F.signum(slope).cast("int").alias("slope_sign"),
        F.when(dz > 0, "ok").otherwise("not_ascending").alias("pair_status"),
    )


def turning_angles(df, keys, index="bp_index", z="depth_m", y="log10_sec", layout=None):
    """Turning angle at each interior breakpoint, both axes scaled to 0..1 per profile.

    End points, and profiles that are flat on an axis, get null.
    """
    return finish(_angles(lay(df, keys, [index], layout), z, y)).drop("_n", "_span")


def _angles(track, z, y):
    track = track.per_profile(
        _z0=F.min(z), _z1=F.max(z), _y0=F.min(y), _y1=F.max(y), _n=F.count("*")
    )
    track = track.with_columns(
        _x=F.try_divide(F.col(z) - F.col("_z0"), F.col("_z1") - F.col("_z0")),
        _v=F.try_divide(F.col(y) - F.col("_y0"), F.col("_y1") - F.col("_y0")),
        _span=F.col("_y1") - F.col("_y0"),
    )
    track = track.scan(
        _px=lag(F.col("_x")), _pv=lag(F.col("_v")), _nx=lead(F.col("_x")), _nv=lead(F.col("_v"))
    )
    angle = turning_angle(
        F.col("_x") - F.col("_px"), F.col("_v") - F.col("_pv"),
        F.col("_nx") - F.col("_x"), F.col("_nv") - F.col("_v"),
    )
    return track.with_columns(turning_angle=angle).on_drop(
        "_z0", "_z1", "_y0", "_y1", "_x", "_v", "_px", "_pv", "_nx", "_nv"
    )


def _first_max(angle, index, allowed):
    """Index and angle of the largest allowed angle, the first one on ties."""
    return F.max_by(
        F.struct(F.col(index).alias("i"), F.col(angle).alias("a")),
        F.when(allowed & F.col(angle).isNotNull(), F.struct(F.col(angle), -F.col(index))),
    )


def transition_zone(df, keys, index="bp_index", z="depth_m", y="log10_sec",
                    bottom=BOTTOM_SEC, top=None, layout=None):
    """Flag the top and bottom breakpoints of the mixing zone.

    TOP has the largest turning angle (among values below `top` when given); BOTTOM has
    the largest angle among the other points with value >= `bottom`.  End points never
    bend, so short profiles have one candidate: the interior one of three points, the first
    of two (it opens the only pair).  It is TOP, and BOTTOM as well if it reaches the threshold.  A
    candidate that `top` rules out leaves such a profile without flags, status no_top_candidate.
    `bottom` and `top` may be columns.
    """
    track = _angles(lay(df, keys, [index], layout), z, y).scan(_i=row_number())
    value = F.pow(F.lit(10.0), F.col(y))
    return finish(_flag_zone(track, index, value, "high", bottom, top, lone=True))


def _flag_zone(track, index, value, side, bottom, top, lone=False):
    """`lone`: a profile's only candidate may be both ends of the zone."""
    column = lambda t: t if t is None or not isinstance(t, (int, float)) else F.lit(float(t))
    bottom, top = column(bottom), column(top)
    eligible = value >= bottom if side == "high" else value <= bottom
    below_top = F.lit(True) if top is None else F.when(top.isNull(), True).otherwise(value < top)
    track = track.with_columns(
        _eligible=F.coalesce(eligible, F.lit(False)), _may_top=F.coalesce(below_top, F.lit(False))
    )
    single = ((F.col("_n") == 2) & (F.col("_i") == 0)) | ((F.col("_n") == 3) & F.col("turning_angle").isNotNull())
    single = F.coalesce(single, F.lit(False)) & F.lit(lone)
    track = track.with_columns(_single=single & F.col("_may_top"), _ruled=single & ~F.col("_may_top")).per_profile(
        _refused=F.max("_ruled"), _best=_first_max("turning_angle", index, F.col("_may_top")), _bent=F.count("turning_angle"),
        _lone=F.min(F.when(F.col("_single"), F.struct(F.col(index).alias("i"), (~F.col("_eligible")).alias("dry")))),
    )
    track = track.with_columns(_top=F.coalesce(F.col("_lone.i"), F.col("_best.i")))
    other = F.col("_eligible") & ~F.coalesce(F.col(index) == F.col("_top"), F.lit(False))
    track = track.with_columns(_other=other).per_profile(
        _bottom=_first_max("turning_angle", index, F.col("_other")),
    )
    bottom_index = F.when(F.col("_refused"), None).when(F.col("_lone").isNull(), F.col("_bottom.i")).when(
        ~F.col("_lone.dry"), F.col("_lone.i"))
    close = (
        F.col("_other") & (F.col(index) != F.col("_bottom.i"))
        & (F.abs(F.col("turning_angle") - F.col("_bottom.a")) <= TIE * F.abs(F.col("_bottom.a")))
    )
    track = track.with_columns(_close=F.coalesce(close, F.lit(False))).per_profile(_ties=F.count_if("_close"))
    status = (
        F.when(F.col("_n") < 2, "too_few_points")
        .when(F.col("_refused"), "no_top_candidate")
        .when((F.col("_span") == 0) & F.col("_lone").isNull(), "flat")
        .when(F.col("_top").isNull() & (F.col("_bent") > 0), "no_top_candidate")
        .when(bottom_index.isNull(), "no_bottom_candidate").otherwise("ok")
    )
    return track.with_columns(
        is_top_of_mixing=F.coalesce(F.col(index) == F.col("_top"), F.lit(False)),
        is_bottom_of_mixing=F.coalesce(F.col(index) == bottom_index, F.lit(False)),
        bot_tie=(F.col("_ties") > 0) & ~F.col("_refused"),
        mz_status=status,
    ).on_drop("_top", "_best", "_bent", "_lone", "_single", "_ruled", "_refused", "_bottom", "_ties", "_close", "_other",
              "_eligible", "_may_top", "_n", "_span", "_i")


def flag_pairs(df, keys, index="bp_index", z="depth_m", y="log10_sec",
               bottom=BOTTOM_SEC, top=None, layout=None):
    """Chord-slope table with the zone flags of each pair's upper breakpoint."""
    layout = layout or lay(df, keys, [index]).layout
    flags = transition_zone(df, keys, index, z, y, bottom, top, layout).select(
        *keys, F.col(index).alias("pair_idx"), "is_top_of_mixing", "is_bottom_of_mixing", "mz_status"
    )
    pairs = chord_slopes(df, keys, index, z, y, layout)
    return pairs.join(flags, [*keys, "pair_idx"], "left")


def promote_pair_flags(breakpoints, pairs, keys, index="bp_index"):
    """Give each breakpoint the flags of the pair it opens.

    The last breakpoint opens no pair, so it is never flagged; when a profile does not
    have exactly one pair fewer than breakpoints, none of its rows is.
    """
    keys = [*keys]
    points = breakpoints.groupBy(*keys).agg(F.count("*").alias("_points"))
    chords = pairs.groupBy(*keys).agg(F.count("*").alias("_chords"))
    fits = points.join(chords, keys, "left").withColumn(
        "_fits", F.coalesce(F.col("_chords") == F.col("_points") - 1, F.lit(False))
    )
    flags = pairs.select(
        *keys, F.col("pair_idx").alias(index), "is_top_of_mixing", "is_bottom_of_mixing"
    )
    out = breakpoints.join(flags, [*keys, index], "left").join(fits, keys, "left")
    return out.withColumns({
        c: F.coalesce(F.col(c) & F.col("_fits"), F.lit(False))
        for c in ("is_top_of_mixing", "is_bottom_of_mixing")
    }).drop("_points", "_chords", "_fits")


def resistivity_zone(df, keys, z="depth_bgl_m", rho="resist_ohm_m", bottom=10.0, layout=None):
    """Mixing zone on log10 resistivity: low resistivity is salt, so BOTTOM needs rho <= bottom.

    End points are never selected, so three points have a TOP only.  Fewer than three
    points, or a flat curve, select nothing; a profile with a
    non-positive resistivity gets status `not_positive`.
    """
    track = lay(df, keys, [z], layout).scan(_i=row_number())
    track = track.with_columns(
        bp_index=(F.col("_i") + 1).cast("int"), _log=F.when(F.col(rho) > 0, F.log10(rho)),
        _bad=F.coalesce(F.col(rho) <= 0, F.lit(False)),
    )
    track = _angles(track, z, "_log").per_profile(_any_bad=F.max("_bad"))
    usable = (F.col("_n") >= 3) & ~F.col("_any_bad")
    track = track.with_columns(turning_angle=F.when(usable, F.col("turning_angle")))
    short = F.col("_n") < 3
    track = track.with_columns(_short=short)
    done = _flag_zone(track, "bp_index", F.when(usable, F.col(rho)), "low", bottom, None)
    some = F.col("_short") | F.col("_any_bad")
    done = done.with_columns(
        is_bottom_of_mixing=F.when(some, False).otherwise(F.col("is_bottom_of_mixing")),
        mz_status=F.when(F.col("_any_bad"), "not_positive").when(F.col("_short"), "too_few_points")
        .otherwise(F.col("mz_status")),
    )
    return finish(done.on_drop("_log", "_bad", "_any_bad", "_short"))


def elbow(df, keys, metric, index="n_breakpoints", normalise=False):
    """Model size farthest from the line joining the first and last metric value.

    Curves are short (one point per model size), so plain grouped aggregates do; sizes
    with a null metric are skipped.
    """
    curve = df.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    point = F.struct(F.col(index).cast("double").alias("x"), F.col(metric).cast("double").alias("y"))
    ends = curve.groupBy(*keys).agg(
        F.min_by(point, F.col(index)).alias("_a"), F.max_by(point, F.col(index)).alias("_b"),
        F.min(metric).alias("_lo"), F.max(metric).alias("_hi"),
    )
    joined = curve.join(ends, [*keys])
    unit = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    width = F.greatest(F.col("_b.x") - F.col("_a.x"), F.lit(1.0))
    unit, width = (unit, width) if normalise else (F.lit(1.0), F.lit(1.0))
    dx, dy = (F.col("_b.x") - F.col("_a.x")) / width, (F.col("_b.y") - F.col("_a.y")) / unit
    px, py = (F.col(index) - F.col("_a.x")) / width, (F.col(metric) - F.col("_a.y")) / unit
    distance = F.coalesce(F.try_divide(F.abs(dx * py - dy * px), F.sqrt(dx * dx + dy * dy)), F.lit(0.0))
    return joined.withColumn("_d", distance).groupBy(*keys).agg(
        F.max_by(F.col(index), F.struct(F.col("_d"), -F.col(index))).alias("elbow"),
        F.max("_d").alias("elbow_distance"),
    )

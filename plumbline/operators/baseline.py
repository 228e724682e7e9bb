"""Running-minimum baselines over width logs."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import lerp
from plumbline.operators.resample import hermite, pchip_slopes
from plumbline.plans.layout import (
    finish, last_known, lay, lead, next_known, row_number, running_min, running_sum,
)

INCH_CM = 2.54
DIRECTIONS = ("top_down", "bottom_up")
KINDS = ("step", "linear", "pchip")


def running_minimum(df, keys, z, v, direction="top_down", layout=None):
    """Cumulative minimum of v along z, from the top or from the bottom."""
    _check(direction, DIRECTIONS)
    track = lay(df, keys, [z, v], layout).scan(
        running_min=running_min(F.col(v), reverse=direction == "bottom_up")
    )
    return finish(track)


def anchors(df, keys, z, v, direction="top_down", layout=None):
    """Rows where the running minimum strictly drops, and the first row."""
    track = _with_anchor(lay(df, keys, [z, v], layout), F.col(v), direction)
    return finish(track.on(track.df.drop("anchor_y")))


def _with_anchor(track, v, direction):
    """running_min, is_anchor and anchor_y; the minimum before a row decides."""
    back = direction == "bottom_up"
    track = track.scan(
        running_min=running_min(v, reverse=back),
        _before=running_min(v, reverse=back, exclusive=True),
    )
    drop = v.isNotNull() & (F.col("_before").isNull() | (v < F.col("_before")))
    return track.with_columns(is_anchor=drop, anchor_y=F.when(drop, v)).on_drop("_before")


def single_zone_baseline(df, keys, z, v, kind="linear", direction="top_down", layout=None):
    """Baseline of one zone: step, linear or PCHIP through the anchors."""
    _check(kind, KINDS)
    _check(direction, DIRECTIONS)
    return finish(_baseline(lay(df, keys, [z, v], layout), z, F.col(v), kind, direction))


def _baseline(track, z, v, kind, direction):
    """Adds baseline_cm; v is null on rows that must not shape the baseline."""
    track = _with_anchor(track, v, direction)
    if kind == "step":
        edge = last_known(v) if direction == "bottom_up" else next_known(v)
        track = track.scan(_edge=edge)
        return track.with_columns(
            baseline_cm=F.coalesce("running_min", "_edge")
        ).on_drop("_edge", "running_min", "anchor_y")
    point = F.when(F.col("is_anchor"), F.struct(F.col(z).alias("x"), F.col("anchor_y").alias("y")))
    if kind == "linear":
        track = track.scan(_low=last_known(point), _high=next_known(point))
        value = lerp(F.col(z), F.col("_low.x"), F.col("_low.y"), F.col("_high.x"), F.col("_high.y"))
        return track.with_columns(baseline_cm=value).on_drop(
            "_low", "_high", "running_min", "anchor_y"
        )
    keys = [*track.keys]
    knots = track.on(
        track.df.where("is_anchor").select(
            *track.window_keys, F.col(z).alias("x0"), F.col("anchor_y").alias("y0")
        )
    )
    knots = pchip_slopes(type(track)(knots.df, track.keys, ("x0",), track.layout), "x0", "y0")
    knots = knots.scan(_knot=row_number(), x1=lead(F.col("x0")), y1=lead(F.col("y0")), d1=lead(F.col("d0")))
    pieces = knots.df.where("x1 is not null or _knot = 0").select(
        *keys, (F.col("_knot") + 1).alias("_piece"), "x0", "y0", "d0", "x1", "y1", "d1"
    )
    counts = knots.df.groupBy(*keys).agg(F.count("*").alias("_knots"))
    track = track.scan(_seen=running_sum(F.col("is_anchor").cast("int")))
    rows = track.df.join(counts, keys, "left").withColumn(
        "_piece",
        F.greatest(F.lit(1), F.least(F.col("_seen"), F.col("_knots") - 1)).cast("long"),
    )
    rows = rows.join(pieces, [*keys, "_piece"], "left")
    value = F.when(F.col("x1").isNull(), F.col("y0")).otherwise(hermite(F.col(z)))
    rows = rows.withColumn("baseline_cm", value).drop(
        "x0", "y0", "d0", "x1", "y1", "d1", "_piece", "_seen", "_knots", "running_min", "anchor_y"
    )
    return track.on(rows.checkpoint() if track.layout.split else rows)


def valid_samples(track, v, floor, iqr_k):
    """is_valid: at or above the floor and the lower fence of floor-passing samples.

    `iqr_k` None switches the fence off.
    """
    passing = F.when(F.col(v) >= floor, F.col(v))
    track = track.quantiles(_q1=(passing, 0.25), _q3=(passing, 0.75))
    ok = F.col(v) >= floor
    if iqr_k is not None:
        ok = ok & (F.col(v) >= F.col("_q1") - F.lit(float(iqr_k)) * (F.col("_q3") - F.col("_q1")))
    ok = F.coalesce(ok, F.lit(False))
    return track.with_columns(is_valid=ok).on_drop("_q1", "_q3")


def two_zone_baseline(
    df, keys, z="depth_m", v="caliper_cm", trim="trim_depth_m", floor=None, kind="linear",
    direction="top_down", analyse_shallow=True, iqr_k=1.5, layout=None,
):
    """Independent baselines above and below the trim depth of each profile.

    `trim` and `floor` name columns, so each profile brings its own.  A zone with fewer
    than two valid samples is labelled `excluded` and gets no baseline.
    """
    _check(kind, KINDS)
    _check(direction, DIRECTIONS)
    floor = F.col("auger_in") * F.lit(INCH_CM) if floor is None else floor
    track = valid_samples(lay(df, keys, [z, v], layout), v, floor, iqr_k)
    shallow = F.col(z) < F.col(trim)
    good = F.col("is_valid").cast("int")
    track = track.per_profile(
        _good_shallow=F.sum(F.when(shallow, good)), _good_deep=F.sum(F.when(~shallow, good))
    )
    zone = F.when(shallow, "shallow").otherwise("deep")
    usable = F.when(shallow, F.col("_good_shallow")).otherwise(F.col("_good_deep")) >= 2
    if not analyse_shallow:
        usable = usable & ~shallow
    track = track.with_columns(_zone=zone, _usable=F.coalesce(usable, F.lit(False)))
    track = track.with_columns(
        zone_label=F.when(F.col("_usable"), F.col("_zone")).otherwise("excluded"),
        _v=F.when(F.col("is_valid") & F.col("_usable"), F.col(v)),
    )
    zoned = _baseline(track.rekey(*keys, "_zone"), z, F.col("_v"), kind, direction)
    done = zoned.rekey(*keys).on_drop("_zone", "_usable", "_v", "_good_shallow", "_good_deep")
    return finish(done)


def _check(value, allowed):
    if value not in allowed:
        raise ValueError(f"{value!r} is not one of {allowed}")

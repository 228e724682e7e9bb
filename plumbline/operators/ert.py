"""Resistivity profiles and their comparison with conductivity."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import lerp
from plumbline.plans.layout import finish, last_known, lay, next_known

X_TOLERANCE = 1e-6


def to_positive_depth(df, z="depth", out="depth_bgl_m"):
    """Source depth is negative downward; below-ground depth is positive."""
    return df.withColumn(out, -F.col(z)).drop(z)


def constant_position(df, keys, x="x", tolerance=1e-9):
    """Profiles whose position along the transect is not constant."""
    return df.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("x_range")).withColumn(
        "x_status", F.when(F.col("x_range") <= tolerance, "ok").otherwise("x_varies")
    )


def select_traces(df, x=None, transects=None, tolerance=X_TOLERANCE):
    """Filter by position within a tolerance and by transect."""
    if x is not None:
        df = df.where(F.abs(F.col("x") - F.lit(float(x))) <= tolerance)
    return df if transects is None else df.where(F.col("transect").isin(*transects))


def require_traces(df, x, tolerance=X_TOLERANCE):
    """select_traces, raising with the positions on offer when none matches."""
    chosen = select_traces(df, x, tolerance=tolerance)
    if chosen.isEmpty():
        offered = df.agg(F.array_join(F.array_sort(F.collect_set("x")).cast("array<string>"), ", ")).first()[0]
        raise ValueError(f"no trace at x={x}; positions are {offered}")
    return chosen


def trim_association(association):
    """Well to (transect, x) table with trimmed text; notes are optional."""
    notes = F.trim("notes") if "notes" in association.columns else F.lit(None).cast("string")
    return association.select(
        F.trim("well_id").alias("well_id"), F.trim("transect").alias("transect"),
        F.col("x").cast("double").alias("x"), notes.alias("notes"),
    )


def interpolate_at(points, curve, keys, z="depth_bgl_m", value="resist_ohm_m", tie=(), layout=None):
    """Curve value at each point's depth, linear between neighbours and clamped at the ends.

    Points and curve rows are stacked and read in depth order: the nearest curve rows on
    either side are the last and next known ones.
    """
    extra = [c for c in points.columns if c not in (*keys, z)]
    left = points.select(*keys, z, F.struct(*extra).alias("_point"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_kind"))
    right = curve.select(*keys, z, F.lit(None).cast(left.schema["_point"].dataType).alias("_point"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_kind"))
    known = F.when(F.col("_kind") == 0, F.struct(F.col(z).alias("z"), F.col("_v").alias("v")))
    stacked = left.unionByName(right).withColumns({f"_tie_{t}": F.col(f"_point.{t}") for t in tie})
    track = lay(stacked, keys, [z, "_kind", *[f"_tie_{t}" for t in tie]], layout)
    track = track.scan(_a=last_known(known), _b=next_known(known)).where("_kind = 1")
    found = lerp(F.col(z), F.col("_a.z"), F.col("_a.v"), F.col("_b.z"), F.col("_b.v"))
    return finish(track).select(*keys, z, "_point.*", found.alias(value))


def comparison(jobs, association, profiles, slopes, traces):
    """Per job: what of profile, slopes, association and trace is there, and the skip reason.

    Every table brings one row per key: profiles and slopes per well, traces per
    (transect, x).
    """
    joined = (
        jobs.join(association.select("well_id", "transect", "x"), "well_id", "left")
        .join(profiles, "well_id", "left").join(slopes, "well_id", "left")
        .join(traces, ["transect", "x"], "left")
    )
    reason = (
        F.when(F.col("transect").isNull(), "no_association").when(F.col("n_samples").isNull(), "no_profile")
        .when(F.col("n_pairs").isNull(), "no_slopes").when(F.col("n_trace").isNull(), "no_trace")
    )
    return joined.withColumns({"reason": reason, "status": F.when(reason.isNull(), "ok").otherwise("skipped")})

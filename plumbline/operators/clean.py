"""Cleaning of raw casts before resampling."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import log10_positive, shift_probe, to_below_ground
from plumbline.plans.layout import finish, lay, row_number, running_max


def chronological(df, keys, time=None, fraction=None, rows=("row_no",), layout=None):
    """Number the rows of a cast by (time, fraction, source position).

    Without a time column the source order stands and `order_status` says so.
    """
    timed = [c for c in (time, fraction) if c in df.columns]
    track = lay(df, keys, [*timed, *rows], layout).scan(seq=row_number())
    status = "by_time" if time in df.columns else "no_time_column"
    return finish(track.with_columns(order_status=F.lit(status)))


def drop_negative_depths(df, z="depth_m"):
    """Keep depths at or below the water table; NaN and null depths go too."""
    return df.where((F.col(z) >= 0) & ~F.isnan(z))


def adjust_depth(df, z="depth_m", adjustment=0.272, method="TOM"):
    return df.withColumn(z, shift_probe(F.col(z), adjustment, method))


def add_log10(df, v="sec_us_cm", out="log10_sec"):
    return df.withColumn(out, log10_positive(F.col(v)))


def add_below_ground(df, z="depth_m", offset="vadose_m", out="depth_bgl_m"):
    """Below-ground depth where the offset is known, null elsewhere."""
    return df.withColumn(out, to_below_ground(F.col(z), F.col(offset)))


def above_floor(df, v="sec_us_cm", floor=200.0):
    """Drop in-air readings below the conductivity floor."""
    return df.where(F.col(v) >= floor)


def mark_descent(df, keys, z, seq, tolerance=0.002, layout=None):
    """is_kept and reversal_m: a row stays if it is no shallower than the deepest before it.

    A rejected row lies above that maximum, so the plain running maximum of all earlier
    rows equals the running maximum of the kept ones.
    """
    track = lay(df, keys, [seq], layout).scan(_deepest=running_max(F.col(z), exclusive=True))
    kept = F.col("_deepest").isNull() | (F.col(z) >= F.col("_deepest") - F.lit(tolerance))
    return finish(track.with_columns(
        is_kept=kept,
        reversal_m=F.greatest(F.coalesce(F.col("_deepest") - F.col(z), F.lit(0.0)), F.lit(0.0)),
    ).on_drop("_deepest"))


def descent_filter(df, keys, z, seq, tolerance=0.002, layout=None):
    marked = mark_descent(df, keys, z, seq, tolerance, layout)
    return marked.where("is_kept").drop("is_kept", "reversal_m")


def descent_statistics(df, keys, z, seq, tolerance=0.002, layout=None):
    """Rows in, kept and removed per cast, and the largest reversal."""
    return mark_descent(df, keys, z, seq, tolerance, layout).groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count_if("is_kept").alias("n_kept"),
        F.count_if(~F.col("is_kept")).alias("n_removed"),
        (F.count_if(~F.col("is_kept")) * 100.0 / F.count("*")).alias("pct_removed"),
        F.max("reversal_m").alias("max_reversal_m"),
    )


def average_duplicates(df, keys, z="depth_m", v="sec_us_cm"):
    """One row per depth with the mean value; other columns go."""
    return df.groupBy(*keys, z).agg(F.avg(v).alias(v))


def duplicate_report(df, keys, z="depth_m"):
    return df.groupBy(*keys, z).agg(F.count("*").alias("frequency")).where("frequency > 1")


def clean_casts(df, keys, z="depth_m", v="sec_us_cm", seq="seq", adjustment=0.272,
                method="TOM", tolerance=0.002, layout=None):
    """Shared prefix of both smoothing recipes: adjust, trim, descend, merge duplicates."""
    rows = drop_negative_depths(adjust_depth(df, z, adjustment, method), z)
    return average_duplicates(descent_filter(rows, keys, z, seq, tolerance, layout), keys, z, v)


def cleaning_counts(df, keys, z="depth_m", v="sec_us_cm", seq="seq", adjustment=0.272,
                    method="TOM", tolerance=0.002, layout=None):
    """Rows left after each cleaning step, per cast."""
    shifted = adjust_depth(df, z, adjustment, method)
    raw = shifted.groupBy(*keys).agg(F.count("*").alias("n_raw"))
    marked = mark_descent(drop_negative_depths(shifted, z), keys, z, seq, tolerance, layout)
    per_depth = marked.groupBy(*keys, z).agg(
        F.count("*").alias("_rows"), F.count_if("is_kept").alias("_kept")
    )
    later = per_depth.groupBy(*keys).agg(
        F.sum("_rows").alias("n_non_negative"), F.sum("_kept").alias("n_descending"),
        F.count_if(F.col("_kept") > 0).alias("n_distinct"),
    )
    steps = ["n_non_negative", "n_descending", "n_distinct"]
    return raw.join(later, [*keys], "left").fillna(0, steps)

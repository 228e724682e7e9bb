"""Instrument-noise estimates from quiet depth intervals."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.plans.layout import Layout, finish, lay, lead, row_number

MAD_TO_SIGMA = 1.4826
LEAST_ROWS = 3


def moving_average(df, keys, z, v, points, out="smooth", layout=None):
    """Centred moving average with reflected ends; `points` is a number or column.

    The window length may differ between profiles.  Each row sits at index / (half + 1/2),
    so that the rows within `half` of it are exactly those within one unit, and one range
    frame serves every profile.  Rows near an end are repeated at their mirrored indices.
    """
    points = F.lit(points) if isinstance(points, (int, float)) else points
    track = lay(df, keys, [z, v], layout).scan(_i=row_number()).per_profile(_n=F.count("*"))
    return finish(_moving_average(track, v, points, out)).drop("_i", "_n")


def _moving_average(track, v, points, out):
    odd = F.when(points % 2 == 0, points + 1).otherwise(points).cast("long")
    track = track.with_columns(_half=F.floor((F.greatest(odd, F.lit(1)) - 1) / 2))
    i, n, half = F.col("_i"), F.col("_n"), F.col("_half")
    period = F.greatest(2 * (n - 1), F.lit(1))
    turns = F.sequence(-F.ceil(half / period) - 1, F.ceil(half / period) + 1)
    images = F.array_distinct(F.flatten(F.transform(
        turns, lambda m: F.array(i + period * m, -i + period * m)
    )))
    near_end = (i <= half) | (i >= n - 1 - half)
    places = F.when((n > 1) & near_end, F.filter(images, lambda p: (p >= -half) & (p <= n - 1 + half)))
    rows, parts, own = track.with_columns(
        _place=F.explode(F.coalesce(places, F.array(i)))
    ).neighbourhood("_place", half)
    frame = (
        Window.partitionBy(*parts).orderBy(F.col("_place") / (half + F.lit(0.5))).rangeBetween(-1, 1)
    )
    rows = rows.withColumn(out, F.avg(v).over(frame)).where(own & (F.col("_place") == i))
    return track.on(rows.drop("_place", "_half", "_block"))


def noise_in_interval(df, keys, z, v, z_low, z_high, detrend_window_m=1.0, layout=None):
    """Noise figures of the samples in [z_low, z_high] of each profile.

    The residual is the sample minus a centred moving average over the detrend window.
    Profiles with fewer than three samples there get status `too_few_samples`.
    """
    layout = layout or Layout.of(df, keys)
    track = lay(df.where(F.col(z).between(z_low, z_high)), keys, [z, v], layout)
    track = track.scan(_next=lead(F.col(z)), _i=row_number())
    track = track.quantiles(_dz=(F.col("_next") - F.col(z), 0.5)).per_profile(_n=F.count("*"))
    points = F.greatest(F.lit(1), F.coalesce(F.bround(F.lit(detrend_window_m) / F.col("_dz")), F.lit(1)))
    points = F.when(points % 2 == 0, points + 1).otherwise(points).cast("long")
    track = _moving_average(track.with_columns(_points=points), v, F.col("_points"), "_trend")
    track = track.with_columns(_r=F.col(v) - F.col("_trend"))
    track = lay(track.df, keys, [z, v], layout) if layout.split else track
    track = track.quantiles(_med=(F.col("_r"), 0.5)).per_profile(_mean=F.avg("_r"))
    track = track.quantiles(_mad=(F.abs(F.col("_r") - F.col("_med")), 0.5))
    track = track.with_columns(_d=F.col("_r") - F.col("_mean")).scan(_d_next=lead(F.col("_d")))
    d = F.col("_d")
    out = track.df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("_dz").alias("median_dz_m"),
        F.max("_points").alias("detrend_window_pts"),
        F.avg(v).alias("cal_mean_cm"), F.stddev_samp(v).alias("cal_std_cm"),
        F.stddev_samp("_r").alias("sigma_std_cm"),
        (F.max("_mad") * MAD_TO_SIGMA).alias("sigma_mad_cm"),
        F.avg("_r").alias("residual_mean_cm"),
        F.try_divide(F.sum(d * F.col("_d_next")), F.sum(d * d)).alias("lag1_autocorr"),
    )
    status = F.when(F.col("n") < LEAST_ROWS, "too_few_samples").otherwise("ok")
    return out.withColumns(
        {"detrend_window_m": F.lit(float(detrend_window_m)), "noise_status": status}
    )


def lag1_autocorrelation(df, keys, z, r, layout=None):
    """Lag-1 autocorrelation about the whole-series mean, over the sum of squares."""
    track = lay(df, keys, [z, r], layout).per_profile(_mean=F.avg(r))
    track = track.with_columns(_d=F.col(r) - F.col("_mean")).scan(_d_next=lead(F.col("_d")))
    d = F.col("_d")
    return track.df.groupBy(*keys).agg(
        F.try_divide(F.sum(d * F.col("_d_next")), F.sum(d * d)).alias("lag1_autocorr")
    )


def compare_noise(noise, pairs, sigma="sigma_std_cm", key="well_id"):
    """Excess spread of a target over a reference: sqrt(max(0, target^2 - reference^2)).

    `pairs` holds reference and target keys.
    """
    side = noise.select(key, sigma)
    reference = side.select(F.col(key).alias("reference"), F.col(sigma).alias("sigma_reference"))
    target = side.select(F.col(key).alias("target"), F.col(sigma).alias("sigma_target"))
    square = F.col("sigma_target") ** 2 - F.col("sigma_reference") ** 2
    return pairs.join(reference, "reference").join(target, "target").withColumn(
        "sigma_excess", F.sqrt(F.greatest(F.lit(0.0), square))
    )

"""Uniform-grid resampling and shape-preserving cubic interpolation."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import grid_point, lerp
from plumbline.plans.layout import exact_quantiles, lag, lay, lead

GRID_BLOCK = 100_000


def pchip_slopes(track, x, y):
    """Fritsch-Butland derivative d0 at every knot of an ordered track."""
    track = track.scan(
        _px=lag(F.col(x)), _py=lag(F.col(y)), _nx=lead(F.col(x)), _ny=lead(F.col(y))
    )
    track = track.with_columns(
        _hl=F.col(x) - F.col("_px"), _hr=F.col("_nx") - F.col(x),
        _dl=F.try_divide(F.col(y) - F.col("_py"), F.col(x) - F.col("_px")),
        _dr=F.try_divide(F.col("_ny") - F.col(y), F.col("_nx") - F.col(x)),
    )
    track = track.scan(
        _nh=lead(F.col("_hr")), _nd=lead(F.col("_dr")), _ph=lag(F.col("_hl")), _pd=lag(F.col("_dl"))
    )
    hl, hr, dl, dr = (F.col(c) for c in ("_hl", "_hr", "_dl", "_dr"))
    near_left, near_right = hl + 2 * hr, 2 * hl + hr
    # written term by term as the registered SQL has it: another order of operations differs in the last bit
    inner = F.when(F.signum(dl) * F.signum(dr) <= 0, F.lit(0.0)).otherwise(
        (3 * hl + 3 * hr) / (near_left / dl + near_right / dr)
    )
    first = _end_slope(hr, F.col("_nh"), dr, F.col("_nd"))
    last = _end_slope(hl, F.col("_ph"), dl, F.col("_pd"))
    slope = (
        F.when(hl.isNull() & hr.isNull(), F.lit(0.0))
        .when(hl.isNull(), first).when(hr.isNull(), last).otherwise(inner)
    )
    return track.with_columns(d0=slope).on_drop(
        "_px", "_py", "_nx", "_ny", "_hl", "_hr", "_dl", "_dr", "_nh", "_nd", "_ph", "_pd"
    )


def _end_slope(h, h_next, d, d_next):
    """Three-point end derivative, limited so that the curve keeps its shape."""
    raw = ((2 * h + h_next) * d - h * d_next) / (h + h_next)
    limited = (
        F.when(F.signum(raw) != F.signum(d), F.lit(0.0))
        .when((F.signum(d) != F.signum(d_next)) & (F.abs(raw) > 3 * F.abs(d)), 3 * d)
        .otherwise(raw)
    )
    return F.when(h_next.isNull(), d).otherwise(limited)


def hermite(x):
    """Cubic Hermite value on the piece (x0,y0,d0)-(x1,y1,d1) of the row."""
    h = F.col("x1") - F.col("x0")
    t = (x - F.col("x0")) / h
    two, three, t2, t3 = 2 * t * t, 3 * t * t, t * t, t * t * t
    return (
        (2 * t3 - three + 1) * F.col("y0") + (t3 - two + t) * h * F.col("d0")
        + (three - 2 * t3) * F.col("y1") + (t3 - t2) * h * F.col("d1")
    )


def step_statistics(df, keys, z, layout=None):
    """Consecutive spacing per profile: 95th percentile, median, mean and minimum."""
    track = lay(df, keys, [z], layout).scan(_next=lead(F.col(z)))
    gaps = track.df.where("_next is not null").select(*keys, (F.col("_next") - F.col(z)).alias("dz"))
    wanted = {"dz_p95": (F.col("dz"), 0.95), "dz_median": (F.col("dz"), 0.5)}
    moments = [F.avg("dz").alias("dz_mean"), F.min("dz").alias("dz_min")]
    return exact_quantiles(gaps, keys, wanted, track.layout, moments)


SPACINGS = ("p95", "median", "mean", "min")


def resample(df, keys, z="depth_m", v="sec_us_cm", kind="pchip", dz=None, spacing="p95", layout=None):
    """Values of each profile on a uniform grid from its first to its last depth.

    Every interval between two samples produces the grid points it contains, so no range
    join is needed.  Without `dz` the spacing is a statistic of the profile's own: the 95th
    percentile, or the median, mean or minimum.  A profile needs two distinct depths.
    """
    if spacing not in SPACINGS:
        raise ValueError(f"unknown spacing {spacing!r}")
    if kind not in ("pchip", "linear"):
        raise ValueError(f"unknown resampling kind {kind!r}")
    track = lay(df.select(*keys, F.col(z).alias("x0"), F.col(v).alias("y0")), keys, ["x0"], layout)
    if kind == "pchip":
        track = pchip_slopes(track, "x0", "y0")
    else:
        track = track.with_columns(d0=F.lit(0.0))
    track = track.scan(x1=lead(F.col("x0")), y1=lead(F.col("y0")), d1=lead(F.col("d0")))
    track = track.per_profile(_start=F.min("x0"), _end=F.max("x0"))
    gap = F.col("x1") - F.col("x0")
    if dz is None and spacing in ("p95", "median"):
        track = track.interpolated("_dz", gap, 0.95 if spacing == "p95" else 0.5)
    elif dz is None:
        track = track.per_profile(_dz=F.avg(gap) if spacing == "mean" else F.min(gap))
    else:
        track = track.with_columns(_dz=F.lit(float(dz)))
    start, step = F.col("_start"), F.col("_dz")
    low = F.floor((F.col("x0") - start) / step) - 1
    high = F.floor((F.col("x1") - start) / step) + 1
    pieces = track.df.where("x1 is not null and _dz > 0").withColumns(
        {"_low": F.greatest(low, F.lit(0)), "_high": high}
    )
    block = F.lit(GRID_BLOCK)
    pieces = pieces.withColumn(
        "_from", F.explode(F.sequence(F.col("_low"), F.col("_high"), block.cast("long")))
    ).withColumn(
        "grid_index",
        F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + block - 1, F.col("_high")))),
    )
    g = grid_point(start, step, F.col("grid_index"))
    pieces = pieces.withColumn("_g", g).where(
        "_g >= x0 and (_g < x1 or (_g = x1 and x1 = _end))"
    )
    x = F.col("_g")
    value = (
        hermite(x) if kind == "pchip"
        else lerp(x, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    )
    return pieces.select(*keys, "grid_index", x.alias(z), value.alias(v))

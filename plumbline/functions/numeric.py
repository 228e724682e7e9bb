"""Numeric column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clean_nan(df, *columns):
    """NaN marks a missing reading; Spark orders NaN above every number, so make it null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def settle(x: Column, digits: int = 6) -> Column:
    """Round for reports: a fixed grid whose cut lies off the decimal half points."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + F.lit(0.4999)).cast("double") / F.lit(scale)


def log10_positive(v: Column) -> Column:
    return F.when(v > 0, F.log10(v))


def to_below_ground(z: Column, offset: Column) -> Column:
    """Water-table depth to below-ground depth; a negative offset is refused."""
    return F.when(
        offset < 0, F.raise_error(F.lit("negative datum offset")).cast("double")
    ).otherwise(z + offset)


def shift_probe(z: Column, adjustment=0.272, method="TOM") -> Column:
    """Vertical sensor offset: everywhere, or only below the surface layer."""
    if method == "YSI":
        return z + F.lit(adjustment)
    if method == "TOM":
        return F.when(z >= 0.001, z + F.lit(adjustment)).otherwise(z)
    raise ValueError(f"unknown adjustment method {method!r}")


def overlap_length(a_one, a_two, b_one, b_two) -> Column:
    """Shared length of two intervals whose ends may be given in either order."""
    low = F.greatest(F.least(a_one, a_two), F.least(b_one, b_two))
    high = F.least(F.greatest(a_one, a_two), F.greatest(b_one, b_two))
    return F.greatest(high - low, F.lit(0.0))


def lerp(x, x0, y0, x1, y1) -> Column:
    """Line through two points, held constant where one side is missing."""
    inside = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.when(x0.isNull(), y1).when(x1.isNull(), y0).otherwise(inside)


def blend(low, high, share) -> Column:
    """low (1 - share) + high share with the first product's rounding error added back: rounded once, as a fused sum is."""
    keep = 1 - share
    split = lambda a: (F.lit(134217729.0) * a) - ((F.lit(134217729.0) * a) - a)  # upper half of the digits
    first, second = low * keep, high * share
    a, b = split(low), split(keep)
    error = ((a * b - first) + a * (keep - b) + (low - a) * b) + (low - a) * (keep - b)
    total = first + second
    lost = (first - (total - (total - first))) + (second - (total - first))
    return total + (lost + error)


def hinge_value(x: Column, const: Column, alpha: Column, betas: Column, psis: Column) -> Column:
    """Continuous piecewise-linear model: const + alpha x + sum beta_j max(0, x - psi_j)."""
    bends = F.zip_with(betas, psis, lambda b, p: b * F.greatest(x - p, F.lit(0.0)))
    return const + alpha * x + F.aggregate(bends, F.lit(0.0), lambda s, t: s + t)


def estimate_of(estimates: Column, name) -> Column:
    """Value of one named estimate in a map of structs, null when absent."""
    return F.try_element_at(estimates, as_column(name))["estimate"]


def interval_of(estimates: Column, name) -> Column:
    return F.try_element_at(estimates, as_column(name))["confidence_interval"]


def numbered_estimates(estimates: Column, prefix: str, n: Column) -> Column:
    """prefix1..prefixN as an array in numeric order."""
    names = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(names, lambda i: estimate_of(estimates, F.concat(F.lit(prefix), i.cast("string"))))


def turning_angle(ux, uy, vx, vy) -> Column:
    """Angle between two successive chords, in radians; a chord without length turns by nothing."""
    lengths = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cosine = F.try_divide(ux * vx + uy * vy, lengths)
    # least and greatest skip nulls, so a missing chord must be kept apart.
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return F.when(cosine.isNotNull(), angle).when(lengths == 0, 0.0)


def grid_point(start: Column, step: Column, k: Column) -> Column:
    """k-th value of a uniform grid, in the floating-point form numeric ranges use."""
    return start + k.cast("double") * ((start + step) - start)

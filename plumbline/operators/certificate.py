"""Proof of a sweep's fits from their own numbers: plain regression conditions, independent of the solver.

A continuous piecewise-linear fit is the least-squares one for its breakpoints exactly when its residuals sum to zero and
are orthogonal to the depth and to every hinge (depth - breakpoint)+.  Sums of the residuals per segment give all of these,
so a fit is proved by one grouped aggregate over its rows, whatever its size.
"""

from pyspark.sql import functions as F

from plumbline.functions.numeric import hinge_value

FIT = ["trial", "seed", "n_breakpoints"]


def _segments(rows, fits, keys, names):
    """Per fit and segment: sums of the residual, residual times depth, squares; about the profile's first depth."""
    pairs = rows.join(fits.select(*keys, *names, "const", "alpha1", "psis", "betas", "_x0"), keys)
    residual = F.col("_y") - hinge_value(F.col("_x"), F.col("const"), F.col("alpha1"), F.col("betas"), F.col("psis"))
    depth = F.col("_x")
    pairs = pairs.withColumns({"_segment": F.size(F.filter("psis", lambda p: depth > p)), "_r": residual, "_d": depth - F.col("_x0")})
    return pairs.groupBy(*keys, *names, "_segment").agg(
        F.sum("_r").alias("r"), F.sum(F.col("_r") * F.col("_d")).alias("rd"), F.sum(F.col("_r") * F.col("_r")).alias("rr"))


def certify(df, fits, keys, x="depth_m", y="log10_sec", min_distance=0.01, names=FIT, rounding=1e-6):
    """Every fit with (possible, line_rss, certified).

    possible: the profile has enough rows, depths and values for that size.  line_rss: residual sum of one straight line.
    certified, for converged fits: breakpoints rise inside the range and `min_distance` apart; `rss` and `bic` are those of
    the fit's own curve; the normal equations hold, each within `rounding` of the product of the two vectors' lengths; and
    the curve is no worse than the line.  For the others: there are no estimates, and a fit that was not possible says unfit.
    """
    keys, names = [*keys], [*names]
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = rows.where("_x is not null and _y is not null")
    shape = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_x").alias("_x0"), F.max("_x").alias("_x9"), (F.max("_y") > F.min("_y")).alias("_bent"),
        F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxy("_y", "_x").alias("_sxy"), F.regr_sxx("_y", "_x").alias("_sxx"))
    line = F.greatest(F.col("_syy") - F.coalesce(F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0)), F.lit(0.0))
    known = fits.join(shape.withColumn("line_rss", line), keys)
    solved = known.where("converged")
    sums = _segments(rows, solved, keys, names).groupBy(*keys, *names).agg(
        F.array_sort(F.collect_list(F.struct("_segment", "r", "rd"))).alias("_parts"), F.sum("r").alias("_r"), F.sum("rd").alias("_rd"),
        F.sum("rr").alias("_rr"))
    joined = known.join(sums, [*keys, *names], "left")
    span, n = F.col("_x9") - F.col("_x0"), F.col("_n")
    length = F.sqrt(n * F.col("_syy"))  # of the constant times that of the values: what a sum of products is measured by
    free = F.lit(rounding)

    def hinge(p):
        deep = F.filter("_parts", lambda s: s["_segment"] > F.size(F.filter("psis", lambda q: q < p)))
        inside = F.aggregate(deep, F.lit(0.0), lambda total, s: total + s["rd"] - (p - F.col("_x0")) * s["r"])
        return F.abs(inside) <= free * span * length

    psis = F.coalesce("psis", F.array().cast("array<double>"))
    edges = F.concat(F.array(F.col("_x0")), psis, F.array(F.col("_x9")))
    gaps = F.zip_with(F.slice(edges, 2, F.size(psis) + 1), F.slice(edges, 1, F.size(psis) + 1), lambda b, a: b - a)
    apart = F.forall(gaps, lambda g: g >= min_distance - 1e-9) | (F.size(psis) == 0)
    own = F.abs(F.col("rss") - F.col("_rr")) <= free * F.col("_syy")
    normal = (F.abs("_r") <= free * length) & (F.abs("_rd") <= free * span * length) & F.forall(psis, hinge)
    size = F.size(psis)
    bic = n * F.log(F.col("rss") / n) + (2 + 2 * size) * F.log(n.cast("double"))
    good_bic = F.col("bic").isNull() | (F.abs(F.col("bic") - bic) <= 1e-6 * F.abs(bic) + 1e-6)
    no_worse = F.col("rss") <= F.col("line_rss") + free * F.col("_syy")
    possible = (n >= 2 * F.col("n_breakpoints") + 3) & (span > 0) & F.col("_bent")
    none = F.col("rss").isNull() & F.col("psis").isNull() & (F.col("status") == "unfit").eqNullSafe(~possible)
    proof = F.when(F.col("converged"), possible & (size == F.col("n_breakpoints")) & apart & own & normal & good_bic & no_worse).otherwise(none)
    return joined.select(*fits.columns, possible.alias("possible"), "line_rss", F.coalesce(proof, F.lit(False)).alias("certified"))

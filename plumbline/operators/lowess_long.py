"""LOWESS for profiles whose rows, or whose windows, do not fit one task.

The window of every row is found by ordered scans.  Each pass then adds up the weighted
sums a local fit needs over pairs of row blocks: a task holds one block of fitted rows and
one block of their neighbours, however long the window is.

On each side of the fitted row the tricube weight is a polynomial in the distance, 1 - 3 t^3 + 3 t^6 - t^9.  So a local
fit needs only sums of powers of the depth over the window's two sides.  `PowerSums` keeps them for aligned runs of 8, 16,
32, ... rows, each about its own centre; a side is a logarithmic number of such runs and a few single rows.  Every run
lies inside the window, so no power is large beside the window's reach and nothing cancels.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.plans.layout import exact_quantiles, finish, lay, row_number, running_sum, spread

#: Keeps the robust scale above zero where half of the residuals vanish.
SCALE_FLOOR = 1e-12


def tricube_moments(dx, reach, weight, y, degree):
    """Sums of w u^p (p <= 2 degree) and w u^p y (p <= degree) along the last axis."""
    u = dx / np.where(reach > 0, reach, 1.0)[:, None]
    w = np.clip(1 - np.abs(u) ** 3, 0, None) ** 3 * weight
    sums = []
    for p in range(2 * degree + 1):
        sums.append(w.sum(axis=1))
        if p <= degree:
            sums.append((w * y).sum(axis=1))
        w = w * u
    even = [s for i, s in enumerate(sums[: 2 * (degree + 1)]) if i % 2 == 0] + sums[2 * (degree + 1):]
    odd = [s for i, s in enumerate(sums[: 2 * (degree + 1)]) if i % 2 == 1]
    return np.stack(even + odd, axis=1)


#: Windows up to this length are summed row by row.
DIRECT = 256
#: Rows of the smallest run whose sums are kept.
LEAF = 8


class PowerSums:
    """Sums of w (x - c)^q and w y (x - c)^q over aligned runs of rows, c the middle of a run's depths."""

    def __init__(self, x, weight, y, degree):
        self.x, self.weight, self.y, self.degree = x, weight, y, degree
        self.powers = 9 + 2 * degree + 1
        n = len(x)
        self.pascal = np.array([[math.comb(p, q) if q <= p else 0 for q in range(self.powers)] for p in range(self.powers)], float)
        count = n // LEAF
        rows = slice(0, count * LEAF)
        runs = x[rows].reshape(count, LEAF)
        centre = (runs[:, 0] + runs[:, -1]) / 2
        power = (runs - centre[:, None])[..., None] ** np.arange(self.powers)
        both = np.stack([weight[rows], weight[rows] * y[rows]]).reshape(2, count, LEAF)
        self.levels = [(centre, np.einsum("snl,nlp->snp", both, power))]
        while len(self.levels[-1][0]) >= 2:
            centre, sums = self.levels[-1]
            pairs = len(centre) // 2
            left, right = centre[0:2 * pairs:2], centre[1:2 * pairs:2]
            above = (left + right) / 2
            joined = self._shift(sums[:, 0:2 * pairs:2], left - above) + self._shift(sums[:, 1:2 * pairs:2], right - above)
            self.levels.append((above, joined))

    def _shift(self, sums, by):
        """Sums about a centre `by` lower than before: binomials of every power."""
        steps = by[:, None] ** np.arange(self.powers)
        out = np.empty_like(sums)
        for p in range(self.powers):
            out[..., p] = (sums[..., :p + 1] * (self.pascal[p, :p + 1] * steps[:, p::-1])).sum(axis=-1)
        return out

    def _runs(self, low, high):
        """(targets, level, run) and (targets, row): the runs and single rows that make up [low, high)."""
        runs, rows = [], []
        low, high = low.copy(), high.copy()
        first, last = -(-low // LEAF), high // LEAF
        inner = first < last
        for k in range(LEAF):  # rows before the first run and after the last
            for at in (np.where(low + k < np.where(inner, first * LEAF, high), low + k, -1),
                       np.where(inner & (last * LEAF + k < high), last * LEAF + k, -1)):
                here = np.flatnonzero(at >= 0)
                rows.append((here, at[here]))
        longest = int((high - low).max(initial=0))
        for k in range(LEAF, min(longest, 2 * LEAF)):  # a window inside two runs holds neither whole
            at = np.where(~inner & (low + k < high), low + k, -1)
            here = np.flatnonzero(at >= 0)
            rows.append((here, at[here]))
        level = 0
        first, last = np.where(inner, first, 0), np.where(inner, last, 0)
        while (first < last).any():
            odd = np.flatnonzero((first < last) & (first % 2 == 1))
            runs.append((odd, level, first[odd]))
            first[odd] += 1
            odd = np.flatnonzero((first < last) & (last % 2 == 1))
            last[odd] -= 1
            runs.append((odd, level, last[odd]))
            first, last, level = first // 2, last // 2, level + 1
        return runs, rows

    def _side(self, low, high, at, reach):
        """Sums of w t^q and w y t^q, t the distance over the reach with its sign, of the rows [low, high) of every target."""
        total = np.zeros((2, len(at), self.powers))
        runs, rows = self._runs(low, high)
        scale = 1.0 / reach
        for who, level, run in runs:
            if len(who):
                centre, sums = self.levels[level]
                unit = scale[who][:, None] ** np.arange(self.powers)
                total[:, who] += self._shift(sums[:, run] * unit, (centre[run] - at[who]) * scale[who])
        for who, row in rows:
            if len(who):
                power = ((self.x[row] - at[who]) * scale[who])[:, None] ** np.arange(self.powers)
                total[0, who] += self.weight[row][:, None] * power
                total[1, who] += (self.weight[row] * self.y[row])[:, None] * power
        return total

    def moments(self, low, high, at, reach):
        """What `tricube_moments` gives, for windows of rows [low, high) about depths `at`."""
        reach = np.where(reach > 0, reach, 1.0)
        middle = np.clip(np.searchsorted(self.x, at, side="left"), low, high)
        left, right = self._side(low, middle, at, reach), self._side(middle, high, at, reach)
        out = []
        for kind, most in ((0, 2 * self.degree), (1, self.degree)):
            for p in range(most + 1):
                parts = [sign ** k * c * side[kind, :, p + k] for sign, side in ((-1, left), (1, right))
                         for k, c in ((0, 1), (3, -3), (6, 3), (9, -1))]
                out.append(sum(parts))
        return np.stack(out, axis=1)


def local_values(moments, raw, degree):
    """Fitted value of each local polynomial; the raw value where it is singular.

    Lines are solved term by term as the registered SQL has it: where the rows nearly leave a fit open, as at the end of a profile,
    another way differs from it in the tenth digit.
    """
    if degree == 1:
        s, su, suu, sy, suy = moments.T
        spread_of = s * suu - su * su
        good = np.abs(spread_of) > 1e-12 * s * s
        return np.where(good, (suu * sy - su * suy) / np.where(good, spread_of, 1.0), raw)
    power = np.add.outer(np.arange(degree + 1), np.arange(degree + 1))
    gram, right = moments[:, power], moments[:, 2 * degree + 1:]
    good = np.abs(np.linalg.det(gram)) > 1e-12 * np.maximum(moments[:, 0], 1e-300) ** (degree + 1)
    value = np.array(raw, float)
    if good.any():
        value[good] = np.linalg.solve(gram[good], right[good][:, :, None])[:, 0, 0]
    return value


def lowess_long(df, keys, z, v, frac, degree, robust_passes, out, layout):
    keys = [*keys]
    track = lay(df, keys, [z, v], layout).scan(_i=row_number()).per_profile(_n=F.count("*"))
    k = F.least(F.col("_n"), F.greatest(F.floor(F.lit(frac) * F.col("_n")), F.lit(degree + 2)))
    rows = finish(track.with_columns(_k=k.cast("long"))).checkpoint()
    samples = rows.select(
        *keys, "_i", F.col(z).cast("double").alias("x"), F.col(v).cast("double").alias("y"), "_k", "_n"
    )
    windows = _windows(samples, keys, layout).checkpoint()
    size = F.lit(layout.rows_per_split)
    targets = windows.withColumns({
        "tb": F.floor(F.col("_i") / size),
        "sb": F.explode(F.sequence(F.floor(F.col("left") / size), F.floor((F.col("left") + F.col("_k") - 1) / size))),
    })
    pairs = targets.select(*keys, "tb", "sb").distinct()
    fitted = samples.withColumns({"weight": F.lit(1.0), "fit": F.lit(None).cast("double")})
    for turn in range(robust_passes + 1):
        if turn:
            residual = fitted.withColumn("miss", F.abs(F.col("y") - F.col("fit")))
            spreads = exact_quantiles(residual, keys, {"half": (F.col("miss"), 0.5)}, layout)
            bell = 1 - (F.col("miss") / (6 * F.col("half") + SCALE_FLOOR)) ** 2
            fitted = residual.join(spreads, keys).withColumn(
                "weight", F.coalesce(F.when(bell > 0, bell ** 2).when(bell <= 0, 0.0), F.lit(1.0))
            ).drop("miss", "half")
        fitted = _one_pass(fitted, targets, pairs, keys, degree, size).checkpoint()
    done = rows.join(fitted.select(*keys, "_i", F.col("fit").alias("_fit")), [*keys, "_i"])
    value = F.when(F.col("_n") < degree + 2, F.col(v)).otherwise(F.col("_fit"))
    return done.withColumn(out, value).drop("_i", "_n", "_k", "_fit")


def _windows(samples, keys, layout):
    """First index and reach of the k nearest rows of every row.

    The window of x starts at the number of starts l with x[l + k] + x[l] < 2 x, a count
    that one scan over starts and rows in order of those values gives.
    """
    position = samples.select(*keys, "_i", "x")
    beyond = samples.where("_i >= _k").select(*keys, (F.col("_i") - F.col("_k")).alias("_i"), F.col("x").alias("far"))
    starts = position.join(beyond, [*keys, "_i"]).select(
        *keys, (F.col("x") + F.col("far")).alias("at"), F.lit(1).alias("is_start"), "_i"
    )
    points = position.select(*keys, (2 * F.col("x")).alias("at"), F.lit(0).alias("is_start"), "_i")
    merged = lay(points.unionByName(starts), keys, ["at", "is_start", "_i"], layout)
    counted = finish(merged.scan(left=running_sum(F.col("is_start"))).where("is_start = 0"))
    found = samples.select(*keys, "_i", "x", "_k").join(counted.select(*keys, "_i", "left"), [*keys, "_i"])
    at = lambda name: position.select(*keys, F.col("_i").alias(f"{name}_i"), F.col("x").alias(name))
    found = found.withColumns({"low_i": F.col("left"), "high_i": F.col("left") + F.col("_k") - 1})
    found = found.join(at("low"), [*keys, "low_i"]).join(at("high"), [*keys, "high_i"])
    reach = F.greatest(F.col("x") - F.col("low"), F.col("high") - F.col("x"))
    return found.select(*keys, "_i", "x", "_k", "left", reach.alias("reach"))


def _one_pass(fitted, targets, pairs, keys, degree, size):
    """Weighted local fits at every row, from sums over pairs of blocks."""
    names, columns = [f"m{p}" for p in range(3 * degree + 2)], fitted.columns
    group = [*keys, "tb", "sb"]
    sources = fitted.select(*keys, "_i", "x", "y", "weight", F.floor(F.col("_i") / size).alias("sb")).join(pairs, [*keys, "sb"])
    schema = ", ".join([
        *[f"`{f.name}` {f.dataType.simpleString()}" for f in fitted.schema.fields if f.name in keys],
        "_i long", *[f"{n} double" for n in names],
    ])

    def partial(left, right):
        left, right = left.sort_values(["left", "_i"]), right.sort_values("s_i")
        j, x, y, weight = (right[c].to_numpy() for c in ("s_i", "s_x", "s_y", "s_weight"))
        first = left["left"].to_numpy()
        low, high = np.searchsorted(j, [first, first + left["_k"].to_numpy()])
        at, reach = left["x"].to_numpy(float), left["reach"].to_numpy(float)
        total = np.zeros((len(left), len(names)))
        longest = int((high - low).max())
        if longest > DIRECT:
            power = PowerSums(x.astype(float), weight.astype(float), y.astype(float), degree)
            for a in range(0, len(left), 1 << 16):
                part = slice(a, a + (1 << 16))
                total[part] = power.moments(low[part], high[part], at[part], reach[part])
        else:
            step = max(1, 1_000_000 // max(longest, 1))
            for a in range(0, len(left), step):
                begin, end = low[a:a + step, None], high[a:a + step, None]
                rows = np.minimum(begin + np.arange(longest), len(j) - 1)
                inside = begin + np.arange(longest) < end
                dx = np.where(inside, x[rows] - at[a:a + step, None], 0.0)
                total[a:a + step] = tricube_moments(dx, reach[a:a + step], weight[rows] * inside, y[rows], degree)
        return pd.concat(
            [left[[*keys, "_i"]].reset_index(drop=True), pd.DataFrame(total, columns=names)], axis=1
        )

    # Both sides come from the same rows: fresh names keep their columns apart.
    other = {c: f"s_{c.strip('_')}" for c in sources.columns}
    sources = sources.select(*[F.col(c).alias(n) for c, n in other.items()])
    other_group = [other[c] for c in group]
    left, right = spread(targets, group), spread(sources, other_group)
    parts = left.groupBy(*group).cogroup(right.groupBy(*other_group)).applyInPandas(partial, schema)
    sums = parts.groupBy(*keys, "_i").agg(*[F.sum(n).alias(n) for n in names])
    joined = fitted.drop("fit").join(sums, [*keys, "_i"])

    def solve(batches):
        for pdf in batches:
            pdf["fit"] = local_values(pdf[names].to_numpy(), pdf["y"].to_numpy(), degree)
            yield pdf[columns]

    return joined.mapInPandas(solve, fitted.schema)

"""Monotone fits of profiles that do not fit one task.

Every part of a profile pools its own violators first.  What is left is a stack of blocks per part, rising inside the part.
The fit's levels are the slopes of the greatest convex minorant of the running sums, and for any slope the minorant's
vertex is where running sum minus slope times index is least: a minimum over parts, each of which knows its own candidate
by its first block above the slope.  A fixed set of slopes, quantiles of the blocks' levels, so cuts a profile at true
block borders in one aggregate.  Between two cuts the levels lie between the two slopes, so blocks beyond them pool with
their neighbours at once, and the rest is bounded by the share of blocks between the slopes.  Each stretch is then pooled in
one task.  There are no rounds, and the number of stages does not depend on the data.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.plans.layout import PART, finish, last_known, lay, row_number, running_sum, spread


def pool_blocks(y, weight):
    """Weighted non-decreasing least-squares fit by pooling adjacent violators: levels, masses and sizes of the blocks."""
    level, mass, size = [], [], []
    for value, w in zip(y, weight):
        level.append(value)
        mass.append(w)
        size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            total = mass[-2] + mass[-1]
            level[-2] = (level[-2] * mass[-2] + level[-1] * mass[-1]) / total
            mass[-2], size[-2] = total, size[-2] + size[-1]
            level.pop(), mass.pop(), size.pop()
    return np.array(level, float), np.array(mass, float), np.array(size, np.int64)


def pool_adjacent(y, weight):
    """The fit of every row."""
    level, _, size = pool_blocks(y, weight)
    return np.repeat(level, size)


def _pool(schema):
    """Grouped-map worker over blocks (_from, _level, _mass) in order."""

    def run(pdf):
        pdf = pdf.sort_values("_from")
        level, mass, size = pool_blocks(pdf["_level"].to_numpy(float), pdf["_mass"].to_numpy(float))
        heads = np.concatenate(([0], np.cumsum(size)[:-1]))
        return pdf.iloc[heads].assign(_level=level, _mass=mass)[schema.names]

    return run


def isotonic_long(df, keys, z, v, out, layout):
    """See `smooth.isotonic`; rows are ordered by depth, then value."""
    keys = [*keys]
    track = lay(df, keys, [z, v], layout).scan(_i=row_number()).reorder("_i")
    single = track.df.select(*keys, PART, F.col("_i").alias("_from"), F.col(v).cast("double").alias("_level"), F.lit(1.0).alias("_mass"))
    schema = single.schema
    blocks = spread(single, [*keys, PART]).groupBy(*keys, PART).applyInPandas(_pool(schema), schema).checkpoint()
    most = blocks.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    cuts = -(-2 * most // layout.rows_per_split) - 1
    stretches = _cut(blocks, keys, cuts, layout) if cuts > 0 else blocks.withColumn("_stretch", F.lit(0).cast("long"))
    fields = stretches.drop(PART).schema
    pooled = spread(stretches.drop(PART), [*keys, "_stretch"]).groupBy(*keys, "_stretch").applyInPandas(_pool(fields), fields)
    starts = pooled.select(*keys, F.col("_from").alias("_i"), "_level")
    joined = track.on(track.df.join(starts, [*keys, "_i"], "left")).scan(_new=last_known(F.col("_level")))
    changed = F.abs(F.col("_new") - F.col(v)) > 1e-9
    return finish(joined.with_columns(was_changed=changed).with_columns(**{out: F.col("_new")}).on_drop("_new", "_level", "_i"))


def _counted(blocks, marks, keys, at, mark_first, name, layout):
    """Adds to every block the number of marks (keys, _at) below its `at`, or up to it if marks come first on ties."""
    side = F.lit(0 if mark_first else 1)
    held = blocks.withColumns({"_at": F.col(at).cast("double"), "_side": F.lit(1) - side, "_mark": F.lit(0)})
    added = marks.select(*keys, "_at").withColumns({"_side": side, "_mark": F.lit(1)})
    both = held.unionByName(added, allowMissingColumns=True)
    counted = lay(both, keys, ["_at", "_side", "_from"], layout).scan(**{name: running_sum(F.col("_mark"))})
    return finish(counted.where("_mark = 0")).drop("_at", "_side", "_mark")


def _cut(blocks, keys, cuts, layout):
    """Blocks with the stretch they lie in, those beyond a stretch's slopes pooled per part."""
    blocks = blocks.withColumnRenamed(PART, "_home")
    fractions = F.array(*[F.lit(float(k / (cuts + 1))) for k in range(1, cuts + 1)])
    slopes = blocks.groupBy(*keys).agg(
        F.percentile_approx("_level", fractions, max(10_000, 10 * cuts)).alias("_slopes"), (F.sum(F.col("_level") * F.col("_mass")) / F.sum("_mass")).alias("_mean"),
    ).withColumn("_slopes", F.array_sort(F.array_distinct("_slopes"))).checkpoint()
    each = slopes.select(*keys, "_mean", F.posexplode("_slopes").alias("_m", "_at"))
    # the running sum before every block, about the mean, and how many slopes lie below its level
    centred = blocks.join(slopes.select(*keys, "_mean"), keys)
    summed = finish(lay(centred, keys, ["_from"], layout).scan(
        _sum=running_sum(F.col("_mass") * (F.col("_level") - F.col("_mean")), exclusive=True)))
    summed = summed.withColumn("_sum", F.coalesce("_sum", F.lit(0.0))).drop("_mean")
    ranked = _counted(summed, each, keys, "_level", False, "_bucket", layout).checkpoint()
    # a part's vertex for slope m: its first block above it, or its end
    inside = [*keys, "_home"]
    firsts = ranked.groupBy(*inside, "_bucket").agg(F.min("_from").alias("_index"), F.min_by("_sum", "_from").alias("_sum"))
    before = F.coalesce(F.lag("_bucket").over(Window.partitionBy(*inside).orderBy("_bucket")), F.lit(0))
    firsts = firsts.withColumn("_first", before).where("_bucket > _first").withColumn("_last", F.col("_bucket") - 1)
    last = F.struct("_from", "_mass", "_sum", "_level")
    ends = ranked.join(slopes.select(*keys, "_mean", F.size("_slopes").alias("_count")), keys).groupBy(*inside, "_mean", "_count").agg(
        F.max("_bucket").alias("_first"), F.max(last).alias("_x")).where("_first < _count").select(
        *inside, (F.col("_x._from") + F.col("_x._mass")).cast("long").alias("_index"),
        (F.col("_x._sum") + F.col("_x._mass") * (F.col("_x._level") - F.col("_mean"))).alias("_sum"), "_first",
        (F.col("_count") - 1).alias("_last"))
    names = [*inside, "_index", "_sum", "_first", "_last"]
    vertices = firsts.select(*names).unionByName(ends.select(*names)).select(
        *keys, "_index", "_sum", F.explode(F.sequence("_first", "_last")).alias("_m"))
    gap = F.col("_sum") - (F.col("_at") - F.col("_mean")) * F.col("_index")
    chosen = vertices.join(each, [*keys, "_m"]).groupBy(*keys, "_m").agg(F.min(F.struct(gap.alias("g"), "_index")).alias("_best"))
    borders = chosen.select(*keys, F.col("_best._index").cast("double").alias("_at"))
    placed = _counted(ranked, borders, keys, "_from", True, "_stretch", layout)
    side = F.signum(F.col("_bucket") - F.col("_stretch")).cast("int")
    own = F.when(side == 0, F.col("_from")).otherwise(F.lit(-1).cast("long"))
    total, mass = F.sum(F.col("_level") * F.col("_mass")), F.sum("_mass")
    return placed.groupBy(*keys, F.col("_home").alias(PART), F.col("_stretch"), side.alias("_side"), own.alias("_own")).agg(
        F.min("_from").alias("_from"), F.when(F.count("*") == 1, F.first("_level")).otherwise(total / mass).alias("_level"), mass.alias("_mass"),
    ).select(*keys, PART, "_from", "_level", "_mass", F.col("_stretch").cast("long").alias("_stretch"))

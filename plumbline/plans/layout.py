"""Ordered computation over profiles of any size.

Most profiles fit comfortably in one task, and then a plain window per profile is the
best plan: one shuffle on the profile key serves every window that follows.  A profile
that holds, say, a third of a 100 TB table does not fit.  `Layout.of` counts rows per
profile (a map-side combined aggregate) and `lay` picks the plan:

* **whole**: windows partitioned by the profile key.
* **split**: rows are range partitioned on (key, order), which cuts long profiles at
  balanced points, and the cut is written to the checkpoint folder so that every later
  stage and every retry sees the same cut.  A scan then runs a window per (key, part),
  summarises each part in one row, runs the same scan over those few rows, and joins
  the carried value back.

Operators are written once against `Track.scan`; both plans give the same rows.
"""

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import blend
from plumbline.plans.session import ensure_checkpoint_dir, ship_package

ROWS_PER_SPLIT = 2_000_000
#: Rows of whole profiles that a task holds on average: its sorts follow this number and not the table.
ROWS_PER_TASK = 250_000
PART = "_part"
BLOCK = "_block"

_FIRST = Window.unboundedPreceding


@dataclass(frozen=True)
class Layout:
    """Whether the largest profile needs splitting, and into how many ranges."""

    split: bool
    parts: int = 1
    rows_per_split: int = ROWS_PER_SPLIT
    tasks: int = 1  # that hold ROWS_PER_TASK rows each

    @staticmethod
    def of(df: DataFrame, keys, rows_per_split=None) -> "Layout":
        limit = rows_per_split or int(
            df.sparkSession.conf.get("spark.plumbline.rowsPerSplit", str(ROWS_PER_SPLIT))
        )
        size = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
        if size[0] is None or size[0] <= limit:
            return Layout(False, 1, limit, math.ceil((size[1] or 0) / ROWS_PER_TASK))
        return Layout(True, math.ceil(size[1] / limit), limit)


@dataclass(frozen=True)
class Scan:
    """One ordered computation: its per-window form and how parts are stitched.

    Every form gets the window in ascending order and the same one reversed.  Looking ahead
    is a running frame over the reversed window: Spark restarts a frame that ends at the last
    row for every row, which is quadratic in the length of a profile.
    """

    local: object  # (window, reversed window) -> Column
    summary: object  # order struct -> aggregate Column over one part
    carry: object  # (summary Column, window over parts, reversed) -> Column
    combine: object  # (local Column, carry Column) -> Column


def running(agg, x, merge, reverse=False, exclusive=False):
    edge = 1 if exclusive else 0
    pick = (lambda w, back: back) if reverse else (lambda w, back: w)
    return Scan(
        lambda w, back: agg(x).over(pick(w, back).rowsBetween(_FIRST, -edge)),
        lambda order: agg(x),
        lambda s, w, back: agg(s).over(pick(w, back).rowsBetween(_FIRST, -1)),
        merge,
    )


def running_min(x, reverse=False, exclusive=False):
    return running(F.min, x, F.least, reverse, exclusive)


def running_max(x, reverse=False, exclusive=False):
    return running(F.max, x, F.greatest, reverse, exclusive)


def running_sum(x, reverse=False, exclusive=False):
    def add(here, before):
        return F.when(here.isNull() & before.isNull(), None).otherwise(
            F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        )

    return running(F.sum, x, add, reverse, exclusive)


def row_number():
    """0-based index of the row inside its profile."""
    one = F.lit(1).cast("long")
    return Scan(
        lambda w, back: (F.row_number().over(w) - 1).cast("long"),
        lambda order: F.sum(one),
        lambda s, w, back: F.sum(s).over(w.rowsBetween(_FIRST, -1)),
        lambda here, before: here + F.coalesce(before, F.lit(0)),
    )


def lag(x):
    boxed = F.struct(x.alias("v"))
    return Scan(
        lambda w, back: F.lag(boxed).over(w),
        lambda order: F.max_by(boxed, order),
        lambda s, w, back: F.lag(s).over(w),
        lambda here, before: F.coalesce(here, before)["v"],
    )


def lead(x):
    boxed = F.struct(x.alias("v"))
    return Scan(
        lambda w, back: F.lead(boxed).over(w),
        lambda order: F.min_by(boxed, order),
        lambda s, w, back: F.lead(s).over(w),
        lambda here, after: F.coalesce(here, after)["v"],
    )


def last_known(x, exclusive=False):
    """Nearest non-null value at or before the row."""
    edge = -1 if exclusive else 0
    return Scan(
        lambda w, back: F.last(x, True).over(w.rowsBetween(_FIRST, edge)),
        lambda order: F.max_by(x, F.when(x.isNotNull(), order)),
        lambda s, w, back: F.last(s, True).over(w.rowsBetween(_FIRST, -1)),
        F.coalesce,
    )


def next_known(x, exclusive=False):
    """Nearest non-null value at or after the row."""
    edge = -1 if exclusive else 0
    return Scan(
        lambda w, back: F.last(x, True).over(back.rowsBetween(_FIRST, edge)),
        lambda order: F.min_by(x, F.when(x.isNotNull(), order)),
        lambda s, w, back: F.last(s, True).over(back.rowsBetween(_FIRST, -1)),
        F.coalesce,
    )


@dataclass(frozen=True)
class Track:
    """A DataFrame of profiles laid out for ordered work."""

    df: DataFrame
    keys: tuple
    order: tuple
    layout: Layout

    @property
    def window_keys(self):
        return [*self.keys, PART] if self.layout.split else [*self.keys]

    def on(self, df: DataFrame) -> "Track":
        """Same layout over a narrow rewrite (select, filter, withColumn) of the rows."""
        return replace(self, df=df)

    def with_columns(self, **columns) -> "Track":
        return self.on(self.df.withColumns(columns))

    def where(self, condition) -> "Track":
        return self.on(self.df.where(condition))

    def on_drop(self, *columns) -> "Track":
        return self.on(self.df.drop(*columns))

    def rekey(self, *keys) -> "Track":
        """Finer keys (the old ones plus a label that is contiguous in the order)."""
        return replace(self, keys=tuple(keys))

    def reorder(self, *order) -> "Track":
        """Columns that give the same order, but leave no ties: a row number that an earlier scan made."""
        return replace(self, order=tuple(order))

    def scan(self, **specs) -> "Track":
        whole = Window.partitionBy(*self.window_keys)
        windows = (
            whole.orderBy(*self.order),
            whole.orderBy(*[F.col(c).desc_nulls_last() for c in self.order]),
        )
        if not self.layout.split:
            return self.with_columns(
                **{n: _unbox(s, s.local(*windows)) for n, s in specs.items()}
            )
        order = F.struct(*[F.col(c) for c in self.order])
        local = self.df.withColumns({f"_here_{n}": s.local(*windows) for n, s in specs.items()})
        over_parts = Window.partitionBy(*self.keys)
        parts = (over_parts.orderBy(PART), over_parts.orderBy(F.desc(PART)))
        carried = (
            self.df.groupBy(*self.window_keys)
            .agg(*[s.summary(order).alias(n) for n, s in specs.items()])
            .select(
                *self.window_keys,
                *[s.carry(F.col(n), *parts).alias(f"_far_{n}") for n, s in specs.items()],
            )
        )
        joined = local.join(carried, self.window_keys, "left")
        done = joined.withColumns(
            {n: s.combine(F.col(f"_here_{n}"), F.col(f"_far_{n}")) for n, s in specs.items()}
        ).drop(*[f"{side}{n}" for n in specs for side in ("_here_", "_far_")])
        return self.on(done.checkpoint())

    def per_profile(self, **aggregates) -> "Track":
        """Attach whole-profile aggregates to every row."""
        if not self.layout.split:
            window = Window.partitionBy(*self.keys)
            return self.with_columns(**{n: a.over(window) for n, a in aggregates.items()})
        totals = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggregates.items()])
        return self.on(self.df.join(totals, [*self.keys], "left").checkpoint())

    def quantiles(self, **wanted) -> "Track":
        """Attach exact whole-profile quantiles: name=(column, fraction)."""
        if not self.layout.split:
            packs, picks = _packed(wanted)
            return self.per_profile(**packs).with_columns(**picks).on_drop(*packs)
        table = exact_quantiles(self.df, self.keys, wanted, self.layout)
        return self.on(self.df.join(table, [*self.keys], "left").checkpoint())

    def interpolated(self, name, x, q) -> "Track":
        """Attach one quantile, rounded once between its two ranks (`blend`): sums and grids built on it keep their last bit."""
        if self.layout.split:
            return self.quantiles(**{name: (x, q)})
        whole = Window.partitionBy(*self.keys)
        track = self.with_columns(_v=x).with_columns(
            _at=F.row_number().over(whole.orderBy(F.col("_v").asc_nulls_last())) - 1, _top=F.count("_v").over(whole) - 1)
        place = F.col("_top") * F.lit(float(q))
        track = track.with_columns(
            _low=F.max(F.when(F.col("_at") == F.floor(place), F.col("_v"))).over(whole),
            _high=F.max(F.when(F.col("_at") == F.ceil(place), F.col("_v"))).over(whole), _share=place - F.floor(place))
        return track.with_columns(**{name: _between("_low", "_high", F.col("_share"))}).on_drop("_v", "_at", "_top", "_low", "_high", "_share")

    def neighbourhood(self, index: str, reach) -> tuple:
        """Rows plus up to `reach` neighbours on both sides in one window partition.

        Returns (df, partition columns, condition selecting the non-copied rows).
        Whole profiles need no copies; split ones copy `reach` rows over each cut.
        """
        if not self.layout.split:
            return self.df, [*self.keys], F.lit(True)
        size = F.lit(self.layout.rows_per_split)
        block = F.floor(F.col(index) / size)
        first = F.floor((F.col(index) - reach) / size)
        last = F.floor((F.col(index) + reach) / size)
        df = self.df.withColumn(BLOCK, F.explode(F.sequence(first, last)))
        return df, [*self.keys, BLOCK], F.col(BLOCK) == block


def _packed(wanted):
    """Quantiles of one column share one pass: aggregates, and how to read them."""
    columns, packs, picks = {}, {}, {}
    for name, (x, q) in wanted.items():
        columns.setdefault(str(x), (x, []))[1].append((name, float(q)))
    for i, (x, items) in enumerate(columns.values()):
        packs[f"_pack{i}"] = F.percentile(x, F.array(*[F.lit(q) for _, q in items]))
        for place, (name, _) in enumerate(items):
            picks[name] = F.get(f"_pack{i}", F.lit(place))
    return packs, picks


def _between(low, high, share):
    return F.when(share == 0, F.col(low)).otherwise(blend(F.col(low), F.col(high), share))


def _unbox(spec, local):
    return spec.combine(local, F.lit(None))


def lay(df: DataFrame, keys, order, layout: Layout | None = None) -> Track:
    """Lay rows out for scans in ascending `order` inside each profile."""
    keys, order = tuple(keys), tuple(order)
    layout = layout or Layout.of(df, keys)
    if layout.split:
        ensure_checkpoint_dir(df.sparkSession)
        df = (
            df.drop(PART, BLOCK)
            .repartitionByRange(layout.parts, *keys, *order)
            .withColumn(PART, F.spark_partition_id())
            .checkpoint()
        )
    return Track(df, keys, order, layout)


def deal(df: DataFrame, keys, layout: Layout) -> DataFrame:
    """Hash whole profiles over as many tasks as their rows need, ahead of the first scan.

    The session's number of shuffle partitions is fixed, so with it a task's rows grow with the table.  The scans that follow
    on these keys, or on more, stay in the same tasks without another shuffle.  Small tables are left to the session.
    """
    if layout.split or layout.tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(layout.tasks, *keys)


def finish(track: Track) -> DataFrame:
    return track.df.drop(PART, BLOCK)


def exact_quantiles(df, by, wanted, layout: Layout | None = None, also=()) -> DataFrame:
    """Exact interpolated quantiles per group: wanted is {name: (column, fraction)}.

    `also` lists named plain aggregates to take in the same pass.

    Small groups use the built-in `percentile`.  It keeps a group's distinct values in
    one task, so for large groups the ranks are narrowed down by counts instead.
    """
    by = list(by)
    layout = layout or Layout.of(df, by)
    if not layout.split:
        packs, picks = _packed(wanted)
        out = df.groupBy(*by).agg(*[p.alias(n) for n, p in packs.items()], *also)
        return out.withColumns(picks).drop(*packs)
    return _narrowed(df, by, wanted, also)


#: Rank accuracy of the sketches that bracket a quantile: one part in so many.
ACCURACY = 10_000


def _narrowed(df, by, wanted, also):
    """Exact quantiles without sorting rows, all fractions of a column at once.

    Mergeable sketches give every fraction a bracket of values that must hold its two ranks.  One counting
    aggregate then keeps the distinct values inside the brackets, and one row for all rows between two
    brackets; running counts over those few rows give the ranks.  Groups smaller than the sketch's accuracy are all bracket.
    """
    columns = {}
    for name, (x, q) in wanted.items():
        columns.setdefault(str(x), (x.cast("double"), []))[1].append((name, float(q)))
    columns = list(columns.values())
    sketches = []
    for i, (x, items) in enumerate(columns):
        ends = [F.lit(min(1.0, max(0.0, q + side * 4 / ACCURACY))) for _, q in items for side in (-1, 1)]
        sketches += [F.percentile_approx(x, F.array(*ends), ACCURACY).alias(f"_ends{i}"), F.count(x).alias(f"_n{i}"),
                     F.min(x).alias(f"_min{i}"), F.max(x).alias(f"_max{i}")]
    known = df.groupBy(*by).agg(*sketches, *also)
    ensure_checkpoint_dir(df.sparkSession)
    known = known.checkpoint()
    out = known.drop(*[f"{c}{i}" for i in range(len(columns)) for c in ("_ends", "_n", "_min", "_max")])
    for i, (x, items) in enumerate(columns):
        few = F.col(f"_n{i}") <= ACCURACY
        low = F.array(*[F.when(few, F.col(f"_min{i}")).otherwise(F.col(f"_ends{i}")[2 * k]) for k in range(len(items))])
        high = F.array(*[F.when(few, F.col(f"_max{i}")).otherwise(F.col(f"_ends{i}")[2 * k + 1]) for k in range(len(items))])
        brackets = known.select(*by, F.arrays_zip(low.alias("low"), high.alias("high")).alias("_brackets"), (F.col(f"_n{i}") - 1).alias("_top"))
        rows = df.select(*by, x.alias("_v")).where("_v is not null").join(brackets, by)
        inside = F.exists("_brackets", lambda b: (b["low"] <= F.col("_v")) & (F.col("_v") <= b["high"]))
        passed = F.array_max(F.transform(F.filter("_brackets", lambda b: b["high"] < F.col("_v")), lambda b: b["high"]))
        mark = F.when(inside, F.struct(F.col("_v").alias("v"), F.lit(False).alias("between"))).otherwise(
            F.struct(passed.alias("v"), F.lit(True).alias("between")))
        counts = rows.groupBy(*by, "_top", mark.alias("_mark")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_mark").rowsBetween(_FIRST, 0))
        ranked = counts.withColumn("_upto", upto).where("NOT _mark.between")

        def held(rank):
            return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")), F.col("_mark.v")))

        aggregates, picks = [], {}
        for name, q in items:
            place = F.col("_top") * F.lit(q)
            aggregates += [held(F.floor(place)).alias(f"_low_{name}"), held(F.ceil(place)).alias(f"_high_{name}")]
            share = place - F.floor(place)
            value = _between(f"_low_{name}", f"_high_{name}", share)
            lost = F.raise_error(F.lit(f"a bracket missed the ranks of {name}")).cast("double")
            picks[name] = F.when(F.col(f"_low_{name}").isNull() | F.col(f"_high_{name}").isNull(), lost).otherwise(value)
        picked = ranked.groupBy(*by, "_top").agg(*aggregates)
        out = out.join(picked.select(*by, *[p.alias(n) for n, p in picks.items()]), by, "left")
    return out


def spread(df: DataFrame, keys) -> DataFrame:
    """Hash profiles over a fixed number of tasks ahead of a grouped-map worker.

    Profiles are few bytes and much computation, so adaptive coalescing by size would put
    them all into one task; an explicit number is left alone, and the grouping reuses it.
    """
    spark = df.sparkSession
    ship_package(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)

"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them.

Only vectors with equal labels and dimensions are compared.  Equal vectors are one class.  A class lives in the cell
of its nearest centroid and is a guest in every other cell whose border with any nearer cell it stands close to: a partner
y of x lies in cell c only if x is at most |x - y| behind each border of c.  `reach` is |x - y| at the threshold and a
margin for rounding, so no link is lost.  Links of x are counted in the home cells of its partners, so no link counts twice.  Large
cells are products of blocks in separate groups, and only counts and a spanning forest leave a task.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.common import ceil_div, settle, slices
from plumbline.llm.components import components
from plumbline.llm.runs import forest

THRESHOLD = 0.98
#: Added to the exact reach for rounding.
MARGIN = 1e-6
#: Vectors a cell should hold over all labels, and the most centroids.
CELL = 2000
MOST_CELLS = 4096
#: Vectors per centroid in the sample for the fit.
SAMPLED = 16
BLOCK = 1024


def unit(x):
    """Rows of x as double-precision unit vectors; scaled first so that squares neither overflow nor vanish."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x, k, rounds=8, seed=3):
    """Unit vectors -> k unit centroids; an emptied cell takes the vector farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        empty = np.flatnonzero(np.bincount(cell, minlength=k) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def cells_of(x, centres, reach):
    """(row, cell, home) of every cell that holds a row of x, as resident or as guest."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    rows, cells = [], []
    for c in range(len(centres)):
        behind = near - near[:, c:c + 1]  # times the distance of the centres: how far behind each border
        inside = (behind <= reach * apart[c]).all(axis=1)
        inside |= home == c
        found = np.flatnonzero(inside)
        rows.append(found)
        cells.append(np.full(len(found), c))
    rows, cells = np.concatenate(rows), np.concatenate(cells)
    return rows, cells, home[rows] == cells


def _vectors(column):
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _placed(classes, fitted, reach):
    """Adds (cell, home) to the classes, once per cell."""

    def run(batches):
        for part in slices(batches, 2048):
            dims = part.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = part.filter(pa.array(dims == dim))
                centres = fitted.get(int(dim))
                if centres is None:
                    at, cell, home = np.arange(rows.num_rows), np.zeros(rows.num_rows, int), np.ones(rows.num_rows, bool)
                else:
                    at, cell, home = cells_of(unit(_vectors(rows.column(4))), centres, reach)
                taken = rows.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home)],
                                                 names=[*taken.schema.names, "cell", "home"])

    v = dict(classes.dtypes)["v"]
    return classes.mapInArrow(run, f"label string, dim int, rep long, n long, v {v}, cell int, home boolean")


def _compare(batches, threshold):
    """Groups of (label, dim, cell, i, j): residents of block i against members of block j."""
    held, last = [], None

    def close():
        table = pa.Table.from_batches(held)
        x = unit(_vectors(table.column("v").combine_chunks()))
        member, resident, reps, n = (table.column(c).to_numpy() for c in ("member", "resident", "rep", "n"))
        m, r = np.flatnonzero(member), np.flatnonzero(resident)
        if not len(m) or not len(r):
            return
        near = (x[m] @ x[r].T >= threshold) & (reps[m][:, None] != reps[r][None, :])
        links = near @ n[r]
        some = np.flatnonzero(links)
        if len(some):
            a, b = np.nonzero(near)
            nodes, roots = forest(m[a], r[b], reps)
            kinds = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(nodes), np.int32)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(np.concatenate([reps[m][some], nodes])),
                 pa.array(np.concatenate([links[some], roots]).astype(np.int64))], ["kind", "a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(5))))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield from close()
                held, last, start = [], key, i
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield from close()


def near_vectors(vectors, id_column="vec_id", vector_column="embedding", label_column="label", threshold=THRESHOLD,
                 reach=None, cell=CELL, block=BLOCK):
    """One row per row of vectors: (id, n_links, component, kept).

    Linked: equal labels and dimensions, cosine in double precision of at least the threshold.  A null label, a null,
    empty or zero vector, a null or non-finite component, or a null id: no links, a component of its own (null for a
    null id).  Rows that repeat are vectors of their own and link with each other; rows that share an id but not the
    vector share links and component.  Other columns are not read.  `reach` is how far behind a border a guest may stand:
    by default as far as a partner can be, which is exact at every size.
    """
    if reach is None:
        reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + MARGIN
    kept = dict(vectors.select(F.col(vector_column).alias("v")).dtypes)["v"]  # single precision is moved as such
    v = F.col(vector_column).cast(kept if kept == "array<float>" else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"),
                          F.size(v).alias("dim"), v.alias("v"),
                          (F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & (F.size(v) > 0) & ~bad
                           & F.exists(v, lambda x: x != 0)).alias("ok"))
    rows = rows.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("vh", F.when(F.col("ok"), F.xxhash64("v")))
    classes = settle(rows.where("ok").groupBy("label", "vh", "v").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim")), "classes")

    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()}
    fitted = {}
    for dim, count in sizes.items():  # dimensions beyond the 64 most frequent are one cell per label
        k = min(MOST_CELLS, count // cell)
        if k > 1:
            share = int(min(1 << 30, (1 << 30) * (SAMPLED * k) / count))
            picked = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rep", "label"), F.lit(1 << 30)) < share))
            sample = picked.select("v").limit(2 * SAMPLED * MOST_CELLS).toArrow()  # a bounded sample
            if sample.num_rows >= k:
                fitted[dim] = spherical_kmeans(unit(_vectors(sample.column("v").combine_chunks())), k)
    placed = settle(_placed(classes.select("label", "dim", "rep", "n", "v"), fitted, reach), "placed")

    group = ["label", "dim", "cell"]
    counts = placed.groupBy(*group).agg(F.count("*").alias("members"), F.count_if("home").alias("residents"))
    counts = counts.where("members > 1 AND residents > 0").select(
        *group, ceil_div(F.col("members"), block).alias("mb"), ceil_div(F.col("residents"), block).alias("rb"))
    sized = placed.join(counts, group).withColumn("spot", F.xxhash64("rep"))
    # a row is compared as a member of its block j with every block i of residents; a resident of block i also meets
    # every block j of members, and is both at once where the two cross
    sized = sized.withColumns({"i0": F.pmod("spot", F.col("rb")), "j0": F.pmod("spot", F.col("mb"))})
    places = F.expr("""
        concat(transform(sequence(0L, rb - 1), x -> named_struct('i', x, 'j', j0, 'member', true, 'resident', home AND x = i0)),
               transform(filter(sequence(0L, mb - 1), x -> home AND x <> j0),
                         x -> named_struct('i', i0, 'j', x, 'member', false, 'resident', true)))""")
    keys = [*group, "i", "j"]
    dealt = sized.select(*group, "rep", "n", "v", F.explode(places).alias("x")).select(
        *group, "x.i", "x.j", "x.member", "x.resident", "rep", "n", "v")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    found = settle(dealt.mapInArrow(lambda b: _compare(b, threshold), "kind int, a long, b long"), "found")

    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    joined = components(found.where("kind = 1").select("a", "b"))
    named = classes.select(F.col("label").alias("label_"), F.col("vh").alias("vh_"), F.col("v").alias("v_"), "rep", "n")
    named = named.join(links, named["rep"] == links["a"], "left").join(joined, named["rep"] == joined["node"], "left")
    named = named.select("label_", "vh_", "v_", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "rep").alias("component"))
    same = (rows["label"] == named["label_"]) & (rows["vh"] == named["vh_"]) & (rows["v"] == named["v_"])
    component = F.coalesce("component", "id")
    return rows.join(named, same, "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                 component.alias("component"), component.eqNullSafe(F.col("id")).alias("kept"))

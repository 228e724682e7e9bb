"""The model sweep for profiles that do not fit one task, over an index of ordered block moments.

A Muggeo step needs sums over the rows deeper than each breakpoint.  Rows are packed in order into blocks of `BLOCK`;
an index holds, per block and set of bootstrap weights, the six sums of all rows beyond it.  What a step needs of the
rows themselves is then only the blocks in which its breakpoints stand.  A round fetches those, one block per breakpoint,
and a fit steps on in its task until a breakpoint leaves the blocks it holds.  So the rows read per round follow the
number of breakpoints, not the length of the profile, and there are far fewer rounds than steps.  Weighted sums
of all restarts are taken once, when the index is made.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators.sweep import (
    MOST_LOST, NO_FIT, apart, at_rest, bootstrap_weights, damping, fit_schema, muggeo_steps, next_breakpoints,
    random_start, running_sums, unscale,
)
from plumbline.plans.layout import finish, lay, row_number
from plumbline.plans.session import ensure_checkpoint_dir, ship_package

FIT = ["trial", "seed", "n_breakpoints"]
#: Rows of a block, and blocks of one entry of the upper index.
BLOCK, ENTRY = 1024, 1024
#: Requests for blocks that are small enough to be sent to every task.
FEW = 50_000
SET = ["set_seed", "set_restart"]


def sweep_long(rows, keys, grid, restarts, tolerance, min_distance, most, layout):
    """Seeded starts, then all restarts of all fits at once, each from the start's result."""
    keys = [*keys]
    scaled, scale = _scaled(rows, keys, layout)
    again = restarts if any(n for _, _, n in grid) else 0
    index = Index(scaled, keys, [(s, k) for s in sorted({s for _, s, _ in grid}) for k in range(again)])
    tasks = rows.sparkSession.createDataFrame(
        [(f"trial_{t + 1}", s, n, random_start(s, n).tolist()) for t, s, n in grid],
        "trial string, seed int, n_breakpoints int, psi array<double>",
    )
    each = F.explode(F.array(*[
        F.struct(F.lit(f"trial_{t + 1}").alias("trial"), F.lit(s).alias("seed"), F.lit(n).alias("n_breakpoints"))
        for t, s, n in grid
    ]))
    fits = scale.withColumn("task", each).select(*scale.columns, "task.*").join(tasks, FIT)
    first = _run(index, _opened(fits), tolerance, min_distance, most)
    tried = first
    if again:
        begin = first.where("state <> 'unfit' and n_breakpoints > 0").withColumn(
            "restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))
        )
        begin = begin.mapInPandas(_begin, begin.schema).checkpoint()
        moved = _run(index, begin, tolerance, min_distance, most, weighted=True)
        names = [*keys, *FIT, "restart"]
        known = begin.select(*names, F.col("psi").alias("begin"))
        psi = F.when(F.col("state") == "done", F.col("psi")).otherwise(F.col("begin"))
        fresh = moved.join(known, names).withColumns(
            {"psi": psi, "state": F.lit("active"), "rss": F.lit(None).cast("double"), "turn": F.lit(0), "lost": F.lit(0)}
        ).select(*begin.columns)
        tried = first.unionByName(_run(index, fresh, tolerance, min_distance, most))
    return _reported(index, rows, first, tried)


def refit_long(rows, saved, keys, tolerance, min_distance, most, layout):
    """Saved breakpoints as starts, without restarts."""
    keys = [*keys]
    scaled, scale = _scaled(rows, keys, layout)
    index = Index(scaled, keys, [])
    psi = F.array_sort(F.transform(F.coalesce("psis", F.array().cast("array<double>")), lambda p: (p - F.col("x0")) / F.col("span")))
    fits = saved.join(scale, keys).withColumns({"n_breakpoints": F.size(F.coalesce("psis", F.array())), "psi": psi})
    first = _run(index, _opened(fits.drop("psis")), tolerance, min_distance, most)
    return _reported(index, rows, first, first)


def _scaled(rows, keys, layout):
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    ranked = finish(lay(rows, keys, ["_x", "_y"], layout).scan(_i=row_number()))
    scale = ranked.groupBy(*keys).agg(
        F.min("_x").alias("x0"), (F.max("_x") - F.min("_x")).alias("span"),
        F.avg("_y").alias("base"), F.stddev_pop("_y").alias("unit"), F.count("*").alias("n_obs"),
    ).checkpoint()
    scaled = ranked.join(scale.where("span > 0 and unit > 0"), keys).select(
        *keys, "_i", ((F.col("_x") - F.col("x0")) / F.col("span")).alias("u"),
        ((F.col("_y") - F.col("base")) / F.col("unit")).alias("v"),
    )
    return scaled, scale


def _fields(schema, names):
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in names]


class Index:
    """Packed blocks, the sums beyond each, and where a breakpoint's block is found."""

    def __init__(self, scaled, keys, sets):
        self.keys = keys
        ordered = Window.partitionBy(*keys).orderBy("block")
        rows = F.array_sort(F.collect_list(F.struct("_i", "u", "v")))
        packed = scaled.groupBy(*keys, F.floor(F.col("_i") / BLOCK).alias("block")).agg(rows.alias("rows")).select(
            *keys, "block", F.col("rows")[0]["_i"].alias("first_i"), F.col("rows.u").alias("u"), F.col("rows.v").alias("v"))
        self.blocks = packed.checkpoint()
        low = F.get("u", F.lit(0))
        heads = self.blocks.select(*keys, "block", low.alias("low")).withColumn("next", F.lead("low").over(ordered)).checkpoint()
        self.ends = heads.select(*keys, "block", "next")
        sums = self._sums([(-1, -1), *sets])
        deeper = Window.partitionBy(*keys, *SET).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys, *SET)
        self.tails = sums.select(
            *keys, *SET, "block", F.array(*[F.coalesce(F.sum(c).over(deeper), F.lit(0.0)) for c in "abcdef"]).alias("tail"),
            F.array(*[F.sum(c).over(whole) for c in "abcdef"]).alias("total")).checkpoint()
        entry = F.floor(F.col("block") / ENTRY).alias("entry")
        lows = F.transform(F.array_sort(F.collect_list(F.struct("block", "low"))), lambda s: s["low"])
        self.entries = heads.groupBy(*keys, entry).agg(lows.alias("lows")).checkpoint()
        fence = F.transform(F.array_sort(F.collect_list(F.struct("entry", F.col("lows")[0].alias("low")))), lambda s: s["low"])
        self.fences = self.entries.groupBy(*keys).agg(fence.alias("fence")).checkpoint()

    def _sums(self, sets):
        names = [*self.keys, *SET, "block", *"abcdef"]

        def run(batches):
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    u, v = np.asarray(row["u"], float), np.asarray(row["v"], float)
                    terms = np.stack([np.ones_like(u), u, u * u, v, u * v, v * v])
                    out = [[*(row[k] for k in self_keys), s, k, row["block"], *(terms @ _weights(s, k, row["first_i"], len(u))).tolist()]
                           for s, k in sets]
                    yield pd.DataFrame(out, columns=names)

        self_keys = self.keys
        return self.blocks.mapInPandas(run, ", ".join([
            *_fields(self.blocks.schema, self.keys), "set_seed int", "set_restart int", "block long", *[f"{c} double" for c in "abcdef"]]))

    def requests(self, fits, names):
        """(names, set, block): the blocks in which the breakpoints of every fit stand, and the first one."""
        found = lambda lows, p: F.greatest(F.size(F.filter(lows, lambda low: low <= p)) - 1, F.lit(0))
        asked = fits.select(*names, *SET, F.explode(F.concat(F.array(F.lit(0.0)), "psi")).alias("p"))
        asked = asked.join(self.fences, self.keys).withColumn("entry", found(F.col("fence"), F.col("p")).cast("long")).drop("fence")
        asked = asked.join(self.entries, [*self.keys, "entry"])
        return asked.select(*names, *SET, (F.col("entry") * ENTRY + found(F.col("lows"), F.col("p"))).cast("long").alias("block")).distinct()

    def fetch(self, fits, names, weighted=False):
        """(names, parts): for every fit the blocks it asks for, with the sums beyond them."""
        own = {"set_seed": F.col("seed"), "set_restart": F.col("restart")} if weighted else {c: F.lit(-1) for c in SET}
        asked = self.requests(fits.withColumns(own), names).checkpoint()
        if asked.count() <= FEW:  # few enough for every task; the index is not shuffled then
            asked = F.broadcast(asked)
        place = [*self.keys, "block"]
        held = self.blocks.join(asked, place)
        held = held.join(self.ends, place).join(self.tails, [*place, *SET])
        part = F.struct("block", "first_i", "u", "v", "next", "tail", "total")
        return held.groupBy(*names).agg(F.collect_list(part).alias("parts"))


def _weights(seed, restart, first, n):
    return np.ones(n) if restart < 0 else bootstrap_weights(n, seed, restart, first)


class Held:
    """The blocks a fit holds: sums deeper than any breakpoint inside them."""

    def __init__(self, parts, seed, restart):
        self.total = np.asarray(parts[0]["total"], float)
        self.blocks = []
        for p in parts:
            u, v = np.asarray(p["u"], float), np.asarray(p["v"], float)
            low = -np.inf if p["block"] == 0 else u[0]
            high = np.inf if p["next"] is None or np.isnan(p["next"]) else p["next"]
            sums = running_sums(u, v, _weights(seed, restart, p["first_i"], len(u)))
            self.blocks.append((low, high, u, sums + np.asarray(p["tail"], float)[:, None]))

    def moments(self, psi):
        """Moments of all rows and of the rows deeper than each breakpoint; None if one stands elsewhere."""
        out = [self.total]
        for p in psi:
            block = next((b for b in self.blocks if b[0] <= p < b[1]), None)
            if block is None:
                return None
            out.append(block[3][:, np.searchsorted(block[2], p, side="right")])
        return np.stack(out)


def _opened(fits):
    """Fits as tasks of the iteration; those that cannot be fitted are closed at once."""
    fit = (F.col("span") > 0) & (F.col("unit") > 0) & (F.col("n_obs") >= 2 * F.col("n_breakpoints") + 3)
    return fits.withColumns({
        "restart": F.lit(-1), "state": F.when(fit, "active").otherwise("unfit"), "rss": F.lit(None).cast("double"), "turn": F.lit(0),
        "lost": F.lit(0),
    })


def _begin(batches):
    """Where each restart begins: at the result of the start, else at a draw of its own."""
    for pdf in batches:
        pdf["psi"] = [
            psi if state == "done" else random_start((seed, restart + 1), n)
            for psi, state, seed, restart, n in zip(pdf["psi"], pdf["state"], pdf["seed"], pdf["restart"], pdf["n_breakpoints"])
        ]
        pdf["state"], pdf["rss"], pdf["turn"], pdf["lost"] = "active", None, 0, 0
        yield pdf


def _run(index, fits, tolerance, min_distance, most, weighted=False):
    """Step all active tasks until they are at rest, failed, or `most` steps old."""
    names = [*index.keys, *FIT, "restart"]
    fits, schema = fits.checkpoint(), fits.schema

    def advance(batches):
        for pdf in batches:
            moved = [_advance(row, tolerance, min_distance, most, weighted) for row in pdf.to_dict("records")]
            pdf = pdf.drop(columns="parts")
            for place, column in enumerate(("psi", "state", "rss", "turn", "lost")):
                pdf[column] = [m[place] for m in moved]
            yield pdf[schema.names]

    for _ in range(most):  # every round takes every active fit at least one step further
        active = fits.where((F.col("state") == "active") & (F.col("turn") < most))
        if active.isEmpty():
            break
        fits = fits.join(index.fetch(active, names, weighted), names, "left").mapInPandas(advance, schema).checkpoint()
    return fits


def _advance(row, tolerance, min_distance, most, weighted):
    """Breakpoints, state, residual sum, age and unidentified steps of a task after all steps that its blocks allow."""
    psi, state, rss, turn, lost = np.asarray(row["psi"], float), row["state"], row["rss"], row["turn"], row["lost"]
    if state != "active" or row["parts"] is None:
        return psi, state, rss, turn, lost
    if len(psi) == 0:
        return psi, "done", 0.0, turn, lost
    held = Held(row["parts"], row["seed"], row["restart"] if weighted else -1)
    while turn < most:
        moments = held.moments(psi)
        if moments is None:
            break
        step = _step(moments, psi)
        if step is None:
            return psi, "failed", None, turn, lost
        moved = psi + (step["moved"] - psi) * damping(turn)
        new = next_breakpoints(psi[None], moved[None], 0.0, 1.0)
        proposed = next_breakpoints(psi[None], step["moved"][None], 0.0, 1.0)
        before = np.nan if rss is None else rss
        rss = float(step["rss"])
        if step["identified"] and at_rest(psi[None], proposed, np.array([rss]), before, tolerance, turn)[0]:
            good = apart(psi[None], 0.0, 1.0, min_distance / row["span"])[0]
            return psi, "done" if good else "failed", rss, turn, lost
        lost += not step["identified"]
        if lost >= MOST_LOST:
            return psi, "failed", None, turn, lost
        psi, turn = new[0], turn + 1
    return psi, "active", rss, turn, lost


def _step(moments, psi):
    """The Muggeo step of one task, None when its equations have no solution."""
    step = muggeo_steps(moments[None], psi[None])
    return {k: a[0] for k, a in step.items()} if np.isfinite(step["full"]).all() else None


def _reported(index, rows, first, tried):
    """The best finished task of every fit in data units; fits without one keep a status."""
    names = [*index.keys, *FIT]
    best = tried.where("state = 'done'").groupBy(*names).agg(
        F.min_by("psi", F.struct("rss", "restart")).alias("best")
    )
    state = F.when(F.col("best").isNotNull(), "done").otherwise(F.col("state"))
    fits = first.join(best, names, "left").withColumns({"psi": F.coalesce("best", "psi"), "state": state}).drop("best")
    fits = fits.checkpoint()
    final = fits.join(index.fetch(fits.where("state = 'done'"), [*names, "restart"]), [*names, "restart"], "left")
    result = fit_schema(rows.schema, index.keys)
    said = {"unfit": "unfit", "active": "moving"}

    def report(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                found = _estimates(row)
                status = "ok" if found is not NO_FIT else said.get(row["state"], "failed")
                out.append({**{k: row[k] for k in names}, "n_obs": row["n_obs"], "converged": status == "ok", "status": status, **found})
            yield pd.DataFrame(out, columns=result.names)

    return final.mapInPandas(report, result)


def _estimates(row):
    """Estimates of a finished fit, in data units; nothing when it did not converge."""
    psi = np.asarray(row["psi"], float)
    step = None
    if row["state"] == "done" and row["parts"] is not None:
        step = _step(Held(row["parts"], row["seed"], -1).moments(psi), psi)
    if step is None:
        return NO_FIT
    return unscale(psi, step, row["n_obs"], row["x0"], row["span"], row["base"], row["unit"])

"""What exists: available runs, missing artefacts, companions, tasks, job defaults."""

from pyspark.sql import functions as F


def available_runs(profiles, fits, keys=("campaign", "well_id", "smoothing")):
    """Profile keys with whether a sweep exists and its largest model size."""
    sweeps = fits.groupBy(*keys).agg(
        F.max("n_breakpoints").alias("max_n"), F.count_distinct("trial").alias("n_trials")
    )
    return profiles.select(*keys).distinct().join(sweeps, [*keys], "left").withColumns(
        {"has_sweep": F.col("max_n").isNotNull(), "n_trials": F.coalesce("n_trials", F.lit(0))}
    )


def missing_parts(wanted, parts, keys):
    """For each key the names of the parts it lacks: parts is {name: key DataFrame}."""
    out = wanted
    for name, have in parts.items():
        out = out.join(have.select(*keys).distinct().withColumn(f"_has_{name}", F.lit(1)), [*keys], "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_has_{n}").isNull(), F.lit(n)) for n in parts]))
    return out.withColumns({
        "missing": F.array_join(missing, ","), "is_complete": F.size(missing) == 0
    }).drop(*[f"_has_{n}" for n in parts])


def companions(wells, key="well_id", site="site"):
    """Other wells of the same site.  `wells` has one row per well."""
    other = wells.select(site, F.col(key).alias("companion"))
    return wells.select(site, key).join(other, site).where(F.col(key) != F.col("companion"))


def task_grid(wells, methods, sizes):
    """One task per well, method and size: the small lists are exploded per row."""
    return wells.withColumn("smoothing", F.explode(F.array(*[F.lit(m) for m in methods]))).withColumn(
        "n_breakpoints", F.explode(F.array(*[F.lit(int(n)) for n in sizes]))
    )


def job_settings(jobs, root, builtin):
    """Fill unset job columns from the root defaults, then from the built-in ones."""
    for name in builtin:
        value = F.lit(root.get(name)) if root.get(name) is not None else F.lit(None)
        kind = jobs.schema[name].dataType if name in jobs.columns else None
        own = F.col(name) if name in jobs.columns else F.lit(None)
        out = F.coalesce(own, value, F.lit(builtin[name]))
        jobs = jobs.withColumn(name, out.cast(kind) if kind is not None else out)
    return jobs


def normalise_campaign(text):
    """202202 becomes 2022_02; other spellings stay."""
    return F.regexp_replace(text.cast("string"), r"^(\d{4})(\d{2})$", "$1_$2")


def trial_index(name):
    """The digits a name ends with (trial_3 -> 3, x_3 -> 3, 3 -> 3); 1 without any."""
    return F.coalesce(F.regexp_extract(name.cast("string"), r"(\d+)$", 1).try_cast("int"), F.lit(1))

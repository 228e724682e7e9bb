"""Datum offsets: extraction from casts, upkeep of the metadata table, lookup."""

from pyspark.sql import functions as F

from plumbline.plans.layout import Layout, exact_quantiles

STD_TOLERANCE_M = 0.01
DEFAULT_CAMPAIGN = "2022_02"


def extract_offsets(casts, keys, ground="depth_gl_m", vertical="depth_m", tolerance_m=STD_TOLERANCE_M, layout=None):
    """Offset per cast: median of ground depth minus vertical position, with a status.

    The spread is the population standard deviation; beyond the tolerance the cast is
    `inconsistent`.  Casts that lack a column say which one.
    """
    keys = [*keys]
    layout = layout or Layout.of(casts, keys)
    gap = F.col(ground) - F.col(vertical)
    rows = casts.withColumn("_gap", gap)
    moments = [
        F.stddev_pop("_gap").alias("offset_std_m"), F.count("_gap").alias("n_samples"),
        F.count(ground).alias("_ground"), F.count(vertical).alias("_vertical"),
    ]
    found = exact_quantiles(rows, keys, {"offset_m": (F.col("_gap"), 0.5)}, layout, moments)
    status = (
        F.when(F.col("_ground") == 0, "missing_ground_depth")
        .when(F.col("_vertical") == 0, "missing_vertical_position")
        .when(F.col("n_samples") == 0, "no_samples")
        .when(F.col("offset_std_m") > tolerance_m, "inconsistent").otherwise("ok")
    )
    return found.withColumn("offset_status", status).select(
        *keys, "offset_m", "offset_std_m", "n_samples", "offset_status"
    )


def latest_cast(offsets, keys, date="cast_date", tie="cast_id"):
    """Newest cast per (site, type, campaign), by aggregation rather than by sorting."""
    rest = [c for c in offsets.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(date, tie))
    return offsets.groupBy(*keys).agg(newest.alias("_n")).select(*keys, "_n.*")


def with_campaign(metadata, default=DEFAULT_CAMPAIGN):
    """Metadata of the old layout has no campaign column: give it the default one."""
    if "campaign" in metadata.columns:
        return metadata
    return metadata.withColumn("campaign", F.lit(default))


def well_metadata(metadata):
    """Metadata rows with well_id = site followed by type."""
    return metadata.withColumn("well_id", F.concat("site", "well_type"))


def extraction_issues(casts_seen, offsets, file_key):
    """What could not be used and why: unparseable name, no campaign, bad offset."""
    reason = (
        F.when(F.col("site").isNull(), "unparseable_name").when(F.col("campaign").isNull(), "no_campaign")
        .when(F.col("offset_status").isNull(), "no_samples")
        .when(F.col("offset_status") != "ok", F.col("offset_status"))
    )
    joined = casts_seen.join(offsets, [file_key], "left").withColumn("reason", reason)
    return joined.where("reason is not null").select(file_key, "reason")


def upsert_offsets(existing, extracted, keys):
    """Merge extracted offsets into the metadata.

    An extraction that is `ok` or `inconsistent` (every one, without a status column) replaces
    the row of its key or adds it; other rows stay, manual ones among them.
    """
    if "offset_status" in extracted.columns:
        extracted = extracted.where(F.col("offset_status").isin("ok", "inconsistent"))
    old = existing.select(
        *keys, F.col("vadose_m").alias("_old"), F.col("source").alias("_old_source"), F.lit(1).alias("_in_old")
    )
    new = extracted.select(*keys, F.col("vadose_m").alias("_new"))
    manual = F.coalesce(F.col("_old_source") == "manual", F.lit(False)) & F.col("_old").isNotNull()
    return old.join(new, [*keys], "full").select(
        *keys,
        F.coalesce("_new", "_old").alias("vadose_m"),
        F.when(F.col("_new").isNotNull(), "computed").otherwise(F.col("_old_source")).alias("source"),
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_new").isNotNull(), "updated")
        .when(manual, "kept_manual").otherwise("kept").alias("action"),
    )


def resolve_offsets(requests, explicit, computed, fallback_campaign, key="well_id"):
    """Three-level lookup: explicit (well, campaign), computed from a cast, fallback campaign.

    Rows nothing resolves keep a null offset and source `unresolved`.  Of repeated metadata
    rows of a key the smallest offset counts, so requests stay one row each.
    """
    known = explicit.where(F.col("vadose_m").isNotNull() & ~F.isnan("vadose_m"))
    first = known.groupBy(key, "campaign").agg(F.min("vadose_m").alias("_explicit"))
    second = computed.where("offset_status = 'ok'").groupBy(key, "campaign").agg(F.min("offset_m").alias("_computed"))
    third = known.where(F.col("campaign") == fallback_campaign).groupBy(key).agg(F.min("vadose_m").alias("_fallback"))
    joined = requests.join(first, [key, "campaign"], "left").join(second, [key, "campaign"], "left").join(third, [key], "left")
    source = (
        F.when(F.col("_explicit").isNotNull(), "explicit").when(F.col("_computed").isNotNull(), "computed")
        .when(F.col("_fallback").isNotNull(), "fallback").otherwise("unresolved")
    )
    return joined.withColumns({
        "vadose_m": F.coalesce("_explicit", "_computed", "_fallback"), "vadose_source": source,
        "is_fallback": source == "fallback",
    }).drop("_explicit", "_computed", "_fallback")


def attach_offset(profiles, metadata, keys=("well_id", "campaign")):
    """Offset by well AND campaign, null where unknown."""
    return profiles.join(metadata.select(*keys, "vadose_m"), [*keys], "left")

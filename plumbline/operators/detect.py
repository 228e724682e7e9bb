"""Anomaly zones of width logs above a running-minimum baseline."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from plumbline.operators.baseline import two_zone_baseline
from plumbline.plans.layout import Layout, finish, lag, lay, lead, running_sum

SEVERITIES = ("none", "mild", "moderate", "severe")


@dataclass(frozen=True)
class DetectionRule:
    """Thresholds of the zone detector, in the unit of the log (cm) and of depth (m)."""

    offset_cm: float = 0.5
    k_sigma: float = 3.0
    sigma_inst_cm: float = 0.1
    mild_max_excess_cm: float = 2.0
    moderate_max_excess_cm: float = 5.0
    saturation_cm: float = 30.0
    min_length_m: float = 0.05
    nominal_cm: float | None = None


def flag_samples(df, rule: DetectionRule, v="caliper_cm"):
    """Threshold, detection flag and severity of every sample with a baseline.

    An excess that equals a class limit belongs to the higher class.
    """
    start = F.col("baseline_cm") + F.lit(rule.offset_cm)
    excess = F.col(v) - start
    saturated = F.col(v) >= F.lit(rule.saturation_cm)
    df = df.withColumns({
        "threshold_cm": start + F.lit(rule.k_sigma * rule.sigma_inst_cm),
        "excess_cm": excess,
        "is_saturated": F.coalesce(saturated, F.lit(False)),
    })
    detected = F.coalesce(F.col(v) > F.col("threshold_cm"), F.lit(False))
    level = (
        F.when(~detected, "none").when(saturated, "severe")
        .when(excess < rule.mild_max_excess_cm, "mild")
        .when(excess < rule.moderate_max_excess_cm, "moderate").otherwise("severe")
    )
    return df.withColumns({"is_anomaly": detected, "severity_per_sample": level})


def sample_table(flagged, keys, z="depth_m", v="caliper_cm"):
    """Per-sample output; the excess here is measured from the noise-inclusive threshold."""
    return flagged.select(
        *keys, z, v, "baseline_cm", "threshold_cm",
        (F.col(v) - F.col("threshold_cm")).alias("excess_from_threshold_cm"),
        "severity_per_sample", "zone_label",
    )


def runs_of_true(df, keys, z, flag, min_points=1, tie=(), layout=None):
    """Unbroken runs of TRUE: first and last position, and number of rows.

    `tie` orders rows at one position; then come those that are not TRUE.
    """
    track = lay(df, keys, [z, *tie, flag], layout)
    runs = _run_ids(track, F.col(flag)).df.where(F.col(flag))
    return (
        runs.groupBy(*keys, "_run")
        .agg(F.min(z).alias("run_start"), F.max(z).alias("run_end"), F.count("*").alias("n_points"))
        .where(F.col("n_points") >= min_points)
        .drop("_run")
    )


def _run_ids(track, flag):
    """Rows of one TRUE run share the number of non-TRUE rows before them."""
    miss = F.when(F.coalesce(flag, F.lit(False)), 0).otherwise(1)
    return track.scan(_run=running_sum(miss))


def zone_table(
    flagged, keys, rule: DetectionRule, z="depth_m", v="caliper_cm", nominal=None, layout=None
):
    """One row per anomaly zone that is long enough.

    z_top is the deeper end and z_bot the shallower one (depth grows downward);
    depth_shallow and depth_deep say the same without the ambiguity.  peak_excess_cm is
    measured from the baseline, peak_excess_over_threshold_cm from baseline and offset;
    the latter gives the severity.
    """
    track = lay(flagged, keys, [z, v], layout).scan(_next=lead(F.col(z)))
    track = track.quantiles(_dz=(F.col("_next") - F.col(z), 0.5))
    runs = _run_ids(track, F.col("is_anomaly")).df.where("is_anomaly")
    peak = F.max_by(
        F.struct(F.col(v).alias("v"), F.col("baseline_cm").alias("b")),
        F.struct(F.col(v), -F.col(z)),
    )

    def level(name):
        return F.count_if(F.col("severity_per_sample") == name).alias(f"n_pp_{name}")

    nominal = F.lit(rule.nominal_cm).cast("double") if nominal is None else nominal
    zones = runs.groupBy(*keys, "_run").agg(
        F.min(z).alias("depth_shallow"), F.max(z).alias("depth_deep"), peak.alias("_peak"),
        F.count("*").alias("n_points"), F.count_if("is_saturated").alias("n_saturated"),
        level("mild"), level("moderate"), level("severe"),
        F.concat_ws("+", F.sort_array(F.collect_set("zone_label"))).alias("sub_zone"),
        F.max("_dz").alias("_dz"), F.max(nominal).alias("_nominal"),
    )
    least_points = F.greatest(F.lit(1), F.bround(F.lit(rule.min_length_m) / F.col("_dz")))
    over = F.col("_peak.v") - F.col("_peak.b") - F.lit(rule.offset_cm)
    return zones.where(F.col("n_points") >= F.coalesce(least_points, F.lit(1))).select(
        *keys,
        F.col("depth_deep").alias("z_top"), F.col("depth_shallow").alias("z_bot"),
        ((F.col("depth_shallow") + F.col("depth_deep")) / 2).alias("z_centre"),
        (F.col("depth_deep") - F.col("depth_shallow")).alias("thickness_m"),
        F.col("_peak.v").alias("peak_cm"), F.col("_peak.b").alias("baseline_at_peak_cm"),
        (F.col("_peak.v") - F.col("_peak.b")).alias("peak_excess_cm"),
        over.alias("peak_excess_over_threshold_cm"),
        "n_saturated",
        F.when(F.col("n_saturated") > 0, "severe")
        .when(over < rule.mild_max_excess_cm, "mild")
        .when(over < rule.moderate_max_excess_cm, "moderate").otherwise("severe").alias("severity"),
        "n_pp_mild", "n_pp_moderate", "n_pp_severe",
        F.lit(rule.offset_cm).alias("offset_cm"), F.lit(rule.k_sigma).alias("k_sigma"),
        F.lit(rule.sigma_inst_cm).alias("sigma_inst_cm"),
        F.lit(rule.mild_max_excess_cm).alias("mild_max_excess_cm"),
        F.lit(rule.moderate_max_excess_cm).alias("moderate_max_excess_cm"),
        (F.col("_peak.v") - F.col("_nominal")).alias("peak_excess_vs_nominal_cm"),
        "sub_zone", "depth_shallow", "depth_deep",
    )


def analyse_logs(df, keys=("well_id",), rule=DetectionRule(), kind="linear",
                 direction="top_down", layout=None, **baseline_options):
    """Baseline and sample flags of every log; feed zone_table, sample_table, log_counts."""
    layout = layout or Layout.of(df, keys)
    based = two_zone_baseline(
        df, keys, kind=kind, direction=direction, layout=layout, **baseline_options
    )
    return flag_samples(based, rule)


def log_counts(flagged, keys, floor, v="caliper_cm"):
    """Rows, rows below the auger floor and valid rows per log."""
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.count_if(F.col(v) < floor).alias("n_below_auger"),
        F.count_if("is_valid").alias("n_valid"), F.count_if("is_anomaly").alias("n_anomaly"),
    )


def severity_counts(table, keys, severity="severity", levels=SEVERITIES[1:]):
    """Zones per profile and severity, one zero-filled column per level in fixed order."""
    return table.groupBy(*keys).pivot(severity, list(levels)).count().fillna(0, list(levels))


def severity_runs(df, keys, z, severity, levels=SEVERITIES[1:], layout=None):
    """Runs of equal severity, each end padded by half the median spacing."""
    track = lay(df, keys, [z, severity], layout).scan(_before=lag(F.col(severity)), _next=lead(F.col(z)))
    track = track.quantiles(_dz=(F.abs(F.col("_next") - F.col(z)), 0.5))
    change = F.when(F.col("_before").eqNullSafe(F.col(severity)), 0).otherwise(1)
    track = track.scan(_run=running_sum(change))
    half = F.coalesce(F.max("_dz") / 2, F.lit(0.0))
    return (
        track.df.where(F.col(severity).isin(*levels))
        .groupBy(*keys, "_run", severity)
        .agg((F.min(z) - half).alias("run_top"), (F.max(z) + half).alias("run_bottom"),
             F.count("*").alias("n_points"))
        .drop("_run")
    )


def outlier_flags(df, keys, v, auger, iqr_k=1.5, layout=None):
    """Display flag: below the auger AND below the fence of auger-passing samples."""
    track = lay(df, keys, [v], layout)
    passing = F.when(F.col(v) >= auger, F.col(v))
    track = track.quantiles(_q1=(passing, 0.25), _q3=(passing, 0.75))
    fence = F.col("_q1") - F.lit(float(iqr_k)) * (F.col("_q3") - F.col("_q1"))
    flag = F.coalesce((F.col(v) < auger) & (F.col(v) < fence), F.lit(False))
    return finish(track.with_columns(is_outlier=flag).on_drop("_q1", "_q3"))


def normalise_signs(df, keys, z, layout=None):
    """Make an all-negative log positive; report mixed logs and leave them as they are."""
    track = lay(df, keys, [z], layout).per_profile(_low=F.min(z), _high=F.max(z))
    flip = (F.col("_high") <= 0) & (F.col("_low") < 0)
    mixed = (F.col("_low") < 0) & ~flip
    track = track.with_columns(**{
        "sign_status": F.when(flip, "flipped").when(mixed, "mixed").otherwise("unchanged"),
        z: F.when(flip, -F.col(z)).otherwise(F.col(z)),
    })
    return finish(track.on_drop("_low", "_high"))

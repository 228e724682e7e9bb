"""Run ledger: identifiers, signatures, append, latest artefact."""

from pyspark.sql import functions as F

from plumbline.sources.publish import publish

LEDGER_COLUMNS = ("run_id", "timestamp", "stage", "well_id", "date", "method_signature",
                  "input_file", "output_file", "params_json", "notes")


def canonical_params(names_and_values):
    """JSON text with keys in alphabetical order; null parameters are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(names_and_values.items())]))


def run_id(params_json):
    """First eight hexadecimal digits of the SHA-1 of the parameter text."""
    return F.substring(F.sha1(params_json), 1, 8)


#: Parameters a method's text names, with the mark before each value; other methods name all they have.
SIGNATURES = {
    "savgol": {"window": "w", "order": "p"}, "lowess": {"frac": "f", "passes": "it"},
    "breakpoints": {"size": "n", "trial": "t"}, "convergence": {"delta": "d", "tolerance": "tol"},
}
FLAGS = ("segmented", "monotone")


def method_signature(method, window=None, order=None, frac=None, passes=None, **others):
    """Readable method text: the name, its parameters and the flags that are set, joined by `_`.

    Every method has its own short marks (`SIGNATURES`); one without lists the parameters that
    are not null in alphabetical order as name and value.  Flags are boolean columns named in FLAGS.
    """
    given = {"window": window, "order": order, "frac": frac, "passes": passes, **others}
    given = {k: v for k, v in given.items() if v is not None}
    values = {k: v.cast("string") for k, v in given.items() if k not in FLAGS}
    flags = [F.when(given[k], F.lit(k)) for k in FLAGS if k in given]
    text = F.concat_ws("_", method, *[F.concat(F.lit(k), values[k]) for k in sorted(values)], *flags)
    for name, marks in SIGNATURES.items():
        parts = [F.concat(F.lit(mark), values[k]) for k, mark in marks.items() if k in values]
        text = F.when(method == name, F.concat_ws("_", F.lit(name), *parts, *flags)).otherwise(text)
    return text


def output_filename(well_id, date, signature, stage, extension="csv"):
    """Name of an artefact: well, date, stage and method text; parts that are null are left out."""
    stem = F.concat_ws("_", well_id, date, stage, signature)
    return F.concat(F.regexp_replace(stem, r"[^A-Za-z0-9._-]", "-"), F.lit(f".{extension}"))


def append_run(entries, folder):
    """Append ledger rows; call after the run's own output action has succeeded."""
    entries.select(*LEDGER_COLUMNS).write.mode("append").parquet(folder)


def write_and_register(output, output_folder, entries, ledger_folder, mode="errorifexists"):
    """Write a result, and only then its ledger rows: a failed write leaves no entry."""
    output.write.mode(mode).parquet(output_folder)
    append_run(entries, ledger_folder)


def publish_run(spark, store, table, output, entries, mode="replace"):
    """Write a result and its ledger rows as one version of a store: both are seen, or neither.

    The result replaces `table` or, with mode `append`, adds to it; the ledger rows add to `ledger`.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = {"ledger": entries.select(*LEDGER_COLUMNS)}
    if mode == "append":
        return publish(spark, store, append={table: output, **rows})
    return publish(spark, store, replace={table: output}, append=rows)


def latest_artefact(ledger, keys, pinned_run=None):
    """Newest ledger row per key, or the rows of one run."""
    if pinned_run is not None:
        return ledger.where(F.col("run_id") == pinned_run)
    rest = [c for c in ledger.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("timestamp", "run_id"))
    return ledger.groupBy(*keys).agg(newest.alias("_n")).select(*keys, "_n.*")

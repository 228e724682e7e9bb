"""Readers: files in, one typed DataFrame of many profiles out."""

import csv
from collections import Counter
from urllib.parse import unquote

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.functions.numeric import clean_nan
from plumbline.plans.session import ensure_checkpoint_dir
from plumbline.sources import stores
from plumbline.sources.names import parse_cast_name, parse_ert_name, well_of_source

# Column spellings, first match wins; callers pass their own table for other firmware.
ALIASES = {
    "depth": ["Vertical Position m", "Depth (m)", "depth_m", "Depth m"],
    "conductivity": [
        "SpCond uS/cm", "SpCond (uS/cm)", "SpCond µS/cm", "Corrected sp Cond [uS/cm]",
        "Corrected sp Cond (uS/cm)", "Corrected Conductivity (uS/cm)", "Corrected Conductivity [uS/cm]",
        "Corrected Conductivity", "sec_us_cm", "Conductivity",
    ],
    "time": ["Time (HH:mm:ss)", "time"],
    "time_frac": ["Time (Fract. Sec)", "time_frac"],
}
DATUM_ALIASES = {
    "ground_depth": ["Depth from GL (m)", "depth_gl_m"],
    "vertical": ["Vertical Position m", "vertical_position_m"],
}
CANONICAL = {"depth": "depth_m", "conductivity": "sec_us_cm"}
SWEEP_JSON = (
    "map<string,struct<df:struct<n_breakpoints:map<string,int>,bic:map<string,double>,"
    "rss:map<string,double>,converged:map<string,boolean>,estimates:map<string,map<string,string>>>>>"
)
ESTIMATE = "struct<estimate:double,confidence_interval:array<double>>"


def resolve_column(columns, concept, aliases=ALIASES, strict=True, trim=False):
    """First alias present: exactly, else ignoring case (and blanks when `trim`)."""
    names = aliases[concept]
    for name in names:
        if name in columns:
            return name
    fold = (lambda s: s.strip().lower()) if trim else str.lower
    folded = {fold(c): c for c in reversed(columns)}
    for name in names:
        if fold(name) in folded:
            return folded[fold(name)]
    if strict:
        raise ValueError(f"no column for {concept!r} among {columns}")
    return None


def coalesce_aliases(df, concept, aliases=ALIASES):
    """Value of a concept in a union of header variants: the first non-null spelling."""
    lower = {c.lower(): c for c in df.columns}
    found = [lower[a.lower()] for a in aliases[concept] if a.lower() in lower]
    if not found:
        raise ValueError(f"no column for {concept!r} among {df.columns}")
    return F.coalesce(*[F.col(f"`{c}`") for c in dict.fromkeys(found)])


def standardise(df, aliases=ALIASES):
    """Rename depth and conductivity to their canonical names."""
    return df.withColumnsRenamed({
        resolve_column(df.columns, concept, aliases): name for concept, name in CANONICAL.items()
    })


def require(df, columns, what):
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def read_casts(spark, paths_by_header, aliases=ALIASES, name=None):
    """Raw cast CSV files, grouped by header variant: {name: (path or paths, schema or None)}.

    Each variant is one scan over all its files, without another to guess types: values are text until a column is picked, and
    without a schema the first file names the columns.  The file name gives site, type, probe and
    date.  Names that do not parse stay in the result with null keys for `unparsed_casts`.
    `name` replaces the file name by another expression over `_metadata`.  The source order
    of a file's rows is (block_start, row_no): ids rise within a block, blocks by offset.
    """
    name = F.col("_metadata.file_name") if name is None else name
    stacked = None
    for paths, schema in paths_by_header.values():
        reader = spark.read.option("header", True).option("recursiveFileLookup", True)
        schema = schema or _first_header(spark, paths)
        part = _picked_casts((reader.schema(schema) if schema else reader).csv(paths), aliases, name)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def _first_header(spark, paths):
    """Text columns that the first file names; Spark would list every file once more to find them.  None if there is no line."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths)
    line = lines.where((F.col("_metadata.file_block_start") == 0) & (F.length(F.trim("value")) > 0)).first()
    if line is None:
        return None
    return StructType([StructField(n, StringType()) for n in _distinct(next(csv.reader([line["value"].removeprefix("\ufeff")])))])


def _distinct(names):
    """Column names of a header; a repeated spelling counts where it stands first."""
    seen = Counter()
    out = []
    for i, n in enumerate(names):
        seen[n.lower()] += 1
        out.append(f"_c{i}" if seen[n.lower()] > 1 or not n else n)
    return out


def _number(value):
    return value.try_cast("double")


def _source(name):
    """File and place of a row."""
    return [
        name.alias("file_name"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row_no"),
    ]


def _picked_casts(raw, aliases, name):
    """Canonical columns of one header variant, with keys from the file name; numbers that do not parse are null."""
    number = lambda column: _number(F.col(f"`{column}`"))
    picked = {c: number(resolve_column(raw.columns, concept, aliases)) for concept, c in CANONICAL.items()}
    for concept in ("time", "time_frac"):
        column = resolve_column(raw.columns, concept, aliases, strict=False)
        if column is None:
            picked[concept] = F.lit(None).cast("string" if concept == "time" else "double")
        else:
            picked[concept] = F.col(f"`{column}`").cast("string") if concept == "time" else number(column)
    ground = resolve_column(raw.columns, "ground_depth", DATUM_ALIASES, strict=False, trim=True)
    picked["depth_gl_m"] = F.lit(None).cast("double") if ground is None else number(ground)
    return _keyed(raw.select(*_source(name), *[c.alias(n) for n, c in picked.items()]))


def _keyed(part):
    keyed = part.withColumns(parse_cast_name(F.col("file_name")))
    return clean_nan(keyed, "depth_m", "sec_us_cm", "depth_gl_m", "time_frac")


#: Header variants of one folder; instruments have a handful.
MOST_HEADERS = 10_000


def cast_headers(spark, path):
    """(file_path, header) of every file below `path`: its first line that is not blank, null for none.

    Tasks list the folders and open the files, so the driver holds neither names nor lines.
    """
    files = stores.listed(spark, path)
    return (_headers(spark, path) if files is None else stores.first_lines(files)).select("file_path", "header")


def _bare(path):
    """A path with one slash behind its scheme: Spark's list of files and its rows write it differently."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _headers(spark, path):
    """The files of `cast_headers` with `_path`, by which their rows are known, in a store that only Spark's own scans read.

    One scan with map-side combine finds the first lines, however the files are split.  The names come from the scan's own
    list of files, which the driver holds, so those without a line are there as well.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path)
    files = [(unquote(f), f) for f in text.inputFiles()]
    listed = spark.createDataFrame(files, "file_path string, _path string").withColumn("_path", _bare("_path"))
    lines = text.select(
        _bare(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    first = lines.where(F.length(F.trim("value")) > 0).groupBy("_path").agg(F.min_by("value", F.struct("_block", "_line")).alias("header"))
    return listed.join(first, "_path", "left").select("_path", "file_path", "header")


def header_columns(header, aliases=ALIASES):
    """(column names, None) of a header line, or (None, why it cannot be read)."""
    if header is None:
        return None, "empty"
    if "\ufffd" in header or any(c < " " and c != "\t" for c in header):
        return None, "not text"
    names = [n.strip().strip('"').strip() for n in next(csv.reader([header]))]
    for concept in ("depth", "conductivity"):
        if resolve_column(names, concept, aliases, strict=False) is None:
            return None, f"no column for {concept}"
    return _distinct(names), None


def read_cast_folder(spark, path, aliases=ALIASES, name=None):
    """(casts, quarantine): every cast file below a folder, whatever headers they have.

    One pass finds the files' header lines, which are kept, and one more reads all files as text columns; each row takes its values
    from the places that its file's header gives.  Files whose header names no depth or no conductivity, that are no text or have no
    lines are left out and listed with a reason, so an odd file does not fail the others.  The number of different
    headers is bounded (`MOST_HEADERS`); files are listed and opened by tasks, so the driver holds none of their names.  Only in a
    store that Spark alone can read (`stores.listed`) the names pass through the driver, as with any file scan.
    """
    ensure_checkpoint_dir(spark)
    files = stores.listed(spark, path)
    found = (_headers(spark, path) if files is None else stores.first_lines(files)).checkpoint()
    kinds = [r["header"] for r in found.select("header").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} headers below {path}")
    concepts = {"depth": aliases, "conductivity": aliases, "time": aliases, "time_frac": aliases, "ground_depth": DATUM_ALIASES}
    places, reasons, width = [], [], 1
    for header in kinds:
        columns, reason = header_columns(header, aliases)
        if reason is not None:
            reasons.append((header, reason))
            continue
        width = max(width, len(columns))
        named = [resolve_column(columns, c, table, strict=False, trim=c == "ground_depth") for c, table in concepts.items()]
        places.append((header, *[None if n is None else columns.index(n) for n in named]))
    reasons = spark.createDataFrame(reasons, "header string, reason string")
    reasons = F.broadcast(reasons)  # at most MOST_HEADERS, while the files are many
    quarantine = found.join(reasons, found["header"].eqNullSafe(reasons["header"])).select("file_path", "reason", found["header"])
    places = spark.createDataFrame(places, "header string, " + ", ".join(f"_{c} int" for c in concepts))
    name = F.col("_metadata.file_name") if name is None else name
    schema = StructType([StructField(f"_{i}", StringType()) for i in range(width)])
    if files is None:
        raw = spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(path)
        rows = raw.select(*_source(name), _bare(F.col("_metadata.file_path")).alias("_path"), F.array(*schema.names).alias("_values"))
        rows = rows.join(found.join(places, "header").drop("file_path"), "_path")
    else:
        lines = stores.lines(files, found.join(F.broadcast(places), "header").drop("header"))  # at most MOST_HEADERS places
        rows = lines.withColumn("_columns", F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "))).select(
            name.alias("file_name"), "_metadata.file_path", F.col("_metadata.file_block_start").alias("block_start"), "row_no",
            F.array(*[F.col(f"_columns.{c}") for c in schema.names]).alias("_values"), *[f"_{c}" for c in concepts])
    value = lambda concept: F.get("_values", F.col(f"_{concept}"))
    return _keyed(rows.select(
        "file_name", "file_path", "block_start", "row_no",
        _number(value("depth")).alias("depth_m"), _number(value("conductivity")).alias("sec_us_cm"), value("time").alias("time"),
        _number(value("time_frac")).alias("time_frac"), _number(value("ground_depth")).alias("depth_gl_m"))), quarantine


def casts_of(casts, well_id, campaign=None, probe=None):
    """Casts of one well, optionally one campaign and probe letter, by (date, probe)."""
    out = casts.where(F.col("well_id") == well_id)
    if campaign is not None:
        out = out.where(F.col("campaign") == campaign)
    if probe is not None:
        out = out.where(F.col("suffix") == probe)
    return out.orderBy("cast_date", "suffix", "file_path", "block_start", "row_no")


def cast_index(casts):
    """One row per cast with its place in the well's (date, probe) order, rows and depths.

    A well has few casts, so numbering them is a small window over the aggregated rows.
    """
    keys = ["well_id", "cast_date", "suffix", "instrument", "file_name"]
    each = casts.where("well_id is not null").groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min("depth_m").alias("depth_min"), F.max("depth_m").alias("depth_max")
    )
    order = Window.partitionBy("well_id").orderBy("cast_date", "suffix", "file_name")
    return each.withColumn("cast_no", F.row_number().over(order))


def unparsed_casts(casts):
    return casts.where("well_id is null").select("file_name").distinct()


def read_width_master(spark, path):
    """Master width log: canonical names, `well_id` from the source file; refuses depths < -0.1."""
    raw = require(
        spark.read.option("header", True).option("inferSchema", True).csv(path),
        ["source_file", "Depth [m]", "calibrated_cm", "Diameter_auger_in"], "width log",
    )
    return width_log(raw.withColumnsRenamed({"Depth [m]": "depth_m"}))


def width_log(raw, least_depth=-0.1):
    """Canonical width-log columns; a depth above the limit fails the job where it is met."""
    depth = F.when(
        F.col("depth_m") < least_depth,
        F.raise_error(F.concat(F.lit("negative depth in "), F.col("source_file"))).cast("double"),
    ).otherwise(F.col("depth_m"))
    out = raw.select(
        "source_file", well_of_source(F.col("source_file")).alias("well_id"),
        depth.alias("depth_m"), F.col("calibrated_cm").cast("double").alias("caliper_cm"),
        F.col("Diameter_auger_in").cast("double").alias("auger_in"),
    )
    return clean_nan(out, "depth_m", "caliper_cm")


def read_table(spark, path, columns, what):
    """Parquet, or CSV with a header, that must have the given columns."""
    reader = spark.read.option("header", True).option("inferSchema", True)
    df = reader.csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return require(df, columns, what)


def read_ert(spark, path, transect=None):
    """Resistivity CSV files: sign flipped, position and variant from the file name.

    `transect` is a text for all files or a column, say one that the folders carry.
    """
    raw = require(
        spark.read.option("header", True).option("inferSchema", True).csv(path),
        ["x_requested", "x_extracted", "depth", "resist", "resistlog10"], "resistivity file",
    )
    variant, x = parse_ert_name(F.col("_metadata.file_name"))
    return raw.select(
        (transect if isinstance(transect, Column) else F.lit(transect)).alias("transect"), variant.alias("variant"), x.alias("x_name"),
        F.col("x_extracted").cast("double").alias("x"), (-F.col("depth")).alias("depth_bgl_m"),
        F.col("resist").cast("double").alias("resist_ohm_m"),
    )


def read_annotations(spark, path, well=None):
    """Annotation CSV with `#` comment lines."""
    df = spark.read.option("header", True).option("inferSchema", True).option("comment", "#").csv(path)
    df = require(df, ["well", "depth_m", "kind", "text"], "annotations")
    return df if well is None else df.where(F.col("well") == well)


def read_sweep_json(spark, path, whole_file=True):
    """Sweep documents {trial: {df: columns keyed by row}}: one row per trial and fit.

    Estimates may be plain numbers or structs with an interval; NaN becomes null.
    """
    raw = spark.read.text(path, wholetext=whole_file)
    return explode_sweep(raw.select(F.col("_metadata.file_name").alias("file_name"), "value"))


def explode_sweep(documents):
    """Rows of sweep documents held in a text column `value`; other columns stay."""
    others = [c for c in documents.columns if c != "value"]
    trials = documents.select(*others, F.explode(F.from_json("value", SWEEP_JSON)).alias("trial", "t"))
    rows = trials.select(*others, "trial", "t.df", F.explode("t.df.n_breakpoints").alias("row", "n_breakpoints"))
    at = lambda c: F.try_element_at(F.col(f"df.{c}"), F.col("row"))
    number = lambda x: F.when(~F.isnan(x), x)
    plain = lambda v: F.struct(number(v.try_cast("double")).alias("estimate"), F.lit(None).cast("array<double>").alias("confidence_interval"))
    estimates = F.transform_values(
        at("estimates"), lambda k, v: F.when(v.startswith("{"), F.from_json(v, ESTIMATE)).otherwise(plain(v))
    )
    return rows.select(
        *others, "trial", "n_breakpoints", number(at("bic")).alias("bic"), number(at("rss")).alias("rss"),
        at("converged").alias("converged"), estimates.alias("estimates"),
    )

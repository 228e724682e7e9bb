"""Depth-annotated notes: text repair, depth tokens, continuation rows, intervals."""

from pyspark.sql import functions as F

from plumbline.plans.layout import finish, lay, lead, row_number, running_sum

NUMBER = r"(\d+(?:\.\d+)?)"
DASHES = "-–—"


def fix_text(text, replacements):
    """Literal replacements in the caller's order, then trim."""
    for wrong, right in replacements.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.trim(text)


def parse_depth(token):
    """(top, bottom) of `a`, `a m` or `a-b`; both null for anything else."""
    whole = rf"^\s*{NUMBER}\s*(?:[{DASHES}]\s*{NUMBER})?\s*m?\s*$"
    top = F.regexp_extract(token, whole, 1).try_cast("double")
    bottom = F.regexp_extract(token, whole, 2).try_cast("double")
    return top, F.coalesce(bottom, top)


def merge_continuations(df, keys, row="row_no", token="depth_token", text="note", replacements=None, layout=None):
    """Append notes without a depth to the entry before them, joined by "; ".

    Rows without a note are skipped before their depth is looked at; notes are trimmed and
    repaired by `replacements`.  The running count of depths numbers the entries; notes before the
    first depth go.  Trailing dots and blanks of all but the last piece are stripped before
    joining.  `position` is the entry's place by centre.
    """
    top, bottom = parse_depth(F.col(token))
    note = fix_text(F.regexp_replace(text, r"^\s+|\s+$", ""), replacements or {})
    rows = df.withColumns({"_top": top, "_bottom": bottom, text: note}).where(F.length(text) > 0)
    track = lay(rows, keys, [row], layout).scan(
        entry=running_sum(F.col("_top").isNotNull().cast("int"))
    )
    piece = F.struct(F.col(row).alias("r"), F.col(text).alias("t"))
    entries = track.df.where("entry > 0").groupBy(*keys, "entry").agg(
        F.min_by("_top", row).alias("depth_top"), F.min_by("_bottom", row).alias("depth_bottom"),
        F.sort_array(F.collect_list(piece)).alias("_pieces"),
    )
    strip = lambda t: F.regexp_replace(t, r"[. ]+$", "")
    texts = F.transform("_pieces", lambda p: p["t"])
    joined = F.array_join(
        F.transform(texts, lambda t, i: F.when(i < F.size(texts) - 1, strip(t)).otherwise(t)), "; "
    )
    done = entries.select(
        *keys, F.col("entry").cast("int").alias("entry"), "depth_top", "depth_bottom",
        ((F.col("depth_top") + F.col("depth_bottom")) / 2).alias("centre"), joined.alias("note"),
    )
    placed = lay(done, keys, ["centre", "entry"], layout).scan(position=row_number())
    return finish(placed.with_columns(position=(F.col("position") + 1).cast("int")))


def extend_intervals(df, keys, z="depth_m", kind="kind", interval_kind="lithology", tie=(), layout=None):
    """Give interval kinds the next depth of their kind as bottom; points end where they start.

    The last interval of a well is open (null bottom); its centre is its top.
    """
    track = lay(df, [*keys, kind], [z, *tie], layout).scan(_next=lead(F.col(z)))
    bottom = F.when(F.col(kind) == interval_kind, F.col("_next")).otherwise(F.col(z))
    return finish(track.with_columns(depth_top=F.col(z), depth_bottom=bottom).with_columns(
        centre=(F.col("depth_top") + F.coalesce("depth_bottom", "depth_top")) / 2
    ).on_drop("_next"))


def centre_between(df, low, high, drop_kinds=()):
    """Annotations whose centre lies in the depth window, without some kinds."""
    kept = df.where(F.col("centre").between(low, high))
    return kept.where(~F.col("kind").isin(*drop_kinds)) if drop_kinds else kept


def stack_annotations(sources, relabel=None):
    """Union of annotation tables (keys, centre, text, kind), kinds renamed by a mapping."""
    out = None
    for kind, df in sources.items():
        df = df.withColumn("kind", F.lit((relabel or {}).get(kind, kind)))
        out = df if out is None else out.unionByName(df)
    return out

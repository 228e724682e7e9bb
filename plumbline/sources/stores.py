"""Folders of very many files: listed, opened and read by tasks, so that the driver holds none of their names."""

import math
import os
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.plans.session import ensure_checkpoint_dir, ship_package

#: Files that a task opens one after another.
OPENED = 2_000
#: Bytes of a file that a task reads; a longer file is cut, and a line goes to the piece in which it begins.
PIECE = 64 << 20
#: Lines that are handed on together, and bytes that are read at a time.
GATHERED, CHUNK = 8_192, 1 << 20
#: Suffixes of files that are unpacked as they are read, and of those that only Spark unpacks.
PACKED, OTHERS = (".gz", ".bz2", ".zst"), (".deflate", ".snappy", ".lz4")

_ENTRIES = "path string, folder boolean, size long, changed timestamp"


@dataclass(frozen=True)
class Files:
    """Files below a folder: (path, size, changed), as they were listed, and into how many tasks they are dealt."""

    df: DataFrame
    prefix: str  # what Spark writes ahead of a path
    tasks: int


def opened(place):
    """(file system, path in it) of a qualified place."""
    from pyarrow import fs

    if place.startswith(("file:/", "/")):
        return fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(place)


def hidden(name):
    """Names that Spark's scans leave out."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(place):
    """(path, folder, size, changed) of what stands in a folder; a file is its own only entry."""
    from pyarrow import fs

    system, path = opened(place)
    if isinstance(system, fs.LocalFileSystem):
        if not os.path.isdir(path):
            known = os.stat(path)
            yield path, False, known.st_size, datetime.fromtimestamp(known.st_mtime, timezone.utc)
            return
        with os.scandir(path) as found:
            for one in found:
                if not hidden(one.name):
                    known = one.stat()
                    yield one.path, one.is_dir(), known.st_size, datetime.fromtimestamp(known.st_mtime, timezone.utc)
        return
    top = system.get_file_info(path)
    for one in [top] if top.is_file else system.get_file_info(fs.FileSelector(path)):
        if not hidden(one.base_name):
            yield one.path, one.type == fs.FileType.Directory, max(one.size or 0, 0), one.mtime


def _list(batches, prefix):
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("changed", pa.timestamp("us", "UTC"))])
    for batch in batches:
        for place in batch.column(0).to_pylist():
            rows = []
            for one in _entries(prefix + place):
                rows.append(one)
                if len(rows) == GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _roots(spark, path):
    """Qualified places that a path or pattern names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [one.getPath().toString() for one in system.globStatus(system.makeQualified(hadoop)) or []]


def listed(spark, path):
    """All files below a folder, listed level by level, each folder by a task.  None in a store that only Spark can read."""
    try:
        roots = [(place, opened(place)[1]) for place in _roots(spark, path)]
    except (Py4JJavaError, OSError, ValueError, ImportError):
        return None
    if not roots:
        return None
    place, inside = roots[0]
    prefix = "file://" if place.startswith("file:/") else place.removesuffix(inside)
    if any(not p.startswith("file:/") and p != prefix + i for p, i in roots):
        return None
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    base, levels = f"{spark.sparkContext.getCheckpointDir()}/listed-{uuid.uuid4().hex}", []
    cores = 2 * spark.sparkContext.defaultParallelism
    todo, files, total, odd = spark.createDataFrame([(i,) for _, i in roots], "path string").coalesce(1), 0, 0, 0
    while True:
        levels.append(f"{base}/{len(levels)}")
        seen = Observation()
        own, foreign = ~F.col("folder"), F.lower(F.col("path")).rlike("(" + "|".join(s.replace(".", "[.]") for s in OTHERS) + ")$")
        todo.mapInArrow(lambda batches: _list(batches, prefix), _ENTRIES).observe(
            seen, F.count_if("folder").alias("folders"), F.count_if(own).alias("files"), F.sum(F.when(own, F.col("size"))).alias("bytes"),
            F.count_if(own & foreign).alias("odd")).write.parquet(levels[-1])
        files, total, odd = files + seen.get["files"], total + (seen.get["bytes"] or 0), odd + seen.get["odd"]
        if not seen.get["folders"]:
            break
        todo = spark.read.schema(_ENTRIES).parquet(levels[-1]).where("folder").select("path").repartition(min(cores, seen.get["folders"]), "path")
    if odd:
        return None
    tasks = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(files / OPENED), math.ceil(total / PIECE))
    found = spark.read.schema(_ENTRIES).parquet(*levels).where("NOT folder").drop("folder")
    return Files(found, prefix, min(tasks, max(1, files)))


def _lines(source, first, last):
    """Lists of the lines of a source that begin at `first` or later and before `last`; ends of lines are \\n, \\r or both."""
    at, cut, rest = max(first - 1, 0), first > 0, b""  # a line that began before is read to its end
    if at:
        source.seek(at)
    while at < last:
        data = source.read(CHUNK)
        parts = (rest + data).splitlines(keepends=True)
        rest = parts.pop() if data and parts else b""  # it may go on
        out = []
        for part in parts:
            if at >= last:
                break
            if not cut:
                out.append(part.rstrip(b"\r\n"))
            cut, at = False, at + len(part)
        if out:
            yield out
        if not data:
            return


def _source(system, path):
    """A file's bytes; only whole files can be unpacked."""
    if path.lower().endswith(PACKED):
        return system.open_input_stream(path, compression="detect")
    return system.open_input_file(path)


def _text(line):
    return line.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


def _quoted(path):
    """A path as Spark's scans write it in `_metadata`: what a URI may not hold is quoted."""
    return re.sub(r"[^A-Za-z0-9_\-!.~'()*:@&=+$,;/\x80-\U0010ffff]", lambda m: f"%{ord(m[0]):02X}", path)


def _first(system, path):
    with _source(system, path) as source:
        for lines in _lines(source, 0, 1 << 62):
            for line in lines:
                if _text(line).strip(" "):
                    return _text(line)
    return None


def first_lines(files):
    """(_path, file_path, header): the first line of every file that is not blank, null for none."""
    prefix = files.prefix

    def run(batches):
        import pyarrow as pa

        system, _ = opened(prefix + "/")
        for batch in batches:
            for a in range(0, batch.num_rows, GATHERED):
                paths = batch.column(0).slice(a, GATHERED)
                yield pa.RecordBatch.from_arrays([paths, pa.array([_first(system, p) for p in paths.to_pylist()], pa.string())], ["_path", "header"])

    found = files.df.select("path").repartition(files.tasks, "path").mapInArrow(run, "_path string, header string")
    return found.select("_path", F.concat(F.lit(prefix), "_path").alias("file_path"), "header")


def lines(files, wanted):
    """The lines below the headers of files: those of `wanted` (_path, ...), with its other columns.

    `_metadata` has what Spark's scans tell of a row's file.  Blank lines are left out, `row_no` rises within a piece.
    """
    prefix = files.prefix
    others = [f for f in wanted.schema.fields if f.name not in ("_path", "file_path")]
    whole = F.lower(F.col("path")).rlike("(" + "|".join(s.replace(".", "[.]") for s in PACKED) + ")$") | (F.col("size") <= PIECE)
    # a merge join at every size: paths take a tenth of their bytes in a file, and Spark would send them all to the driver
    known = files.df.join(wanted.drop("file_path").hint("merge"), F.col("path") == F.col("_path")).drop("_path")
    pieces = known.withColumn("first", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PIECE).cast("long")))))
    pieces = pieces.withColumn("last", F.when(whole, F.lit(1 << 62)).otherwise(F.col("first") + PIECE))
    pieces = pieces.select("path", "size", "changed", "first", "last", *[f.name for f in others])
    kinds = "path string, size long, changed timestamp, first long, last long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)

    def run(batches):
        import pyarrow as pa

        system, _ = opened(prefix + "/")
        blank = bytes(range(33))
        for batch in batches:
            places, numbers, texts = [], [], []
            quoted = pa.array([_quoted(p) for p in batch.column(0).to_pylist()], pa.string())

            def gathered():
                at = pa.array(places, pa.int64())
                return pa.RecordBatch.from_arrays([*[c.take(at) for c in (quoted, *batch.columns[1:])], pa.array(numbers, pa.int64()), pa.array(texts, pa.string())],
                                                  names=[*batch.schema.names, "row_no", "line"])

            for k, (path, first, last) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)))):
                header, number = first == 0, 0
                with _source(system, path) as source:
                    for some in _lines(source, first, last):
                        for line in some:
                            if header:
                                header = not _text(line).strip(" ")
                            elif line.strip(blank):
                                places.append(k)
                                numbers.append(number)
                                texts.append(line.decode("utf-8", "replace"))
                            number += 1
                            if len(texts) == GATHERED:
                                yield gathered()
                                places, numbers, texts = [], [], []
            if texts:
                yield gathered()

    rows = pieces.repartition(files.tasks, "path", "first").mapInArrow(run, f"{kinds}, row_no long, line string")
    about = F.struct(
        F.concat(F.lit(prefix.removesuffix("//")), "path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("size").alias("file_size"),
        F.col("first").alias("file_block_start"), (F.least("last", "size") - F.col("first")).alias("file_block_length"), F.col("changed").alias("file_modification_time"))
    return rows.select(about.alias("_metadata"), "row_no", "line", *[f.name for f in others])

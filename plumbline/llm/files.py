"""Files that tasks write and read in the shared folder, by any scheme pyarrow opens."""

from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Partitions whose totals are summed in one task before the totals of such blocks are.
BLOCK = 512


def open_path(path):
    """(file system, its path) of a URI or an absolute local path."""
    from pyarrow import fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def task_file(folder, sequence, suffix):
    """A name that no other attempt of this or another task uses; listing the names is up to the task's result."""
    context = TaskContext.get()
    return f"{folder}/part-{context.partitionId():06d}-{sequence:05d}-{context.taskAttemptId()}.{suffix}"


def create(path):
    system, place = open_path(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place, compression=None)  # the name would have it compressed again


def spread(manifest, most=20_000):
    """One task per listed file, or as many tasks as `most` allows."""
    return manifest.repartition(max(1, min(most, manifest.count())))


def running_start(manifest, value):
    """Adds `start`: the sum of `value` over earlier rows by (part, sequence); totals of blocks of parts come first."""
    rows = manifest.withColumn("block_", F.floor(F.col("part") / BLOCK))
    inside = Window.partitionBy("block_").orderBy("part", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # one row per BLOCK tasks
    totals = rows.groupBy("block_").agg(F.sum(value).alias("total_"))
    totals = totals.select("block_", F.coalesce(F.sum("total_").over(across), F.lit(0)).alias("before_"))
    within = rows.withColumn("within_", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(totals, "block_").withColumn("start", (F.col("within_") + F.col("before_")).cast("long")).drop(
        "block_", "within_", "before_")

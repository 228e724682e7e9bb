"""What the operators of this package share: the shared folder, settled tables, batches of texts."""

import atexit
import uuid

from pyspark.sql import functions as F

from plumbline.plans.session import ensure_checkpoint_dir, ship_package

_CLEANED = set()


def shared_folder(spark):
    """A folder of this application below spark.checkpoint.dir, which all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    folder = f"{base.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"
    if folder not in _CLEANED:
        _CLEANED.add(folder)
        ship_package(spark)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark, folder):
    """Drop the application's intermediate tables when the driver ends."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before; the folder is named after it
        return


def new_path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df, name):
    """Write a table to the shared folder and read it back: its lineage ends there, lost executors or not."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows=256):
    """Record batches cut so small that a task holds few texts as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ceil_div(column, by):
    return F.ceil(column / F.lit(by)).cast("long")

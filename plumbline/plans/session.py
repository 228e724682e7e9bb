"""Session settings used by the bench, the tests and stand-alone jobs."""

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(cores="*", shuffle_partitions=8, app_name="plumbline", memory="12g"):
    """Local session for tests and benches; a cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark):
    """Use the cluster's shared checkpoint folder; fall back only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    context.setCheckpointDir(folder)


_SHIPPED = set()


def ship_package(spark):
    """Send this package to the Python workers, once per application.

    Grouped-map workers import it by name, wherever the job was started from.  The archive
    is built on the driver, and Spark copies it to the executors.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    if not package.is_dir():  # already imported from a shipped archive
        return
    target = Path(tempfile.mkdtemp(prefix="plumbline-package-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)

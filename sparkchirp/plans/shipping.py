"""Lets executors import this package wherever the driver found it, and names the shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_sparkchirp_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="sparkchirp-")) / "sparkchirp.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._sparkchirp_sent = True


def shipped(query):
    """A query (spark, sf_dir) that sends the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one, but only in local mode."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sparkchirp.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        path = tempfile.mkdtemp(prefix="sparkchirp-")
        spark.conf.set("spark.sparkchirp.scratch", path)
    return path.rstrip("/")


_made: dict[str, list[str]] = {}  # of every Spark application, in order


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered for ``clear_scratch``."""
    path = f"{shared_folder(spark)}/sparkchirp-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_paths(spark: SparkSession) -> list[str]:
    """The paths given out in this application and not yet cleared."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, keep=()) -> int:
    """Delete what lies at the paths given out so far but those in ``keep``; gives their number.

    For a driver to call once the results it needs are written: results read from scratch tables are lazy.
    """
    keep, paths = set(keep), scratch_paths(spark)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path not in keep:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    _made[spark.sparkContext.applicationId] = [p for p in paths if p in keep]
    return len(paths) - len(scratch_paths(spark))

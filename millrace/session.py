"""Session factory: UTC, adaptive execution, ANSI. On a cluster, pass only what differs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(app: str = "millrace", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session whose settings hold for tests and single machines; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if cpus or "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus or os.cpu_count()}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus or os.cpu_count()),
        # what Python workers get at once stays small where texts are long
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once an application, wherever they run and whatever their path holds."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)

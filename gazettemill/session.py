"""Session settings shared by tests, bench and the driver's smoke run."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Whether workers find the package by the PYTHONPATH that this process began with.
_INHERITED = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, unless PYTHONPATH already leads there."""
    app = spark.sparkContext.applicationId
    if _INHERITED or app in _shipped:
        return
    _shipped.add(app)
    staged = Path(tempfile.mkdtemp(prefix="gazettemill-ship-"))
    shutil.copytree(ROOT / "gazettemill", staged / "pkg" / "gazettemill", ignore=shutil.ignore_patterns("__pycache__"))
    for module in ROOT.glob("*_pipeline.py"):
        shutil.copy(module, staged / "pkg")
    spark.sparkContext.addPyFile(shutil.make_archive(str(staged / "gazettemill"), "zip", staged / "pkg"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that driver and executors share: below spark.checkpoint.dir, a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gazettemill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes and rows, for jobs that hand whole texts to Python.

    Every operator asks for the same bounds, and only where the session still
    has Spark's own defaults, so it doesn't matter which plan runs last.
    """
    for name, default, bound in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", str((1 << 31) - 1), str(16 << 20))):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, default).rstrip("Bb") == default:
            spark.conf.set(name, bound)


def build_session(app: str = "gazettemill", cpus: int | str = "*", **conf: str) -> SparkSession:
    """Local session for development; on a cluster the submit settings win.

    AQE is on (runtime coalescing and skew-join splitting) and the session
    time zone is UTC, which every time-window operator assumes.
    """
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

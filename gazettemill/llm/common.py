"""Helpers every corpus operator uses: inputs, written cuts, Arrow batch size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches as small_batches

#: ASCII white space of the contracts, as a regex class.
ASCII_SPACE = r"[\x20\x09-\x0D]"


_owner: str | None = None
_kept: dict[str, object] = {}


def take_over(owner: str) -> None:
    """First thing in a Python task: what another owner's tasks left in this worker process goes back to the system.

    Workers live on through all stages of a job, so without this the words,
    indexes and freed memory of one stage count on top of the next one's.
    """
    global _owner
    if owner == _owner:
        return
    _owner = owner
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def kept(owner: str, make: Callable[[], object]):
    """What ``owner`` keeps in this worker process from one task to the next, until another owner takes over."""
    take_over(owner)
    if owner not in _kept:
        _kept[owner] = make()
    return _kept[owner]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="gazettemill-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only on one machine (a local master, as in tests) does a temporary folder
    stand in where that setting is missing; on a cluster that is an error, as
    executors wouldn't see each other's files. Spark removes the folder when
    the JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_dir()
    path = f"{base.rstrip('/')}/gazettemill-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there.

    The written table survives lost executors, and its file sizes give the
    planner real statistics for its own broadcast-or-shuffle choice.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def write(df: DataFrame, name: str) -> str:
    """Write ``df`` into the shared folder; the path."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle, however small Spark takes a side to be.

    An explode's rows count as those it was given, and arrays and counts are a
    fraction on disk of what they are in memory, so a side that passes for
    small can be more than the driver holds.
    """
    return left.join(right.hint("merge"), keys, how)


def weighted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner", rest: Callable[..., DataFrame] = DataFrame.join) -> DataFrame:
    """``left`` joined to ``right``, whose rows have different keys and tell in ``weight`` how many rows of ``left`` hold theirs.

    A key of over 1000 rows and over a 100 000th of all is broadcast, so that
    no task gets all its rows; there are under 100 000 such keys at any size.
    All others are joined by a shuffle, or as ``rest`` joins (``meet``: by a
    shuffle always).
    """
    bounds = right.agg(F.sum(weight).alias("all"), F.max(weight).alias("most")).first()
    heavy = 1000 + (bounds["all"] or 0) / 100_000
    if (bounds["most"] or 0) <= heavy:
        return rest(left, right, keys, how)
    often = F.broadcast(right.where(F.col(weight) > heavy))
    others = rest(left.join(often.select(*keys), keys, "left_anti"), right.where(F.col(weight) <= heavy), keys, how)
    return left.join(often, keys).unionByName(others)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))

"""The store of dated signals: partitioned Parquet that a run replaces only where it has new rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What makes a signal the same one; axes may be null.
KEY = ["outlet", "type", "axis", "period_start", "period_end"]
SCHEMA = "outlet string, axis string, period_start date, value string, method string, type string, period_end date"


class SignalStore:
    """Signals (``KEY``, value, method) below ``path``, partitioned by type and period_end.

    A write replaces the stored rows of its keys and keeps all others: other
    outlets of the same type and period, and every other period. The touched
    partitions are first staged whole beside the store, then swapped in by a
    dynamic partition overwrite, so readers see old or new partitions and a
    failed write leaves the old ones. Runs of different periods don't touch
    each other's partitions. Of several rows of one key in a write one stays
    (the largest value).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def read(self) -> DataFrame:
        fs, target = self._fs(f"{self.path}/signals")
        if not fs.exists(target):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/signals")

    def write(self, rows: DataFrame, method: str) -> None:
        dated = rows.withColumns({"period_start": F.to_date("period_start"), "period_end": F.to_date("period_end"), "method": F.lit(method)})
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        new = f"{staged}/new"
        dated.groupBy(*KEY).agg(F.max_by("value", "value").alias("value"), F.first("method").alias("method")).write.parquet(new)
        run = self.spark.read.parquet(new)
        touched = run.select("type", "period_end").distinct()
        same = None
        stored, fresh = self.read().alias("stored"), run.select(*KEY).alias("fresh")
        for key in KEY:
            equal = F.col(f"stored.{key}").eqNullSafe(F.col(f"fresh.{key}"))
            same = equal if same is None else same & equal
        kept = stored.join(touched, ["type", "period_end"], "left_semi").alias("stored").join(fresh, same, "left_anti")
        kept.unionByName(run).write.parquet(f"{staged}/whole")
        whole = self.spark.read.parquet(f"{staged}/whole").repartition("type", "period_end")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type", "period_end").parquet(f"{self.path}/signals")
        fs, target = self._fs(staged)
        fs.delete(target, True)

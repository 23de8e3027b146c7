"""Structured Streaming forms: arrival dedup, windows, flash, sessions, interval joins.

Each function takes a streaming (or batch) DataFrame and returns one; sinks
and triggers belong to the caller. ``drain`` runs a query over what has
landed and stops, into a table on shared storage.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..session import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def landed(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of files (which only a pattern finds alike)."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet*")


def landed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of article arrivals."""
    raw = landed(spark, sf_dir, "events", EVENTS)
    return raw.select(F.col("event_id").alias("article_id"), F.col("user_id").alias("outlet_id"), F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("story"), F.col("ts").cast("timestamp").alias("published_at"), "event_type", "value")


CLOSING = "~closing"


class Closing:
    """A stream that is empty until ``land`` puts one article of another story and outlet into it, later than all others.

    Joined to a landed stream, it moves the watermark past every window that
    the landed rows left open, as the next day's arrivals would.
    """

    def __init__(self, landed: DataFrame, batch: DataFrame, hours: int = 24 * 7):
        self.spark, self.path = landed.sparkSession, shared_dir(landed.sparkSession, "closing")
        self.schema, self.batch, self.hours = landed.schema, batch, hours
        self.spark.createDataFrame([], landed.schema).write.parquet(self.path)
        self.stream = landed.unionByName(self.spark.readStream.schema(landed.schema).parquet(self.path))

    def land(self) -> None:
        latest = self.batch.agg(F.max("published_at").alias("published_at"))
        at = F.coalesce("published_at", F.timestamp_seconds(F.lit(0))) + F.make_dt_interval(hours=F.lit(self.hours))
        dull = {"string": F.lit(CLOSING), "array": F.array()}
        values = [at if f.name == "published_at" else dull.get(f.dataType.typeName(), F.lit(-1)).cast(f.dataType) for f in self.schema]
        latest.select(*(v.alias(f.name) for v, f in zip(values, self.schema))).write.mode("append").parquet(self.path)


@contextlib.contextmanager
def state_store(spark: SparkSession, provider: str) -> Iterator[None]:
    """The session's state store while streams are started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def run_landed(writer, path: str) -> None:
    """Start a stream's writer on the checkpoint below ``path``, process what has landed since its last run, and stop."""
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, mode: str = "append", then: tuple = ()) -> DataFrame:
    """Process all that has landed into a Parquet table with a checkpoint, and read that back.

    Each of ``then`` lands more; after each the stream restarts from its checkpoint.
    """
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession, "stream")
    for land in (None, *then):
        if land is not None:
            land()
        run_landed(stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out"), path)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def first_arrivals(articles: DataFrame, key: str, horizon: str = "72 hours") -> DataFrame:
    """Exactly-once arrival: one row for each key within the horizon."""
    return articles.withWatermark("published_at", horizon).dropDuplicatesWithinWatermark([key])


def canonical_arrivals(articles: DataFrame, horizon: str = "72 hours") -> DataFrame:
    return first_arrivals(articles.withColumn("canonical", tokens.canonical_url(F.col("url"))), "canonical", horizon)


def windowed_coverage(articles: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Articles by window and event type."""
    return articles.withWatermark("published_at", late).groupBy(F.window("published_at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def flash_candidates(articles: DataFrame, min_outlets: int = 5, width: str = "2 hours", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sliding windows in which ``min_outlets`` different outlets covered a story; sets are bounded by the outlets."""
    grouped = articles.withWatermark("published_at", late).groupBy(F.window("published_at", width, slide), "story").agg(F.size(F.collect_set("outlet_id")).cast("long").alias("outlets"))
    return grouped.where(F.col("outlets") >= min_outlets).select(F.col("window.start").alias("start"), "story", "outlets")


def activity_sessions(articles: DataFrame, key: str, gap: str = "72 hours", late: str = "10 minutes") -> DataFrame:
    """Bursts of activity that end after ``gap`` of silence."""
    return articles.withWatermark("published_at", late).groupBy(F.session_window("published_at", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def story_matches(articles: DataFrame, hours: int = 72, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(article_id, story, start, n): the articles' earlier activity of their story within ``hours``.

    A story's activity is reduced to one row for each ``width`` first, so an article meets a bounded number of rows
    (73 at most) however busy its story is. An hour counts if it began before the article and was still active
    ``hours`` before it.
    """
    a = articles.select("article_id", F.col("story").alias("of_story"), "published_at").withWatermark("published_at", late)
    hourly = articles.withWatermark("published_at", late).groupBy(F.window("published_at", width), "story")
    activity = hourly.agg(F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.count("*").alias("n"))
    activity = activity.select("story", F.window_time("window").alias("closed"), F.col("window.start").alias("start"), "first_at", "last_at", "n")
    kept = F.expr(f"of_story = story and published_at >= closed - interval {width} and published_at <= closed + interval {hours} hours")
    return a.join(activity, kept & F.expr(f"first_at < published_at and last_at >= published_at - interval {hours} hours")).select("article_id", "story", "start", "n")


def split_late(articles: DataFrame, horizon_start) -> tuple[DataFrame, DataFrame]:
    """Rows within the look-back, and older ones for the side batch that widens first_seen."""
    late = F.col("published_at") < horizon_start
    return articles.where(~late), articles.where(late)

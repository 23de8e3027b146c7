"""Stateful streams of stories: assignment with members, and a story table that late articles widen.

``StoryAssignment`` keeps each block's open stories in state (a map of
centroids, a list of members, event-time timers that close a story after its
window). ``StoryStore`` is a foreachBatch target whose table is a set of
mergeable partial results, one folder for each batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of an assignment stream: an article's story, or (without an article) a closed story with its size.
ASSIGNED = "block string, story long, article_id long, articles long, closed_at timestamp"


class StoryAssignment(StatefulProcessor):
    """Joins an article to the nearest open story of its block if centroid and one member are both at the threshold.

    Centroids are running means, renormalised at each step. A story is open to
    articles up to ``window_hours`` after its last one; once the watermark is
    beyond that, a timer removes its centroid and members and reports its size.
    Articles of a batch are taken in (time, id) order. A block's articles meet
    in one task, so blocks must be narrow enough for one (a language's desk).
    """

    def __init__(self, threshold: float, window_hours: float):
        self.threshold, self.window_hours = threshold, window_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stories = handle.getMapState("stories", "story long", "centroid array<double>, n long, last_at double")
        self.members = handle.getListState("members", "story long, vector array<double>")
        self.next = handle.getValueState("next", "story long")

    def _closes(self, last_at: float) -> int:
        """Milliseconds at which no article in time can join any more."""
        return int((last_at + self.window_hours * 3600) * 1000) + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        open_ = {k[0]: [np.array(v[0]), v[1], v[2]] for k, v in self.stories.iterator()}
        held: dict[int, list[np.ndarray]] = {}
        for story, vector in self.members.get():
            held.setdefault(story, []).append(np.array(vector))
        following = self.next.get()[0] if self.next.exists() else 0
        touched, added = set(), []
        for row in sorted(rows, key=lambda r: (r["published_at"], r["article_id"])):
            at = row["published_at"].timestamp()
            v = np.array(row["embedding"], np.float64)
            v /= max(float(np.linalg.norm(v)), 1e-12)
            best, story = -2.0, None
            for name, (centroid, _, last) in open_.items():
                if last >= at - self.window_hours * 3600 and (c := float(centroid @ v)) > best:
                    best, story = c, name
            if story is None or best < self.threshold or max(float(m @ v) for m in held[story]) < self.threshold:
                story, following = following, following + 1
                open_[story], held[story] = [v, 1, at], []
            else:
                centroid, n, last = open_[story]
                mean = (centroid * n + v) / (n + 1)
                open_[story] = [mean / max(float(np.linalg.norm(mean)), 1e-12), n + 1, max(last, at)]
            held[story].append(v)
            touched.add(story)
            added.append((story, v.tolist()))
            yield Row(block=key[0], story=story, article_id=row["article_id"], articles=None, closed_at=None)
        for story in touched:
            centroid, n, last = open_[story]
            self.stories.updateValue((story,), (centroid.tolist(), n, last))
            self.handle.registerTimer(self._closes(last))
        self.members.appendList(added)
        self.next.update((following,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = [(k[0], v[1], v[2]) for k, v in self.stories.iterator() if self._closes(v[2]) <= now]
        if not over:  # the story that set this timer has had another article since
            return
        gone = {story for story, _, _ in over}
        left = [tuple(m) for m in self.members.get() if m[0] not in gone]
        self.members.clear()
        if left:
            self.members.put(left)
        for story, n, last in over:
            self.stories.removeKey((story,))
            yield Row(block=key[0], story=story, article_id=None, articles=n, closed_at=dt.datetime.fromtimestamp(last))


def assigned(articles: DataFrame, threshold: float = 0.18, window_hours: float = 72, late: str = "1 hour") -> DataFrame:
    """Stream of ``ASSIGNED`` rows from a stream of (block, article_id, published_at, embedding).

    Needs the RocksDB state store (``with_state_store``).
    """
    rows = articles.select("block", "article_id", "published_at", "embedding").withWatermark("published_at", late)
    return rows.groupBy("block").transformWithState(StoryAssignment(threshold, window_hours), ASSIGNED, "Append", "EventTime")


class StoryStore:
    """A story table on shared storage, fed batch by batch from ``foreachBatch``.

    A batch is reduced to (story, outlet_id, late) with count, first and last
    time, which can be merged in any order, and written to a folder of its own
    number; a replayed batch overwrites itself. Articles older than
    ``look_back_hours`` before the latest of the earlier batches are late: they
    are counted as such and widen first_seen, counts and the flash verdict like
    any other. ``compact`` merges the folders up to a batch into one base,
    after which replays of those batches change nothing.
    """

    def __init__(self, spark: SparkSession, path: str, look_back_hours: float = 72):
        self.spark, self.path, self.look_back_hours = spark, path.rstrip("/"), look_back_hours

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the complete folders below ``kind``."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n) for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _parts(self, before: int | None = None) -> DataFrame | None:
        base = max((b for b in self._numbers("base") if before is None or b < before), default=-1)
        paths = [f"{self.path}/base/{base}"] if base >= 0 else []
        paths += [f"{self.path}/batch/{n}" for n in self._numbers("batch") if n > base and (before is None or n < before)]
        return self.spark.read.parquet(*paths) if paths else None

    @staticmethod
    def _merged(parts: DataFrame) -> DataFrame:
        return parts.groupBy("story", "outlet_id", "late").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """The foreachBatch function: takes (story, outlet_id, published_at)."""
        if batch_id <= max(self._numbers("base"), default=-1):
            return
        earlier = self._parts(batch_id)
        latest = None if earlier is None else earlier.agg(F.max("last_at")).first()[0]
        late = F.lit(False) if latest is None else F.col("published_at") < F.lit(latest) - F.make_dt_interval(hours=F.lit(self.look_back_hours))
        rows = batch.select("story", "outlet_id", late.alias("late"), F.lit(1).cast("long").alias("n"), F.col("published_at").alias("first_at"), F.col("published_at").alias("last_at"))
        self._merged(rows).write.mode("overwrite").parquet(f"{self.path}/batch/{batch_id}")

    def compact(self) -> None:
        done = self._numbers("batch")
        if done:
            self._merged(self._parts()).write.mode("overwrite").parquet(f"{self.path}/base/{done[-1]}")

    def stories(self, min_outlets: int = 5, flash_hours: float = 2) -> DataFrame:
        """(story, articles, outlets, late, first_seen, last_seen, is_flash) of everything merged so far."""
        outlets = self._parts().groupBy("story", "outlet_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("late"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
        place = F.row_number().over(Window.partitionBy("story").orderBy("first_at", "outlet_id"))
        nth = F.min(F.when(F.col("place") == min_outlets, F.col("first_at")))
        found = outlets.withColumn("place", place).groupBy("story").agg(F.sum("n").alias("articles"), F.count("*").alias("outlets"), F.sum("late").alias("late"), F.min("first_at").alias("first_seen"), F.max("last_at").alias("last_seen"), nth.alias("nth"))
        quick = F.unix_micros("nth") - F.unix_micros("first_seen") <= int(flash_hours * 3.6e9)
        return found.withColumn("is_flash", F.coalesce(quick, F.lit(False))).drop("nth")

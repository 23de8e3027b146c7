"""Incremental story assignment of a whole article table, slice by slice of time.

The rule is sequential: in order of time an article joins the open story with
the nearest centroid, if that cosine and the one to some member reach the
threshold, else it opens a story. What costs is comparing articles with all
open stories and their members; that is spread over the cluster, and only the
decisions of one slice of at most about ``slice_rows`` articles are taken in
one task. Between slices open stories and members live in written tables.

For each article of a slice block products against all open stories give the
``listed`` nearest ones, and block products against the members of these give
the best member. Up to ``HELD`` open stories go into the task whole, which
then keeps all their centroids exact; of more it keeps those that its own
articles have changed. An unlisted story is no nearer than the last listed
one, so a decision is exact unless every listed story has changed and none of
the changed ones is as near as that; there (or where the older members of the
story at hand were not compared and none of its new ones reaches the
threshold) the task stops, and the next slice begins with that article and is
at most twice as long as what was decided. The first article of a slice is
always decided. Random hyperplanes instead of block products don't help at
the default threshold: at a cosine of 0.18 a hyperplane separates two vectors
with probability 0.44, at 0 with 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir, small_batches
from .vectors import BLOCK_ROWS

#: Articles of a slice, and open stories up to which the task that decides a slice holds them all.
SLICE_ROWS, HELD = 16_000, 2000
_CANDIDATES = "array<struct<story long, cosine double, member double>>"
#: Written member tables that are read side by side before they are merged.
_TABLES = 16


def _unit(vectors) -> np.ndarray:
    m = np.array(list(vectors), np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _meet(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """A join by shuffle: a broadcast in each of many slices would bring their tables to the driver one after the other."""
    return left.join(right.hint("merge"), keys, how)


def _nearest(articles: DataFrame, stories: DataFrame, n_stories: int, listed: int, window_hours: float, n_articles: int = BLOCK_ROWS) -> DataFrame:
    """(article_id, rank, story, cosine): each article's ``listed`` nearest open stories, by blocks of stories."""
    blocks = stories.withColumn("block", F.pmod(F.xxhash64("story"), F.lit(-(-n_stories // BLOCK_ROWS)))).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("story", "centroid", "last"))).alias("stories"))
    asked = articles.withColumn("part", F.pmod(F.xxhash64("article_id"), F.lit(max(8, -(-n_articles // BLOCK_ROWS))))).groupBy("part").agg(F.collect_list(F.struct("article_id", "t", "embedding")).alias("articles"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ones, others in zip(batch.column("articles"), batch.column("stories")):
                (ids, t, vectors), (names, centroids, last) = ones.values.flatten(), others.values.flatten()
                names = names.to_numpy()
                cos = _unit(_matrix(vectors)) @ _matrix(centroids).T
                cos[last.to_numpy()[None, :] < t.to_numpy()[:, None] - window_hours] = -3.0
                best = np.argsort(-cos, axis=1, kind="stable")[:, :listed]
                cos = np.take_along_axis(cos, best, axis=1)
                live = cos > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.to_numpy(), live.sum(axis=1))), pa.array(names[best][live]), pa.array(cos[live])], names=["article_id", "story", "cosine"])

    near = asked.hint("shuffle_replicate_nl").crossJoin(blocks).mapInArrow(product, "article_id long, story long, cosine double")
    order = Window.partitionBy("article_id").orderBy(F.desc("cosine"), "story")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed)


def _best_member(near: DataFrame, articles: DataFrame, members: DataFrame) -> DataFrame:
    """(article_id, story, member): the nearest member's cosine, by blocks of a story's members."""
    asked = _meet(near, articles.select("article_id", "embedding"), "article_id").groupBy("story").agg(F.collect_list(F.struct("article_id", "embedding")).alias("articles"))
    # Members of the asked stories only; a large story's are dealt over blocks of bounded size.
    sizes = _meet(members, near.select("story").distinct(), "story", "left_semi").groupBy("story").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    held = _meet(members, sizes, "story").groupBy("story", F.pmod(F.xxhash64("article_id"), F.col("blocks")).alias("block")).agg(F.collect_list("vector").alias("members"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for story, ones, others in zip(batch.column("story").to_pylist(), batch.column("articles"), batch.column("members")):
                ids, vectors = ones.values.flatten()
                cos = (_unit(_matrix(vectors)) @ _matrix(others.values).T).max(axis=1)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.full(len(ids), story)), pa.array(cos)], names=["article_id", "story", "member"])

    found = _meet(asked, held, "story").mapInArrow(product, "article_id long, story long, member double")
    return found.groupBy("article_id", "story").agg(F.max("member").alias("member"))


def _decide(rows: pd.DataFrame, stories: pd.DataFrame, following: int, threshold: float, window_hours: float, listed: int, whole: bool) -> pd.DataFrame:
    """The decisions of a slice in order, as far as they are exact, and the stories they changed.

    ``stories`` are those that its articles list or, if ``whole``, all open ones.
    """
    rows, stories = rows.sort_values(["t", "article_id"]), stories.sort_values("story")
    start = {story: (np.array(c), n, last) for story, c, n, last in zip(stories["story"], stories["centroid"], stories["n"], stories["last"])}
    n, dims = len(rows) + len(start), len(rows["embedding"].iat[0])
    slots: dict[int, int] = {}  # stories that are kept exact, by row of the arrays below
    names: list[int] = []
    centroids, last, sizes = np.zeros((n, dims)), np.zeros(n), np.zeros(n, np.int64)
    added: list[list[np.ndarray]] = []

    def keep(story: int, centroid: np.ndarray, size: int, seen: float) -> None:
        i = slots[story] = len(names)
        names.append(story)
        added.append([])
        centroids[i], sizes[i], last[i] = centroid, size, seen

    if whole:
        for story, values in start.items():
            keep(story, *values)
    fresh_from, out = following, []
    for article, t, vector, found in zip(rows["article_id"], rows["t"], _unit(rows["embedding"]), rows["candidates"]):
        found = [] if found is None else list(found)
        untouched = next((c for c in found if c["story"] not in slots), None)
        story, best = (untouched["story"], untouched["cosine"]) if untouched else (None, -2.0)
        k = len(names)
        if k:
            cos = np.where(last[:k] >= t - window_hours, centroids[:k] @ vector, -2.0)
            at = int(cos.argmax())
            if cos[at] > best:
                story, best = names[at], float(cos[at])
        unlisted = found[-1]["cosine"] if not whole and not untouched and len(found) == listed else -2.0
        if unlisted >= threshold and unlisted > best:
            break
        if story is not None and best >= threshold:
            older = next((c["member"] for c in found if c["story"] == story), None)
            if (older is None or older < threshold) and not any(float(m @ vector) >= threshold for m in (added[slots[story]] if story in slots else ())):
                if older is None and story < fresh_from:
                    break
                story = None
        else:
            story = None
        if story is None:
            story, following = following, following + 1
            keep(story, vector, 0, t)
        elif story not in slots:
            keep(story, *start[story])
        i = slots[story]
        mean = (centroids[i] * sizes[i] + vector) / (sizes[i] + 1)
        centroids[i], sizes[i], last[i] = mean / max(float(np.linalg.norm(mean)), 1e-12), sizes[i] + 1, max(last[i], t)
        added[i].append(vector)
        out.append((article, story, vector, 0, t))
    out += [(None, story, centroids[i], int(sizes[i]), float(last[i])) for story, i in slots.items() if added[i]]
    return pd.DataFrame(out, columns=["article_id", "story", "vector", "n", "last"]).astype({"article_id": "Int64"})


def _decider(*settings):
    return lambda rows, stories: _decide(rows, stories, *settings)


def assign_stories(articles: DataFrame, threshold: float = 0.18, window_hours: float = 72, slice_rows: int = SLICE_ROWS, listed: int = 8) -> DataFrame:
    """(article_id, story) for (article_id, t in hours, embedding); stories are numbered in the order they open."""
    spark, path = articles.sparkSession, shared_dir(articles.sparkSession, "stories")
    small_batches(spark)

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    timed = articles.select("article_id", F.col("t").cast("double").alias("t"), F.col("embedding").cast("array<double>").alias("embedding")).where("t is not null")
    articles = written(timed.sort("t"), "articles")
    hours = articles.groupBy(F.floor("t").alias("hour")).count().orderBy("hour").collect()  # one row for each hour of the table
    ends = np.cumsum([count for _, count in hours])
    done, members = [], []
    stories = spark.createDataFrame([], "story long, centroid array<double>, n long, last double")
    following, decided, take, turn, rest = 0, 0, slice_rows, 0, articles
    while len(ends) and decided < ends[-1]:
        # Whole hours, one at least, to about ``take`` articles.
        upto = max(int(np.searchsorted(ends, decided + take, "right")) - 1, int(np.searchsorted(ends, decided, "right")))
        asked, n_asked = rest.where(F.col("t") < hours[upto]["hour"] + 1), int(ends[upto]) - decided
        n_stories = stories.count()
        held = stories
        if n_stories:
            near = written(_nearest(asked, stories, n_stories, listed, window_hours, n_asked), f"near-{turn}")
            best = _best_member(near, asked, members[0] if len(members) == 1 else _union(members))
            found = _meet(near, best, ["article_id", "story"]).groupBy("article_id").agg(F.expr("transform(array_sort(collect_list(struct(rank, struct(story, cosine, member) AS c))), x -> x.c)").cast(_CANDIDATES).alias("candidates"))
            asked = _meet(asked, found, "article_id", "left")
            if n_stories > HELD:
                held = _meet(stories, near.select("story").distinct(), "story", "left_semi")
        else:
            asked = asked.withColumn("candidates", F.lit(None).cast(_CANDIDATES))

        decide = _decider(following, threshold, window_hours, listed, n_stories <= HELD)
        one = F.lit(0).alias("slice")
        out = written(asked.groupBy(one).cogroup(held.groupBy(one)).applyInPandas(decide, "article_id long, story long, vector array<double>, n long, last double"), f"out-{turn}")
        new = out.where("article_id is not null")
        end, newest, n_new = new.agg(F.max(F.struct("last", "article_id")), F.max("story"), F.count("*")).first()
        done.append(new.select("article_id", "story"))
        following = max(following, newest + 1)
        changed = out.where("article_id is null").select("story", F.col("vector").alias("centroid"), "n", "last")
        kept = _meet(stories, changed, "story", "left_anti").unionByName(changed)
        stories = written(kept.where(F.col("last") >= end[0] - window_hours), f"open-{turn}")
        members.append(new.select("story", "article_id", "vector"))
        if len(members) > _TABLES:
            members = [written(_meet(_union(members), stories, "story", "left_semi"), f"members-{turn}")]
        rest = articles.where((F.col("t") >= end[0]) & ((F.col("t") > end[0]) | (F.col("article_id") > end[1])))
        take = min(slice_rows, 2 * (take if n_new == n_asked else n_new))
        decided, turn = decided + n_new, turn + 1
    return _union(done) if done else articles.select("article_id", F.lit(0).cast("long").alias("story")).limit(0)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out

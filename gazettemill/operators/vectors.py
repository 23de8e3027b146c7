"""Hashed embeddings, neighbours, centroids, threshold sweeps and story clustering."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..session import small_batches

DIMENSIONS = 768
#: Stop words that a task takes.
MOST_STOPS = 200_000
BLOCK_ROWS = 2000


def hashed_features(articles: DataFrame, stops: DataFrame, text: str = "title") -> DataFrame:
    """(article_id, idx, weight): signed feature hashing of content words and their character 4- and 5-grams, L2-normalised.

    A text's features are counted inside its row: a task holds one batch of texts, and nothing is shuffled.
    """
    small_batches(articles.sparkSession)
    words = {r["word"] for r in stops.select("word").distinct().limit(MOST_STOPS + 1).collect()}
    if len(words) > MOST_STOPS:
        raise ValueError(f"a dictionary of over {MOST_STOPS} stop words doesn't fit a task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for article, joined in zip(pdf["article_id"], pdf["joined"]):
                held, sums = _hashed(joined)
                at = np.flatnonzero(held)
                norm = np.sqrt((sums * sums).sum())
                if norm > 0:
                    out.append((article, at, sums[at] / norm))
            if out:
                ids, at, weights = zip(*out)
                yield pd.DataFrame({"article_id": np.repeat(ids, [len(a) for a in at]), "idx": np.concatenate(at), "weight": np.concatenate(weights)})

    kept = F.array_join(F.filter(T.words(F.col(text)), lambda w: ~w.isin(sorted(words))) if words else T.words(F.col(text)), " ")
    kind = dict(articles.dtypes)["article_id"]
    joined = articles.select("article_id", kept.alias("joined")).where("article_id is not null and joined <> ''")
    return joined.mapInPandas(run, f"article_id {kind}, idx long, weight double")


def _hashed(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each dimension and their signed weights, for a text of space-joined words."""
    grams = (f"c:{joined[i : i + n]}" for n in (4, 5) for i in range(len(joined) - n + 1))
    tf = Counter(itertools.chain((f"w:{w}" for w in joined.split(" ")), grams))
    digests = b"".join(hashlib.md5(f.encode("utf-8", "replace")).digest()[:8] for f in tf)
    halves = np.frombuffer(digests, ">u4").reshape(-1, 2).astype(np.int64)
    weights = (1 + np.log(np.array(list(tf.values()), np.float64))) * np.where(halves[:, 1] % 2 == 0, 1.0, -1.0)
    idx = halves[:, 0] % DIMENSIONS
    return np.bincount(idx, minlength=DIMENSIONS), np.bincount(idx, weights, DIMENSIONS)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, vec_id, cosine): exact top k of a stated query set against all rows, in blocks.

    Queries and rows are gathered in blocks of about ``BLOCK_ROWS``; each pair
    of blocks is one matrix product that keeps k of each query, and the k best
    of all remain.
    """
    n_blocks, n_slices = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (queries, vectors))
    blocks = queries.select("vec_id", "embedding").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).groupBy("block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    rows = vectors.select("vec_id", "embedding").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(n_slices)))
    data = rows.groupBy("slice").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        for pdf in batches:
            for qs, rs in zip(pdf["queries"], pdf["rows"]):
                q, r = (unit(np.array([x["embedding"] for x in xs], np.float64)) for xs in (qs, rs))
                ids, cos = np.array([x["vec_id"] for x in rs]), q @ r.T
                out = []
                for i, x in enumerate(qs):
                    c = np.where(ids == x["vec_id"], -2.0, cos[i])
                    best = np.lexsort((ids, -np.round(c, 9)))[:k]
                    out += [(x["vec_id"], int(ids[b]), float(c[b])) for b in best if c[b] > -2]
                yield pd.DataFrame(out, columns=["query", "vec_id", "cosine"])

    near = data.crossJoin(blocks).mapInPandas(multiply, "query long, vec_id long, cosine double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "vec_id")).cast("long"))
    return ranked.where(F.col("rank") <= k)


def centroids(vectors: DataFrame, group: str = "label") -> DataFrame:
    """(group, pos, value): normalised element-wise mean."""
    means = vectors.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group)))
    return means.withColumn("norm", norm).select(group, F.col("pos").cast("long").alias("pos"), F.when(F.col("norm") == 0, 0.0).otherwise(F.col("m") / F.col("norm")).alias("value"))


def nearest_to_centroid(vectors: DataFrame, group: str = "label", preferred: str | None = None) -> DataFrame:
    """The member that titles the group: one with ``preferred`` (has a snippet) if there is any, then the closest to the centroid."""
    mean = centroids(vectors, group).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("centroid"))
    first = F.lit(True) if preferred is None else F.coalesce(F.col(preferred), F.lit(False))
    scored = vectors.join(mean, group).withColumns({"first": first, "cos": F.round(T.cosine(F.col("embedding"), F.col("centroid")), 6)})
    return scored.groupBy(group).agg(F.max_by(F.struct("vec_id", "cos"), F.struct("first", "cos", (-F.col("vec_id")).alias("back"))).alias("x")).select(group, "x.vec_id", "x.cos")


def sweep(pairs: DataFrame, similarity: str = "cosine", same: str = "same") -> DataFrame:
    """Precision, recall and F1 at thresholds 0.05 to 0.95; precision is 1 where nothing is predicted."""
    grid = pairs.sparkSession.range(1, 20).select((F.col("id") * 5 / 100).alias("threshold"))
    hit = F.col(similarity) >= F.col("threshold")
    sums = pairs.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.count_if(hit & F.col(same)).alias("tp"), F.count_if(hit & ~F.col(same)).alias("fp"), F.count_if(~hit & F.col(same)).alias("fn"))  # 19 rows
    return _rated(sums)


def sweep_all(vectors: DataFrame) -> DataFrame:
    """The sweep over every pair of different rows, in blocks of about ``BLOCK_ROWS``.

    Two blocks meet once, in one matrix product that gives at most 40 counts: how many
    of its pairs, of equal and of other labels, lie at each step of the thresholds.
    """
    n_slices = max(1, -(-vectors.count() // BLOCK_ROWS))
    rows = vectors.select("vec_id", "embedding", "label").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(n_slices)))
    blocks = rows.groupBy("slice").agg(F.collect_list(F.struct("vec_id", "embedding", "label")).alias("rows"))
    lower = blocks.select("rows", F.explode(F.sequence(F.col("slice"), F.lit(n_slices - 1).cast("long"))).alias("slice"), F.col("slice").alias("from_slice"))
    met = lower.join(blocks.withColumnRenamed("rows", "others"), "slice").select((F.col("slice") == F.col("from_slice")).alias("own"), "rows", "others")
    steps = np.arange(1, 20) * 5 / 100

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts(xs):
            m = np.array([x["embedding"] for x in xs], np.float64)
            return np.array([x["vec_id"] for x in xs]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12), np.array([x["label"] for x in xs])

        for pdf in batches:
            for own, one, other in zip(pdf["own"], pdf["rows"], pdf["others"]):
                (i, a, la), (j, b, lb) = parts(one), parts(other)
                counted = i[:, None] < j[None, :] if own else np.ones((len(i), len(j)), bool)
                step = np.searchsorted(steps, (a @ b.T)[counted], side="right")
                same = (la[:, None] == lb[None, :])[counted]
                tally = np.array([np.bincount(step[same == s], minlength=20) for s in (False, True)])
                yield pd.DataFrame([(k, s == 1, int(tally[s, k])) for s in (0, 1) for k in range(20)], columns=["step", "same", "n"])

    tally = met.mapInPandas(count, "step long, same boolean, n long").groupBy("step", "same").agg(F.sum("n").alias("n"))
    grid = vectors.sparkSession.range(1, 20).select("id", (F.col("id") * 5 / 100).alias("threshold"))
    hit, same = F.col("step") >= F.col("id"), F.col("same")
    total = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias
    sums = grid.join(F.broadcast(tally), F.lit(True), "left").groupBy("threshold").agg(total(hit & same)("tp"), total(hit & ~same)("fp"), total(~hit & same)("fn"))  # 40 rows
    return _rated(sums)


def _rated(sums: DataFrame) -> DataFrame:
    precision = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    rated = sums.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return rated.select("threshold", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def fold_stories(rows: list[tuple], threshold: float, window_hours: float = 72) -> list[int]:
    """Story number of each (time in hours, unit vector) in order: the nearest active story whose centroid and one
    member are both at the threshold, else a new one. Centroids are running means, renormalised at each step."""
    stories: list[dict] = []
    out = []
    for t, v in rows:
        best, at = -2.0, -1
        for i, s in enumerate(stories):
            if s["last"] >= t - window_hours and (c := float(s["centroid"] @ v)) > best:
                best, at = c, i
        if at >= 0 and best >= threshold and max(float(m @ v) for m in stories[at]["members"]) >= threshold:
            s = stories[at]
            mean = (s["centroid"] * len(s["members"]) + v) / (len(s["members"]) + 1)
            s["centroid"] = mean / max(float(np.linalg.norm(mean)), 1e-12)
            s["members"].append(v)
            s["last"] = max(s["last"], t)
        else:
            stories.append({"centroid": v, "members": [v], "last": t})
            at = len(stories) - 1
        out.append(at)
    return out

"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _minimum(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``: combined in the map tasks, so a hub costs no single task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minimum(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the component's smallest node.

    Each round is written to the shared folder; rounds end when the links no
    longer change (their count and hash sum), a logarithmic number of times.
    """
    links = common.cut(links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        links = common.cut(_small_star(_large_star(links)), "links")

"""Dated outlet signals: agenda, co-coverage map, blind spots."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from . import spectral


def topic_shares(articles: DataFrame) -> DataFrame:
    """(outlet_id, topic, n, share) over articles with a topic."""
    counts = articles.where("topic is not null").groupBy("outlet_id", "topic").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("outlet_id")))


def agenda(articles: DataFrame, min_articles: int = 10) -> DataFrame:
    """Deviation of each outlet's topic share from the unweighted mean of eligible outlets; an absent topic is 0."""
    shares = topic_shares(articles)
    eligible = shares.groupBy("outlet_id").agg(F.sum("n").alias("total")).where(F.col("total") >= min_articles).select("outlet_id")
    shares = shares.join(eligible, "outlet_id")
    # Outlets x topics of the outlets at hand: dimensions, not articles.
    grid = eligible.crossJoin(shares.select("topic").distinct()).join(shares, ["outlet_id", "topic"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    mean = F.avg("share").over(Window.partitionBy("topic"))
    return grid.select("outlet_id", "topic", "share", (F.col("share") - mean).alias("deviation"), F.count("*").over(Window.partitionBy("topic")).alias("outlets")).where("outlets >= 2").drop("outlets")


def agenda_interval(articles: DataFrame, resamples: int = 200, min_articles: int = 10) -> DataFrame:
    """Bootstrap 95 % interval of the deviation: topic counts of a resample are multinomial, drawn per outlet."""
    points = agenda(articles, min_articles).join(topic_shares(articles).groupBy("outlet_id").agg(F.sum("n").alias("total")), "outlet_id")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("topic")
        rng = np.random.default_rng([42, int(pdf["outlet_id"].iat[0])])
        n, p = int(pdf["total"].iat[0]), pdf["share"].to_numpy()
        shares = rng.multinomial(n, p / p.sum(), resamples) / n
        shift = pdf["deviation"].to_numpy() - pdf["share"].to_numpy()
        low, high = np.percentile(shares, [2.5, 97.5], axis=0) + shift
        return pdf.assign(low=low, high=high)[["outlet_id", "topic", "deviation", "low", "high"]]

    return points.groupBy("outlet_id").applyInPandas(draw, "outlet_id long, topic string, deviation double, low double, high double")


def _written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` in the shared folder, for what is read several times."""
    path = shared_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cocoverage_pairs(articles: DataFrame, min_outlets: int = 2, min_stories: int = 3) -> DataFrame:
    """Distinct (outlet_id, story_id) of stories that enough outlets covered and outlets with enough such stories.

    Read three times, the distinct pairs are written first, a story's together.
    """
    pairs = _written(articles.select("outlet_id", "story_id").repartition("story_id").distinct(), "covering")
    shared = pairs.groupBy("story_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_outlets).select("story_id")
    pairs = pairs.join(shared, "story_id")
    active = pairs.groupBy("outlet_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_stories).select("outlet_id")
    return pairs.join(active, "outlet_id")


def cocoverage_gram(pairs: DataFrame) -> DataFrame:
    """(i, j, k, centred): row-normalised Gram matrix of outlets and its double-centred form.

    Stories meet by equi-join on the story; a story's outlets are bounded by the number of outlets.
    """
    size = pairs.groupBy("outlet_id").agg(F.count("*").alias("size"))
    left = pairs.join(size, "outlet_id").select("story_id", F.col("outlet_id").alias("i"), F.col("size").alias("si"))
    right = left.select("story_id", F.col("i").alias("j"), F.col("si").alias("sj"))
    both = left.join(right, "story_id").groupBy("i", "j", "si", "sj").agg(F.count("*").alias("n"))
    known = both.select("i", "j", (F.col("n") / F.sqrt(F.col("si") * F.col("sj").cast("double"))).alias("k"))
    ids = size.select("outlet_id")
    grid = ids.select(F.col("outlet_id").alias("i")).crossJoin(ids.select(F.col("outlet_id").alias("j")))
    full = grid.join(known, ["i", "j"], "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    centred = F.col("k") - F.avg("k").over(Window.partitionBy("i")) - F.avg("k").over(Window.partitionBy("j")) + F.avg("k").over(Window.partitionBy())
    return full.withColumn("centred", centred)


def cocoverage_map(articles: DataFrame) -> DataFrame:
    """(outlet_id, x, y, variance_x, variance_y): two leading principal coordinates; none for fewer than three outlets."""
    return _map_of(_written(cocoverage_pairs(articles).select("outlet_id", "story_id"), "pairs"))


def _map_of(pairs: DataFrame) -> DataFrame:
    schema = "outlet_id long, x double, y double, variance_x double, variance_y double"
    if pairs.select("outlet_id").distinct().limit(3).count() < 3:
        return pairs.sparkSession.createDataFrame([], schema)
    placed, shares = spectral.principal_coordinates(pairs)
    at = lambda i: F.round(F.coalesce(F.get("coordinates", i), F.lit(0.0)), 4) + 0.0
    share = lambda i: F.lit(round(shares[i], 3) if len(shares) > i else 0.0)
    return placed.select("outlet_id", at(0).alias("x"), at(1).alias("y"), share(0).alias("variance_x"), share(1).alias("variance_y"))


def map_loadings(articles: DataFrame, top: int = 10) -> DataFrame:
    """(axis, story_id, loading): the stories that pull each axis up and down most."""
    pairs = _written(cocoverage_pairs(articles).select("outlet_id", "story_id"), "pairs")
    positions = _map_of(pairs)
    weights = pairs.groupBy("outlet_id").agg((1 / F.sqrt(F.count("*"))).alias("w")).join(positions.select("outlet_id", "x", "y"), "outlet_id")
    norm = positions.agg(*(f.alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("s", F.sqrt(F.sum(F.col(c) * F.col(c)))), ("total", F.sum(c)))), F.count("*").alias("outlets"))  # one row
    parts = pairs.join(weights, "outlet_id").groupBy("story_id").agg(F.sum("w").alias("mass"), *(F.sum(F.col(c) * F.col("w")).alias(c) for c in ("x", "y")))
    load = lambda c: F.round((F.col(c) - F.col("mass") * F.col(f"total_{c}") / F.col("outlets")) / (F.col(f"s_{c}") * F.col(f"s_{c}")), 6)
    loads = _written(parts.crossJoin(F.broadcast(norm)).select("story_id", F.posexplode(F.array(load("x"), load("y"))).alias("axis", "loading")).where("abs(loading) > 1e-6"), "loads")
    ends = []
    for order in (F.desc("loading"), F.asc("loading")):  # a filter on one rank each, so that only the first ones of a partition are shuffled
        place = F.row_number().over(Window.partitionBy("axis").orderBy(order, "story_id"))
        ends.append(loads.withColumn("place", place).where(F.col("place") <= top).select("axis", "story_id", "loading"))
    return ends[0].union(ends[1]).distinct()


def outlet_blind_spots(articles: DataFrame, share: float = 0.5, min_active: int = 3) -> DataFrame:
    """Stories that enough other active outlets of the country covered but this outlet didn't."""
    pairs = articles.select("outlet_id", "country", "story_id").distinct()
    active = pairs.select("outlet_id", "country").distinct()
    peers = active.groupBy("country").agg(F.count("*").alias("active")).where(F.col("active") >= min_active)
    covered = pairs.groupBy("country", "story_id").agg(F.count("*").alias("covering"))
    bar = F.greatest(F.lit(2.0), F.bround(F.lit(share) * (F.col("active") - 1)))
    wide = covered.join(peers, "country").where(F.col("covering") >= bar)
    return wide.join(active, "country").join(pairs.select("outlet_id", "story_id"), ["outlet_id", "story_id"], "left_anti").select("outlet_id", "story_id", "covering", (F.col("active") - 1).alias("peers"))


def outlet_blind_spot_summary(articles: DataFrame, keep: int = 50) -> DataFrame:
    """Per outlet: number of blind spots, peers and the last ``keep`` story ids."""
    spots = outlet_blind_spots(articles)
    newest = Window.partitionBy("outlet_id").orderBy(F.desc("story_id"))
    ranked = spots.withColumn("rn", F.row_number().over(newest))
    return ranked.groupBy("outlet_id").agg(
        F.count("*").alias("n"), F.max("peers").alias("peers"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= keep, F.col("story_id")))), ",").alias("stories"),
    )


def signal_rows(kind: str, rows: DataFrame, outlet: str, value: Column, axis: Column | None = None) -> DataFrame:
    """One family of signals in long form: (outlet, type, axis, value), values as JSON."""
    none = F.lit(None).cast("string")
    return rows.select(F.col(outlet).cast("string").alias("outlet"), F.lit(kind).alias("type"), (none if axis is None else axis.cast("string")).alias("axis"), F.to_json(value).alias("value"))


def signal_run(families: list[DataFrame], period_start: Column, period_end: Column) -> DataFrame:
    """All families of one window, dated: (outlet, type, axis, period_start, period_end, value), the key of a replacing write but for the value."""
    rows = functools.reduce(DataFrame.unionByName, families)
    return rows.select("outlet", "type", "axis", period_start.alias("period_start"), period_end.alias("period_end"), "value")


def signal_views(rows: DataFrame) -> DataFrame:
    """(outlet, view, axis, place, item, value): what a page shows of each outlet's latest signals, from stored ones (``signal_run``).

    Of each type the latest period counts, of annotation the latest of each axis. Agenda: the three topics most over
    and most under the mean, in points. Tone: percent of each. Framing: the four largest groups. Speakers: the five
    most cited. Blind spots, map and annotation: their numbers as they are.
    """
    own = F.when(F.col("type") == "annotation", F.col("axis"))
    latest = rows.withColumn("axis", own).groupBy("outlet", "type", "axis").agg(F.max_by("value", F.struct("period_end", "period_start")).alias("value"))
    items = latest.select("outlet", "type", "axis", F.explode(F.from_json("value", "map<string,string>")).alias("item", "text"))
    number = F.when(F.col("text") == "true", 1.0).when(F.col("text") == "false", 0.0).otherwise(F.col("text").try_cast("double"))
    items = items.withColumn("value", number).where("value is not null").drop("text")
    of = Window.partitionBy("outlet", "type")
    grouped = items.where("type = 'framing'").withColumn("item", F.split_part("item", F.lit("/"), F.lit(1))).groupBy("outlet", "type", "axis", "item").agg(F.sum("value").alias("value"))
    ranked = items.where("type <> 'framing'").unionByName(grouped).withColumns({
        "place": F.row_number().over(of.orderBy(F.desc("value"), "item")), "last": F.row_number().over(of.orderBy("value", F.desc("item"))), "all": F.sum("value").over(of),
    })
    agenda = F.col("type") == "agenda"
    over, under = agenda & (F.col("place") <= 3), agenda & (F.col("last") <= 3)
    points = F.round(F.col("value") * 100, 1)
    show = lambda keep, view, place, value: ranked.where(keep).select("outlet", view.alias("view"), "axis", place.cast("long").alias("place"), "item", value.alias("value"))
    plain = F.col("type").isin("blindspot", "cocoverage", "annotation")
    parts = [
        show(over, F.lit("agenda over"), F.col("place"), points), show(under, F.lit("agenda under"), F.col("last"), points),
        show(F.col("type") == "tone", F.lit("tone"), F.col("place"), F.round(F.col("value") * 100 / F.when(F.col("all") == 0, 1).otherwise(F.col("all")))),
        show((F.col("type") == "framing") & (F.col("place") <= 4), F.lit("framing"), F.col("place"), F.col("value")),
        show((F.col("type") == "actors") & (F.col("place") <= 5), F.lit("actors"), F.col("place"), F.col("value")), show(plain, F.col("type"), F.lit(None), F.col("value")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def _big_pairs(articles: DataFrame, min_outlets: int) -> DataFrame:
    pairs = articles.select("outlet_id", "country", "story_id").distinct()
    big = pairs.groupBy("story_id").agg(F.count("*").alias("covering_sources"), F.countDistinct("country").alias("covering_countries")).where(F.col("covering_sources") >= min_outlets)
    return pairs.join(big, "story_id")


def propensity(articles: DataFrame, min_outlets: int = 5, min_stories: int = 10) -> DataFrame:
    """(outlet_id, country, p): share of big stories that the outlet covered."""
    big = _big_pairs(articles, min_outlets)
    total = big.agg(F.countDistinct("story_id").alias("total")).where(F.col("total") >= min_stories)
    active = articles.select("outlet_id", "country").distinct()
    held = big.groupBy("outlet_id").agg(F.count("*").alias("n"))
    return active.join(held, "outlet_id", "left").crossJoin(F.broadcast(total)).select("outlet_id", "country", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p"))  # one row is broadcast


def country_blind_spots(articles: DataFrame, as_of=None, maturity_hours: int = 6, max_p: float = 0.05, min_countries: int = 3, min_active: int = 3, top: int = 3) -> DataFrame:
    """Big mature stories a whole country missed although its outlets' habits make that unlikely.

    p_null is the product of (1 - propensity) over the country's outlets; the
    ``top`` least likely countries of each story are kept.
    """
    chance = propensity(articles).groupBy("country").agg(F.count("*").alias("active"), F.product(1 - F.col("p")).alias("p_null")).where(F.col("active") >= min_active)
    chance = chance.where(F.round("p_null", 10) < max_p)
    big = _big_pairs(articles, 5).where(F.col("covering_countries") >= min_countries)
    stories = big.select("story_id", "covering_sources", "covering_countries").distinct()
    if as_of is not None:
        first = articles.groupBy("story_id").agg(F.min("published_at").alias("first_seen"))
        stories = stories.join(first.where(F.col("first_seen") <= as_of - F.make_dt_interval(hours=F.lit(maturity_hours))).select("story_id"), "story_id")
    # Stories x the few countries that pass: countries are a bounded dimension.
    absent = stories.crossJoin(chance).join(big.select("story_id", "country").distinct(), ["story_id", "country"], "left_anti")
    least = Window.partitionBy("story_id").orderBy(F.round("p_null", 10), "country")
    hits = absent.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= top)
    return hits.select("story_id", "country", F.round("p_null", 4).alias("p_null"), "active", "covering_sources", "covering_countries")


def blind_spot_flags(articles: DataFrame) -> DataFrame:
    """Every story with its number of flags: stories without a hit get none, which clears old flags."""
    hits = country_blind_spots(articles).groupBy("story_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("country")), ",").alias("countries"))
    return articles.select("story_id").distinct().join(hits, "story_id", "left").select("story_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("countries", F.lit("")).alias("countries"))

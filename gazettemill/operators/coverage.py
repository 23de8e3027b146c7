"""Story coverage, flash detection and ranking of stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens


def story_counts(articles: DataFrame, story: str = "story_id", outlet: str = "outlet_id") -> DataFrame:
    """Articles and distinct outlets of each story."""
    return articles.groupBy(story).agg(F.count("*").alias("article_count"), F.countDistinct(outlet).alias("source_count"))


def story_span(articles: DataFrame, story: str = "story_id") -> DataFrame:
    """First and last event time of each story."""
    return articles.groupBy(story).agg(F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))


def coverage_long(articles: DataFrame) -> DataFrame:
    """(story_id, kind, name, n): articles per country and per language; one shuffle for both grouping sets."""
    named = articles.select("story_id", F.col("country").cast("string").alias("country"), F.coalesce("language", F.lit("?")).alias("language"))
    sets = named.groupingSets([["story_id", "country"], ["story_id", "language"]], "story_id", "country", "language").agg(F.count("*").alias("n"), F.grouping("language").alias("by_country"))
    return sets.select("story_id", F.when(F.col("by_country") == 1, "country").otherwise("language").alias("kind"), F.when(F.col("by_country") == 1, F.col("country")).otherwise(F.col("language")).alias("name"), "n")


def coverage_maps(articles: DataFrame) -> DataFrame:
    """(story_id, by_country, by_language) as maps."""
    pairs = coverage_long(articles).groupBy("story_id", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counts"))
    return pairs.groupBy("story_id").agg(
        F.first(F.when(F.col("kind") == "country", F.col("counts")), ignorenulls=True).alias("by_country"),
        F.first(F.when(F.col("kind") == "language", F.col("counts")), ignorenulls=True).alias("by_language"),
    )


def flash_stories(articles: DataFrame, story: str, min_outlets: int = 5, hours: float = 2) -> DataFrame:
    """Stories whose ``min_outlets``-th new outlet came within ``hours`` of the first article."""
    first = articles.groupBy(story, "outlet_id").agg(F.min("published_at").alias("t"))
    nth = first.withColumn("rn", F.row_number().over(Window.partitionBy(story).orderBy("t", "outlet_id"))).withColumn("first_seen", F.min("t").over(Window.partitionBy(story)))
    delay = (F.unix_micros("t") - F.unix_micros("first_seen")) / 1e6
    return nth.where((F.col("rn") == min_outlets) & (delay <= hours * 3600)).select(story, F.round(delay, 3).alias("seconds"))


def recent_coverage(articles: DataFrame, as_of: Column, story: str, hours: int = 24) -> DataFrame:
    """Distinct outlets of each story in the last ``hours``."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    return articles.where(F.col("published_at") >= since).groupBy(story).agg(F.countDistinct("outlet_id").alias("recent_outlets"))


def weight(coverage: str, last_seen: str, as_of: Column, half_life: float = 12, fresh_half_life: float = 2, fresh: float = 6) -> Column:
    """Recency-weighted rank of a story: coverage that halves by age plus a short-lived bonus."""
    hours = F.greatest((F.unix_micros(as_of) - F.unix_micros(last_seen)) / 3.6e9, F.lit(0.0))
    return F.greatest(F.col(coverage), F.lit(1)) * F.pow(F.lit(0.5), hours / half_life) + fresh * F.pow(F.lit(0.5), hours / fresh_half_life)


def top_stories(articles: DataFrame, as_of: Column, story: str, limit: int, seen_hours: int = 48, candidates: int = 200) -> DataFrame:
    """Front page: the ``limit`` heaviest of the latest stories; the ``limit`` latest if none was seen in ``seen_hours``."""
    latest = story_span(articles, story).orderBy(F.desc("last_seen"), story).limit(candidates)
    # A window over the candidates alone: never more than ``candidates`` rows.
    seen = latest.withColumns({"recent": F.col("last_seen") >= as_of - F.make_dt_interval(hours=F.lit(seen_hours)), "place": F.row_number().over(Window.orderBy(F.desc("last_seen"), story))})
    fresh = seen.withColumn("any", F.max("recent").over(Window.partitionBy())).where(F.col("recent") | (~F.col("any") & (F.col("place") <= limit))).select(story, "first_seen", "last_seen")
    ranked = fresh.join(recent_coverage(articles, as_of, story), story, "left").withColumn("recent_outlets", F.coalesce("recent_outlets", F.lit(1).cast("long")))
    return ranked.withColumn("weight", F.round(weight("recent_outlets", "last_seen", as_of), 4)).orderBy(F.desc("weight"), story).limit(limit).select(story, "recent_outlets", "weight")


def timeline(articles: DataFrame) -> DataFrame:
    """Each story's articles in order, the seconds after its first and after the one before."""
    w = Window.partitionBy("story_id").orderBy("published_at", "article_id")
    at = F.unix_micros("published_at")
    return articles.select(
        "story_id", "article_id", "outlet_id", F.row_number().over(w).cast("long").alias("position"),
        ((at - F.first(at).over(w)) / 1e6).cast("long").alias("after_first"),
        ((at - F.lag(at).over(w)) / 1e6).cast("long").alias("after_previous"),
    )


def version_order(articles: DataFrame, country: int, language: str) -> DataFrame:
    """A story's versions: the reader's country first, then the reader's language, then time."""
    w = Window.partitionBy("story_id").orderBy((F.col("country") != country).cast("int"), (F.col("language") != language).cast("int"), "published_at", "article_id")
    return articles.select("story_id", "article_id", F.row_number().over(w).cast("long").alias("position"))


def diverse_versions(articles: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Three most different versions of a story: one article per outlet, then two farthest-point steps.

    Distance is that of the outlets' places on the map (outlet_id, x, y) where both have one, else 1 for another
    country plus 0.5 for another language; ties go to the earlier article.
    """
    one = articles.withColumn("rn", F.row_number().over(Window.partitionBy("story_id", "outlet_id").orderBy("published_at", "article_id"))).where("rn = 1")
    nowhere = F.lit(None).cast("double")
    one = one.withColumns({"x": nowhere, "y": nowhere}) if positions is None else one.join(positions.select("outlet_id", "x", "y"), "outlet_id", "left")
    told = ("article_id", "country", "language", "x", "y")
    order = Window.partitionBy("story_id").orderBy("published_at", "article_id")
    seeds = one.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("story_id", F.struct(*told).alias("a"))

    def gap(other: str) -> Column:
        of = lambda c: F.col(f"{other}.{c}")
        apart = lambda c: F.coalesce((~F.col(c).eqNullSafe(of(c))).cast("double"), F.lit(0.0))
        return F.coalesce(F.hypot(F.col("x") - of("x"), F.col("y") - of("y")), apart("country") + 0.5 * apart("language"))

    def farthest(rows: DataFrame, distance: Column, name: str) -> DataFrame:
        w = Window.partitionBy("story_id").orderBy(F.desc("d"), "published_at", "article_id")
        return rows.withColumn("d", distance).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("story_id", F.struct(*told).alias(name))

    rest = one.join(seeds, "story_id").where(F.col("article_id") != F.col("a.article_id"))
    second = farthest(rest, gap("a"), "b")
    rest = rest.join(second, "story_id").where(F.col("article_id") != F.col("b.article_id"))
    third = farthest(rest, F.least(gap("a"), gap("b")), "c")
    out = seeds.join(second, "story_id", "left").join(third, "story_id", "left")
    return out.select("story_id", F.col("a.article_id").alias("first"), F.col("b.article_id").alias("second"), F.col("c.article_id").alias("third"))


def headline_subtitles(stories: DataFrame, articles: DataFrame, locale: str) -> DataFrame:
    """(story, subtitle, translated): what a story's title means in the reader's language; null where nothing fits.

    ``stories`` holds story, title_neutral, title_language and translations (a map), ``articles`` story, article_id,
    title, snippet, language, outlet_language and published_at. A title in the reader's language needs none; else
    the translation, else the title of a version whose own and outlet's language both are the reader's, that
    differs from the neutral title and shares a strong word with it (where both have some): one with a snippet
    if there is any, then the earliest.
    """
    fits = articles.where((F.col("language") == locale) & (F.col("outlet_language") == locale) & (F.coalesce("title", F.lit("")) != ""))
    met = fits.join(stories.select("story", "title_neutral"), "story").where("title <> title_neutral")
    ours, theirs = tokens.strong_words(F.col("title")), tokens.strong_words(F.col("title_neutral"))
    met = met.where((F.size(ours) == 0) | (F.size(theirs) == 0) | tokens.same_news(ours, theirs))
    bare = (F.coalesce(F.trim("snippet"), F.lit("")) == "").cast("int")
    best = met.groupBy("story").agg(F.min_by("title", F.struct(bare.alias("bare"), "published_at", "article_id")).alias("version"))
    joined = stories.join(best, "story", "left").withColumn("made", F.nullif(F.try_element_at("translations", F.lit(locale)), F.lit("")))
    foreign = ~F.col("title_language").eqNullSafe(F.lit(locale))
    return joined.select("story", F.when(foreign, F.coalesce("made", "version")).alias("subtitle"), (foreign & F.col("made").isNotNull()).alias("translated"))


def guaranteed_slots(top: DataFrame, breaking: DataFrame, story: str, limit: int) -> DataFrame:
    """Breaking stories that the list lacks take its last places; the list is then sorted again."""
    missing = breaking.join(top, story, "left_anti").withColumn("forced", F.lit(0))
    merged = top.withColumn("forced", F.lit(1)).unionByName(missing)
    kept = merged.orderBy("forced", F.desc("weight"), story).limit(limit)
    return kept.select(story, "weight", F.row_number().over(Window.orderBy(F.desc("weight"), story)).cast("long").alias("place"))

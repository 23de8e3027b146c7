"""Collection monitoring, ownership and shared accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_accounts(accounts: DataFrame) -> DataFrame:
    """Groups of outlets behind one (exchange, publisher id)."""
    valid = accounts.where(F.col("publisher_id").cast("string").rlike("^[A-Za-z0-9._-]+$"))
    groups = valid.select("exchange", "publisher_id", "outlet_id").distinct().groupBy("exchange", "publisher_id").agg(F.count("*").alias("outlets"), F.array_join(F.array_sort(F.collect_list("outlet_id")), ",").alias("members"))
    return groups.where("outlets > 1")


def failure_streaks(fetches: DataFrame, as_of: Column, threshold: int = 3, hours: float = 6) -> DataFrame:
    """Consecutive failures up to each outlet's last fetch; in back-off if there are enough and the last is recent.

    Gaps and islands: a running count of successes numbers the islands.
    """
    order = Window.partitionBy("outlet_id").orderBy("published_at", "article_id")
    runs = fetches.withColumn("island", F.sum(F.when(F.col("event_type") == "error", 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by_island = runs.groupBy("outlet_id", "island").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.max("published_at").alias("last"))
    last = by_island.groupBy("outlet_id").agg(F.max_by("failures", "island").alias("streak"), F.max("failures").alias("longest"), F.max("last").alias("last_fetch"))
    idle = (F.unix_micros(as_of) - F.unix_micros("last_fetch")) / 3.6e9
    return last.select("outlet_id", "streak", "longest", ((F.col("streak") >= threshold) & (idle < hours)).alias("in_backoff"))


def feed_verdicts(fetches: DataFrame) -> DataFrame:
    """Per outlet: enabled if any of its feeds (event types) works, and the feeds that failed last."""
    feeds = fetches.groupBy("outlet_id", "event_type").agg(F.max_by(F.col("value") >= 10, F.struct("published_at", "article_id")).alias("ok"))
    bad = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("event_type")))), ",")
    return feeds.groupBy("outlet_id").agg(F.bool_or("ok").alias("enabled"), bad.alias("failing"))


def courtesy_audit(fetches: DataFrame, default_seconds: float = 2, slow_seconds: float = 5) -> DataFrame:
    """Requests to a host sooner after the one before than its interval allows (every fifth host asks for more)."""
    order = Window.partitionBy("outlet_id").orderBy("published_at", "article_id")
    gap = (F.unix_micros("published_at") - F.lag(F.unix_micros("published_at")).over(order)) / 1e6
    least = F.when(F.col("outlet_id") % 5 == 0, slow_seconds).otherwise(default_seconds)
    return fetches.select("outlet_id", "article_id", gap.alias("gap"), least.alias("least")).where("gap < least").select("outlet_id", "article_id", F.round("gap", 3).alias("gap"))


def query_batches(outlets: DataFrame, size: int = 6) -> DataFrame:
    """Search queries: outlets without feeds alone, the rest ``size`` to a query."""
    order = Window.partitionBy("has_feed").orderBy("outlet_id")
    numbered = outlets.withColumn("batch", F.when(F.col("has_feed"), F.floor((F.row_number().over(order) - 1) / size)).otherwise(F.col("outlet_id")))
    return numbered.groupBy("has_feed", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("outlet_id")), lambda o: F.concat(F.lit("domain:"), o)), " OR ").alias("query"), F.count("*").alias("n"))


def refresh_due(profiles: DataFrame, as_of: Column, limit: int, empty_hours: int = 6, days: int = 14) -> DataFrame:
    """Profiles to refresh, never-profiled first, then oldest: empty ones after hours, others after days."""
    age = (F.unix_micros(as_of) - F.unix_micros("profiled_at")) / 3.6e9
    due = F.col("profiled_at").isNull() | (F.col("empty") & (age >= empty_hours)) | (age >= 24 * days)
    return profiles.where(due).orderBy(F.asc_nulls_first("profiled_at"), "outlet_id").limit(limit).select("outlet_id", "empty")


def catalogue_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue by slug: new values win, gone entries stay; status tells created, updated or kept."""
    o = old.select("slug", F.col("name").alias("old_name"), F.lit(True).alias("in_old"))
    n = new.select("slug", F.col("name").alias("new_name"), F.lit(True).alias("in_new"))
    both = o.join(n, "slug", "full_outer")
    status = F.when(F.col("in_old").isNull(), "created").when(F.col("in_new").isNotNull() & (~F.col("old_name").eqNullSafe(F.col("new_name"))), "updated").otherwise("kept")
    return both.select("slug", F.coalesce("new_name", "old_name").alias("name"), status.alias("status"))


def ownership_load(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """Ownership facts split into those of known outlets and the skipped rest, counted per owner."""
    known = outlets.select("outlet_id").distinct().withColumn("known", F.lit(True))
    return edges.join(known, "outlet_id", "left").groupBy("owner").agg(F.count_if(F.col("known")).alias("edges"), F.count_if(F.col("known").isNull()).alias("skipped"))


def first_owner(edges: DataFrame) -> DataFrame:
    return edges.groupBy("outlet_id").agg(F.min("owner").alias("owner"), F.count("*").alias("owners"))


def outlet_record(articles: DataFrame, edges: DataFrame, fundings: DataFrame) -> DataFrame:
    """One row for each outlet: owners, public funding (thousands; years latest first) and article count."""
    owners = edges.groupBy("outlet_id").agg(F.array_join(F.array_sort(F.collect_set("owner")), ";").alias("owners"))
    money = fundings.groupBy("outlet_id", "year").agg(F.round(F.sum("amount"), 2).alias("amount"))
    by_year = money.groupBy("outlet_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("year"), asc=False), lambda y: y.cast("string")), ",").alias("years"), F.round(F.sum("amount") / 1000, 1).alias("funding"))
    count = articles.groupBy("outlet_id").agg(F.count("*").alias("articles"))
    return count.join(owners, "outlet_id", "left").join(by_year, "outlet_id", "left").select("outlet_id", "articles", "owners", "years", "funding")


def reader_languages(views: DataFrame, as_of: Column, default: list[str], days: int = 7) -> DataFrame:
    """Languages by last use within ``days``, then the default order."""
    spark = views.sparkSession
    dim = spark.createDataFrame([(i, x) for i, x in enumerate(default)], "ordinal int, language string")
    used = views.where(F.col("published_at") >= as_of - F.make_dt_interval(days=F.lit(days))).groupBy("language").agg(F.max("published_at").alias("last"))
    order = Window.orderBy(F.desc_nulls_last("last"), "ordinal")
    return dim.join(used, "language", "left").select("language", F.row_number().over(order).cast("long").alias("priority"))


def latest_record(log: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Append log reduced to the latest record of each key (null keys match each other)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")

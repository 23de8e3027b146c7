"""Streaming queries over the landed events, drained to a table, with batch oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import arrivals, stories
from . import views
from .text_queries import _CANON

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _closed(spark, d, build):
    """``build`` over the landed events and, once these are through, one closing event: what the stream alone gives."""
    closing = arrivals.Closing(arrivals.landed_events(spark, d), views.evt(spark, d))
    out = arrivals.drain(build(closing.stream), then=(closing.land,))
    return out if "story" not in out.columns else out.where(F.col("story") != arrivals.CLOSING)


@query("st1_first_arrivals", "SELECT event_type, user_id AS outlet_id FROM events GROUP BY 1, 2")
def st1(spark, d):
    stream = arrivals.landed_events(spark, d).withColumn("key", F.concat_ws("/", "event_type", "outlet_id"))
    return arrivals.drain(arrivals.first_arrivals(stream, "key", "3650 days")).select("event_type", "outlet_id")


@query("st1_canonical_arrivals", views.with_views(f"WITH {_CANON} SELECT DISTINCT canonical FROM cu", "page"))
def st1_canonical(spark, d):
    """Pages as arrivals, all of one instant: each canonical URL arrives once."""
    stream = arrivals.landed(spark, d, "pages", "page_id long, url string").select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200)).alias("published_at"))
    return arrivals.drain(arrivals.canonical_arrivals(stream)).select("canonical")


@query("st2_windowed_coverage", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts))//1000000 AS start, event_type, count(*) AS n, round(sum(value),4) AS value FROM events GROUP BY 1,2")
def st2(spark, d):
    out = _closed(spark, d, arrivals.windowed_coverage)
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("st3_flash_candidates", """WITH e AS (SELECT user_id, event_type||'/'||strftime(ts,'%Y-%m-%d') AS story, time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS b FROM events, range(12) r(k))
 SELECT epoch_us(b)//1000000 AS start, story, count(DISTINCT user_id) AS outlets FROM e GROUP BY 1,2 HAVING count(DISTINCT user_id)>=5""")  # fmt: skip
def st3(spark, d):
    out = _closed(spark, d, arrivals.flash_candidates)
    return out.select(F.unix_seconds("start").alias("start"), "story", "outlets")


@query("st4_activity_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id AS outlet_id, epoch_us(min(ts))//1000000 AS start, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def st4(spark, d):
    out = _closed(spark, d, lambda a: arrivals.activity_sessions(a, "outlet_id", "12 hours"))
    return out.select("outlet_id", F.unix_seconds("start").alias("start"), "n")


@query("st7_story_matches", """WITH e AS (SELECT event_id, event_type||'/'||strftime(ts,'%Y-%m-%d') AS story, ts FROM events), h AS (SELECT story, time_bucket(INTERVAL 1 HOUR, ts) AS b, min(ts) AS f, max(ts) AS l, count(*) AS n FROM e GROUP BY 1,2)
 SELECT event_id AS article_id, story, epoch_us(b)//1000000 AS start, n FROM e JOIN h USING(story) WHERE f<ts AND l>=ts - INTERVAL 72 HOUR""")  # fmt: skip
def st7(spark, d):
    out = _closed(spark, d, arrivals.story_matches)
    return out.select("article_id", "story", F.unix_seconds("start").alias("start"), "n")


@query("st5_stateful_stories")
def st5(spark, d):
    """Timed embeddings arrive in three deliveries, a week and more apart; blocks are the desks of their events.

    Between deliveries the stream restarts from its checkpoint; the closing article lets the timers end all stories.
    """
    timed = views.arr(spark, d).select(F.col("desk").alias("block"), "article_id", "published_at", "embedding")
    path = shared_dir(spark, "arrivals")
    first, last = timed.agg(F.min("published_at"), F.max("published_at")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    parts = [timed.where(F.col("published_at") < cuts[0]), timed.where((F.col("published_at") >= cuts[0]) & (F.col("published_at") < cuts[1])), timed.where(F.col("published_at") >= cuts[1])]
    parts[0].write.parquet(path)
    landed = spark.readStream.schema(timed.schema).parquet(path)
    closing = arrivals.Closing(landed, timed)
    land = [lambda p=p: p.write.mode("append").parquet(path) for p in parts[1:]]
    with arrivals.state_store(spark, stories.ROCKS):
        out = arrivals.drain(stories.assigned(closing.stream), then=(*land, closing.land))
    return out.where(F.col("block") != arrivals.CLOSING).select("block", "story", "article_id", "articles", F.unix_seconds("closed_at").alias("closed_at"))


@query("st6_late_articles", """WITH e AS (SELECT user_id, event_type||'/'||strftime(ts,'%Y-%m-%d') AS story, ts FROM events), f AS (SELECT story, user_id, min(ts) AS t FROM e GROUP BY 1,2),
 r AS (SELECT story, t, row_number() OVER (PARTITION BY story ORDER BY t, user_id) AS rn, min(t) OVER (PARTITION BY story) AS f0 FROM f), q AS (SELECT story FROM r WHERE rn=5 AND epoch_us(t)-epoch_us(f0) <= 7200000000)
 SELECT story, count(*) AS articles, count(DISTINCT user_id) AS outlets, epoch_us(min(ts))//1000000 AS first_seen, epoch_us(max(ts))//1000000 AS last_seen, story IN (SELECT story FROM q) AS is_flash FROM e GROUP BY 1""")  # fmt: skip
def st6(spark, d):
    """Events arrive in three deliveries without any order of time, so two of them are mostly late; the last batch comes twice."""
    rows = views.evt(spark, d).select("article_id", "story", "outlet_id", "published_at")
    path = shared_dir(spark, "disorder")
    store = stories.StoryStore(spark, f"{path}/store")
    part = F.pmod(F.xxhash64("article_id"), F.lit(3))
    rows.limit(0).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    for k in range(3):
        rows.where(part == k).write.mode("append").parquet(f"{path}/in")
        arrivals.run_landed(stream.writeStream.foreachBatch(store.merge), path)
    store.merge(rows.where(part == 2), 2)
    store.compact()
    return store.stories().select("story", "articles", "outlets", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"), "is_flash")

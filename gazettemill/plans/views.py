"""Fixture views: the given tables seen as articles, outlets, stories and ratings.

Each view has a Spark form (a function of session and folder) and a DuckDB
form (an SQL body in ``SQL``), so that an operator runs on the same rows in
both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Outlets and countries of the coverage fixture.
N_OUTLETS, N_COUNTRIES = 48, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with outlet, country, language, story and topic."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article_id"),
        (F.col("l_orderkey") % N_OUTLETS).alias("outlet_id"),
        (F.col("l_orderkey") % N_OUTLETS % N_COUNTRIES).alias("country"),
        F.col("l_partkey").alias("story_id"),
        F.col("p_type").alias("topic"),
        F.col("l_returnflag").alias("language"),
        F.col("l_shipdate").cast("timestamp").alias("published_at"),
    )


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: title (first line), snippet and full text."""
    d = table(spark, sf_dir, "documents")
    flat = F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.col("source").alias("outlet"),
        F.col("lang").alias("language"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.substring(flat, 1, 200).alias("snippet"),
        F.col("text").alias("full_text"),
    )


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles of 150 outlets; a story is an event type on a day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("article_id"),
        F.col("user_id").alias("outlet_id"),
        F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("story"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.col("event_type"),
        F.col("value"),
    )


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def arr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as timed articles: each takes time, outlet and desk of an event, spread evenly over the events."""
    vectors, events = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events")
    step = vectors.agg((F.max("vec_id") + 1).alias("v")).crossJoin(events.agg((F.max("event_id") + 1).alias("e"))).select(F.floor(F.col("e") / F.col("v")).alias("step"))  # one row
    placed = vectors.crossJoin(F.broadcast(step)).select("vec_id", "embedding", (F.col("vec_id") * F.col("step")).alias("event_id"))
    timed = events.select("event_id", F.col("ts").cast("timestamp").alias("published_at"), F.col("user_id").alias("outlet_id"), F.col("event_type").alias("desk"))
    return placed.join(timed, "event_id").select(F.col("vec_id").alias("article_id"), "published_at", "outlet_id", "desk", "embedding")


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings -2..2 by 12 annotators on two axes, one for each (article, annotator, axis)."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_quantity")
    rated = line.groupBy(F.col("l_partkey").alias("article_id"), (F.col("l_suppkey") % 12).alias("annotator_id"), F.col("l_linestatus").alias("axis")).agg(
        F.max(F.col("l_quantity").cast("int") % 5 - 2).alias("value")
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_brand").alias("outlet"))
    return rated.join(part, "article_id").withColumn("self_axis", (F.col("annotator_id") % 5 - 2).cast("double"))


def own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("owner"), (F.col("s_suppkey") % N_OUTLETS).alias("outlet_id"))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % N_OUTLETS).alias("outlet_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("program")).agg(F.sum("o_totalprice").alias("amount"))


def acct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % N_OUTLETS).alias("outlet_id"), F.col("c_mktsegment").alias("exchange"), F.col("c_nationkey").alias("publisher_id"))


SQL = {
    "cov": """SELECT l_orderkey*10+l_linenumber AS article_id, l_orderkey%48 AS outlet_id, l_orderkey%48%8 AS country, l_partkey AS story_id,
        p_type AS topic, l_returnflag AS language, l_shipdate::TIMESTAMP AS published_at FROM lineitem JOIN part ON l_partkey=p_partkey""",
    "doc": r"""SELECT doc_id AS article_id, source AS outlet, lang AS language, split_part(text, chr(10), 1) AS title,
        substr(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), 1, 200) AS snippet, text AS full_text FROM documents""",
    "evt": """SELECT event_id AS article_id, user_id AS outlet_id, event_type||'/'||strftime(ts,'%Y-%m-%d') AS story, ts::TIMESTAMP AS published_at, event_type, value FROM events""",
    "ann": """SELECT article_id, annotator_id, axis, value, p_brand AS outlet, (annotator_id%5-2)::DOUBLE AS self_axis FROM (
        SELECT l_partkey AS article_id, l_suppkey%12 AS annotator_id, l_linestatus AS axis, max(trunc(l_quantity)::INT%5-2) AS value FROM lineitem GROUP BY ALL)
        JOIN part ON p_partkey=article_id""",
    "own": "SELECT s_name AS owner, s_suppkey%48 AS outlet_id FROM supplier",
    "funding": "SELECT o_custkey%48 AS outlet_id, year(o_orderdate) AS year, o_orderpriority AS program, sum(o_totalprice) AS amount FROM orders GROUP BY ALL",
    "acct": "SELECT c_custkey%48 AS outlet_id, c_mktsegment AS exchange, c_nationkey AS publisher_id FROM customer",
    "emb": "SELECT vec_id, embedding, label FROM embeddings",
    "page": "SELECT page_id, url, html FROM pages",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind CTEs of the named views; ``sql`` may start with further CTEs."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"

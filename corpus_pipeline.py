"""Stages that turn ``documents`` into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept,
and its result is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazettemill.llm import common, decontam, linededup, packing, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the rejection threshold; rows of a null doc_id stay."""
    judged = toxicity.flagged(docs, common.read(spark, sf_dir, "labels"))
    rejected = common.cut(judged.where("predicted = 1 and doc_id is not null").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that five or more documents share (the largest doc_id keeps them)."""
    kept = linededup.dedup_lines(docs, 40, 5)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is similar by 0.8 or more over five-word shingles."""
    return simhash.one_of_each(docs, 5, 0.8).select(COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, common.read(spark, sf_dir, "benchmark"), 0.8).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of every remaining document in sequences of at most 2048 tokens."""
    import public_tokenizers

    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)
    return packed.placed("doc_id", "piece", "start", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack),
]

#: Cosine neighbours, similarity groups and tokenisers have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return docs

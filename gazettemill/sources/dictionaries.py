"""Dictionaries as landed JSON files: topics, framing terms, valences, stop words.

Each function reads one file or a folder of them and gives the table that the
lexical operators take. Keywords and terms are trimmed and lower-cased where
matching ignores case; empty ones are left out, repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def _clean(words: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.trim(w))), lambda w: w != ""))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, ordinal, lang, term, total) from {"topics": [{"id", "keywords": {lang: [words]}}]}; ordinal is the place in the file."""
    raw = _json(spark, path, "topics array<struct<id:string,keywords:map<string,array<string>>>>").select(F.posexplode("topics").alias("ordinal", "t"))
    each = raw.where("t.id is not null").select(F.col("t.id").alias("topic"), "ordinal", F.explode("t.keywords").alias("lang", "words")).withColumn("words", _clean(F.col("words")))
    return each.select("topic", "ordinal", "lang", F.explode("words").alias("term"), F.size("words").alias("total"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(lang, grp, term, connotation, n_tokens) from {"language", "groups": [{"id", "terms": [{"term", "connotation"}]}]}."""
    raw = _json(spark, path, "language string, groups array<struct<id:string,terms:array<struct<term:string,connotation:string>>>>")
    each = raw.select(F.col("language").alias("lang"), F.explode("groups").alias("g")).select("lang", F.col("g.id").alias("grp"), F.explode("g.terms").alias("t"))
    term = F.trim("t.term")
    return each.where(term != "").select("lang", "grp", term.alias("term"), F.coalesce("t.connotation", F.lit("neutral")).alias("connotation"), F.size(F.split(term, r"\s+")).alias("n_tokens")).dropDuplicates(["lang", "grp", "term"])


def valence(spark: SparkSession, path: str) -> DataFrame:
    """(lang, word, score) from {"language", "valence": {word: score}}."""
    raw = _json(spark, path, "language string, valence map<string,double>").select(F.col("language").alias("lang"), F.explode("valence").alias("word", "score"))
    return raw.withColumn("word", F.lower(F.trim("word"))).where("word <> '' and score is not null").groupBy("lang", "word").agg(F.max("score").alias("score"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(stop_lang, word) from {"language", "words": [..]}."""
    raw = _json(spark, path, "language string, words array<string>")
    return raw.select(F.col("language").alias("stop_lang"), F.explode(_clean(F.col("words"))).alias("word")).distinct()

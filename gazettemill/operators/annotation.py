"""Inter-annotator agreement and publication gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(value: str) -> Column:
    """Orientation bracket of a declared position: below -0.5, middle, above 0.5."""
    return F.when(F.col(value) < -0.5, "low").when(F.col(value) > 0.5, "high").otherwise("middle")


def agreement(ratings: DataFrame) -> DataFrame:
    """Krippendorff's alpha (ordinal) of each outlet and axis; null without two ratings of a unit, 1 without variation.

    Only the counts of each value in each unit are paired, never raters:
    a unit has at most five values whatever its number of ratings.
    """
    keys = ["outlet", "axis"]
    counts = ratings.where("value is not null").groupBy(*keys, "article_id", "value").agg(F.count("*").alias("n"))
    unit = Window.partitionBy(*keys, "article_id")
    counts = counts.withColumn("m", F.sum("n").over(unit)).where("m >= 2")
    left = counts.select(*keys, "article_id", "m", F.col("value").alias("c"), F.col("n").alias("nc"))
    right = counts.select(*keys, "article_id", F.col("value").alias("k"), F.col("n").alias("nk"))
    weight = F.col("nc") * (F.col("nk") - F.when(F.col("c") == F.col("k"), 1).otherwise(0)) / (F.col("m") - 1)
    coincidence = left.join(right, [*keys, "article_id"]).groupBy(*keys, "c", "k").agg(F.sum(weight).alias("o"))
    marginal = coincidence.groupBy(*keys, "c").agg(F.sum("o").alias("n_c"))
    upto = F.sum("n_c").over(Window.partitionBy(*keys).orderBy("c"))
    marginal = marginal.withColumn("upto", upto).withColumn("n", F.sum("n_c").over(Window.partitionBy(*keys)))
    one = marginal.select(*keys, "c", F.col("n_c").alias("na"), F.col("upto").alias("ua"), "n")
    two = marginal.select(*keys, F.col("c").alias("k"), F.col("n_c").alias("nb"), F.col("upto").alias("ub"))
    low_first = F.when(F.col("c") <= F.col("k"), F.col("ub") - F.col("ua") + F.col("na")).otherwise(F.col("ua") - F.col("ub") + F.col("nb"))
    delta = F.pow(low_first - (F.col("na") + F.col("nb")) / 2, 2)
    grid = one.join(two, keys).where("c <> k").withColumn("delta", delta)
    sums = grid.join(coincidence, [*keys, "c", "k"], "left").groupBy(*keys).agg(
        F.sum(F.coalesce("o", F.lit(0.0)) * F.col("delta")).alias("observed"), F.sum(F.col("na") * F.col("nb") * F.col("delta")).alias("expected")
    )
    totals = marginal.groupBy(*keys).agg(F.max("n").alias("n"))
    alpha = F.when(F.col("n") <= 1, None).when(F.coalesce("expected", F.lit(0.0)) == 0, 1.0).otherwise(1 - (F.col("n") - 1) * F.col("observed") / F.col("expected"))
    known = totals.join(sums, keys, "left").select(*keys, F.round(alpha, 6).alias("alpha"))
    return ratings.select(*keys).distinct().join(known, keys, "left")


def label(ratings: DataFrame) -> DataFrame:
    """Mean of the brackets' means, so each bracket of annotators weighs alike."""
    by_bracket = ratings.where("value is not null").groupBy("outlet", "axis", bracket("self_axis").alias("bracket")).agg(F.avg("value").alias("mean"))
    return by_bracket.groupBy("outlet", "axis").agg(F.round(F.avg("mean"), 2).alias("label"))


def gate(ratings: DataFrame, min_articles: int = 50, min_annotators: int = 3, min_brackets: int = 2, min_alpha: float = 0.6) -> DataFrame:
    """Whether an outlet's label may be published, and exactly what is missing if not."""
    facts = ratings.groupBy("outlet", "axis").agg(
        F.countDistinct("article_id").alias("articles"), F.countDistinct("annotator_id").alias("annotators"), F.countDistinct(bracket("self_axis")).alias("brackets")
    )
    known = facts.join(agreement(ratings), ["outlet", "axis"])
    lacks = F.array_compact(F.array(
        F.when(F.col("articles") < min_articles, "articles"), F.when(F.col("annotators") < min_annotators, "annotators"),
        F.when(F.col("brackets") < min_brackets, "brackets"), F.when(F.col("alpha").isNull() | (F.col("alpha") < min_alpha), "agreement"),
    ))
    return known.withColumn("missing", F.array_join(lacks, ",")).withColumn("published", F.col("missing") == "")


def signals(ratings: DataFrame, min_alpha: float = 0.6) -> DataFrame:
    """A row for each outlet and axis: the label if published, else null with what is missing."""
    return gate(ratings, min_alpha=min_alpha).join(label(ratings), ["outlet", "axis"], "left").select(
        "outlet", "axis", F.when(F.col("published"), F.col("label")).alias("label"), "published", "missing"
    )


def training_rows(ratings: DataFrame) -> DataFrame:
    """Mean label of each article on each axis, a column for each axis."""
    return ratings.groupBy("article_id").pivot("axis", ["F", "O"]).agg(F.round(F.avg("value"), 6)).withColumnsRenamed({"F": "axis_f", "O": "axis_o"})


def assignment(ratings: DataFrame, annotator: int, latest: int = 200) -> DataFrame:
    """Next article for an annotator: of the outlet they rated least, an unseen one of its latest, in seeded order."""
    rated = ratings.where(F.col("annotator_id") == annotator).select("article_id", "outlet").distinct()
    done = rated.groupBy("outlet").agg(F.count("*").alias("done"))
    outlets = ratings.select("outlet").distinct().join(done, "outlet", "left").select("outlet", F.coalesce("done", F.lit(0)).alias("done"))
    newest = Window.partitionBy("outlet").orderBy(F.desc("article_id"))
    articles = ratings.select("outlet", "article_id").distinct().withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= latest)
    unseen = articles.join(rated.select("article_id"), "article_id", "left_anti").join(outlets, "outlet")
    shuffled = F.md5(F.concat(F.lit(f"{annotator}/"), F.col("article_id").cast("string")))
    return unseen.orderBy("done", "outlet", shuffled).limit(1).select("outlet", "article_id", "done")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest rating of each (article, annotator, axis); ``na`` counts as no value."""
    both = old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    last = Window.partitionBy("article_id", "annotator_id", "axis").orderBy(F.desc("version"))
    return both.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn", "version")

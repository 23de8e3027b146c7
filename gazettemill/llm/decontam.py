"""Benchmark decontamination: SimHash of item-sized windows, in DataFrame functions only.

Texts are lower-cased and split into words of letters and digits. An item of
n words has m = n - 4 five-word shingles, and so has a window of n words. The
similarity of a window and an item is the weighted Jaccard similarity of
their shingles (weights: how often each occurs); a document leaks an item if
some window reaches ``min_similarity``.

1. Windows of each item size m slide over the documents. A window that
   reaches similarity s has at least s * m positions with shingles that items
   of its size hold, and one that starts at such a shingle does at least as
   well, so only these are kept: none is missed. Which item a window may leak
   isn't asked here.
   Of the starts within a ``HOP`` th of an item's size one stands for all.
2. Each different window gets a 64-bit SimHash, and so does each item. They
   are looked up in a multi-index of RADIUS + 1 bit blocks by size, over all
   items: two fingerprints within RADIUS bits share at least one block. At
   similarity 0.8 the expected distance is 10 bits and its deviation 3, so
   the radius of 24 leaves out nothing that is found in practice; unrelated
   pairs are 32 bits apart, so about one in forty passes.
3. A document and the items that its windows met are verified by the exact
   weighted similarity of every window, as it slides over the document: an
   occurrence of a shingle counts in the windows that hold it but not so many
   earlier ones as the item has, which is a run of starts, so running sums
   give all windows at once.

A document or item of fewer than five words is one shingle of all its words,
so a short item matches only a document of just these words. Null and empty
texts match nothing; items without words match nothing. A null doc_id or
item_id is a value like any other; different texts of an item_id are looked
for each; repeated rows give their result once, and an empty table gives no
rows. Texts may have any length. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE = 5
RADIUS = 24
#: Bits of the 25 blocks: 14 of three bits, then 11 of two.
BLOCKS = [3] * 14 + [2] * 11
#: Windows that are fingerprinted start so many to an item's size apart, at most.
HOP = 32


def _shingles(text: str) -> F.Column:
    """Hashes of the five-word shingles of a text in order; none for a text without words."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(
        F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - SIZE, F.lit(0)))).otherwise(F.array().cast("array<int>")).alias("at"))),
        lambda x: F.transform(x["at"], lambda i: F.xxhash64(*(F.get(x["w"], i + j) for j in range(SIZE)))),
    )[0]


def _ceil(x: F.Column) -> F.Column:
    return F.ceil(x - 1e-9).cast("int")


def _fingerprint(h: str) -> F.Column:
    """The 64-bit SimHash of a group's hashes: a bit is set if it is set in over half of them."""
    out = F.lit(0).cast("long")
    for bit in range(64):
        ones = F.sum(F.shiftrightunsigned(F.col(h), bit).bitwiseAND(F.lit(1)))
        out = out.bitwiseOR(F.when(2 * ones > F.count("*"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return out


def _blocks(fp: str) -> F.Column:
    """(block number, bits) packed into one number, for each block of the multi-index."""
    out, at = [], 0
    for number, bits in enumerate(BLOCKS):
        out.append(F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(8 * number))
        at += bits
    return F.array(*out)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text").where("text is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, min_similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_shingles): the best window of each leaked item in each document.

    ``start`` is the window's first shingle (counted in words from 0).
    """
    texts = benchmark.where("text is not null").select("item_id", "text").distinct()
    items = texts.withColumns({"item": F.xxhash64("item_id", "text"), "sh": _shingles("text")}).withColumn("m", F.size("sh")).where("m > 0")
    items = common.cut(items.select("item", "item_id", "m", "sh"), "items")
    weights = common.cut(items.select("item", "m", F.explode("sh").alias("h")).groupBy("item", "m", "h").agg(F.count("*").alias("w")), "weights")

    # Windows of each item size that hold enough shingles of items of that size, whichever.
    sizes = common.cut(weights.select("h", "m").distinct(), "sizes")
    each = _keyed(docs).withColumn("sh", _shingles("text")).select("doc_id", "body", F.size("sh").alias("n"), F.posexplode("sh").alias("pos", "h"))
    hits = each.join(sizes, "h").groupBy("doc_id", "body", "m", "n").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    dense = hits.withColumn("need", _ceil(F.col("m") * F.lit(min_similarity))).where(F.size("at") >= F.col("need"))
    starts = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.when(F.get("at", i + F.col("need") - 1) - F.get("at", i) < F.col("m"), F.get("at", i))),
        lambda s: s.isNotNull(),
    )
    hop = F.greatest(F.lit(1), F.floor(F.col("m") / HOP)).cast("int")
    first = F.filter("starts", lambda s, i: (i == 0) | (F.floor(s / F.col("hop")) != F.floor(F.get("starts", i - 1) / F.col("hop"))))
    chosen = dense.select("doc_id", "body", "m", starts.alias("starts"), hop.alias("hop")).where(F.size("starts") > 0)
    chosen = common.cut(chosen.select("doc_id", "body", "m", first.alias("starts")), "chosen")

    # Their shingles, each different window once.
    named = chosen.select(F.col("doc_id").alias("named_id"), F.col("body").alias("named_body")).distinct()
    mine = F.col("doc_id").eqNullSafe(F.col("named_id")) & (F.col("body") == F.col("named_body"))
    held = _keyed(docs).join(named, mine, "left_semi").dropDuplicates(["doc_id", "body"])
    shingled = common.cut(held.select(F.col("doc_id").alias("named_id"), F.col("body").alias("named_body"), _shingles("text").alias("sh")), "shingled")
    whole = chosen.join(shingled, mine).select("doc_id", "body", "m", "sh", F.explode("starts").alias("start")).withColumn("window", F.expr("slice(sh, start + 1, m)"))
    key = ["m", "k1", "k2"]
    whole = whole.select("doc_id", "body", "m", F.xxhash64("window").alias("k1"), F.xxhash64(F.lit(1), "window").alias("k2"), "window")
    placed = common.cut(whole.groupBy("doc_id", "body", *key).agg(F.first("window").alias("window")), "placed")
    windows = common.cut(placed.groupBy(*key).agg(F.count("*").alias("n"), F.first("window").alias("window")), "windows")

    # The multi-index: fingerprints of windows and of all items meet by size and block.
    each = windows.select(*key, F.explode("window").alias("h"))
    prints = each.groupBy(*key).agg(_fingerprint("h").alias("fp"))
    indexed = items.select("item", "m", F.explode("sh").alias("h")).groupBy("item", "m").agg(_fingerprint("h").alias("item_fp"))
    indexed = common.cut(indexed.select("item", "m", "item_fp", F.explode(_blocks("item_fp")).alias("block")), "index")
    met = prints.withColumn("block", F.explode(_blocks("fp"))).join(indexed, ["m", "block"])
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).groupBy(*key).agg(F.collect_set("item").alias("items"))
    near = common.cut(near.join(windows.select(*key, "n"), key), "near")
    pairs = common.weighted_join(placed.select("doc_id", "body", *key), near, key, "n").select("doc_id", "body", "m", F.explode("items").alias("item")).distinct()

    # Shared shingles of a document and an item: each occurrence counts for a run of starts.
    pair = ["doc_id", "body", "item", "m", "n"]
    every = common.cut(pairs, "pairs").join(shingled, mine).select(*pair[:4], F.size("sh").alias("n"), F.posexplode("sh").alias("pos", "h"))
    occurring = every.join(weights.drop("m"), ["item", "h"]).groupBy(*pair, "h", "w").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    runs = F.transform("at", lambda p, i: F.struct(F.greatest(F.coalesce(F.when(i >= F.col("w"), F.get("at", (i - F.col("w")).cast("int"))) + 1, F.lit(0)), p - F.col("m") + 1).alias("a"), (p + 1).alias("z")))
    ends = F.flatten(F.transform(runs, lambda r: F.when(r["a"] < r["z"], F.array(F.struct(r["a"].alias("at"), F.lit(1).alias("by")), F.struct(r["z"].alias("at"), F.lit(-1).alias("by"))))))
    steps = occurring.select(*pair, F.explode(ends).alias("s")).groupBy(*pair, F.col("s.at").alias("at")).agg(F.sum("s.by").alias("by"))
    along = Window.partitionBy(*pair).orderBy("at")
    level = steps.select(*pair, "at", F.sum("by").over(along).alias("both"), (F.lead("at", 1).over(along) - 1).alias("till")).where("both > 0")
    starts = F.explode(F.array("at", F.least("till", F.col("n") - 1))).alias("start")  # the windows at a document's end are shorter
    seen = level.select(*pair, "both", starts).withColumn("len", F.least("m", F.col("n") - F.col("start")))
    seen = seen.withColumn("similarity", F.col("both") / (F.col("m") + F.col("len") - F.col("both"))).where(F.col("similarity") >= min_similarity - 1e-9)
    named = seen.join(items.select("item", "item_id"), "item")
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.col("len"))).alias("x"))
    return best.select("doc_id", "item_id", F.round("x.similarity", 6).alias("similarity"), (-F.col("x.back")).alias("start"), F.col("x.len").alias("n_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame, min_similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents that leak an item; rows of a null doc_id go only if such a row leaks."""
    leaked = leaks(docs, benchmark, min_similarity).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(leaked, F.col("doc_id").cast("long").eqNullSafe(F.col("leaked")), "left_anti")

"""Documents that share nearly all n-grams: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are the different shingle sets (documents with equal
sets are one row from the start), columns are the 64-bit hashes of shingles.
The product of the incidence with its transpose counts, for two rows, the
shingles they share. It is formed from blocks of columns: each shuffle
partition of the column keys is a block, the join on the column is that
block's product, and the counts of a pair are summed over the blocks. What
can't reach the similarity is left out early:

* Screen. Rows of similar size that are similar share so many of their
  smallest hashes (``_prefix``) that a row without enough columns of others
  among these is similar to none.
* Columns of the remaining rows are ordered by how many rows have them, rare
  ones first; a row with too few columns of several rows is left out. Two rows
  that are similar share a column among the first ``size - needed + 1`` of
  each; only these are multiplied. A pair goes on if sizes allow the similarity
  and the overlap counted so far plus what is left after the last shared column
  reaches the least overlap of both sizes.
* Columns of large groups: every row of a column first meets the column's most
  connected row only. Those links make components, and then rows outside the
  column's largest component meet the rows of other components, where what is
  left of both from that column on reaches the least overlap. A group of near
  copies is thus linked by about as many pairs as it has rows, and no link
  between components is lost.

Each pair that passes is counted exactly over both whole sets.

A document's set: its different shingles, the whole word sequence if it has
fewer words. Null or empty texts, and texts without words, have size 0 and
link to nothing, each other included. Rows of a null doc_id get the component
of documents with an equal set, null if there are none. Repeated rows stay;
rows of one doc_id with different texts count as different documents. Ties:
component_id is the smallest doc_id of a component. An empty table gives no
rows, texts may have any length, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import _shingle_hashes

#: Bits of the map of documents whose sets are needed: 2 MB. Where it is crowded more sets are made and left out.
_BITS = 1 << 24
#: Bits of a column's hash in the incidence: columns that agree there only bring more candidates, as pairs are counted over whole sets.
_COLUMN_BITS = 40
#: A screened row's smallest hashes are so many more than it may lack, as a part of its size, and it must share as many. With
#: fewer, columns that unrelated rows happen to share pass more rows the larger the table is; with more, more columns are counted.
_SPARE = 10


def _sets(texts: list[str], size: int) -> list[np.ndarray]:
    return [np.unique(np.array(_shingle_hashes(t, size), np.uint64)).view(np.int64) for t in texts]


def _key(hashes: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(hashes.tobytes()), np.int64).tolist())


def _needed(size: int, percent: int) -> int:
    """Columns that a row of this size shares with any similar row, at least."""
    return -(-percent * size // 100)


def _prefix(size: int, percent: int) -> int:
    """Smallest hashes of a row of this size that are screened."""
    return size - _needed(size, percent) + 1 + size // _SPARE


def _overlap(a, b, percent: int):
    """Least overlap of similar rows of sizes ``a`` and ``b``: percent * (a + b) / (100 + percent), rounded up."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent) - 1e-9)


def join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links are at ``percent`` of the union or more."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = _sets(pdf["text"].tolist(), size)
            keys = [_key(s) for s in sets]
            prefixes = [s[: _prefix(len(s), percent)] for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets], "s1": [k[0] for k in keys], "s2": [k[1] for k in keys], "prefix": prefixes})

    shape = "doc_id long, n_shingles long, s1 long, s2 long, prefix array<long>"
    sketches = common.cut(texts.mapInPandas(sketch, shape), "sketches")
    groups = sketches.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"))
    rows = common.cut(groups.withColumn("row", F.monotonically_increasing_id()), "rows")

    # A set of so few shingles that no other size and no other set comes near it takes no part.
    able = rows.where((F.col("size") + 1) * percent <= F.col("size") * 100).where("rep is not null")
    visits = able.select("row", F.explode("prefix").alias("column"))
    shared = common.cut(visits.groupBy("column").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = common.weighted_join(visits, shared, ["column"], "n").groupBy("row").agg(F.count("*").alias("met"))
    enough = F.floor(F.ceil(F.col("size") * percent / 100 - 1e-9) / _SPARE) + 1  # a smaller similar row has this many more columns, at least
    named = common.cut(able.select("row", "rep", "s1", "s2", "size").join(met, "row").where(F.col("met") >= enough).select("row", "rep", "s1", "s2"), "named")

    bits = _bitmap(named, spark)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named_bits = bits.value
        for pdf in batches:
            at = pdf["at"].to_numpy()
            pdf = pdf[named_bits[at >> 5] >> (at & 31) & 1 == 1]
            if pdf.empty:
                continue
            sets = _sets(pdf["text"].tolist(), size)
            keys = [_key(s) for s in sets]
            yield pd.DataFrame({"s1": [k[0] for k in keys], "s2": [k[1] for k in keys], "columns": sets})

    # Sets are made before any shuffle, so that no texts are shuffled; the bitmap spares most texts that aren't needed.
    sets = texts.where("doc_id is not null").select("text", _bit("doc_id").alias("at")).mapInPandas(whole, "s1 long, s2 long, columns array<long>")
    sets = common.cut(sets.dropDuplicates(["s1", "s2"]).join(named.select("row", "s1", "s2"), ["s1", "s2"]).select("row", "columns"), "sets")
    entries = _entries(sets, percent)

    tried = common.cut(_meet_heads(entries, percent), "pairs")
    links = _similar(tried, sets, percent)
    rest = common.cut(_meet_others(entries, _rooted(links), percent).join(tried, ["a", "b"], "left_anti"), "rest")
    roots = _rooted(links.union(_similar(rest, sets, percent)))

    least = roots.join(rows.select(F.col("row").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("linked"))
    linked = roots.join(least, "root").select(F.col("node").alias("row"), "linked")
    known = rows.select("row", "s1", "s2", "rep", "n").join(linked, "row", "left").where("n > 1 or linked is not null")
    known = common.cut(known.select("s1", "s2", "n", F.coalesce("linked", "rep").alias("component_id")), "known")
    found = common.weighted_join(sketches.select("doc_id", "n_shingles", "s1", "s2"), known, ["s1", "s2"], "n", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _bit(name: str):
    return F.pmod(F.xxhash64(name), F.lit(_BITS))


def _bitmap(named: DataFrame, spark):
    """A bitmap of ``_BITS`` bits, whatever the input, with those of the named documents set; sent to all tasks."""
    at = named.select(_bit("rep").alias("at"))
    found = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toPandas()
    words = np.zeros(_BITS >> 5, np.uint32)
    words[found["word"]] = found["bits"].astype(np.uint32)
    return spark.sparkContext.broadcast(words)


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """(column, row, size, at): the incidence restricted to each row's first columns, and to columns of several rows."""
    sizes = sets.select("row", F.size("columns").cast("long").alias("size"))  # joined late, so that no size goes with every column
    terms = sets.select("row", F.explode("columns").alias("column"))
    terms = terms.withColumn("column", F.col("column").bitwiseAND(F.lit((1 << _COLUMN_BITS) - 1)))
    shared = common.cut(terms.groupBy("column").agg(F.count("*").alias("n")).where("n > 1"), "columns")
    found = common.weighted_join(terms, shared, ["column"], "n").groupBy("row").agg(F.collect_list("n").alias("n"), F.collect_list("column").alias("column")).join(sizes, "row")
    found = found.select("row", "size", F.sort_array(F.arrays_zip("n", "column")).alias("found"))  # two flat arrays take less of the shuffle than one of structs
    spare = F.size("found") - F.ceil(F.col("size") * percent / 100 - 1e-9).cast("int")
    first = found.where(spare >= 0).select("row", "size", (F.col("size") - F.size("found")).alias("alone"), F.posexplode(F.slice("found", 1, spare + 1)).alias("at", "first"))
    entries = common.cut(first.select("first.column", "row", "size", (F.col("alone") + F.col("at")).alias("at")), "entries")
    several = common.cut(entries.groupBy("column").agg(F.count("*").alias("n")).where("n > 1"), "several")
    return common.cut(common.weighted_join(entries, several, ["column"], "n"), "incidence")


def _possible(products: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose counts over all blocks of columns may still reach the similarity.

    ``products`` has a row for each pair and shared column: x and y, their sizes and the column's places in both.
    """
    sized = products.where(F.least("x_size", "y_size") * 100 >= F.greatest("x_size", "y_size") * percent)
    turned = F.col("x") > F.col("y")
    pick = lambda one, two: F.when(turned, F.col(two)).otherwise(F.col(one))
    pairs = sized.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *(pick(f"{p}_{c}", f"{q}_{c}").alias(f"{n}_{c}") for p, q, n in (("x", "y", "a"), ("y", "x", "b")) for c in ("size", "at")))
    summed = pairs.groupBy("a", "b").agg(F.count("*").alias("overlap"), F.first("a_size").alias("a_size"), F.first("b_size").alias("b_size"), F.max("a_at").alias("a_at"), F.max("b_at").alias("b_at"))
    left = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) - 1
    return summed.where(F.col("overlap") + left >= _overlap(F.col("a_size"), F.col("b_size"), percent)).select("a", "b")


def _meet_heads(entries: DataFrame, percent: int) -> DataFrame:
    """Each column's rows with the one of them that has most columns shared with others."""
    degrees = entries.groupBy("row").agg(F.count("*").alias("degree"))
    best = entries.join(degrees, "row").groupBy("column").agg(F.max_by(F.struct(F.col("row").alias("y"), F.col("size").alias("y_size"), F.col("at").alias("y_at")), F.struct("degree", (-F.col("row")).alias("back"))).alias("head"), F.count("*").alias("weight"))
    heads = common.cut(best.select("column", "weight", "head.*"), "heads")
    met = common.weighted_join(entries.drop("n"), heads, ["column"], "weight").where("row <> y")
    return _possible(met.select(F.col("row").alias("x"), F.col("size").alias("x_size"), F.col("at").alias("x_at"), "y", "y_size", "y_at"), percent)


def _meet_others(entries: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Each column's rows outside its largest component with its rows of other components."""
    placed = common.cut(entries.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("part", F.coalesce("root", "row")).select("column", "row", "size", "at", "part", "n"), "placed")
    parts = placed.groupBy("column", "part").agg(F.count("*").alias("rows"))
    major = parts.groupBy("column").agg(F.max_by("part", F.struct("rows", "part")).alias("major"), F.sum("rows").alias("weight"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    known = common.cut(common.weighted_join(placed, common.cut(major, "major"), ["column"], "weight"), "known")
    one = known.where("part <> major").select("column", F.col("row").alias("x"), F.col("size").alias("x_size"), F.col("at").alias("x_at"), F.col("part").alias("x_part"))
    two = known.select("column", F.col("row").alias("y"), F.col("size").alias("y_size"), F.col("at").alias("y_at"), F.col("part").alias("y_part"), (F.col("part") == F.col("major")).alias("in_major"))
    # All shared columns of a pair stand at or behind its first one, so what is left there bounds the overlap.
    left = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    fits = (left >= _overlap(F.col("x_size"), F.col("y_size"), percent)) & (F.col("x_part") != F.col("y_part")) & (F.col("in_major") | (F.col("x") < F.col("y")))
    return one.join(two, "column").where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(pdf["x"], pdf["y"])], np.int64)
            union = pdf["x"].map(len).to_numpy(np.int64) + pdf["y"].map(len).to_numpy(np.int64) - both
            yield pdf.loc[100 * both >= percent * union, ["a", "b"]]

    # Only sets of rows in pairs are shuffled: the row numbers are few and small next to the sets.
    side = lambda end, name: sets.join(pairs.select(F.col(end).alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias(end), F.col("columns").alias(name))
    with_sets = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")
    return common.cut(with_sets.select("a", "b", "x", "y").mapInPandas(count, "a long, b long"), "similar")


def _rooted(links: DataFrame) -> DataFrame:
    """(node, root) of every linked row, the roots included."""
    roots = connected_components(links, "a", "b")
    return common.cut(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")

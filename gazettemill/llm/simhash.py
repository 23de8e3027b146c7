"""SimHash near-duplicates by a grid join on per-segment bit counts.

A 64-bit fingerprint is mapped to its 16 four-bit segments' bit counts, a
point on an integer grid. Two fingerprints at Hamming distance d are at most
d apart in Manhattan distance there, so distance 2 or less means that some
grid point lies within 1 of both: each fingerprint visits its own cell and
the 32 cells next to it, and links are sought among visitors of a cell and
verified by the exact distance. Counts, cells and neighbours are packed into
one long (a nibble for each segment), in SQL arithmetic.

Equal fingerprints are one class from the start, so exact copies never meet
as pairs. In a cell with more than ``CELL`` visitors pairs aren't formed:
those fingerprints are grouped by their 65 variants of at most one changed
bit. All members of such a group are within distance 2 of each other (there
are 65 at most), any two fingerprints within distance 2 share one, and a link
to the group's smallest member joins them all. That way is exact too.

Null text counts as empty; texts without words have fingerprint 0 and link
like any other. Rows of a null doc_id keep it; they take part, and their
component_id is the smallest doc_id reachable that isn't null. Repeated rows
stay. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SEED = 42
#: Differing bits up to which fingerprints link; cells within 1 of both ends cover just this radius.
DISTANCE = 2
#: Visitors of a grid cell up to which pairs are verified one by one.
CELL = 16
_LANES = np.uint64(0x0001_0001_0001_0001)
_SEGMENT = 0xFFFF  # hashes that 16-bit lanes can count


def _shingle_hashes(text: str, size: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)]
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints_of(texts: list[str], size: int) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half the shingle hashes."""
    return _prints([_shingle_hashes(text, size) for text in texts])


def _prints(shingles: list[list[int]]) -> np.ndarray:
    out = np.zeros(len(shingles), np.uint64)
    hashes, rows, starts, first, counts = [], [], [], [], []
    at = 0
    for i, found in enumerate(shingles):
        if len(found):
            rows.append(i)
            counts.append(len(found))
            first.append(len(starts))
            starts += range(at, at + len(found), _SEGMENT)
            at += len(found)
            hashes.append(np.array(found, np.uint64))
    if not rows:
        return out
    flat = np.concatenate(hashes)
    needed = np.array(counts, np.int64)
    prints = np.zeros(len(rows), np.uint64)
    for j in range(16):
        lanes = np.add.reduceat((flat >> np.uint64(j)) & _LANES, starts)
        for lane in range(4):
            ones = np.add.reduceat(((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), first)
            prints |= (2 * ones > needed).astype(np.uint64) << np.uint64(16 * lane + j)
    out[rows] = prints
    return out


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text over ``size``-word shingles, as a signed long."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fingerprints_of(pdf["text"].tolist(), size).view(np.int64)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return texts.mapInPandas(run, "doc_id long, fp long")


def hexadecimal(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _cells(fp: str) -> F.Column:
    """The cell of the segment counts and its 32 neighbours. Nibbles hold count + 1, so none borrows."""
    pairs = F.expr(f"(({fp} ^ shiftrightunsigned({fp}, 1)) & 6148914691236517205L) | shiftleft({fp} & shiftrightunsigned({fp}, 1) & 6148914691236517205L, 1)")
    fours = pairs.bitwiseAND(F.lit(0x3333333333333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x3333333333333333))
    own = fours + F.lit(0x1111111111111111)
    return F.array(own, *(own + F.lit(sign << 4 * i) for i in range(16) for sign in (1, -1)))


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints that join all pairs within distance 2."""
    visits = common.cut(classes.select("fp", F.explode(_cells("fp")).alias("cell")), "cells")
    met = common.cut(visits.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "met")  # counted before rows of a cell meet
    visits = common.cut(common.weighted_join(visits, met, ["cell"], "n"), "visits")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    others = F.collect_list("fp").over(Window.partitionBy("cell").orderBy("fp").rowsBetween(-CELL, -1))
    few = visits.where(F.col("n") <= CELL).select("fp", others.alias("others")).select(F.col("fp").alias("a"), F.explode("others").alias("b")).where(close).distinct()
    crowded = visits.where(F.col("n") > CELL).select("fp").distinct()
    variants = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    grouped = crowded.select("fp", F.explode(variants).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    many = grouped.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b").distinct()
    return few.union(many)


def components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``prints`` (doc_id, fp)."""
    prints = common.cut(prints, "fingerprints")
    classes = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    roots = connected_components(links(classes), "a", "b").withColumnRenamed("node", "fp")
    roots = roots.union(roots.select(F.col("root").alias("fp"), "root").distinct())
    reps = roots.join(classes.select("fp", "rep"), "fp")
    joined = reps.select("fp", "root").join(reps.groupBy("root").agg(F.min("rep").alias("linked")), "root").select("fp", "linked")
    known = classes.join(joined, "fp", "left").where("n > 1 or linked is not null").select("fp", "n", F.coalesce("linked", "rep").alias("component_id"))
    return common.weighted_join(prints, common.cut(known, "known"), ["fp"], "n", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; fingerprint in 16 hexadecimal digits."""
    found = components(fingerprints(docs, size))
    return found.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


# Similar documents: prefix filter on rare shingles, verified by the exact similarity.


def _shared(size: int, least: float) -> int:
    """Shingles that a text of ``size`` shares with any similar one, at least."""
    return math.ceil(least * size - 1e-9)


def _prefix(size: int, least: float, more: int = 0) -> int:
    """First shingles, in one order for all texts, that hold the first ``more`` + 1 shared with any similar text."""
    return min(size, size - _shared(size, least) + 1 + more)


def _similarities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    common.take_over("similar texts")
    for pdf in batches:
        out = []
        for x, y in zip(pdf["x"], pdf["y"]):
            one, two = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(np.intersect1d(one, two, assume_unique=True))
            out.append(both / max(1, len(one) + len(two) - both))
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": out})


def similar_groups(docs: DataFrame, size: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id) of every document that has a similar one: Jaccard of ``size``-word shingles.

    Two texts at Jaccard similarity s share a shingle among the first
    1 - s of each, in any one order of shingles, and a tenth of all shingles
    more for a tenth more of them, so none is missed. The order by hash
    leaves the texts that have enough shingles of others there (a tenth of
    the smallest similar text's and one); among these the order is by frequency, rare ones first, so that common passages make
    no buckets unless they are nearly the whole text. Texts first meet those
    whose SimHash is within ``DISTANCE`` bits of theirs, and in a bucket its most central and its first document; then all pairs of a bucket
    that aren't yet in one component meet, unless their sizes or the number
    of their shingles found elsewhere exclude the similarity. Each candidate
    pair is verified by the shingle sets of both whole texts, and links are
    joined to components.

    Exact copies are grouped by their text's hash. group_id is the smallest
    doc_id of the group. Documents without words are one group of copies.
    Null doc_ids take no part; repeated rows of a doc_id stand for its first
    text.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).where("doc_id is not null")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        common.take_over("similar texts")
        for pdf in batches:
            found = pdf["text"].tolist()
            hashes = [np.array(_shingle_hashes(t, size), np.uint64) for t in found]
            sets = [np.unique(h).view(np.int64) for h in hashes]
            copies = [xxh64_intdigest(" ".join(t.split()).encode("utf-8", "replace")) - (1 << 63) for t in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "copies": copies, "fp": _prints(hashes).view(np.int64), "needed": [_shared(len(s), min_similarity) // 10 + 1 for s in sets], "prefix": [s[: _prefix(len(s), min_similarity, len(s) // 10)] for s in sets]})

    prints = common.cut(texts.mapInPandas(sketch, "doc_id long, copies long, fp long, needed int, prefix array<long>"), "sketches")
    classes = common.cut(prints.groupBy("copies").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("needed").alias("needed"), F.first("prefix").alias("prefix"), F.count("*").alias("n")), "classes")
    visits = classes.select("doc_id", F.explode("prefix").alias("shingle"))
    met = visits.select("doc_id", F.count("*").over(Window.partitionBy("shingle")).alias("n")).where("n > 1")
    met = common.cut(met.groupBy("doc_id").agg(F.count("*").alias("met")), "met")
    named = common.cut(classes.select("doc_id", "needed").join(met, "doc_id").where("met >= needed").select("doc_id").distinct(), "named")

    def shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.take_over("similar texts")
        for pdf in batches:
            sets = [np.unique(np.array(_shingle_hashes(t, size), np.uint64)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "hashes": [s.view(np.int64) for s in sets], "shingles": [s.astype(np.uint32).tobytes() for s in sets]})

    sets = common.cut(texts.join(named, "doc_id", "left_semi").mapInPandas(shingle_sets, "doc_id long, hashes array<long>, shingles binary").dropDuplicates(["doc_id"]), "sets")
    own = Window.partitionBy("doc_id")
    terms = sets.select("doc_id", F.size("hashes").alias("size"), F.explode("hashes").alias("shingle"))
    terms = terms.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).where("df > 1")
    terms = terms.select("doc_id", "size", "shingle", F.count("*").over(own).alias("common"), F.row_number().over(own.orderBy("df", "shingle")).alias("at"))
    first = F.least(F.col("size"), F.col("size") - F.ceil(min_similarity * F.col("size") - 1e-9) + 1)
    buckets = common.cut(terms.where(F.col("size") - F.col("common") + F.col("at") <= first).select("shingle", "doc_id", "size", "common"), "buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
        similar = both.mapInPandas(_similarities, "a long, b long, similarity double").where(F.col("similarity") >= min_similarity)
        return common.cut(similar.select("a", "b"), "similar")

    weighed = buckets.join(buckets.groupBy("doc_id").agg(F.count("*").alias("weight")), "doc_id")
    heads = weighed.groupBy("shingle").agg(F.max(F.struct("common", "weight", (-F.col("doc_id")).alias("back"))).alias("top"), F.min("doc_id").alias("first"))
    heads = heads.select("shingle", F.array_distinct(F.array(-F.col("top.back"), F.col("first"))).alias("heads"))
    met = buckets.join(heads, "shingle").select(F.col("doc_id").alias("x"), F.explode("heads").alias("y"))
    met = met.union(_near_in_print(classes.join(named, "doc_id").select("doc_id", "fp")))
    tried = common.cut(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "pairs")
    similar = verified(tried)

    roots = _rooted(similar)
    placed = common.cut(buckets.join(roots, buckets["doc_id"] == roots["node"], "left").select("shingle", "doc_id", "size", "common", F.coalesce("root", "doc_id").alias("part")), "placed")
    one, two = placed.alias("one"), placed.alias("two")
    most = F.least("one.common", "two.common", "one.size", "two.size")
    apart = (F.col("one.doc_id") < F.col("two.doc_id")) & (F.col("one.part") != F.col("two.part"))
    possible = most >= min_similarity * (F.col("one.size") + F.col("two.size") - most) - 1e-6
    rest = one.join(two, (F.col("one.shingle") == F.col("two.shingle")) & apart & possible).select(F.col("one.doc_id").alias("a"), F.col("two.doc_id").alias("b")).distinct()
    rest = common.cut(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    roots = _rooted(similar.union(verified(rest)))
    grouped = classes.join(roots, classes["doc_id"] == roots["node"], "left").where("n > 1 or root is not null")
    grouped = common.cut(grouped.select("copies", "n", F.coalesce("root", "doc_id").alias("group_id")), "grouped")
    return common.weighted_join(prints.select("copies", "doc_id"), grouped, ["copies"], "n").select("doc_id", "group_id").distinct()


def _near_in_print(prints: DataFrame) -> DataFrame:
    """(x, y): pairs of documents that join all whose fingerprints (doc_id, fp) link, equal ones by their first document."""
    prints = common.cut(prints, "prints")
    firsts = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    equal = common.weighted_join(prints, firsts.where("n > 1"), ["fp"], "n").select(F.col("doc_id").alias("x"), F.col("first").alias("y"))
    a, b = (firsts.select(F.col("fp").alias(end), F.col("first").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    return equal.where("x <> y").union(links(firsts).join(a, "a").join(b, "b").select("x", "y"))


def _rooted(links: DataFrame) -> DataFrame:
    """(node, root) of every linked document, the roots included."""
    roots = connected_components(links, "a", "b")
    return common.cut(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")


def one_of_each(docs: DataFrame, size: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of similar documents; all others stay as they are."""
    others = common.cut(similar_groups(docs, size, min_similarity).where("doc_id <> group_id").select("doc_id").distinct(), "others")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)

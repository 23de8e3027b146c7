"""Context-triggered piecewise hashing: chunk signatures compared by edit distance.

A rolling hash over seven bytes ends a chunk wherever its top bits are zero,
so boundaries depend on nearby content alone. A fingerprint reads
``k:first:second``: the chunk signature at block size 2**k and at 2**(k+1),
one of 64 characters for each chunk; k follows from the text's length so that
the first has about 64 chunks. Two fingerprints compare where a block size
is common to both, by the share of their signatures that an insert-delete
edit distance leaves alike; signatures without any common run of four
characters (or of all, if shorter) are unlike.

Null text counts as empty (fingerprint ``0::``). Equal texts have equal
fingerprints and likeness 1. Documents are ordered by descending doc_id, ties
by descending text, null doc_ids last; a single document is followed by
itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the hash: window, multipliers, signature characters.
WINDOW, MULTIPLIER, MIX, SPREAD = 7, 0x01000193, 0x9E3779B1, 0x85EBCA6B
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
CHUNKS = 64
LONGEST = 4
RUN = 4


def _window_hashes(data: np.ndarray) -> np.ndarray:
    out = data.astype(np.uint32)
    factor = 1
    for j in range(1, min(WINDOW, len(data))):
        factor = factor * MULTIPLIER & 0xFFFFFFFF
        out[j:] += data[:-j] * np.uint32(factor)
    return out * np.uint32(MIX)


def _signature(hashes: np.ndarray, k: int) -> str:
    """A character for each chunk; one of ``LONGEST`` block sizes without a boundary ends there."""
    ends = np.flatnonzero(hashes >> np.uint32(32 - k) == 0) if k else np.arange(len(hashes))
    starts = np.append(0, ends + 1)
    starts = starts[starts < len(hashes)]
    longest = LONGEST << k
    if len(wide := np.flatnonzero(np.diff(starts, append=len(hashes)) > longest)):
        after = np.append(starts, len(hashes))
        starts = np.sort(np.concatenate([starts, *(np.arange(after[i] + longest, after[i + 1], longest) for i in wide)]))
    sums = np.add.reduceat(hashes ^ (hashes >> np.uint32(15)), starts, dtype=np.uint32)
    return ALPHABET[(sums * np.uint32(SPREAD)) >> np.uint32(26)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if not len(data):
        return "0::"
    k = max(0, (len(data) - 1).bit_length() - CHUNKS.bit_length() + 1)
    hashes = _window_hashes(data)
    return f"{k}:{_signature(hashes, k)}:{_signature(hashes, k + 1)}"


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & where.get(c, 0)
        row = (row + match) | (row - match)
        row &= full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common_subsequence(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1: the best agreement of signatures at a block size that both have."""
    if one == other:
        return 1.0
    (ka, a1, a2), (kb, b1, b2) = one.split(":"), other.split(":")
    at, bt = {int(ka): a1, int(ka) + 1: a2}, {int(kb): b1, int(kb) + 1: b2}
    return max((_alike(at[k], bt[k]) for k in at.keys() & bt.keys()), default=0.0)


def _pair(doc_id, text: str, print_: str, following: str, next_print: str) -> dict:
    take = len(text) // 3
    edited = text[: len(text) - take] + following[:take]
    edited_print = fingerprint(edited)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
        "fingerprint": print_, "edited_fingerprint": edited_print,
        "near_edited": likeness(print_, edited_print), "near_next": likeness(print_, next_print),
    }


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _RESULT.split(", ")]).astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64", "edited_sha256": object, "fingerprint": object, "edited_fingerprint": object})


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text edited with its successor's.

    Range partitions stream in order; only the last document of a partition
    lacks its successor, the first of the next non-empty one. Those edge rows
    (two for each partition) are joined by partition number afterwards.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
        .repartitionByRange(common.partitions(spark), F.col("doc_id").desc_nulls_last())  # ids alone are sampled for the ranges
        .sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    )

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, edge = TaskContext.get().partitionId(), None, None
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                now = (doc_id, text, fingerprint(text))
                if held:
                    rows.append(_pair(*held, *now[1:]))
                else:
                    edge = text
                held = now
            yield _frame(rows).assign(part=part, head=None, tail=None).astype({"head": object, "tail": object})
        if held:
            last = {"doc_id": held[0], "n_chars": len(held[1]), "fingerprint": held[2], "near_edited": 0.0, "near_next": 0.0}
            yield _frame([last]).assign(part=part, head=edge, tail=held[1]).astype({"head": object, "tail": object})

    streamed = common.cut(ordered.mapInPandas(stream, f"{_RESULT}, part int, head string, tail string"), "streamed")
    edges = streamed.where("tail is not null")
    order = Window.orderBy("part")  # a row for each partition
    following = F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    numbers = edges.select("part", following.alias("next_part"))
    heads = edges.select(F.col("part").alias("next_part"), F.col("head").alias("following"))
    open_rows = edges.select("part", "doc_id", F.col("tail").alias("text")).join(numbers, "part").join(heads, "next_part").select("doc_id", "text", "following")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _frame([_pair(d, t, fingerprint(t), f, fingerprint(f)) for d, t, f in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["following"])])

    closed = open_rows.mapInPandas(close, _RESULT)
    return streamed.where("tail is null").select(closed.columns).union(closed)

"""Line dedup: range-partitioned line hashes, streamed in (key, document, position) order.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased. Keys of ``min_chars`` code points or more in ``min_docs`` or more
documents lose all their lines except those of the largest doc_id that holds
them. Keys travel as two independent 64-bit hashes.

Lines are dealt out by ranges of (hash, document), so the ranges themselves
split a key that a third of all documents hold. Each partition streams its
sorted runs; a run inside it is decided there, and the first and last run,
which may go on in the next partition, are decided from counts over all
partitions. The result is a compressed keep bitmap for each document that
loses a line, not text.

Null or empty text is one empty line. A document is a doc_id (null: one
document, smaller than any other); repeated rows of a doc_id count once and
lose the same lines, each row by its own text. An empty table gives no rows.
Other columns pass through ``apply``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_NO_ID = -(1 << 63)
_DOC, _BODY, _BITMAP, _LOST = "__gm_doc", "__gm_body", "__gm_bitmap", "__gm_lost"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STREAMED = "doc long, body long, pos int, n_lines int, h1 long, h2 long, open boolean, docs_here long"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the join key of a row: its document and the hash of its text."""
    return docs.withColumns({_DOC: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), _BODY: F.xxhash64(common.text_or_empty())})


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, body, n_lines, pos, h1, h2) of the lines that are long enough."""
    lines = F.split(common.text_or_empty(), "\n", -1)
    rows = _keyed(docs).select(F.col(_DOC).alias("doc"), F.col(_BODY).alias("body"), F.size(lines).alias("n_lines"), F.posexplode(lines).alias("pos", "line"))
    trimmed = rows.withColumn("line", F.btrim("line", F.lit(" \t\n\x0b\f\r"))).where(F.length("line") >= min_chars)
    key = F.translate("line", _UPPER, _LOWER)
    return trimmed.select("doc", "body", "n_lines", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _stream(min_docs: int):
    def decide(rows: pd.DataFrame, first_open: bool, last_open: bool) -> pd.DataFrame:
        h1, h2, doc = (rows[c].to_numpy() for c in ("h1", "h2", "doc"))
        new = np.ones(len(rows), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        n_docs = np.add.reduceat(other.astype(np.int64), starts)
        last = doc[np.append(starts[1:], len(rows)) - 1]
        is_open = np.zeros(len(starts), bool)
        is_open[0] |= first_open
        is_open[-1] |= last_open
        keep = is_open[run] | ((n_docs[run] >= min_docs) & (doc != last[run]))
        # An open run's documents are counted once, on its first row: ranges split by document, so counts add up.
        here = np.where(new & is_open[run], n_docs[run], 0)
        return rows[keep].assign(open=is_open[run][keep], docs_here=here[keep])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.take_over("lines")
        held: list[pd.DataFrame] = []  # the run that goes on, in pieces
        first = True
        for pdf in batches:
            if not len(pdf):
                continue
            h1, h2 = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
            same = (h1 == h1[-1]) & (h2 == h2[-1])
            goes_on = len(pdf) - int(same.sum())  # sorted: the last key's rows stand together
            if held and (goes_on or held[-1]["h1"].iat[-1] != h1[0] or held[-1]["h2"].iat[-1] != h2[0]):
                done = pd.concat([*held, pdf[:goes_on]])
                yield decide(done, first, False)
                held, first = [], False
            elif not held and goes_on:
                yield decide(pdf[:goes_on], first, False)
                first = False
            held.append(pdf[goes_on:])
        if held:
            yield decide(pd.concat(held), first, True)

    return stream


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, body, n_lines, pos) of every line that goes."""
    spark = docs.sparkSession
    hashes = common.cut(line_hashes(docs, min_chars), "lines")
    common.small_batches(spark)
    ordered = hashes.select("doc", "body", "pos", "n_lines", "h1", "h2").repartitionByRange(common.partitions(spark), "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "body", "pos")
    streamed = common.cut(ordered.mapInPandas(_stream(min_docs), _STREAMED), "streamed")
    undecided = streamed.where("open")
    totals = undecided.groupBy("h1", "h2").agg(F.sum("docs_here").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs)
    late = undecided.join(F.broadcast(totals), ["h1", "h2"]).where("doc <> last")  # at most two open runs for each partition
    columns = ["doc", "body", "n_lines", "pos"]
    return streamed.where("not open").select(columns).union(late.select(columns))


@F.pandas_udf(T.BinaryType())
def _bitmap(positions: pd.Series, n_lines: pd.Series) -> pd.Series:
    common.take_over("lines")

    def one(drop, n):
        keep = np.ones(n, bool)
        keep[np.asarray(drop, np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(d, n) for d, n in zip(positions, n_lines)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, body, n_lines, n_dropped, bitmap) of the documents that lose lines; bitmap: zlib of packed keep bits."""
    by_doc = dropped_lines(docs, min_chars, min_docs).groupBy("doc", "body").agg(F.collect_set("pos").alias("drop"), F.first("n_lines").alias("n_lines"))
    return by_doc.select("doc", "body", "n_lines", F.size("drop").cast("long").alias("n_dropped"), _bitmap("drop", "n_lines").alias("bitmap"))


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    common.take_over("lines")

    def one(t, b):
        if b is None:
            return t
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=len(lines))
        return "\n".join([x for x, k in zip(lines, keep.tolist()) if k])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap)], dtype=object)


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the kept text (never null) and n_lines, n_dropped."""
    common.small_batches(docs.sparkSession)
    mine = bitmaps.select(F.col("doc").alias(_DOC), F.col("body").alias(_BODY), F.col("n_dropped").alias(_LOST), F.col("bitmap").alias(_BITMAP))
    texts = _keyed(docs).withColumn("text", common.text_or_empty())
    joined = texts.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")).join(mine, [_DOC, _BODY], "left")
    kept = joined.withColumns({"n_dropped": F.coalesce(_LOST, F.lit(0).cast("long")), "text": _kept("text", _BITMAP)})
    return kept.drop(_DOC, _BODY, _BITMAP, _LOST)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    return apply(docs, keep_bitmaps(docs, min_chars, min_docs))

"""Token-ID files: flat unsigned ids, 64-bit document offsets, memory-mapped reads.

Layout in the output folder, one set for each range partition of doc_id:

* ``part-N.bin``  ids, unsigned 16-bit if the vocabulary fits, else 32-bit, little-endian
* ``part-N.doc``  signed 64-bit doc_id of each document (smallest value: null)
* ``part-N.off``  unsigned 64-bit global offsets, one more than documents
* ``manifest``    Parquet table: part, paths, documents, tokens and their global bases

A task writes under a name of its own attempt and reports it in the manifest
row, so a retried or speculative task leaves only an unreferenced file. Bases
are prefix sums over the manifest (a row for each partition), added in a
second pass that writes the offsets.

Null text counts as empty (the end id alone). Repeated doc_ids follow each
other, ordered by text; a null doc_id comes first. An empty table gives no
parts. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

_NULL_ID = np.iinfo(np.int64).min
_MANIFEST = "part long, bin string, doc string, len string, dtype string, n_docs long, n_tokens long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class TokenFiles:
    """A finished set of files; ``manifest`` has a row for each part."""

    manifest: DataFrame

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids) of each document; ids: little-endian unsigned 32-bit."""
        spark = self.manifest.sparkSession
        parts = self.manifest.repartitionByRange(common.partitions(spark), "part")
        return parts.mapInPandas(_read_parts, "doc_id long, start long, n_tokens long, ids binary")


def write(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int) -> TokenFiles:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order."""
    spark = docs.sparkSession
    common.small_batches(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
        .repartitionByRange(common.partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def write_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(out_dir)
        enc = encoder(tokenizer_path)
        dtype = np.dtype("<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4")
        end = np.array([end_id], dtype).tobytes()
        part = TaskContext.get().partitionId()
        names = {kind: f"{base}/part-{part:06d}-{uuid.uuid4().hex}.{kind}" for kind in ("bin", "doc", "len")}
        n_docs = n_tokens = 0
        with fs.open_output_stream(names["bin"]) as ids_out, fs.open_output_stream(names["doc"]) as doc_out, fs.open_output_stream(names["len"]) as len_out:
            for pdf in batches:
                lengths = []
                for raw in enc.encode(pdf["text"].tolist()):
                    ids_out.write(np.frombuffer(raw, "<u4").astype(dtype).tobytes() + end)
                    lengths.append(len(raw) // 4 + 1)
                doc_ids = [_NULL_ID if pd.isna(x) else int(x) for x in pdf["doc_id"]]
                doc_out.write(np.array(doc_ids, "<i8").tobytes())
                len_out.write(np.array(lengths, "<u8").tobytes())
                n_docs, n_tokens = n_docs + len(lengths), n_tokens + sum(lengths)
        if n_docs:
            yield pd.DataFrame([[part, names["bin"], names["doc"], names["len"], dtype.str, n_docs, n_tokens]], columns=_columns(_MANIFEST))
        else:
            for name in names.values():
                fs.delete_file(name)

    counted = common.cut(ordered.mapInPandas(write_part, _MANIFEST), "counted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    based = counted.select(
        "*",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"),
    )

    def write_offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _filesystem(out_dir)
        for pdf in batches:
            offs = []
            for row in pdf.itertuples():
                with fs.open_input_stream(row.len) as f:
                    lengths = np.frombuffer(f.read(), "<u8")
                offs.append(row.len[:-4] + f"-{uuid.uuid4().hex}.off")
                with fs.open_output_stream(offs[-1]) as f:
                    f.write((np.concatenate([[0], np.cumsum(lengths)]) + row.token_base).astype("<u8").tobytes())
            yield pdf.assign(off=offs, dir=out_dir).drop(columns="len")

    schema = _MANIFEST.replace(" len string,", "") + ", doc_base long, token_base long, off string, dir string"
    done = based.repartitionByRange(common.partitions(spark), "part").mapInPandas(write_offsets, schema)
    return TokenFiles(common.cut(done, "manifest"))


def load(spark: SparkSession, manifest_path: str) -> TokenFiles:
    return TokenFiles(spark.read.parquet(manifest_path))


def _columns(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    """The file memory-mapped where it lies on a mounted disk, else read from its store."""
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _read_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            fs, _ = _filesystem(row.dir)
            ids, docs, offs = _mapped(fs, row.bin, row.dtype), _mapped(fs, row.doc, "<i8"), _mapped(fs, row.off, "<u8")
            local = (offs - np.uint64(row.token_base)).astype(np.int64)
            for lo in range(0, row.n_docs, 500):
                hi = min(lo + 500, row.n_docs)
                doc_id = pd.array(docs[lo:hi].tolist(), dtype="Int64")
                doc_id[np.asarray(docs[lo:hi]) == _NULL_ID] = pd.NA
                yield pd.DataFrame({
                    "doc_id": doc_id,
                    "start": offs[lo:hi].astype(np.int64),
                    "n_tokens": local[lo + 1 : hi + 1] - local[lo:hi],
                    "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(local[lo:hi], local[lo + 1 : hi + 1])],
                })

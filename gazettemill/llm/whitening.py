"""Whitening of embeddings with MLlib's BlockMatrix.

A vector's entries become integers x = floor(scale * c). The fit list holds
each different x vector once: n vectors with per-dimension sums S. Its
centred rows (n * x - S) / n are gathered into dense blocks of ``_CELLS``
numbers and written with one shared layout: block number ``flat`` is row block
``flat`` of a tall BlockMatrix, and place (flat // side, flat % side) of a
square one.

* Scatter: transpose of the tall matrix times itself, with the middle
  dimension split so that a task holds ``_SHARE`` blocks of each side; only
  the dimensions x dimensions result reaches the driver, for ``eigh``.
* Projection: the square matrix times a block diagonal of copies of the
  whitening matrix (eigenvectors over the roots of their eigenvalues). In the
  square layout MLlib spreads the product over as many tasks as there are
  partitions; of a tall one it would make only the root of that.

Projected rows are joined back to all rows of the table by a 128-bit hash of
x; vectors that very many rows share are broadcast (``common.weighted_join``).
The driver holds one matrix of dimensions x dimensions and MLlib's list of
block numbers (one for each ``_CELLS`` numbers).

Rows whose vector is null or holds a null, NaN or infinite entry are dropped.
Shorter vectors than the longest count as ending in zeros. Rows of a null or
repeated vec_id stay, each with its own result rows; ties have one result as
equal vectors share it. Components with an eigenvalue of zero, up to rounding,
don't exist: a single different vector, or vectors without entries, give no
rows, nor does an empty table. Other columns are ignored. A deviation that
doesn't fit into 64 bits is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Numbers of a dense block: 2 MB.
_CELLS = 1 << 18
#: Blocks of each side that a task of the scatter product holds.
_SHARE = 16
_EDGE = 9.0e18  # below it a sum of squares surely fits into 64 bits
_KEYS = ["k1", "k2"]


@dataclass(frozen=True)
class Whitened:
    """``rows``: (vec_id, deviation, whitened array) of each remaining row; the rest describes the fit list."""

    rows: DataFrame
    n: int
    explained: list[float]
    identity_error: float


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x, k1, k2) of the rows that remain: x padded to the longest vector, and its 128-bit hash."""
    c = F.col("embedding")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.select("vec_id", "embedding").where(c.isNotNull() & sound)
    lengths = kept.agg(F.min(F.size(c)), F.max(F.size(c))).first()
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    if lengths[0] != lengths[1]:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(lengths[1]) - F.size(c)))
    return kept.select("vec_id", x.alias("x")).withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(1), "x")})


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        x = np.stack(pdf["x"].to_numpy())
        wide = len(x) * float(np.abs(x.astype(np.float64)).max(initial=0)) > 2**62
        totals = (x.astype(object) if wide else x).sum(axis=0)
        yield pd.DataFrame({"at": range(len(totals)), "total": [Decimal(int(t)) for t in totals]})


def _block_matrix(df: DataFrame, rows: int, cols: int, n_rows: int, n_cols: int) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", df, rows, cols, n_rows, n_cols), rows, cols)


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> Whitened:
    """The remaining rows of ``vectors`` (vec_id, embedding), projected on the first ``components`` components."""
    spark = vectors.sparkSession
    rows = integers(vectors, scale)
    fit = common.cut(rows.groupBy("x").agg(F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.count("*").alias("copies")), "fit")
    n = fit.count()
    totals = fit.where(F.size("x") > 0).mapInPandas(_sums, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    s = [int(t["total"]) for t in totals]  # one for each dimension
    d = len(s)
    nothing = Whitened(rows.select("vec_id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).where("false"), n, [], 0.0)
    if n < 2 or d == 0:
        return nothing
    per_block = max(1, _CELLS // d)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []
        wide_sums, sums = np.array([float(v) for v in s]), np.array([(v + 2**63) % 2**64 - 2**63 for v in s], np.int64)

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["x"].to_numpy())
            about = x.astype(np.float64) * n - wide_sums
            with np.errstate(over="ignore"):
                exact = x * np.int64(n) - sums  # right wherever the difference fits, whatever wraps on the way
            centred = np.where(np.abs(about) < _EDGE, exact, about) / n
            size = np.square(about).sum(axis=1)
            deviation = [int(v) if ok else None for v, ok in zip(np.square(exact).sum(axis=1), size < _EDGE)]
            for i in np.flatnonzero((size >= _EDGE) & (size < 2 * _EDGE)):
                whole = sum((n * int(v) - t) ** 2 for v, t in zip(x[i], s))
                deviation[i] = whole if whole < 2**63 else None
            full = np.zeros((per_block, d))
            full[: len(x)] = centred
            return pd.DataFrame({"part": [part], "seq": [seq], "values": [full.ravel()], "k1": [pdf["k1"].to_numpy()], "k2": [pdf["k2"].to_numpy()], "copies": [pdf["copies"].to_numpy()], "deviation": [pd.array(deviation, "Int64")]})

        for pdf in batches:
            held.append(pdf)
            while sum(map(len, held)) >= per_block:
                whole = pd.concat(held, ignore_index=True)
                yield block(whole[:per_block])
                seq, held = seq + 1, [whole[per_block:]]
        if sum(map(len, held)):
            yield block(pd.concat(held, ignore_index=True))

    shape = "part long, seq long, values array<double>, k1 array<long>, k2 array<long>, copies array<long>, deviation array<long>"
    placed = common.cut(fit.mapInPandas(blocks, shape), "centred")
    across, longest, count = placed.agg(F.max("part"), F.max("seq"), F.count("*")).first()
    flat = F.col("part") * (longest + 1) + F.col("seq")
    total = (across + 1) * (longest + 1)
    side = math.isqrt(total - 1) + 1
    as_matrix = F.struct(F.lit(1).cast("tinyint").alias("type"), F.lit(per_block).alias("numRows"), F.lit(d).alias("numCols"), F.lit(None).cast("array<int>").alias("colPtrs"), F.lit(None).cast("array<int>").alias("rowIndices"), F.col("values"), F.lit(True).alias("isTransposed"))
    # Parquet stores a matrix as the struct it consists of, so a struct written is a matrix when read with that type.
    index = lambda row, col: F.struct(row.cast("long").alias("_1"), col.cast("long").alias("_2"))
    at = T.StructType().add("_1", "long").add("_2", "long")
    path = common.write(placed.select(index(flat, F.lit(0)).alias("tall"), index(F.floor(flat / side), flat % side).alias("square"), as_matrix.alias("matrix")), "blocks")
    matrices = spark.read.schema(T.StructType().add("tall", at).add("square", at).add("matrix", MatrixUDT())).parquet(path)

    tall = _block_matrix(matrices.select("tall", "matrix"), per_block, d, total * per_block, d)
    java = tall._java_matrix_wrapper._java_model
    scatter = BlockMatrix(java.transpose().multiply(java, max(1, -(-count // _SHARE))), d, d).toLocalMatrix().toArray()
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, axes = values[::-1], axes[:, ::-1]
    k = int(min(components, (values > values[0] * d * np.finfo(float).eps).sum())) if values[0] > 0 else 0
    if k == 0:
        return nothing
    matrix = axes[:, :k] / np.sqrt(values[:k])
    explained = [float(v / values.sum()) for v in values[:k]]

    copies = spark.sparkContext.parallelize(range(side), min(side, common.partitions(spark))).map(lambda j: ((j, j), Matrices.dense(d, k, matrix.ravel(order="F"))))
    square = _block_matrix(matrices.select("square", "matrix"), per_block, d, side * per_block, side * d)
    projected = square.multiply(BlockMatrix(copies, d, k, side * d, side * k))
    path = common.write(callMLlibFunc("getMatrixBlocks", projected._java_matrix_wrapper._java_model).toDF("at", "matrix"), "projected")
    dense = spark.read.schema(T.StructType().add("at", at).add("matrix", MatrixUDT.sqlType())).parquet(path)
    columns = [F.slice("matrix.values", 1 + c * per_block, per_block).alias(f"z{c}") for c in range(k)]  # results are stored by columns
    met = dense.select((F.col("at._1") * side + F.col("at._2")).alias("flat"), *columns).join(placed.select(flat.alias("flat"), *_KEYS, "copies", "deviation"), "flat")
    points = met.select(F.inline(F.arrays_zip(*_KEYS, "copies", "deviation", *(f"z{c}" for c in range(k))))).where("copies is not null")
    z = [f"z{c}" for c in range(k)]
    points = common.cut(points.select(*_KEYS, "copies", "deviation", F.array(*z).alias("whitened")), "points")
    of = lambda c: F.col("whitened")[c]
    moments = points.agg(*(F.avg(of(a)) for a in range(k)), *(F.avg(of(a) * of(b)) for a in range(k) for b in range(k))).first()
    mean, second = np.array(moments[:k]), np.array(moments[k:]).reshape(k, k)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    joined = common.weighted_join(rows.select("vec_id", *_KEYS), points, _KEYS, "copies")
    return Whitened(joined.select("vec_id", "deviation", "whitened"), n, explained, error)


def by_component(done: Whitened) -> DataFrame:
    """One row for each row and component, numbered from 1."""
    told = F.array(*(F.lit(v) for v in done.explained)) if done.explained else F.array().cast("array<double>")
    rows = done.rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(done.n).cast("long").alias("n"), "deviation", "whitened", told[F.col("at")].alias("explained"), F.lit(done.identity_error).alias("identity_error"))

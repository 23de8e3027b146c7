"""Leading principal coordinates of a sparse incidence: block Krylov iteration by joins and sums.

The row-normalised, column-centred matrix M (outlets x stories) is never
formed: M M' times a few columns is two joins of the sparse pairs with those
columns, two sums and a correction by means. Up to ``_BASIS`` outlets are spanned
at once, and one join and one sum do. The columns of all outlets
stay a table; what reaches the driver are inner products of columns, at most
``2 * _BASIS`` squared numbers, whatever the number of outlets and stories.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: Columns multiplied at once, and columns of the basis at which it starts again from its best.
_BLOCK, _BASIS = 16, 96


def _products(table: DataFrame, left: str, right: str) -> np.ndarray:
    """Inner products of the array columns' entries over all rows."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = np.stack(pdf["a"]).T @ np.stack(pdf["b"])
                yield pd.DataFrame({"width": [p.shape[1]], "p": [p.ravel()]})

    wide = table.select(F.col(left).alias("a"), F.col(right).alias("b"))
    rows = wide.mapInPandas(partial, "width int, p array<double>").select("width", F.posexplode("p").alias("at", "p")).groupBy("width", "at").agg(F.sum("p").alias("p")).orderBy("at").toPandas()
    return rows["p"].to_numpy().reshape(-1, rows["width"].iat[0]) if len(rows) else np.zeros((0, 0))


def _mapped(table: DataFrame, keep: list[str], **made) -> DataFrame:
    """``table`` with new array columns, each a function of the row arrays: name=(columns, matrices)."""
    names = list(made)
    used = sorted({c for columns, _ in made.values() for c in columns})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                stacked = {c: np.stack(pdf[c]) for c in used}
                out = pdf[keep].copy()
                for name in names:
                    out[name] = list(sum(stacked[c] @ m for c, m in zip(*made[name])))
                yield out

    kinds = dict(table.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{n} array<double>" for n in names])
    return table.select(*dict.fromkeys([*keep, *used])).mapInPandas(run, schema)


def principal_coordinates(pairs: DataFrame, row: str = "outlet_id", column: str = "story_id", k: int = 2, tolerance: float = 1e-9, rounds: int = 60) -> tuple[DataFrame, list[float]]:
    """((row, coordinates array), shares of the total variance) of the ``k`` leading axes.

    ``pairs`` holds distinct (row, column); they are read twice. An axis points to the side of its
    largest coordinate. With more rows than ``_BASIS`` it ends when the residuals of the leading
    axes are below ``tolerance`` of the largest eigenvalue, or nothing new is left to span.
    """
    spark, path = pairs.sparkSession, shared_dir(pairs.sparkSession, "axes")
    step = iter(range(1_000_000))

    def written(table: DataFrame) -> DataFrame:
        name = f"{path}/{next(step)}"
        table.write.parquet(name)
        return spark.read.schema(table.schema).parquet(name)

    sizes = pairs.groupBy(row).agg((1 / F.sqrt(F.count("*"))).alias("w"))
    n = sizes.count()
    # A column's entries stand together, so that the sums over it are made before the shuffle.
    entries = written(pairs.join(sizes, row).select(row, column, "w").repartition(column).sortWithinPartitions(column))
    masses = entries.groupBy(column).agg(F.sum("w").alias("mass"), F.sum(F.col("w") * F.col("w")).alias("squares"))
    told = masses.agg(F.sum("squares"), F.sum(F.col("mass") * F.col("mass"))).first()
    total = (told[0] or 0.0) - (told[1] or 0.0) / max(n, 1)

    def projected(table: DataFrame, name: str) -> DataFrame:
        """(column, z0 ...): M' times the array column; a column's mean comes from a further sum, of its weights."""
        width = table.select(F.size(name)).first()[0]
        parts = [F.col(name)[i] for i in range(width)]
        sums = table.agg(*(F.sum(p) for p in parts)).first()
        up = entries.join(table.select(row, name), row).groupBy(column).agg(F.sum("w").alias("mass"), *(F.sum(F.col("w") * p).alias(f"z{i}") for i, p in enumerate(parts)))
        return up.select(column, *((F.col(f"z{i}") - F.col("mass") * F.lit(float(sums[i]) / n)).alias(f"z{i}") for i in range(width)))

    def multiplied(table: DataFrame, name: str) -> DataFrame:
        """(row, y): M M' times the array column; what the centring takes off is the mean over all rows."""
        held = projected(table, name)
        z = [c for c in held.columns if c != column]
        down = written(entries.join(held, column).groupBy(row).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in z)))
        shift = down.agg(*(F.avg(c) for c in z)).first()
        return down.select(row, F.array(*(F.col(c) - F.lit(float(m)) for c, m in zip(z, shift))).alias("y"))

    def orthonormal(table: DataFrame, against: bool) -> DataFrame | None:
        """The new columns y without what ``v`` spans, of unit length and orthogonal; twice, for rounding's sake."""
        least = None
        for _ in range(2):
            whole = table.withColumn("both", F.concat("v", "y")) if against else table.withColumn("both", F.col("y"))
            gram = _products(whole, "both", "both")
            d = len(gram) - table.select(F.size("y")).first()[0]
            inside, own = gram[:d, d:], gram[d:, d:]
            least = max(1e-20 * own.diagonal().max(initial=0.0), 1e-280) if least is None else 1e-8
            values, axes = np.linalg.eigh(own - inside.T @ inside)
            some = values > least
            if not some.any():
                return None
            turn = axes[:, some] / np.sqrt(values[some])
            table = written(_mapped(table, [row, "v"], y=(["y", "v"], [turn, -inside @ turn])) if against else _mapped(table, [row], y=(["y"], [turn])))
        return table

    spanned = n <= _BASIS  # the basis spans all rows, so inner products of the projections are the whole matrix
    seeds = F.array(*(F.xxhash64(row, F.lit(i)) / F.lit(2.0**63) for i in range(n if spanned else _BLOCK)))
    started = orthonormal(written(entries.select(row).distinct().select(row, seeds.alias("y"))), False)
    basis = written(started.select(row, F.col("y").alias("v"), F.array().cast("array<double>").alias("kv"))) if started is not None else None
    block = None if started is None else started.select(row, F.col("y").alias("v"))
    values = vectors = None
    if spanned and block is not None:
        held = projected(block, "v")
        small = _products(held.select(F.array(*(c for c in held.columns if c != column)).alias("z")), "z", "z")
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
    for _ in range(rounds if block is not None and not spanned else 0):
        basis = written(basis.join(multiplied(block, "v"), row).select(row, "v", F.concat("kv", "y").alias("kv"), "y"))
        small = _products(basis, "v", "kv")
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        top = vectors[:, :k]
        square = _products(basis, "kv", "kv")
        off = np.sqrt(np.maximum(np.diag(top.T @ square @ top) - values[:k] ** 2, 0))
        if (off <= tolerance * max(values[0], 1e-300)).all():
            break
        if len(values) + _BLOCK > _BASIS:  # start again from the best of what is spanned
            best = vectors[:, :_BLOCK]
            basis = written(_mapped(basis, [row], v=(["v"], [best]), kv=(["kv"], [best])))
            basis = written(basis.select(row, "v", "kv", F.col("kv").alias("y")))
        grown = orthonormal(basis.select(row, "v", "y"), True)
        if grown is None:
            break
        block = grown.select(row, F.col("y").alias("v"))
        basis = written(basis.select(row, F.col("v").alias("old"), "kv").join(block, row).select(row, F.concat("old", "v").alias("v"), "kv"))
    if values is None or total <= 0:
        return entries.select(row).distinct().select(row, F.array(*(F.lit(0.0) for _ in range(k))).alias("coordinates")), [0.0] * k
    k = min(k, len(values))
    width = basis.select(F.size("v")).first()[0]
    scaled = vectors[:width, :k] * np.sqrt(np.maximum(values[:k], 0))
    placed = written(_mapped(basis, [row], coordinates=(["v"], [scaled])))
    ends = placed.agg(*(F.max_by(F.signum(F.col("coordinates")[i]), F.struct(F.abs(F.col("coordinates")[i]), F.col(row))) for i in range(k))).first()
    turned = [F.col("coordinates")[i] * F.lit(float(e) or 1.0) for i, e in enumerate(ends)]
    return placed.select(row, F.array(*turned).alias("coordinates")), [float(max(v, 0) / total) for v in values[:k]]

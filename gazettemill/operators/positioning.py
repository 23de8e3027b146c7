"""Positions of articles and outlets by ridge regression on human labels, with cross-validated error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of (1, features, label) by axis and fold, of a batch's rows."""
    for pdf in batches:
        for (axis, fold), part in pdf.groupby(["axis", "fold"]):
            z = np.column_stack([np.ones(len(part)), np.stack(part["features"]).astype(np.float64), part["label"]])
            yield pd.DataFrame({"axis": [axis], "fold": [fold], "m": [(z.T @ z).ravel()]})


def _ridge(m: np.ndarray, alpha: float) -> np.ndarray:
    """Weights, the free intercept first, from the summed products."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    w = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(len(centred) - 1), centred[:-1, -1])
    return np.concatenate([[mean[-1] - mean[:-1] @ w], w])


def fit(examples: DataFrame, alpha: float = 1.0, least: int = 200) -> dict[str, dict]:
    """axis -> n, mae and weights, from (article_id, axis, features, label); axes with fewer than ``least`` examples have none.

    One pass sums the products of each axis and fold; a fold's model comes from the sums of the others. A second
    pass measures every example with the model that hasn't seen it. Folds go by the article's hash.
    """
    sound = examples.where("features is not null and label is not null and axis is not null")
    enough = [r["axis"] for r in sound.groupBy("axis").count().where(F.col("count") >= least).collect()]
    rows = sound.where(F.col("axis").isin(enough)).select("axis", F.pmod(F.xxhash64("article_id"), F.lit(FOLDS)).alias("fold"), "features", F.col("label").cast("double").alias("label"))
    sums = rows.mapInPandas(_moments, "axis string, fold long, m array<double>").select("axis", "fold", F.posexplode("m").alias("at", "m")).groupBy("axis", "fold", "at").agg(F.sum("m").alias("m")).orderBy("axis", "fold", "at").toPandas()
    by = {key: g["m"].to_numpy().reshape(int(np.sqrt(len(g))), -1) for key, g in sums.groupby(["axis", "fold"])}
    whole = {axis: sum(m for (a, _), m in by.items() if a == axis) for axis in enough}
    left_out = {(axis, fold): _ridge(whole[axis] - m, alpha) for (axis, fold), m in by.items()}

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby(["axis", "fold"]):
                off = left_out[key][0] + np.stack(part["features"]) @ left_out[key][1:] - part["label"]
                yield pd.DataFrame({"axis": [key[0]], "fold": [key[1]], "off": [float(np.abs(off).sum())], "n": [len(part)]})

    folds = rows.mapInPandas(errors, "axis string, fold long, off double, n long").groupBy("axis", "fold").agg((F.sum("off") / F.sum("n")).alias("mae"), F.sum("n").alias("n"))
    told = {r["axis"]: r for r in folds.groupBy("axis").agg(F.avg("mae").alias("mae"), F.sum("n").alias("n")).collect()}
    return {axis: {"n": told[axis]["n"], "mae": told[axis]["mae"], "weights": _ridge(whole[axis], alpha)} for axis in sorted(enough)}


def outlet_positions(articles: DataFrame, models: dict[str, dict]) -> DataFrame:
    """(outlet, axis, articles, position, mae, examples): mean predictions, never of single articles; (outlet, features) in."""
    weights = {axis: model["weights"] for axis, model in models.items()}

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["features"])
                for axis, w in weights.items():
                    part = pd.DataFrame({"outlet": pdf["outlet"], "axis": axis, "total": w[0] + x @ w[1:], "n": 1})
                    yield part.groupby(["outlet", "axis"], as_index=False, dropna=False).sum()

    sums = articles.where("features is not null").select(F.col("outlet").cast("string").alias("outlet"), "features").mapInPandas(predict, "outlet string, axis string, total double, n long").groupBy("outlet", "axis").agg(F.sum("n").alias("articles"), (F.sum("total") / F.sum("n")).alias("position"))
    told = articles.sparkSession.createDataFrame([(a, float(m["mae"]), int(m["n"])) for a, m in models.items()], "axis string, mae double, examples long")
    return sums.join(told, "axis").select("outlet", "axis", "articles", "position", "mae", "examples")

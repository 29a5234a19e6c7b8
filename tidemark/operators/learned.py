"""Fitted substitutes for learned detectors and classifiers, on Spark's own ML library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import pin
from tidemark.functions.fourier import DOUBLES

def _vectors(windows: DataFrame, col: str) -> DataFrame:
    return windows.withColumn("_v", array_to_vector(F.col(col)))


def fit_low_rank(
    windows: DataFrame, rank: int, length: int, col: str = "x", rounds: int = 60, tolerance: float = 1e-9
) -> tuple[np.ndarray, np.ndarray]:
    """Leading principal components (length x rank) of the windows, and their mean.

    Subspace iteration: a round multiplies a thin basis by the windows and by their
    transpose, summed by task, so nothing larger than length x (rank + 8) is held
    anywhere. Store windows that are dear to compute; each round reads them.
    """
    means = windows.select(F.posexplode(col).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"))
    centre = np.zeros(length)
    for row in means.collect():  # one row per window position
        centre[row["pos"]] = row["m"]
    width = min(length, rank + 8)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(length, width)))[0]
    previous = np.zeros(rank)
    for _ in range(rounds):
        product = _covariance_times(windows.select(col), basis, centre)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        top = np.sort(values)[::-1][:rank]
        if width == length or np.abs(top - previous).max() <= tolerance * max(top[0], 1e-300):
            return basis @ turn[:, np.argsort(values)[::-1][:rank]], centre
        previous, basis = top, np.linalg.qr(product)[0]
    return basis @ turn[:, np.argsort(values)[::-1][:rank]], centre


def _covariance_times(windows: DataFrame, basis: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Sum over windows w of (w - centre)((w - centre)' basis): a matrix per task, added up by position."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(basis.shape)
        for batch in batches:
            if len(batch):
                gap = np.stack(batch.iloc[:, 0].to_numpy()) - centre
                total += gap.T @ (gap @ basis)
        yield pd.DataFrame({"pos": np.arange(len(total)), **{f"c{j}": total[:, j] for j in range(total.shape[1])}})

    names = [f"c{j}" for j in range(basis.shape[1])]
    parts = windows.mapInPandas(add, "pos long, " + ", ".join(f"{n} double" for n in names))
    sums = parts.groupBy("pos").agg(*[F.sum(n).alias(n) for n in names]).collect()  # one row per window position
    out = np.zeros(basis.shape)
    for row in sums:
        out[row["pos"]] = [row[n] for n in names]
    return out


def low_rank_reconstruction(
    windows: DataFrame, basis: np.ndarray, centre: np.ndarray, col: str = "x", name: str = "reconstructed"
) -> DataFrame:
    """Each window projected on the components and back."""

    @F.pandas_udf(DOUBLES)
    def back(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        gap = np.stack(x.to_numpy()) - centre
        return pd.Series(list(gap @ basis @ basis.T + centre))

    return pin(windows, col).withColumn(name, back(col))


def fit_mixture(windows: DataFrame, k: int, seed: int = 0, col: str = "x") -> GaussianMixtureModel:
    return GaussianMixture(k=k, featuresCol="_v", predictionCol="_c", probabilityCol="_q", seed=seed).fit(
        _vectors(windows, col)
    )


def mixture_score(windows: DataFrame, model: GaussianMixtureModel, col: str = "x", name: str = "score") -> DataFrame:
    """Negative log density of each window under the mixture."""
    weights = np.asarray(model.weights)
    means, inverses, logdets = [], [], []
    for g in model.gaussians:
        cov = g.cov.toArray()
        values, vectors = np.linalg.eigh(cov)
        keep = values > values.max() * len(values) * 1e-12
        means.append(g.mean.toArray())
        inverses.append((vectors[:, keep] / values[keep]) @ vectors[:, keep].T)
        logdets.append(float(np.sum(np.log(values[keep]))) + keep.sum() * np.log(2 * np.pi))

    @F.pandas_udf(T.DoubleType())
    def energy(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        m = np.stack(x.to_numpy())
        parts = []
        for w, mu, inv, logdet in zip(weights, means, inverses, logdets, strict=True):
            gap = m - mu
            parts.append(np.log(w) - 0.5 * (np.einsum("ij,jk,ik->i", gap, inv, gap) + logdet))
        top = np.max(parts, axis=0)
        return pd.Series(-(top + np.log(np.sum(np.exp(np.asarray(parts) - top), axis=0))))

    return pin(windows, col).withColumn(name, energy(col))


def class_weights(windows: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes * n_class) of each class."""
    counts = windows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(totals)).select(  # totals is one row
        label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight")
    )


def fit_classifier(
    windows: DataFrame, col: str = "x", label: str = "label", balanced: bool = False, max_iter: int = 50, reg: float = 0.01
) -> LogisticRegressionModel:
    """Multinomial linear classifier on the flattened window."""
    data = _vectors(windows, col)
    kwargs = {}
    if balanced:
        data = data.join(class_weights(windows, label), label)
        kwargs["weightCol"] = "weight"
    return LogisticRegression(
        featuresCol="_v", labelCol=label, maxIter=max_iter, regParam=reg, family="multinomial", **kwargs
    ).fit(data)


def classify(windows: DataFrame, model: LogisticRegressionModel, col: str = "x") -> DataFrame:
    """Class probabilities and the most likely class."""
    scored = model.transform(_vectors(windows, col))
    return scored.withColumn("probabilities", vector_to_array("probability")).withColumn(
        "predicted", F.col("prediction").cast("int")
    ).drop("_v", "rawPrediction", "probability", "prediction")


def flatten_features(windows: DataFrame, cols: list[str], name: str = "x") -> DataFrame:
    """Feature arrays concatenated to one array."""
    return windows.withColumn(name, F.concat(*cols))


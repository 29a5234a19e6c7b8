"""Anomaly scores, thresholds and alert summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import array_mean, array_sum, array_var_samp, dot, softmax
from tidemark.operators.quantiles import exact_quantiles

KEYS = ("series_id",)


def _error(x: Column, y: Column, kind: str) -> Column:
    d = x - y
    if kind == "mse":
        return d * d
    if kind == "mae":
        return F.abs(d)
    if kind == "combined":
        return (d * d + F.abs(d)) * 0.5
    raise ValueError(f"unknown error {kind!r}")


def point_error(pairs: Sequence[tuple[str, str]], kind: str = "mse") -> Column:
    """Error of one time point, averaged over its (actual, reconstructed) feature pairs."""
    terms = [_error(F.col(a), F.col(b), kind) for a, b in pairs]
    return sum(terms[1:], terms[0]) / F.lit(float(len(terms)))


def array_errors(x: str, y: str, kind: str = "mse") -> Column:
    """Error at each point of a window, as an array."""
    return F.zip_with(x, y, lambda a, b: _error(a, b, kind))


def reduce_errors(errors: Column, reduction: str = "mean") -> Column:
    """``mean``, ``sum`` or ``none`` of an error array."""
    if reduction == "none":
        return errors
    if reduction == "mean":
        return array_mean(errors)
    if reduction == "sum":
        return array_sum(errors)
    raise ValueError(f"unknown reduction {reduction!r}")


def window_score(x: Sequence[str], y: Sequence[str], kind: str = "mse") -> Column:
    """Mean error of a window over time and features."""
    terms = [array_mean(array_errors(a, b, kind)) for a, b in zip(x, y, strict=True)]
    return sum(terms[1:], terms[0]) / F.lit(float(len(terms)))


def score_points_by_window(
    df: DataFrame, error: Column, length: int, keys: Sequence[str] = KEYS, idx: str = "idx"
) -> DataFrame:
    """Window scores of non-overlapping windows straight from scored points, without building arrays."""
    scored = df.select(*keys, F.floor(F.col(idx) / F.lit(length)).cast("long").alias("w_no"), error.alias("_e"))
    grouped = scored.groupBy(*keys, "w_no").agg(F.avg("_e").alias("score"), F.count("_e").alias("_n"))
    return grouped.where(F.col("_n") == length).drop("_n")


def two_decoder_score(x: str, first: str, second: str, alpha: float = 0.5) -> Column:
    """alpha * error of the first reconstruction + (1 - alpha) * error of the second."""
    one, two = array_mean(array_errors(x, first)), array_mean(array_errors(x, second))
    return F.lit(alpha) * one + F.lit(1.0 - alpha) * two


def relative_distance(x: str, y: str, floor: float = 1e-10) -> Column:
    """|x - y| / |x|."""
    gap = array_sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))
    return F.sqrt(gap) / F.greatest(F.sqrt(dot(x, x)), F.lit(floor))


def cosine_similarity(x: str, y: str, floor: float = 1e-8) -> Column:
    return dot(x, y) / F.greatest(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(floor))


def prediction_variance(pred: str) -> Column:
    """Spread of a forecast over its horizon."""
    return array_var_samp(F.col(pred))


def prediction_magnitude(pred: str) -> Column:
    """Mean absolute forecast."""
    return array_mean(F.transform(pred, lambda v: F.abs(v)))


def input_variance(x: str) -> Column:
    """Spread of the input window, the score when nothing else is available."""
    return array_var_samp(F.col(x))


def forecast_error_score(
    forecasts: DataFrame,
    actuals: DataFrame,
    pred: str = "pred",
    col: str = "x",
    kind: str = "mae",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Error of each forecast step against the point it forecasts, joined on (series, idx).

    ``forecasts`` has ``w_end`` (first forecast position) and an array of predictions.
    """
    steps = forecasts.select(*keys, "w_start", "w_end", F.posexplode(pred).alias("_h", "pred"))
    steps = steps.select(*keys, "w_start", (F.col("_h") + 1).alias("h"), (F.col("w_end") + F.col("_h")).alias("idx"), "pred")
    joined = steps.join(actuals.select(*keys, "idx", F.col(col).alias("true")), [*keys, "idx"])
    return joined.select(*keys, "w_start", "h", "idx", "pred", "true", _error(F.col("true"), F.col("pred"), kind).alias("score"))


def kl_divergence(p: Column | str, q: Column | str, eps: float = 1e-4) -> Column:
    """sum p' (log p' - log q') with p' = p + eps and q' = q + eps."""
    return array_sum(
        F.zip_with(p, q, lambda a, b: (a + F.lit(eps)) * (F.log(a + F.lit(eps)) - F.log(b + F.lit(eps))))
    )


def discrepancy_score(errors: str, series: str, prior: str) -> Column:
    """Softmax over time of the negative symmetric divergence, times the error, per point.

    ``series`` and ``prior`` hold one distribution per point (array of arrays).
    """
    both = F.zip_with(series, prior, lambda p, q: -(kl_divergence(p, q) + kl_divergence(q, p)))
    return F.zip_with(softmax(both), errors, lambda w, e: w * e)


# Model names that are scored by reconstruction.
RECONSTRUCTION_MODELS = (
    "AnomalyTransformer",
    "OmniAnomaly",
    "USAD",
    "DAGMM",
    "AutoEncoder",
    "VAE",
    "LSTM_VAE",
    "LSTM_AE",
    "VTTPAT",
    "VTTSAT",
)


def detection_method(model: str) -> str:
    return "reconstruction" if model in RECONSTRUCTION_MODELS else "prediction"


def with_method(df: DataFrame, model: str) -> DataFrame:
    """Add the detection method as a struct column."""
    method = detection_method(model)
    approach = (
        "distance between a window and its reconstruction"
        if method == "reconstruction"
        else "spread and error of the forecast"
    )
    return df.withColumn(
        "method", F.struct(F.lit(model).alias("model"), F.lit(method).alias("method"), F.lit(approach).alias("approach"))
    )


# -- thresholds -----------------------------------------------------------------------------------


def sigma_threshold(df: DataFrame, score: str = "score", by: Sequence[str] = (), sigmas: float = 2.0) -> DataFrame:
    """Mean plus two population deviations of the scores."""
    return df.groupBy(*by).agg((F.avg(score) + F.lit(sigmas) * F.stddev_pop(score)).alias("threshold"))


def percentile_threshold(
    df: DataFrame, p: float = 0.95, score: str = "score", by: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    """Percentile of the scores, linear between neighbours: exact by rank, or from Spark's quantile sketch."""
    if approximate:
        return df.groupBy(*by).agg(F.percentile_approx(score, p, 1_000_000).alias("threshold"))
    return exact_quantiles(df, [p], score, by).select(*by, F.col("quantiles")[0].alias("threshold"))


def flag(df: DataFrame, threshold: DataFrame | float, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Add 0/1 ``alert``: score strictly above the threshold. A given number wins, zero included."""
    if isinstance(threshold, DataFrame):
        df = df.join(threshold, list(by)) if by else df.crossJoin(F.broadcast(threshold))  # one row
    else:
        df = df.withColumn("threshold", F.lit(float(threshold)))
    return df.withColumn("alert", F.when(F.col(score) > F.col("threshold"), 1).otherwise(0))


def alert_summary(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold, number of alerts and their percentage."""
    return flagged.groupBy(*by).agg(
        F.first("threshold").alias("threshold"),
        F.sum("alert").cast("long").alias("anomalies_detected"),
        (F.avg("alert") * 100.0).alias("anomaly_rate"),
    )


def score_summary(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(score).alias("anomaly_score_mean"), F.stddev_pop(score).alias("anomaly_score_std")
    )

"""Anomaly scores, thresholds, forecast metrics and anomaly metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import anomaly_metrics as am
from tidemark.operators import forecast_metrics as fm
from tidemark.operators import ordering, scoring, windows
from tidemark.plans.inputs import HOURLY_SQL, PAIRS_SQL, POINTS_SQL, events, hourly, pairs, points, windows_sql
from tidemark.plans.registry import query, r, rsql

# -- scores ------------------------------------------------------------------------------------------

RECON_SQL = f"""{POINTS_SQL}, {windows_sql('points', 24, 24)},
recon AS (
  SELECT *, avg(x) OVER (PARTITION BY series_id, w_start) AS y,
         first_value(x) OVER (PARTITION BY series_id, w_start ORDER BY pos) AS z FROM wins)"""


def _recon(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with two stand-in reconstructions: the window mean and the first value."""
    wins = windows.sliding_windows(points(spark, sf), 24, 24).withColumn("_m", arrays.array_mean(F.col("x")))
    return wins.withColumns(
        {"y": F.transform("x", lambda _: F.col("_m")), "z": F.transform("x", lambda _: F.element_at("x", 1))}
    ).drop("_m")


@query(
    "point_errors",
    f"""WITH {RECON_SQL} SELECT series_id, w_start, CAST(pos AS INTEGER) AS pos, {rsql('(x - z) * (x - z)')} AS mse, {rsql('abs(x - z)')} AS mae,
        {rsql('0.5 * ((x - z) * (x - z) + abs(x - z))')} AS combined FROM recon""",
)
def point_errors(spark: SparkSession, sf: str) -> DataFrame:
    df = _recon(spark, sf).withColumns({k: scoring.array_errors("x", "z", k) for k in ("mse", "mae", "combined")})
    out = df.select("series_id", "w_start", F.posexplode(F.arrays_zip("mse", "mae", "combined")).alias("pos", "e"))
    return out.select("series_id", "w_start", "pos", *[r(f"e.{k}").alias(k) for k in ("mse", "mae", "combined")])


@query(
    "window_scores",
    f"""WITH {RECON_SQL} SELECT series_id, w_start, {rsql('avg((x - y) * (x - y))')} AS score, {rsql('sum(abs(x - y))')} AS total,
        {rsql('0.3 * avg((x - y) * (x - y)) + 0.7 * avg((x - z) * (x - z))', 4)} AS two_decoder,
        {rsql('sqrt(sum((x - y) * (x - y))) / sqrt(sum(x * x))')} AS distance, {rsql('sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))')} AS cosine
        FROM recon GROUP BY 1, 2""",
)
def window_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _recon(spark, sf).select(
        "series_id",
        "w_start",
        r(scoring.window_score(["x"], ["y"])).alias("score"),
        r(scoring.reduce_errors(scoring.array_errors("x", "y", "mae"), "sum")).alias("total"),
        r(scoring.two_decoder_score("x", "y", "z", 0.3), 4).alias("two_decoder"),
        r(scoring.relative_distance("x", "y")).alias("distance"),
        r(scoring.cosine_similarity("x", "y")).alias("cosine"),
    )


@query(
    "window_scores_from_points",
    f"WITH {POINTS_SQL} SELECT series_id, CAST(idx // 24 AS BIGINT) AS w_no, {rsql('avg((x - 100) * (x - 100))', 4)} AS score FROM points GROUP BY 1, 2 HAVING count(*) = 24",
)
def window_scores_from_points(spark: SparkSession, sf: str) -> DataFrame:
    df = points(spark, sf).withColumn("level", F.lit(100.0))
    return scoring.score_points_by_window(df, scoring.point_error([("x", "level")]), 24).withColumn("score", r("score", 4))


@query(
    "prediction_scores",
    f"""WITH {RECON_SQL} SELECT series_id, w_start, {rsql('var_samp(x)', 4)} AS variance, {rsql('avg(abs(x - 50))')} AS magnitude, {rsql('var_samp(x)', 4)} AS input_variance,
        'DLinear' AS model, 'prediction' AS method FROM recon GROUP BY 1, 2""",
)
def prediction_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = _recon(spark, sf).withColumn("pred", F.transform("x", lambda v: v - 50))
    scored = df.select(
        "series_id",
        "w_start",
        r(scoring.prediction_variance("pred"), 4).alias("variance"),
        r(scoring.prediction_magnitude("pred")).alias("magnitude"),
        r(scoring.input_variance("x"), 4).alias("input_variance"),
    )
    named = scoring.with_method(scored, "DLinear")
    return named.select(*scored.columns, F.col("method.model").alias("model"), F.col("method.method").alias("method"))


@query(
    "forecast_error_scores",
    f"""WITH {POINTS_SQL}, {windows_sql('points', 24, 12)},
last AS (SELECT series_id, w_start, x AS pred FROM wins WHERE pos = 23)
SELECT l.series_id, l.w_start, CAST(p.idx - l.w_start - 23 AS INTEGER) AS h, CAST(p.idx AS BIGINT) AS idx, {rsql('abs(p.x - l.pred)')} AS score
FROM last l JOIN points p ON p.series_id = l.series_id AND p.idx BETWEEN l.w_start + 24 AND l.w_start + 29""",
)
def forecast_error_scores(spark: SparkSession, sf: str) -> DataFrame:
    pts = points(spark, sf)
    naive = windows.sliding_windows(pts, 24, 12).withColumn("pred", F.array_repeat(F.element_at("x", -1), 6))
    out = scoring.forecast_error_score(naive, pts)
    return out.select("series_id", "w_start", "h", "idx", r("score").alias("score"))


@query(
    "discrepancy_scores",
    f"""WITH {RECON_SQL},
p AS (SELECT series_id, w_start, pos // 4 AS seg, (x + 1) / sum(x + 1) OVER (PARTITION BY series_id, w_start, pos // 4) + 1e-4 AS a, 0.25 + 1e-4 AS b, x FROM recon),
d AS (SELECT series_id, w_start, seg, -(sum(a * (ln(a) - ln(b))) + sum(b * (ln(b) - ln(a)))) AS d, avg(x * x) AS e FROM p GROUP BY 1, 2, 3)
SELECT series_id, w_start, CAST(seg AS INTEGER) AS pos, {rsql('e * exp(d) / sum(exp(d)) OVER (PARTITION BY series_id, w_start)', 4)} AS score FROM d""",
)
def discrepancy_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = windows.segments(_recon(spark, sf), "x", 4)
    shifted = F.transform("segments", lambda s: F.transform(s, lambda v: v + 1))
    df = df.withColumn("shifted", shifted)
    df = df.withColumns(
        {
            "p": F.transform("shifted", lambda s: F.transform(s, lambda v: v / arrays.array_sum(s))),
            "q": F.transform("shifted", lambda s: F.transform(s, lambda _: F.lit(0.25))),
            "errors": F.transform("segments", lambda s: arrays.array_mean(F.transform(s, lambda v: v * v))),
        }
    ).withColumn("score", scoring.discrepancy_score("errors", "p", "q"))
    return df.select("series_id", "w_start", F.posexplode("score").alias("pos", "score")).withColumn("score", r("score", 4))


# -- thresholds -----------------------------------------------------------------------------------------


def _alerts(threshold_fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scored = events(spark, sf).select("event_type", F.col("x").alias("score"))
        flagged = scoring.flag(scored, threshold_fn(scored), ["event_type"])
        out = scoring.alert_summary(flagged, ["event_type"])
        return out.withColumns({"threshold": r("threshold"), "anomaly_rate": r("anomaly_rate")})

    return run


def _alert_sql(threshold: str) -> str:
    return f"""WITH t AS (SELECT event_type, {threshold} AS threshold FROM events GROUP BY 1)
SELECT e.event_type, {rsql('max(threshold)')} AS threshold, CAST(count(*) FILTER (value > threshold) AS BIGINT) AS anomalies_detected,
       {rsql('100.0 * count(*) FILTER (value > threshold) / count(*)')} AS anomaly_rate
FROM events e JOIN t ON t.event_type = e.event_type GROUP BY 1"""


query("alerts_sigma", _alert_sql("avg(value) + 2 * stddev_pop(value)"))(_alerts(lambda s: scoring.sigma_threshold(s, by=["event_type"])))
query("alerts_percentile", _alert_sql("quantile_cont(value, 0.95)"))(_alerts(lambda s: scoring.percentile_threshold(s, by=["event_type"])))


@query("alerts_fixed", f"SELECT event_type, 0.0::DOUBLE AS threshold, CAST(count(*) FILTER (value > 0) AS BIGINT) AS anomalies_detected, {rsql('100.0 * count(*) FILTER (value > 0) / count(*)')} AS anomaly_rate FROM events GROUP BY 1")
def alerts_fixed(spark: SparkSession, sf: str) -> DataFrame:
    scored = events(spark, sf).select("event_type", F.col("x").alias("score"))
    return scoring.alert_summary(scoring.flag(scored, 0.0), ["event_type"]).withColumn("anomaly_rate", r("anomaly_rate"))


@query("score_summary", f"SELECT event_type, {rsql('avg(value)')} AS anomaly_score_mean, {rsql('stddev_pop(value)')} AS anomaly_score_std FROM events GROUP BY 1")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.score_summary(events(spark, sf), "x", ["event_type"])
    return out.withColumns({c: r(c) for c in ("anomaly_score_mean", "anomaly_score_std")})


# -- forecast metrics ------------------------------------------------------------------------------------

E = "actual - pred"
BASIC_SQL = {
    "mae": f"avg(abs({E}))",
    "mse": f"avg(({E}) * ({E}))",
    "rmse": f"sqrt(avg(({E}) * ({E})))",
    "mape": f"avg(abs({E}) / greatest(abs(actual), 1e-6))",
    "mspe": f"avg(pow(({E}) / greatest(abs(actual), 1e-6), 2))",
}
DIGITS = {"mse": 1, "mae": 4, "rmse": 4}


def _metric_sql(items: dict[str, str]) -> str:
    return ", ".join(f"{rsql(v, DIGITS.get(k, 6))} AS {k}" for k, v in items.items())


@query(
    "forecast_metrics",
    f"""WITH {PAIRS_SQL}, c AS (SELECT h, avg(actual) AS m FROM pairs GROUP BY 1)
SELECT p.h, {_metric_sql(BASIC_SQL)}, {rsql('sqrt(sum((actual - pred) * (actual - pred))) / sqrt(sum((actual - m) * (actual - m)))')} AS rse
FROM pairs p JOIN c ON c.h = p.h GROUP BY 1""",
)
def forecast_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = fm.basic_metrics(pairs(spark, sf), ["h"])
    return out.select("h", *[r(c, DIGITS.get(c, 6)).alias(c) for c in out.columns if c != "h"])


@query(
    "forecast_metrics_signed",
    f"WITH {PAIRS_SQL} SELECT series_id, "
    + _metric_sql({**BASIC_SQL, "mape": "avg(abs((pred - actual) / (actual + 1e-5)))", "mspe": "avg(pow((pred - actual) / (actual + 1e-5), 2))"})
    + " FROM pairs GROUP BY 1",
)
def forecast_metrics_signed(spark: SparkSession, sf: str) -> DataFrame:
    out = fm.signed_metrics(pairs(spark, sf), ["series_id"])
    return out.select("series_id", *[r(c, DIGITS.get(c, 6)).alias(c) for c in out.columns if c != "series_id"])


@query("rse_eps", f"WITH {PAIRS_SQL} SELECT {rsql('sqrt(sum((actual - pred) * (actual - pred))) / (sqrt(sum((actual - m) * (actual - m))) + 1e-5)')} AS rse FROM pairs, (SELECT avg(actual) AS m FROM pairs)")
def rse_eps(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).agg(r(fm.rse(eps=1e-5)).alias("rse"))


@query(
    "corr_cells",
    f"""WITH {PAIRS_SQL},
d AS (SELECT series_id, h, actual - avg(actual) OVER w AS dt, pred - avg(pred) OVER w AS dp FROM pairs WINDOW w AS (PARTITION BY series_id, h)),
c AS (SELECT series_id, h, sum(dt * dp) / sqrt(sum(dt * dt * dp * dp)) AS c FROM d GROUP BY 1, 2)
SELECT h, {rsql('avg(c)', 5)} AS corr FROM c GROUP BY 1""",
)
def corr_cells(spark: SparkSession, sf: str) -> DataFrame:
    return fm.corr(pairs(spark, sf), ["h", "series_id"], ["h"]).withColumn("corr", r("corr", 5))


@query(
    "masked_percentage_errors",
    f"""WITH {PAIRS_SQL} SELECT series_id, {rsql('avg(abs((pred - actual) * CASE WHEN actual = 0 THEN 0 ELSE mask / actual END))')} AS mape,
        {rsql('200 * avg(CASE WHEN abs(pred) + abs(actual) = 0 THEN 0 ELSE abs(actual - pred) / (abs(pred) + abs(actual)) END * mask)')} AS smape FROM pairs GROUP BY 1""",
)
def masked_percentage_errors(spark: SparkSession, sf: str) -> DataFrame:
    out = pairs(spark, sf).groupBy("series_id").agg(fm.masked_mape().alias("mape"), fm.smape().alias("smape"))
    return out.select("series_id", r("mape").alias("mape"), r("smape").alias("smape"))


@query(
    "mase",
    f"""WITH {POINTS_SQL},
hist AS (SELECT * FROM points WHERE idx < 40),
naive AS (SELECT a.series_id, avg(abs(a.x - b.x)) AS s FROM hist a JOIN hist b ON a.series_id = b.series_id AND a.idx = b.idx + 7 GROUP BY 1)
SELECT {rsql('avg(abs(p.x - 100) / n.s)')} AS mase FROM points p JOIN naive n ON n.series_id = p.series_id WHERE p.idx >= 40""",
)
def mase(spark: SparkSession, sf: str) -> DataFrame:
    pts = points(spark, sf)
    ahead = pts.where("idx >= 40").select("series_id", F.col("x").alias("true"), F.lit(100.0).alias("pred"), F.lit(1.0).alias("mask"))
    return fm.mase(ahead, pts.where("idx < 40"), 7).select(r("mase").alias("mase"))


@query(
    "criteria",
    f"""WITH {PAIRS_SQL}, s AS (SELECT series_id, (actual - pred) / 10000 AS e FROM pairs)
SELECT series_id, {rsql('avg(e * e)')} AS mse, {rsql('avg(abs(e))')} AS mae, {rsql('avg(CASE WHEN abs(e) <= 1 THEN e * e / 2 ELSE abs(e) - 0.5 END)')} AS huber FROM s GROUP BY 1""",
)
def criteria(spark: SparkSession, sf: str) -> DataFrame:
    scaled = pairs(spark, sf).withColumns({"true": F.col("true") / 10000, "pred": F.col("pred") / 10000})
    out = scaled.groupBy("series_id").agg(*[fm.criterion(n).alias(n) for n in ("mse", "mae", "huber")])
    return out.select("series_id", *[r(n).alias(n) for n in ("mse", "mae", "huber")])


@query("mean_of_batches", f"WITH {PAIRS_SQL}, b AS (SELECT series_id, h, avg(abs({E})) AS mae FROM pairs GROUP BY 1, 2) SELECT series_id, {rsql('avg(mae)', 4)} AS mae FROM b GROUP BY 1")
def mean_of_batches(spark: SparkSession, sf: str) -> DataFrame:
    out = fm.mean_of_batches(pairs(spark, sf), "h", {"mae": fm.mae()}, ["series_id"])
    return out.withColumn("mae", r("mae", 4))


@query("accuracy", f"SELECT user_id AS series_id, {rsql('''avg(CASE WHEN (value > 100) = (event_type = 'error') THEN 1.0 ELSE 0.0 END)''')} AS accuracy FROM events GROUP BY 1")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    df = events(spark, sf).select("series_id", (F.col("x") > 100).alias("pred"), (F.col("event_type") == "error").alias("true"))
    return df.groupBy("series_id").agg(r(fm.accuracy()).alias("accuracy"))


# -- anomaly metrics ---------------------------------------------------------------------------------------

ERRORS_SQL = f"""{POINTS_SQL},
scored AS (SELECT series_id, idx, x AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, CASE WHEN x > 60 THEN 1 ELSE 0 END AS pred FROM points)"""

ALL_SQL = """
scored AS (SELECT 0 AS series_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value AS score,
                  CASE WHEN hour(ts) BETWEEN 8 AND 11 THEN 1 ELSE 0 END AS label, CASE WHEN value > 60 THEN 1 ELSE 0 END AS pred FROM events)"""

# runs of true labels, numbered by the difference of position and rank
SEG_SQL = """
hits AS (SELECT *, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS island FROM scored WHERE label = 1),
segs AS (SELECT series_id, island, min(idx) AS s, max(idx) AS e, count(*) AS len, sum(pred) AS hit,
                min(CASE WHEN pred = 1 THEN idx END) AS first, min(score) AS lo, max(score) AS hi
         FROM hits GROUP BY 1, 2),
tagged AS (SELECT d.*, g.s, g.e, g.len, g.hit, g.lo, g.hi FROM scored d LEFT JOIN segs g ON d.series_id = g.series_id AND d.idx BETWEEN g.s AND g.e)"""


def user_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: error events are the anomalies, the value is the score."""
    return points(spark, sf).select(
        "series_id",
        "idx",
        F.col("x").alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.when(F.col("x") > 60, 1).otherwise(0).alias("pred"),
    )


def all_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as one long series with a daily true segment."""
    one = ordering.add_index(events(spark, sf).select("event_id", "ts", "x"), keys=[], order=["ts", "event_id"])
    return one.select(
        "idx",
        F.col("x").alias("score"),
        F.when(F.hour("ts").between(8, 11), 1).otherwise(0).alias("label"),
        F.when(F.col("x") > 60, 1).otherwise(0).alias("pred"),
    )


def _prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p, rc = f"({tp} / ({tp} + {fp} + 1e-5))", f"({tp} / ({tp} + {fn} + 1e-5))"
    return f"{rsql(p)} AS precision, {rsql(rc)} AS recall, {rsql(f'2 * {p} * {rc} / ({p} + {rc} + 1e-5)')} AS f1"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r(c, 9 if c == "threshold" else 6) for c in (cols or ("precision", "recall", "f1"))})


@query(
    "point_metrics",
    f"""WITH {ERRORS_SQL}, c AS (SELECT series_id, CAST(sum(pred * label) AS DOUBLE) AS tp, CAST(sum((1 - pred) * (1 - label)) AS DOUBLE) AS tn,
        CAST(sum(pred * (1 - label)) AS DOUBLE) AS fp, CAST(sum((1 - pred) * label) AS DOUBLE) AS fn FROM scored GROUP BY 1) SELECT *, {_prf()} FROM c""",
)
def point_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(am.point_metrics(user_errors(spark, sf), ["series_id"]))


@query("label_segments", f"WITH {ERRORS_SQL}, {SEG_SQL} SELECT series_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", len AS length, CAST(row_number() OVER (PARTITION BY series_id ORDER BY s) AS BIGINT) AS seg FROM segs")
def label_segments(spark: SparkSession, sf: str) -> DataFrame:
    return am.segment_table(user_errors(spark, sf), block=16)


@query(
    "point_adjust",
    f"""WITH {ALL_SQL}, {SEG_SQL}
SELECT CAST(idx AS BIGINT) AS idx, CASE WHEN pred = 1 OR (label = 1 AND hit > 0 AND idx > 0) THEN 1 ELSE 0 END AS adjusted FROM tagged""",
)
def point_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return am.adjust_predictions(all_events(spark, sf), keys=[]).select("idx", "adjusted")


@query(
    "point_adjust_metrics",
    f"""WITH {ERRORS_SQL}, {SEG_SQL},
adj AS (SELECT series_id, label, CASE WHEN pred = 1 OR (label = 1 AND hit > 0) THEN 1 ELSE 0 END AS pred FROM tagged),
c AS (SELECT series_id, CAST(sum(pred * label) AS DOUBLE) AS tp, CAST(sum((1 - pred) * (1 - label)) AS DOUBLE) AS tn,
        CAST(sum(pred * (1 - label)) AS DOUBLE) AS fp, CAST(sum((1 - pred) * label) AS DOUBLE) AS fn FROM adj GROUP BY 1)
SELECT *, {_prf()} FROM c""",
)
def point_adjust_metrics(spark: SparkSession, sf: str) -> DataFrame:
    adjusted = am.adjust_predictions(user_errors(spark, sf), keep_first=False)
    return _rounded(am.point_metrics(adjusted, ["series_id"], "adjusted"))


@query(
    "adjust_latency",
    f"""WITH {ERRORS_SQL}, {SEG_SQL}
SELECT series_id, {rsql('sum(CASE WHEN first IS NOT NULL THEN greatest(first - greatest(s, 1), 0) ELSE 0 END) / (count(first) + 1e-5)')} AS latency, count(first) AS segments FROM segs GROUP BY 1""",
)
def adjust_latency(spark: SparkSession, sf: str) -> DataFrame:
    return am.adjust_latency(user_errors(spark, sf)).withColumn("latency", r("latency"))


@query(
    "pa_k_adjust",
    f"""WITH {ALL_SQL}, {SEG_SQL}
SELECT CAST(idx AS BIGINT) AS idx, CASE WHEN pred = 1 OR (label = 1 AND hit > 0 AND 100.0 * hit / len >= 40) THEN 1 ELSE 0 END AS adjusted FROM tagged""",
)
def pa_k_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return am.adjust_predictions(all_events(spark, sf), k=40, keys=[]).select("idx", "adjusted")


@query(
    "pa_k_latency",
    f"""WITH {ERRORS_SQL}, {SEG_SQL}
SELECT series_id, {rsql('sum(CASE WHEN hit > 0 AND 100.0 * hit >= 50 * len THEN len - hit ELSE 0 END) / (count(*) + 1e-5)')} AS latency, count(*) AS segments FROM segs GROUP BY 1""",
)
def pa_k_latency(spark: SparkSession, sf: str) -> DataFrame:
    return am.adjust_latency(user_errors(spark, sf), k=50).withColumn("latency", r("latency"))


def _grid_sql(thresholds: str, ks: str) -> str:
    """Counts per threshold and K from a plain join of thresholds and rows."""
    return f"""
th AS ({thresholds}),
ks AS (SELECT unnest([{ks}])::DOUBLE AS k),
island AS (SELECT *, CASE WHEN label = 1 THEN idx - row_number() OVER (PARTITION BY series_id, label ORDER BY idx) END AS island FROM scored),
cell AS (SELECT series_id, island, i, t, label, count(*) AS len, count(*) FILTER (score > t) AS hit FROM island, th GROUP BY ALL),
agg AS (
  SELECT series_id, k, i, t,
    CAST(sum(CASE WHEN label = 1 THEN CASE WHEN hit > 0 AND 100.0 * hit >= k * len THEN len ELSE hit END ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN label = 0 THEN hit ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN label = 0 THEN len - hit ELSE 0 END) AS DOUBLE) AS tn,
    CAST(sum(CASE WHEN label = 1 AND NOT (hit > 0 AND 100.0 * hit >= k * len) THEN len - hit ELSE 0 END) AS DOUBLE) AS fn,
    sum(CASE WHEN label = 1 AND hit > 0 AND 100.0 * hit >= k * len THEN len - hit ELSE 0 END) / (count(*) FILTER (label = 1) + 1e-5) AS latency
  FROM cell, ks GROUP BY ALL),
ratio AS (SELECT *, tp / (tp + fp + 1e-5) AS p, tp / (tp + fn + 1e-5) AS rc, 2 * (tp / (tp + fp + 1e-5)) * (tp / (tp + fn + 1e-5)) / ((tp / (tp + fp + 1e-5)) + (tp / (tp + fn + 1e-5)) + 1e-5) AS f FROM agg)"""


GRID_COLS = f"k, {rsql('t', 9)} AS threshold, tp, tn, fp, fn, {rsql('latency')} AS latency, {rsql('p')} AS precision, {rsql('rc')} AS recall, {rsql('f')} AS f1"
GRID_ROUND = ("threshold", "latency", "precision", "recall", "f1")


@query(
    "sequence_metrics",
    f"""WITH {ERRORS_SQL}, {_grid_sql('SELECT 0 AS i, 60.0 AS t', '20.0')},
auc AS (SELECT p.series_id, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS a
        FROM scored p JOIN scored n ON p.series_id = n.series_id WHERE p.label = 1 AND n.label = 0 GROUP BY 1),
ap AS (SELECT series_id, avg(CAST(tp AS DOUBLE) / all_) AS v FROM (
        SELECT p.series_id, p.idx, count(*) FILTER (o.label = 1) AS tp, count(*) AS all_ FROM scored p JOIN scored o ON o.series_id = p.series_id AND o.score >= p.score
        WHERE p.label = 1 GROUP BY 1, 2) GROUP BY 1)
SELECT q.series_id, {GRID_COLS}, {rsql('a')} AS roc_auc, {rsql('v')} AS average_precision
FROM ratio q JOIN auc ON auc.series_id = q.series_id JOIN ap ON ap.series_id = q.series_id""",
)
def sequence_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = am.sequence_metrics(user_errors(spark, sf), 60.0, 20)
    return _rounded(out, *GRID_ROUND, "roc_auc", "average_precision")


@query(
    "threshold_grid",
    f"WITH {ERRORS_SQL}, {_grid_sql('SELECT i, 20.0 + (i + 1) * 15.0 AS t FROM range(0, 10) g(i)', '0.0, 50.0, 100.0')} SELECT series_id, {GRID_COLS} FROM ratio",
)
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = am.grid_metrics(user_errors(spark, sf), am.grid(20.0, 170.0, 10), [0, 50, 100])
    return _rounded(out, *GRID_ROUND)


BEST_SQL = "best AS (SELECT *, row_number() OVER (PARTITION BY series_id, k ORDER BY f DESC, i) AS rk FROM ratio)"


RANKING_SQL = """auc AS (SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS a FROM scored p, scored n WHERE p.label = 1 AND n.label = 0),
cum AS (SELECT sum(pos) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS al, pos FROM (SELECT score, sum(label) AS pos, count(*) AS c FROM scored GROUP BY 1)),
ap AS (SELECT sum(pos * tp / al) / sum(pos) AS v FROM cum)"""


@query(
    "threshold_search",
    f"""WITH {ALL_SQL}, {_grid_sql('SELECT i, 20.0 + (i + 1) * 1.875 AS t FROM range(0, 80) g(i)', '10.0')}, {BEST_SQL},
{RANKING_SQL}
SELECT {GRID_COLS}, {rsql('a')} AS roc_auc, {rsql('v')} AS average_precision FROM best, auc, ap WHERE rk = 1""",
)
def threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    out = am.search_thresholds(all_events(spark, sf), 20.0, 170.0, 80, k=10, keys=[])
    return _rounded(out, *GRID_ROUND, "roc_auc", "average_precision")


VALID_THRESHOLDS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, (SELECT quantile_cont(value, {(100 - (i + 1) * 5) / 100}) FROM events WHERE event_type <> 'error'))" for i in range(8)
) + ") g(i, t)"


@query(
    "threshold_search_validation",
    f"""WITH {ERRORS_SQL},
{_grid_sql(VALID_THRESHOLDS, '0.0')}, {BEST_SQL}
SELECT series_id, {GRID_COLS} FROM best WHERE rk = 1""",
)
def threshold_search_validation(spark: SparkSession, sf: str) -> DataFrame:
    valid = events(spark, sf).where("event_type <> 'error'").select(F.col("x").alias("score"))
    out = am.search_validation_percentiles(valid, user_errors(spark, sf), 0, 40, 5)
    return _rounded(out, *GRID_ROUND)


COMBINED = "SELECT value FROM events WHERE event_type <> 'error' UNION ALL SELECT value FROM events"


@query(
    "threshold_percentile",
    f"""WITH {ALL_SQL}, {_grid_sql(f'SELECT 0 AS i, (SELECT quantile_cont(value, 0.9) FROM ({COMBINED})) AS t', '0.0')}, {RANKING_SQL}
SELECT {GRID_COLS}, {rsql('a')} AS roc_auc, {rsql('v')} AS average_precision FROM ratio, auc, ap""",
)
def threshold_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold is a percentile of training scores and tested scores together."""
    tested = events(spark, sf).select("event_type", F.col("x").alias("score"))
    combined = tested.where("event_type <> 'error'").unionByName(tested).select("score")
    out = am.percentile_search(combined, all_events(spark, sf), 10, keys=[])
    return _rounded(out, *GRID_ROUND, "roc_auc", "average_precision")


PA_THRESHOLDS = "SELECT i, lo + (i + 1) * (hi - lo) / 1000 AS t FROM range(0, 1000) g(i), (SELECT quantile_cont(score, 0.5) AS lo, quantile_cont(score, 0.99) AS hi FROM scored)"
PA_KS = ", ".join(f"{k}.0" for k in am.K_VALUES)


@query(
    "pa_k_table",
    f"WITH {ALL_SQL}, {_grid_sql(PA_THRESHOLDS, PA_KS)}, {BEST_SQL}, {RANKING_SQL} SELECT {GRID_COLS}, {rsql('a')} AS roc_auc FROM best, auc WHERE rk = 1",
)
def pa_k_table(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(am.pa_k_table(all_events(spark, sf), keys=[]), *GRID_ROUND, "roc_auc")


@query(
    "pa_k_auc",
    f"""WITH {ALL_SQL}, {_grid_sql(PA_THRESHOLDS, PA_KS)}, {BEST_SQL},
t AS (SELECT k, f, lead(k) OVER (ORDER BY k) AS k2, lead(f) OVER (ORDER BY k) AS f2 FROM best WHERE rk = 1)
SELECT {rsql('sum((f + f2) / 2 * (k2 - k)) / 100')} AS pa_auc FROM t""",
)
def pa_k_auc(spark: SparkSession, sf: str) -> DataFrame:
    return am.pa_k_auc(am.pa_k_table(all_events(spark, sf), keys=[]), keys=[]).select(r("pa_auc").alias("pa_auc"))


@query(
    "roc_points",
    f"""WITH {ALL_SQL}, tot AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM scored)
SELECT score AS threshold, {rsql('sum(sum(1 - label)) OVER (ORDER BY score DESC) / max(n)')} AS fpr, {rsql('sum(sum(label)) OVER (ORDER BY score DESC) / max(p)')} AS tpr FROM scored, tot GROUP BY 1""",
)
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(am.roc_points(all_events(spark, sf), keys=[]), "fpr", "tpr")


@query(
    "ranking_metrics",
    f"""WITH {ERRORS_SQL},
auc AS (SELECT p.series_id, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS a
        FROM scored p JOIN scored n ON p.series_id = n.series_id WHERE p.label = 1 AND n.label = 0 GROUP BY 1),
ap AS (SELECT series_id, avg(CAST(tp AS DOUBLE) / all_) AS v FROM (
        SELECT p.series_id, p.idx, count(*) FILTER (o.label = 1) AS tp, count(*) AS all_ FROM scored p JOIN scored o ON o.series_id = p.series_id AND o.score >= p.score
        WHERE p.label = 1 GROUP BY 1, 2) GROUP BY 1)
SELECT auc.series_id, {rsql('a')} AS roc_auc, {rsql('v')} AS average_precision FROM auc JOIN ap ON ap.series_id = auc.series_id""",
)
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(am.ranking_metrics(user_errors(spark, sf)), "roc_auc", "average_precision")


PR_SQL = """
tot AS (SELECT series_id, CAST(sum(label) AS DOUBLE) AS p, count(*) AS n FROM scored GROUP BY 1),
lv AS (SELECT a.series_id, a.score, CAST(count(*) FILTER (b.label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (b.label = 0) AS DOUBLE) AS fp
       FROM (SELECT DISTINCT series_id, score FROM scored) a JOIN scored b ON b.series_id = a.series_id AND b.score >= a.score GROUP BY 1, 2),
pr AS (SELECT lv.series_id, lv.score, tp, fp, tp / (tp + fp) AS prec, tp / p AS rec, p, n - p AS neg FROM lv JOIN tot ON tot.series_id = lv.series_id)"""


@query(
    "best_pr_f1",
    f"""WITH {ERRORS_SQL}, {PR_SQL}, f AS (SELECT *, 2 * prec * rec / (prec + rec + 1e-8) AS f FROM pr),
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY f DESC, score) AS rk FROM f)
SELECT series_id, score AS threshold, {rsql('prec')} AS precision, {rsql('rec')} AS recall, {rsql('f')} AS f1 FROM o WHERE rk = 1""",
)
def best_pr_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(am.best_pr_f1(user_errors(spark, sf)))


@query(
    "youden_metrics",
    f"""WITH {ERRORS_SQL}, {PR_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY tp * neg - fp * p DESC, score DESC) AS rk FROM pr)
SELECT series_id, CASE WHEN g THEN score END AS threshold, {rsql('CASE WHEN g THEN prec ELSE 0 END')} AS precision, {rsql('CASE WHEN g THEN rec ELSE 0 END')} AS recall,
  {rsql('CASE WHEN g THEN (tp + neg - fp) / (p + neg) ELSE neg / (p + neg) END')} AS f1_micro, {rsql('CASE WHEN g THEN (tp / p + 1 - fp / neg) / 2 ELSE 0.5 END')} AS roc_auc
FROM (SELECT *, tp * neg - fp * p > 0 AS g FROM o WHERE rk = 1 AND p > 0 AND neg > 0)""",
)
def youden_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(am.youden_metrics(user_errors(spark, sf)), "precision", "recall", "f1_micro", "roc_auc")


@query(
    "best_segment_f1",
    f"""WITH {ERRORS_SQL}, {SEG_SQL},
items AS (SELECT series_id, lo AS sc, len, len AS hit, e AS pos FROM segs UNION ALL SELECT series_id, score, 1, 0, idx FROM scored WHERE label = 0),
tot AS (SELECT series_id, sum(label) AS p, count(*) AS n FROM scored GROUP BY 1),
run AS (SELECT i.series_id, sc, pos, CAST(sum(len) OVER w AS DOUBLE) AS al, CAST(sum(hit) OVER w AS DOUBLE) AS tp, p, n FROM items i JOIN tot ON tot.series_id = i.series_id
        WINDOW w AS (PARTITION BY i.series_id ORDER BY sc, pos)),
c AS (SELECT *, al - tp AS fp, CAST(p - tp AS DOUBLE) AS fn, CAST(n - al - p + tp AS DOUBLE) AS tn FROM run),
f AS (SELECT *, tp / (tp + fp + 1e-5) AS pr, tp / (tp + fn + 1e-5) AS rc FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY 2 * pr * rc / (pr + rc + 1e-5) DESC, sc, pos) AS rk FROM f)
SELECT series_id, sc AS threshold, tp, tn, fp, fn, {_prf()} FROM o WHERE rk = 1""",
)
def best_segment_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(am.best_segment_f1(user_errors(spark, sf)))


@query("lift_segments", f"WITH {ALL_SQL}, {SEG_SQL} SELECT CAST(idx AS BIGINT) AS idx, CASE WHEN label = 1 THEN hi ELSE score END AS score FROM tagged")
def lift_segments(spark: SparkSession, sf: str) -> DataFrame:
    return am.lift_segments(all_events(spark, sf), keys=[]).select("idx", "score")


@query(
    "composite_metrics",
    f"""WITH {ERRORS_SQL.replace('scored AS', 'raw AS')}, scored0 AS (SELECT series_id, idx, -score AS score, label, pred FROM raw),
{SEG_SQL.replace('scored', 'scored0')},
scored AS (SELECT series_id, idx, label, CASE WHEN label = 1 THEN hi ELSE score END AS score FROM tagged), {PR_SQL},
auc AS (SELECT p.series_id, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS a
        FROM scored p JOIN scored n ON p.series_id = n.series_id WHERE p.label = 1 AND n.label = 0 GROUP BY 1),
ap AS (SELECT d.series_id, avg(prec) AS v FROM scored d JOIN pr ON pr.series_id = d.series_id AND pr.score = d.score WHERE d.label = 1 GROUP BY 1),
f AS (SELECT series_id, max(2 * prec * rec / (prec + rec + 1e-5)) AS f FROM pr GROUP BY 1)
SELECT auc.series_id, {rsql('a')} AS roc_auc, {rsql('v')} AS average_precision, {rsql('f')} AS f1 FROM auc JOIN ap ON ap.series_id = auc.series_id JOIN f ON f.series_id = auc.series_id""",
)
def composite_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(am.composite_metrics(user_errors(spark, sf)), "roc_auc", "average_precision", "f1")


@query(
    "one_class_guard",
    f"""WITH {HOURLY_SQL}, scored AS (SELECT CAST(CAST(epoch(ts) AS BIGINT) // 3600 AS BIGINT) AS hour_no, x AS score, label FROM hourly),
auc AS (SELECT p.hour_no, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS a FROM scored p JOIN scored n ON p.hour_no = n.hour_no WHERE p.label = 1 AND n.label = 0 GROUP BY 1)
SELECT s.hour_no, min(label) = max(label) AS one_class, {rsql('CASE WHEN min(label) = max(label) THEN 0 ELSE max(a) END')} AS roc_auc FROM scored s LEFT JOIN auc ON auc.hour_no = s.hour_no GROUP BY 1""",
)
def one_class_guard(spark: SparkSession, sf: str) -> DataFrame:
    hour_no = F.floor(ordering.epoch_micros("ts") / F.lit(3_600_000_000)).cast("long")
    df = hourly(spark, sf).select(hour_no.alias("hour_no"), F.col("x").alias("score"), "label")
    guarded = am.class_guard(am.ranking_metrics(df, ["hour_no"]), df, ["roc_auc"], ["hour_no"])
    return guarded.select("hour_no", "one_class", r("roc_auc").alias("roc_auc"))

"""Model plug-ins, fitted forecasts and detectors, imputation, stationarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decompose, forecast, forecast_metrics, impute, learned, models, scaling, scoring, splits, stationarity, windows
from tidemark.operators.ordering import add_index
from tidemark.plans.draws_sql import Sql, uniform
from tidemark.plans.inputs import DAILY_SQL, POINTS_SQL, daily, points, shapes, windows_sql
from tidemark.plans.registry import query, r, rsql
from tidemark.session import staged

WIN_SQL = f"{POINTS_SQL}, {windows_sql('points', 24, 12)}"


def _wins(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding_windows(points(spark, sf), 24, 12)


# -- plug-in models ------------------------------------------------------------------------------------


def _median_model():
    """Example model: absolute distance of each point to the window median."""
    return lambda w: np.abs(w - np.median(w, axis=1, keepdims=True)).mean(axis=2)


@query(
    "model_scores",
    f"""WITH {WIN_SQL}, m AS (SELECT series_id, w_start, median(x) AS m FROM wins GROUP BY 1, 2)
SELECT w.series_id, w.w_start, CAST(pos AS INTEGER) AS pos, {rsql('abs(x - m)')} AS score FROM wins w JOIN m ON m.series_id = w.series_id AND m.w_start = w.w_start""",
)
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = models.score_windows(_wins(spark, sf), _median_model, "score", length=24)
    return out.select("series_id", "w_start", F.posexplode("out").alias("pos", "score")).withColumn("score", r("score"))


def _repeat_model():
    """Example forecaster: repeat the last day half."""
    return lambda w: w[:, -6:, :]


@query(
    "model_forecast",
    f"""WITH {DAILY_SQL}, {windows_sql('daily', 28, 14, 'orders, mean')},
f AS (SELECT series_id, w_start, pos - 22 AS h, orders, mean FROM wins WHERE pos >= 22)
SELECT series_id, w_start, CAST(w_start + 28 AS BIGINT) AS w_end, CAST(h AS INTEGER) AS h, {rsql('orders')} AS pred_0, {rsql('mean', 4)} AS pred_1 FROM f""",
)
def model_forecast(spark: SparkSession, sf: str) -> DataFrame:
    wins = windows.sliding_windows(daily(spark, sf), 28, 14, ["orders", "mean"])
    out = models.score_windows(wins, _repeat_model, "forecast", ["orders", "mean"], length=28)
    out = models.describe_windows(out, 28, 14, "forecast")
    zipped = F.arrays_zip(F.col("out")[0].alias("a"), F.col("out")[1].alias("b"))
    steps = out.select("series_id", "w_start", "w_end", F.posexplode(zipped).alias("h", "z"))
    names = steps.schema["z"].dataType.names
    return steps.select(
        "series_id", "w_start", "w_end", "h", r(F.col("z")[names[0]]).alias("pred_0"), r(F.col("z")[names[1]], 4).alias("pred_1")
    )


def _smooth_model():
    """Example model: every point halfway to the window mean."""
    return lambda w: (w + w.mean(axis=1, keepdims=True)) / 2


def _ends_model():
    """Example model: scores of the classes falling, level and rising, from the window's ends."""

    def run(w: np.ndarray) -> np.ndarray:
        rise = w[:, -1, 0] - w[:, 0, 0]
        return np.stack([np.maximum(-rise, 0), np.full(len(w), 20.0), np.maximum(rise, 0)], axis=1)

    return run


HALFWAY = "(x + avg(x) OVER (PARTITION BY series_id, w_start)) / 2"


def _by_point(out: DataFrame) -> DataFrame:
    return out.select("series_id", "w_start", F.posexplode(F.col("out")[0]).alias("pos", "v")).withColumn("v", r("v"))


@query("model_reconstruct", f"WITH {WIN_SQL} SELECT series_id, w_start, CAST(pos AS INTEGER) AS pos, {rsql(HALFWAY)} AS v FROM wins")
def model_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    return _by_point(models.score_windows(_wins(spark, sf), _smooth_model, "reconstruct", length=24))


@query("model_impute", f"WITH {WIN_SQL} SELECT series_id, w_start, CAST(pos AS INTEGER) AS pos, {rsql('CASE WHEN pos % 5 = 0 THEN (SELECT avg(y.x) FROM wins y WHERE y.series_id = w.series_id AND y.w_start = w.w_start AND y.pos % 5 <> 0) ELSE x END')} AS v FROM wins w")
def model_impute(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth point is hidden from the model, which fills it; the others are kept."""
    hidden = F.transform("x", lambda v, i: F.when(i % 5 != 0, v).otherwise(F.lit(float("nan"))))
    out = models.score_windows(_wins(spark, sf).withColumn("x", hidden), _fill_model, "impute", length=24)
    return _by_point(out)


def _fill_model():
    """Example model: the mean of the points that are known."""
    return lambda w: np.where(np.isnan(w), np.nanmean(w, axis=1, keepdims=True), w)


@query(
    "model_classify",
    f"""WITH {WIN_SQL}, e AS (SELECT series_id, w_start, max(x) FILTER (pos = 23) - max(x) FILTER (pos = 0) AS rise FROM wins GROUP BY 1, 2)
SELECT series_id, w_start, CASE WHEN -rise > 20 THEN 0 WHEN rise > 20 THEN 2 ELSE 1 END AS class, {rsql('greatest(abs(rise), 20)')} AS top FROM e""",
)
def model_classify(spark: SparkSession, sf: str) -> DataFrame:
    out = models.score_windows(_wins(spark, sf), _ends_model, "classify", length=24)
    best = F.array_max("out")
    return out.select("series_id", "w_start", (F.array_position("out", best) - 1).cast("int").alias("class"), r(best).alias("top"))


# -- fitted forecasts -------------------------------------------------------------------------------------


def _forecast_errors(spark: SparkSession, sf: str, kernel: int | None) -> DataFrame:
    cut = staged(splits.split_train_valid(points(spark, sf)))
    train = windows.forecast_windows(cut.where("split = 'train'"), 6, 0, 2)
    valid = staged(add_index(cut.where("split = 'val'").withColumnRenamed("idx", "_old"), order=["_old"]).select("series_id", "idx", "x"))
    model = forecast.fit_linear(train, 6, 2, kernel)
    out = scoring.forecast_error_score(forecast.linear_forecast(windows.sliding_windows(valid, 6, 1), model), valid)
    return forecast_metrics.basic_metrics(out, ["h"]).select("h", r("mae", 4).alias("mae"), r("mse", 2).alias("mse"))


@query("linear_forecast_decomposed")
def linear_forecast_decomposed(spark: SparkSession, sf: str) -> DataFrame:
    """Errors on windows of the validation rows, which the fit has not seen."""
    return _forecast_errors(spark, sf, 3)


@query("linear_forecast_direct")
def linear_forecast_direct(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast_errors(spark, sf, None)


def _fit_balance(spark: SparkSession, sf: str, kernel: int | None) -> DataFrame:
    """Whether the fit's errors are at right angles to every input, which holds for least squares alone."""
    cut = splits.split_train_valid(points(spark, sf))
    train = staged(windows.forecast_windows(cut.where("split = 'train'"), 24, 0, 6).withColumn("x", F.col("x_x")))
    model = forecast.fit_linear(train, 24, 6, kernel, ridge=0.0)
    parts = decompose.decompose_window(train, kernel) if kernel else train
    inputs = [F.col(c) for c in (("seasonal", "trend") if kernel else ("x",))]
    made = forecast.linear_forecast(parts.withColumn("inputs", F.concat(*inputs, F.array(F.lit(1.0)))), model)
    errors = F.zip_with("x_y", "pred", lambda y, p: y - p)
    each = made.select("inputs", F.posexplode(errors).alias("h", "e")).select("h", "e", F.posexplode("inputs").alias("input", "v"))
    sums = each.groupBy("h", "input").agg(F.sum(F.col("e") * F.col("v")).alias("g"), F.sum(F.abs(F.col("e") * F.col("v"))).alias("size"))
    return sums.select("h", "input", (F.abs("g") <= 1e-6 * F.col("size")).alias("balanced"))


def _balance_sql(inputs: int) -> str:
    return f"SELECT CAST(h AS INTEGER) AS h, CAST(input AS INTEGER) AS input, true AS balanced FROM range(0, 6) a(h), range(0, {inputs}) b(input) WHERE (SELECT count(*) FROM events) > 0"


@query("linear_fit_direct", _balance_sql(25))
def linear_fit_direct(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_balance(spark, sf, None)


@query("linear_fit_decomposed", _balance_sql(49))
def linear_fit_decomposed(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_balance(spark, sf, 7)


DYNAMICS_SQL = f"""WITH RECURSIVE {DAILY_SQL}, {windows_sql('daily', 28, 14, 'orders, mean')},
z AS (SELECT series_id, w_start, pos, (orders - avg(orders) OVER w) / sqrt(var_pop(orders) OVER w + 1e-5) AS a, (mean - avg(mean) OVER w) / sqrt(var_pop(mean) OVER w + 1e-5) AS b FROM wins WINDOW w AS (PARTITION BY series_id, w_start)),
nx AS (SELECT *, lead(a) OVER w AS a2, lead(b) OVER w AS b2 FROM z WINDOW w AS (PARTITION BY series_id, w_start ORDER BY pos)),
g AS (SELECT series_id, w_start, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * a2) AS ya, sum(a * b2) AS yb, sum(b * a2) AS za, sum(b * b2) AS zb FROM nx WHERE a2 IS NOT NULL GROUP BY 1, 2),
k AS (SELECT series_id, w_start, CASE WHEN aa = 0 THEN 0 WHEN bb = 0 THEN ya / aa ELSE (bb * ya - ab * za) / d END AS p, CASE WHEN aa = 0 THEN 0 WHEN bb = 0 THEN yb / aa ELSE (bb * yb - ab * zb) / d END AS q,
  CASE WHEN bb = 0 THEN 0 WHEN aa = 0 THEN za / bb ELSE (aa * za - ab * ya) / d END AS r, CASE WHEN bb = 0 THEN 0 WHEN aa = 0 THEN zb / bb ELSE (aa * zb - ab * yb) / d END AS s FROM (SELECT *, aa * bb - ab * ab AS d FROM g)),
pw(series_id, w_start, n, p, q, r, s) AS (SELECT series_id, w_start, 1, p, q, r, s FROM k UNION ALL
  SELECT pw.series_id, pw.w_start, n + 1, pw.p * k.p + pw.q * k.r, pw.p * k.q + pw.q * k.s, pw.r * k.p + pw.s * k.r, pw.r * k.q + pw.s * k.s FROM pw JOIN k ON k.series_id = pw.series_id AND k.w_start = pw.w_start WHERE n < 7),
rec AS (SELECT z.series_id, z.w_start, 'rec' AS part, z.pos AS h, coalesce(y.a * p + y.b * r, z.a) AS a, coalesce(y.a * q + y.b * s, z.b) AS b
  FROM z JOIN k ON k.series_id = z.series_id AND k.w_start = z.w_start LEFT JOIN z y ON y.series_id = z.series_id AND y.w_start = z.w_start AND y.pos = z.pos - 1),
pred AS (SELECT z.series_id, z.w_start, 'pred' AS part, {{h}} AS h, z.a * p + z.b * r AS a, z.a * q + z.b * s AS b FROM z JOIN pw ON pw.series_id = z.series_id AND pw.w_start = z.w_start AND {{on}}),
alls AS (SELECT * FROM rec UNION ALL SELECT * FROM pred)
SELECT series_id, w_start, part, 'orders' AS feature, CAST(h AS INTEGER) AS h, {rsql('a', 4)} AS value FROM alls UNION ALL SELECT series_id, w_start, part, 'mean', CAST(h AS INTEGER), {rsql('b', 4)} FROM alls"""


def _dynamics(spark: SparkSession, sf: str, multi_step: bool) -> DataFrame:
    cols = ["orders", "mean"]
    wins = windows.sliding_windows(daily(spark, sf), 28, 14, cols)
    scaled = scaling.normalize_window(scaling.normalize_window(wins, "orders"), "mean")
    out = forecast.linear_dynamics(scaled, cols, 7, multi_step)
    pieces = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(c).alias("feature"), F.col(f"dynamics.{p}")[i].alias("v")) for p in ("rec", "pred") for i, c in enumerate(cols)])
    each = out.select("series_id", "w_start", F.explode(pieces).alias("s"))
    return each.select("series_id", "w_start", "s.part", "s.feature", F.posexplode("s.v").alias("h", "value")).withColumn("value", r("value", 4))


@query("linear_dynamics", DYNAMICS_SQL.replace("{h}", "n - 1").replace("{on}", "z.pos = 27"))
def linear_dynamics(spark: SparkSession, sf: str) -> DataFrame:
    return _dynamics(spark, sf, False)


@query("linear_dynamics_multi_step", DYNAMICS_SQL.replace("{h}", "z.pos - 21").replace("{on}", "n = 7 AND z.pos >= 21"))
def linear_dynamics_multi_step(spark: SparkSession, sf: str) -> DataFrame:
    return _dynamics(spark, sf, True)


# -- fitted detectors and classifier ------------------------------------------------------------------------


@query("low_rank_scores")
def low_rank_scores(spark: SparkSession, sf: str) -> DataFrame:
    wins = staged(_wins(spark, sf))
    model, centre = learned.fit_low_rank(wins, 4, 24)
    out = learned.low_rank_reconstruction(wins, model, centre)
    return out.select("series_id", "w_start", r(scoring.window_score(["x"], ["reconstructed"]), 3).alias("score"))


@query("mixture_scores")
def mixture_scores(spark: SparkSession, sf: str) -> DataFrame:
    wins = staged(windows.sliding_windows(points(spark, sf), 8, 4))
    return learned.mixture_score(wins, learned.fit_mixture(wins, 3)).select("series_id", "w_start", r("score", 3).alias("score"))


@query("window_classes")
def window_classes(spark: SparkSession, sf: str) -> DataFrame:
    wins = shapes(spark, sf)
    out = learned.classify(wins, learned.fit_classifier(wins, balanced=True))
    return out.select("window_id", "label", "predicted", r(F.array_max("probabilities"), 3).alias("confidence"))


@query("class_weights", f"SELECT label::INTEGER AS label, {rsql('(SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * CAST(count(*) AS DOUBLE))')} AS weight FROM embeddings GROUP BY 1")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return learned.class_weights(shapes(spark, sf)).withColumn("weight", r("weight"))


# -- imputation ----------------------------------------------------------------------------------------------


HIDDEN = f"{uniform(0, 'x', Sql('series_id'), Sql('idx'))} < 0.25"


@query("random_mask", f"WITH {POINTS_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, CASE WHEN {HIDDEN} THEN 0 ELSE 1 END AS x_mask, CASE WHEN {HIDDEN} THEN NULL ELSE x END AS x_seen FROM points")
def random_mask(spark: SparkSession, sf: str) -> DataFrame:
    return impute.random_mask(points(spark, sf), ["x"]).select("series_id", "idx", "x_mask", "x_seen")


HOLES_SQL = f"{POINTS_SQL}, holes AS (SELECT series_id, idx, x, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS mask, CASE WHEN event_type <> 'error' THEN x END AS seen FROM points)"


def _holes(spark: SparkSession, sf: str) -> DataFrame:
    """Error events are the missing cells."""
    seen = F.col("event_type") != "error"
    return points(spark, sf).select(
        "series_id", "idx", "x", F.when(seen, 1).otherwise(0).alias("mask"), F.when(seen, F.col("x")).alias("seen")
    )


FILLED = """coalesce((SELECT arg_max(k.seen, k.idx) FROM holes k WHERE k.series_id = o.series_id AND k.idx <= o.idx AND k.seen IS NOT NULL),
  (SELECT arg_min(k.seen, k.idx) FROM holes k WHERE k.series_id = o.series_id AND k.idx >= o.idx AND k.seen IS NOT NULL))"""


@query("impute_fill", f"WITH {HOLES_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {FILLED} AS imputed FROM holes o")
def impute_fill(spark: SparkSession, sf: str) -> DataFrame:
    return impute.impute(_holes(spark, sf), "seen").select("series_id", "idx", "imputed")


@query("impute_mean", f"WITH {HOLES_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('coalesce(seen, avg(seen) OVER (PARTITION BY series_id))')} AS imputed FROM holes")
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    return impute.impute(_holes(spark, sf), "seen", "mean").select("series_id", "idx", r("imputed").alias("imputed"))


@query("impute_identity", f"WITH {POINTS_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, x AS imputed FROM points")
def impute_identity(spark: SparkSession, sf: str) -> DataFrame:
    return impute.impute(points(spark, sf), "x", "identity").select("series_id", "idx", "imputed")


TREND_SQL = f"""{HOLES_SQL}, filled AS (SELECT series_id, idx, seen, mask, x, {FILLED} AS f FROM holes o),
sz AS (SELECT series_id, count(*) AS n FROM filled GROUP BY 1), offs AS (SELECT unnest(range(-2, 3)) AS o),
smooth AS (SELECT c.series_id, c.idx, any_value(c.seen) AS seen, any_value(c.mask) AS mask, any_value(c.x) AS x, avg(p.f) AS m FROM filled c JOIN sz ON sz.series_id = c.series_id, offs
  JOIN filled p ON p.series_id = c.series_id AND p.idx = least(greatest(c.idx + o, 0), n - 1) GROUP BY 1, 2)"""


@query("impute_trend", f"WITH {TREND_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('coalesce(seen, m)')} AS imputed FROM smooth")
def impute_trend(spark: SparkSession, sf: str) -> DataFrame:
    return impute.impute(_holes(spark, sf), "seen", "trend", 5).select("series_id", "idx", r("imputed").alias("imputed"))


@query("imputation_error", f"WITH {TREND_SQL} SELECT series_id, count(*) AS cells, {rsql('avg(abs(x - m))')} AS mae, {rsql('avg((x - m) * (x - m))', 4)} AS mse FROM smooth WHERE mask = 0 GROUP BY 1")
def imputation_error(spark: SparkSession, sf: str) -> DataFrame:
    filled = impute.impute(_holes(spark, sf), "seen", "trend", 5)
    out = impute.imputation_error(filled, "x", "imputed", F.col("mask"), ["series_id"])
    return out.select("series_id", "cells", r("mae").alias("mae"), r("mse", 4).alias("mse"))


# -- stationarity ----------------------------------------------------------------------------------------------


def _adf_sql(source: str, col: str) -> str:
    """Both regressions from centred sums over self-joined lags."""
    return f"""
lagged AS (SELECT a.series_id, b.{col} AS y, a.{col} - b.{col} AS d, b.{col} - c.{col} AS l FROM {source} a
           JOIN {source} b ON b.series_id = a.series_id AND b.idx = a.idx - 1 LEFT JOIN {source} c ON c.series_id = a.series_id AND c.idx = a.idx - 2),
s0 AS (SELECT series_id, count(*) AS n, regr_slope(d, y) AS b, regr_sxx(d, y) AS sxx, regr_syy(d, y) * (1 - regr_r2(d, y)) AS rss FROM lagged GROUP BY 1),
s0b AS (SELECT series_id, count(*) AS n, regr_syy(d, y) * (1 - regr_r2(d, y)) AS rss FROM lagged WHERE l IS NOT NULL GROUP BY 1),
m AS (SELECT *, y - avg(y) OVER w AS cy, d - avg(d) OVER w AS cd, l - avg(l) OVER w AS cl FROM lagged WHERE l IS NOT NULL WINDOW w AS (PARTITION BY series_id)),
q AS (SELECT series_id, count(*) AS n, sum(cy * cy) AS yy, sum(cl * cl) AS ll, sum(cd * cd) AS dd, sum(cy * cl) AS yl, sum(cy * cd) AS yd, sum(cl * cd) AS ld FROM m GROUP BY 1),
q2 AS (SELECT *, (ll * yd - yl * ld) / (yy * ll - yl * yl) AS b, (yy * ld - yl * yd) / (yy * ll - yl * yl) AS g FROM q),
s1 AS (SELECT series_id, n, b, dd - b * yd - g * ld AS rss, ll / (yy * ll - yl * yl) AS v FROM q2),
adf AS (SELECT s0.series_id, s0.n AS n0, s1.n AS n1, s0.b / sqrt(s0.rss / (s0.n - 2) / s0.sxx) AS t0, s1.b / sqrt(s1.rss / (s1.n - 3) * s1.v) AS t1,
        s1.n * ln(s1.rss / s1.n) + 6 < s0b.n * ln(s0b.rss / s0b.n) + 4 AS one
        FROM s0 JOIN s1 ON s1.series_id = s0.series_id JOIN s0b ON s0b.series_id = s0.series_id)"""


@query("unit_root_lag1", f"WITH {POINTS_SQL}, {_adf_sql('points', 'x')} SELECT series_id, 'x' AS feature, n1 AS n, {rsql('t1')} AS stat FROM adf")
def unit_root_lag1(spark: SparkSession, sf: str) -> DataFrame:
    return stationarity.adf(points(spark, sf), lag=1).select("series_id", "feature", "n", r("stat").alias("stat"))


@query("unit_root_aic", f"WITH {POINTS_SQL}, {_adf_sql('points', 'x')} SELECT series_id, 'x' AS feature, CASE WHEN one THEN 1 ELSE 0 END AS lag, CASE WHEN one THEN n1 ELSE n0 END AS n, {rsql('CASE WHEN one THEN t1 ELSE t0 END')} AS stat FROM adf")
def unit_root_aic(spark: SparkSession, sf: str) -> DataFrame:
    return stationarity.adf(points(spark, sf)).withColumn("stat", r("stat"))


FEATURES_SQL = f"{DAILY_SQL}, long AS (" + " UNION ALL ".join(f"SELECT series_id || '/{c}' AS series_id, idx, {c} AS v FROM daily" for c in ("orders", "total", "mean")) + ")"


@query(
    "unit_root_mean",
    f"WITH {FEATURES_SQL}, {_adf_sql('long', 'v')} SELECT split_part(series_id, '/', 1) AS series_id, {rsql('avg(CASE WHEN one THEN t1 ELSE t0 END)')} AS mean_stat FROM adf GROUP BY 1",
)
def unit_root_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over the features of a series."""
    stats = stationarity.adf(daily(spark, sf), ["orders", "total", "mean"])
    return stationarity.mean_adf(stats, ["series_id"]).withColumn("mean_stat", r("mean_stat"))

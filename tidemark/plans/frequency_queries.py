"""Decomposition, smoothing, wavelets, spectra and the closed-form forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decompose, forecast, ordering, spectral, windows
from tidemark.plans.draws_sql import Sql, cell
from tidemark.plans.inputs import HOURLY_SQL, POINTS_SQL, events, hourly, points, windows_sql
from tidemark.plans.registry import query, r, rsql

WIN_SQL = f"{POINTS_SQL}, {windows_sql('points', 24, 12)}"


def _wins(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding_windows(points(spark, sf), 24, 12)


def _long(df: DataFrame, col: str, digits: int = 6, name: str = "v") -> DataFrame:
    out = df.select("series_id", "w_start", F.posexplode(col).alias("pos", name))
    return out.withColumn(name, r(name, digits))


# -- moving averages ----------------------------------------------------------------------------------


def _ma_sql(source: str, kernels: list[int]) -> str:
    half = max(kernels) // 2
    means = ", ".join(f"avg(p.x) FILTER (abs(o.o) <= {k // 2}) AS ma_{k}" for k in kernels)
    return f"""sz AS (SELECT series_id, count(*) AS n FROM {source} GROUP BY 1),
offs AS (SELECT unnest(range({-half}, {half + 1})) AS o),
ma AS (SELECT c.series_id, c.idx, any_value(c.x) AS x, {means}
       FROM {source} c JOIN sz ON sz.series_id = c.series_id, offs o
       JOIN {source} p ON p.series_id = c.series_id AND p.idx = least(greatest(c.idx + o.o, 0), n - 1) GROUP BY 1, 2)"""


@query("moving_average", f"WITH {POINTS_SQL}, {_ma_sql('points', [5, 13])} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('ma_5')} AS ma_5, {rsql('ma_13')} AS ma_13 FROM ma")
def moving_average(spark: SparkSession, sf: str) -> DataFrame:
    out = decompose.moving_average(points(spark, sf), [5, 13], rows=32)
    return out.select("series_id", "idx", r("ma_5").alias("ma_5"), r("ma_13").alias("ma_13"))


@query("trend_seasonal", f"WITH {HOURLY_SQL}, {_ma_sql('hourly', [25])} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('ma_25')} AS trend, {rsql('x - ma_25')} AS seasonal FROM ma")
def trend_seasonal(spark: SparkSession, sf: str) -> DataFrame:
    return decompose.decompose(hourly(spark, sf), 25).select("series_id", "idx", r("trend").alias("trend"), r("seasonal").alias("seasonal"))


@query(
    "trend_seasonal_single_series",
    f"""WITH one AS (SELECT 0 AS series_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value AS x FROM events), {_ma_sql('one', [25])}
SELECT CAST(idx AS BIGINT) AS idx, {rsql('ma_25')} AS trend, {rsql('x - ma_25')} AS seasonal FROM ma""",
)
def trend_seasonal_single_series(spark: SparkSession, sf: str) -> DataFrame:
    one = ordering.add_index(events(spark, sf).select("event_id", "ts", "x"), keys=[], order=["ts", "event_id"])
    return decompose.decompose(one, 25, keys=[], rows=512).select("idx", r("trend").alias("trend"), r("seasonal").alias("seasonal"))


@query("trend_multi_kernel", f"WITH {HOURLY_SQL}, {_ma_sql('hourly', [5, 13, 25])} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('(ma_5 + ma_13 + ma_25) / 3')} AS trend FROM ma")
def trend_multi_kernel(spark: SparkSession, sf: str) -> DataFrame:
    return decompose.decompose_multi(hourly(spark, sf), [5, 13, 25]).select("series_id", "idx", r("trend").alias("trend"))


@query(
    "window_trend",
    f"""WITH {WIN_SQL}, offs AS (SELECT unnest(range(-3, 4)) AS o)
SELECT w.series_id, w.w_start, CAST(w.pos AS INTEGER) AS pos, {rsql('avg(p.x)')} AS v
FROM wins w, offs JOIN wins p ON p.series_id = w.series_id AND p.w_start = w.w_start AND p.pos = least(greatest(w.pos + o, 0), 23) GROUP BY 1, 2, 3""",
)
def window_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _long(decompose.decompose_window(_wins(spark, sf), 7), "trend")


# -- smoothing and filters --------------------------------------------------------------------------------


@query(
    "exponential_smoothing",
    f"""WITH {POINTS_SQL}
SELECT a.series_id, CAST(a.idx AS BIGINT) AS idx, {rsql('pow(0.8, a.idx + 1) * 50 + sum(0.2 * pow(0.8, a.idx - b.idx) * b.x)')} AS v
FROM points a JOIN points b ON a.series_id = b.series_id AND b.idx <= a.idx GROUP BY 1, 2, a.idx""",
)
def exponential_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    out = decompose.exponential_smoothing(points(spark, sf), 0.8, 50.0)
    return out.select("series_id", "idx", r("smoothed").alias("v"))


@query(
    "exponential_smoothing_single_series",
    f"""WITH one AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value AS x FROM events)
SELECT CAST(a.idx AS BIGINT) AS idx, {rsql('sum(0.5 * pow(0.5, a.idx - b.idx) * b.x)')} AS v
FROM one a JOIN one b ON b.idx <= a.idx GROUP BY 1, a.idx""",
)
def exponential_smoothing_single_series(spark: SparkSession, sf: str) -> DataFrame:
    one = ordering.add_index(events(spark, sf).select("event_id", "ts", "x"), keys=[], order=["ts", "event_id"])
    return decompose.exponential_smoothing(one, 0.5, keys=[]).select("idx", r("smoothed").alias("v"))


GROWTH_SQL = f"""{POINTS_SQL},
diffs AS (SELECT a.series_id, a.idx, a.x, a.x - coalesce(b.x, 50) AS d FROM points a LEFT JOIN points b ON a.series_id = b.series_id AND b.idx = a.idx - 1),
grown AS (SELECT a.series_id, a.idx, any_value(a.x) AS x, sum(0.2929 * pow(0.7071, a.idx - b.idx) * b.d) AS g FROM diffs a JOIN diffs b ON a.series_id = b.series_id AND b.idx <= a.idx GROUP BY 1, 2)"""


@query("growth", f"WITH {GROWTH_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('g')} AS v FROM grown")
def growth(spark: SparkSession, sf: str) -> DataFrame:
    return decompose.growth(points(spark, sf), 0.7071, z0=50.0).select("series_id", "idx", r("growth").alias("v"))


@query(
    "damped_trend_forecast",
    f"""WITH {GROWTH_SQL}, n AS (SELECT series_id, max(idx) AS t FROM points GROUP BY 1),
lev AS (SELECT n.series_id, t, pow(0.8, t + 1) * 50 + sum(0.2 * pow(0.8, t - g.idx) * g.x + pow(0.8, t - g.idx + 1) * g.g) AS level, max(g.g) FILTER (g.idx = t) AS growth
        FROM n JOIN grown g ON g.series_id = n.series_id GROUP BY 1, 2),
st AS (SELECT h, (SELECT sum(pow(0.9, i)) FROM range(1, h + 1) q(i)) AS w FROM range(1, 7) s(h))
SELECT series_id, CAST(t AS BIGINT) AS last_idx, CAST(h AS INTEGER) AS h, {rsql('level + growth * w')} AS pred FROM lev, st""",
)
def damped_trend_forecast(spark: SparkSession, sf: str) -> DataFrame:
    out = forecast.damped_trend_forecast(points(spark, sf), 0.8, 0.7071, 0.9, 6, v0=50.0)
    return out.withColumn("pred", r("pred"))


KERNEL = [0.1, 0.2, 0.3, 0.4]


@query(
    "causal_filter",
    f"""WITH {POINTS_SQL}, k(lag, w) AS (VALUES (0, 0.4), (1, 0.3), (2, 0.2), (3, 0.1))
SELECT a.series_id, CAST(a.idx AS BIGINT) AS idx, {rsql('sum(w * b.x)')} AS v FROM points a, k JOIN points b ON b.series_id = a.series_id AND b.idx = a.idx - lag GROUP BY 1, 2""",
)
def causal_filter(spark: SparkSession, sf: str) -> DataFrame:
    return decompose.causal_filter(points(spark, sf), KERNEL).select("series_id", "idx", r("filtered").alias("v"))


# -- wavelets ---------------------------------------------------------------------------------------------

HAAR_STEP = """
a{j} AS (SELECT series_id, idx // 2 AS idx, (coalesce(max(x) FILTER (idx % 2 = 0), 0) + coalesce(max(x) FILTER (idx % 2 = 1), 0)) / sqrt(2) AS x,
                (coalesce(max(x) FILTER (idx % 2 = 0), 0) - coalesce(max(x) FILTER (idx % 2 = 1), 0)) / sqrt(2) AS h FROM {src} GROUP BY 1, 2)"""
HAAR_SQL = f"""{POINTS_SQL}, {HAAR_STEP.format(j=1, src='points')}, {HAAR_STEP.format(j=2, src='a1')}, {HAAR_STEP.format(j=3, src='a2')}"""


@query(
    "haar_transform",
    f"""WITH {HAAR_SQL}
SELECT series_id, 'high_1' AS band, CAST(idx AS BIGINT) AS pos, {rsql('h')} AS coef FROM a1 UNION ALL
SELECT series_id, 'high_2', CAST(idx AS BIGINT), {rsql('h')} FROM a2 UNION ALL
SELECT series_id, 'high_3', CAST(idx AS BIGINT), {rsql('h')} FROM a3 UNION ALL
SELECT series_id, 'low_3', CAST(idx AS BIGINT), {rsql('x')} FROM a3""",
)
def haar_transform(spark: SparkSession, sf: str) -> DataFrame:
    return decompose.haar(points(spark, sf), 3).withColumn("coef", r("coef"))


@query("haar_inverse", f"WITH {POINTS_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('x')} AS x FROM points")
def haar_inverse(spark: SparkSession, sf: str) -> DataFrame:
    pts = points(spark, sf)
    back = decompose.inverse_haar(decompose.haar(pts, 3), lengths=ordering.series_lengths(pts))
    return back.select("series_id", F.col("idx").cast("long").alias("idx"), r("x").alias("x"))


@query(
    "wavelet_window",
    f"""WITH {WIN_SQL},
l1 AS (SELECT series_id, w_start, pos // 2 AS pos, sum(x) / sqrt(2) AS lo, sum(CASE WHEN pos % 2 = 0 THEN x ELSE -x END) / sqrt(2) AS hi FROM wins GROUP BY 1, 2, 3),
l2 AS (SELECT series_id, w_start, pos // 2 AS pos, sum(lo) / sqrt(2) AS lo, sum(CASE WHEN pos % 2 = 0 THEN lo ELSE -lo END) / sqrt(2) AS hi FROM l1 GROUP BY 1, 2, 3)
SELECT series_id, w_start, 'high_1' AS band, CAST(pos AS INTEGER) AS pos, {rsql('hi')} AS v FROM l1 UNION ALL
SELECT series_id, w_start, 'high_2', CAST(pos AS INTEGER), {rsql('hi')} FROM l2 UNION ALL
SELECT series_id, w_start, 'low_2', CAST(pos AS INTEGER), {rsql('lo')} FROM l2""",
)
def wavelet_window(spark: SparkSession, sf: str) -> DataFrame:
    bands = decompose.wavelet_window(_wins(spark, sf), 24, 2, mode="symmetric")
    parts = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("c")) for b in ("high_1", "high_2", "low_2")])
    out = bands.select("series_id", "w_start", F.explode(parts).alias("s"))
    out = out.select("series_id", "w_start", "s.band", F.posexplode("s.c").alias("pos", "v"))
    return out.withColumn("v", r("v"))


@query("wavelet_window_inverse", f"WITH {WIN_SQL} SELECT series_id, w_start, CAST(pos AS INTEGER) AS pos, {rsql('x')} AS v FROM wins")
def wavelet_window_inverse(spark: SparkSession, sf: str) -> DataFrame:
    bands = decompose.wavelet_window(_wins(spark, sf), 24, 2)
    return _long(decompose.inverse_wavelet_window(bands, 2), "restored")


# -- spectra ------------------------------------------------------------------------------------------------

DFT_SQL = f"""{WIN_SQL},
bins AS (SELECT unnest(range(0, 13)) AS bin),
dft AS (SELECT series_id, w_start, bin, sum(x * cos(2 * pi() * bin * pos / 24.0)) AS re, -sum(x * sin(2 * pi() * bin * pos / 24.0)) AS im FROM wins, bins GROUP BY 1, 2, 3),
amps AS (SELECT *, sqrt(re * re + im * im) AS amp FROM dft)"""


@query("spectrum_rows", f"WITH {DFT_SQL} SELECT series_id, w_start, 'x' AS feature, CAST(bin AS INTEGER) AS bin, {rsql('amp', 5)} AS amp FROM amps")
def spectrum_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.spectrum_rows(_wins(spark, sf)).withColumn("amp", r("amp", 5))


PERIOD_SQL = f"""{DFT_SQL}, m AS (SELECT bin, avg(amp) AS amp FROM amps GROUP BY 1),
top AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN bin = 0 THEN 0 ELSE amp END DESC, bin) AS rank FROM m)"""


@query("dominant_periods", f"WITH {PERIOD_SQL} SELECT CAST(rank AS INTEGER) AS rank, CAST(bin AS INTEGER) AS bin, CAST(24 // bin AS BIGINT) AS period, {rsql('amp', 5)} AS amp FROM top WHERE rank <= 3")
def dominant_periods(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.dominant_periods(_wins(spark, sf), 24, 3).withColumn("amp", r("amp", 5))


@query("window_period_weights", f"WITH {DFT_SQL} SELECT series_id, w_start, CAST(bin AS INTEGER) AS bin, {rsql('amp', 5)} AS weight FROM amps WHERE bin IN (1, 2, 4)")
def window_period_weights(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.window_period_weights(_wins(spark, sf), [1, 2, 4]).withColumn("weight", r("weight", 5))


@query("shared_spectrum", f"WITH {DFT_SQL}, m AS (SELECT bin, avg(amp) AS amp, row_number() OVER (ORDER BY avg(amp) DESC, bin) AS rank FROM amps GROUP BY 1) SELECT CAST(rank AS INTEGER) AS rank, CAST(bin AS INTEGER) AS bin, {rsql('amp', 5)} AS amp FROM m WHERE rank <= 2")
def shared_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.shared_spectrum(_wins(spark, sf), 24).withColumn("amp", r("amp", 5))


INVERSE = "sum((CASE WHEN f.bin IN (0, 12) THEN 1 ELSE 2 END) / 24.0 * (f.re * cos(2 * pi() * f.bin * w.pos / 24.0) - f.im * sin(2 * pi() * f.bin * w.pos / 24.0)))"


@query(
    "spectrum_split",
    f"""WITH {DFT_SQL}
SELECT w.series_id, w.w_start, CAST(w.pos AS INTEGER) AS pos, {rsql(INVERSE)} AS invariant, {rsql(f'any_value(w.x) - {INVERSE}')} AS variant
FROM wins w JOIN dft f ON f.series_id = w.series_id AND f.w_start = w.w_start WHERE f.bin IN (0, 1, 3) GROUP BY 1, 2, 3""",
)
def spectrum_split(spark: SparkSession, sf: str) -> DataFrame:
    both = spectral.spectrum_split(_wins(spark, sf), [0, 1, 3]).withColumn("z", F.arrays_zip("invariant", "variant"))
    out = both.select("series_id", "w_start", F.posexplode("z").alias("pos", "z"))
    return out.select("series_id", "w_start", "pos", r("z.invariant").alias("invariant"), r("z.variant").alias("variant"))


@query(
    "dft_season_trend",
    f"""WITH {DFT_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, w_start ORDER BY amp DESC) AS rk FROM amps WHERE bin > 0),
f AS (SELECT * FROM rk WHERE rk < 5)
SELECT w.series_id, w.w_start, CAST(w.pos AS INTEGER) AS pos, {rsql(INVERSE)} AS seasonal, {rsql(f'any_value(w.x) - {INVERSE}')} AS trend
FROM wins w JOIN f ON f.series_id = w.series_id AND f.w_start = w.w_start GROUP BY 1, 2, 3""",
)
def dft_season_trend(spark: SparkSession, sf: str) -> DataFrame:
    both = spectral.dft_split(_wins(spark, sf), 5).withColumn("z", F.arrays_zip("seasonal", "trend"))
    out = both.select("series_id", "w_start", F.posexplode("z").alias("pos", "z"))
    return out.select("series_id", "w_start", "pos", r("z.seasonal").alias("seasonal"), r("z.trend").alias("trend"))


@query("select_modes", f"WITH {DFT_SQL} SELECT series_id, w_start, 'x' AS feature, CAST(bin AS INTEGER) AS bin, {rsql('amp', 5)} AS amp FROM amps WHERE bin < 4")
def select_modes(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.select_modes(spectral.spectrum_rows(_wins(spark, sf)), 24, 4).withColumn("amp", r("amp", 5))


@query(
    "select_modes_random",
    f"""WITH {DFT_SQL}, m AS (SELECT b, row_number() OVER (ORDER BY {cell(7, 'mode', Sql('b'))}, b) AS k FROM range(0, 12) r(b))
SELECT series_id, w_start, 'x' AS feature, CAST(bin AS INTEGER) AS bin, {rsql('amp', 5)} AS amp FROM amps JOIN m ON m.b = amps.bin WHERE k <= 4""",
)
def select_modes_random(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.select_modes(spectral.spectrum_rows(_wins(spark, sf)), 24, 4, "random", 7).withColumn("amp", r("amp", 5))


LAG_SQL = f"""{WIN_SQL}, lags AS (SELECT unnest(range(0, 13)) AS lag),
half AS (SELECT q.series_id, q.w_start, lag, sum(q.x * k.x) AS c FROM lags, wins q JOIN wins k ON k.series_id = q.series_id AND k.w_start = q.w_start AND q.pos = (k.pos + lag) % 24 GROUP BY 1, 2, 3),
corr AS (SELECT * FROM half UNION ALL SELECT series_id, w_start, 24 - lag, c FROM half WHERE lag BETWEEN 1 AND 11),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, w_start ORDER BY round(c, 4) DESC, lag) AS rk, max(c) OVER (PARTITION BY series_id, w_start) AS best FROM corr),
top AS (SELECT *, exp(c - best) / sum(exp(c - best)) OVER (PARTITION BY series_id, w_start) AS weight FROM rk WHERE rk <= 3)"""


@query("autocorrelation_values", f"WITH {LAG_SQL} SELECT series_id, w_start, CAST(lag AS INTEGER) AS pos, {rsql('c', 4)} AS v FROM corr")
def autocorrelation_values(spark: SparkSession, sf: str) -> DataFrame:
    return _long(spectral.autocorrelation(_wins(spark, sf)), "corr", 4)


@query("strongest_lags", f"WITH {LAG_SQL} SELECT series_id, w_start, CAST(rk AS INTEGER) AS rank, CAST(lag AS INTEGER) AS lag, {rsql('c', 4)} AS corr, {rsql('weight', 5)} AS weight FROM top")
def strongest_lags(spark: SparkSession, sf: str) -> DataFrame:
    out = spectral.autocorrelation(_wins(spark, sf)).select("series_id", "w_start", F.posexplode("lags").alias("k", "s"))
    return out.select("series_id", "w_start", (F.col("k") + 1).alias("rank"), "s.lag", r("s.corr", 4).alias("corr"), r("s.weight", 5).alias("weight"))


@query(
    "delay_aggregation",
    f"""WITH {LAG_SQL}
SELECT w.series_id, w.w_start, CAST(w.pos AS INTEGER) AS pos, {rsql('sum(weight * r.x)', 5)} AS v
FROM wins w JOIN top t ON t.series_id = w.series_id AND t.w_start = w.w_start JOIN wins r ON r.series_id = w.series_id AND r.w_start = w.w_start AND r.pos = (w.pos + t.lag) % 24
GROUP BY 1, 2, 3""",
)
def delay_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    return _long(spectral.delay_aggregation(spectral.autocorrelation(_wins(spark, sf))), "aggregated", 5)


@query("shared_lags", f"WITH {LAG_SQL}, m AS (SELECT lag, avg(c) AS c, row_number() OVER (ORDER BY round(avg(c), 4) DESC, lag) AS rank FROM corr GROUP BY 1) SELECT CAST(rank AS INTEGER) AS rank, CAST(lag AS INTEGER) AS lag, {rsql('c', 3)} AS corr FROM m WHERE rank <= 3")
def shared_lags(spark: SparkSession, sf: str) -> DataFrame:
    # a lag and its mirror are one sum, so the smaller lag comes first
    return spectral.shared_lags(_wins(spark, sf)).select("rank", "lag", r("corr", 3).alias("corr"))


HARMONIC = "sum(2 * f.amp / 24.0 * cos(2 * pi() * f.bin * t / 24.0 + atan2(f.im, f.re)))"
HARMONIC_SQL = f"""{DFT_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, w_start ORDER BY amp DESC) AS rk FROM amps WHERE bin BETWEEN 1 AND 11),
f AS (SELECT * FROM rk WHERE rk <= 3)"""


@query("harmonic_extrapolation", f"WITH {HARMONIC_SQL} SELECT series_id, w_start, CAST(t AS INTEGER) AS pos, {rsql(HARMONIC)} AS v FROM f, range(0, 36) g(t) GROUP BY 1, 2, 3")
def harmonic_extrapolation(spark: SparkSession, sf: str) -> DataFrame:
    return _long(spectral.harmonic_extrapolation(_wins(spark, sf), 24, 12, 3), "season")


@query(
    "harmonic_forecast",
    f"""WITH {HARMONIC_SQL}, c AS (SELECT series_id, w_start, CAST(t - 24 AS INTEGER) AS pos, {HARMONIC} AS v FROM f, range(24, 30) g(t) GROUP BY 1, 2, 3),
m AS (SELECT series_id, w_start, avg(x) AS m FROM wins GROUP BY 1, 2)
SELECT c.series_id, c.w_start, 't+' || (pos + 1) AS step, {rsql('v + m')} AS pred FROM c JOIN m ON m.series_id = c.series_id AND m.w_start = c.w_start""",
)
def harmonic_forecast(spark: SparkSession, sf: str) -> DataFrame:
    long_run = forecast.harmonic_forecast(_wins(spark, sf), 24, 12, 3)
    return forecast.named_steps(forecast.take_steps(long_run, 6)).withColumn("pred", r("pred"))


@query("unfitted_linear", f"WITH {WIN_SQL} SELECT series_id, w_start, 't+' || h AS step, {rsql('avg(x)')} AS pred FROM wins, range(1, 5) g(h) GROUP BY 1, 2, h")
def unfitted_linear(spark: SparkSession, sf: str) -> DataFrame:
    out = forecast.unfitted_linear(_wins(spark, sf), 4, kernel=7)
    return forecast.named_steps(out).withColumn("pred", r("pred"))

"""Cleaning, splits, scaling, calendar features and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import arrays, calendar
from tidemark.operators import cleaning, ordering, scaling, splits, windows
from tidemark.plans.inputs import (
    DAILY_SQL,
    DAY,
    HOURLY_SQL,
    POINTS_SQL,
    daily,
    events,
    hourly,
    points,
    table,
    windows_sql,
)
from tidemark.plans.registry import query, r, rsql
from tidemark.session import staged

# -- index, cleaning -------------------------------------------------------------------------------


@query("series_index", f"WITH {POINTS_SQL} SELECT series_id, event_id, CAST(idx AS BIGINT) AS idx FROM points")
def series_index(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("series_id", "event_id", "idx")


@query("single_series_index", "SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events")
def single_series_index(spark: SparkSession, sf: str) -> DataFrame:
    one = events(spark, sf).select("event_id", "ts")
    return ordering.add_index(one, keys=[], order=["ts", "event_id"]).select("event_id", "idx")


@query("feature_mode_ms", f"WITH {DAILY_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, orders, {rsql('mean', 4)} AS mean, {rsql('total', 2)} AS total, {rsql('total', 2)} AS y FROM daily")
def feature_mode_ms(spark: SparkSession, sf: str) -> DataFrame:
    wide = daily(spark, sf)
    out = cleaning.select_features(wide, "MS", target="total", ts="ts", keys=["series_id", "idx"])
    return out.drop("ts").withColumns({"mean": r("mean", 4), "total": r("total", 2), "y": r("y", 2)})


@query("feature_mode_single", f"WITH {DAILY_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('total', 2)} AS total FROM daily")
def feature_mode_single(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.select_features(daily(spark, sf), "S", target="total", keys=["series_id", "idx"])
    return out.drop("ts").withColumn("total", r("total", 2))


@query("drop_null_cast", "SELECT event_id, CAST(value AS DOUBLE) AS x, CAST(k AS DOUBLE) AS k FROM (SELECT event_id, value, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events) WHERE k IS NOT NULL AND value IS NOT NULL")
def drop_null_cast(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    df = table(spark, sf, "events").select("event_id", "user_id", F.col("value").alias("x"), F.when(k % 7 != 0, k).alias("k"))
    clean = cleaning.drop_columns(cleaning.drop_null_rows(df, ["x", "k"]), ["user_id"])
    return cleaning.cast_features(clean, ["x", "k"])


GRID_SQL = f"""{HOURLY_SQL},
span AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span)"""


@query(
    "fill_forward_backward",
    f"""WITH {GRID_SQL},
known AS (SELECT g.series_id, g.ts, h.x FROM grid g LEFT JOIN hourly h ON h.series_id = g.series_id AND h.ts = g.ts)
SELECT series_id, CAST(epoch(ts) AS BIGINT) // 3600 AS hour_no, {rsql('''coalesce(
  (SELECT arg_max(k.x, k.ts) FROM known k WHERE k.series_id = o.series_id AND k.ts <= o.ts AND k.x IS NOT NULL),
  (SELECT arg_min(k.x, k.ts) FROM known k WHERE k.series_id = o.series_id AND k.ts >= o.ts AND k.x IS NOT NULL))''')} AS x
FROM known o""",
)
def fill_forward_backward(spark: SparkSession, sf: str) -> DataFrame:
    grid = cleaning.fill_gaps_in_time(hourly(spark, sf).select("series_id", "ts", "x"), 3600, ["x"])
    filled = cleaning.fill_forward_backward(grid, ["x"], chunk=ordering.time_chunk("ts", 5 * DAY))
    hour_no = F.floor(ordering.epoch_micros("ts") / F.lit(3_600_000_000)).cast("long")
    return filled.select("series_id", hour_no.alias("hour_no"), r("x").alias("x"))


@query("length_report", "SELECT user_id AS series_id, count(*) AS n, count(*) >= 64 AS enough FROM events GROUP BY 1")
def length_report(spark: SparkSession, sf: str) -> DataFrame:
    checked = cleaning.validate_schema(events(spark, sf), ["x"], width=1)
    return cleaning.length_report(checked, 64)


@query("binary_labels", "SELECT event_id, CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS is_attack, CASE WHEN value > 0 THEN 1 ELSE 0 END AS positive FROM events")
def binary_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = events(spark, sf)
    named = cleaning.binary_label(df, "event_type", normal="view", name="is_attack")
    return cleaning.binary_label(named, "x", name="positive").select("event_id", "is_attack", "positive")


@query("attach_labels", f"WITH {HOURLY_SQL}, lab AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, max(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS label FROM events GROUP BY 1, 2) SELECT h.series_id, CAST(h.idx AS BIGINT) AS idx, {rsql('h.x')} AS x, l.label FROM hourly h JOIN lab l ON h.series_id = l.series_id AND h.ts = l.ts")
def attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = (
        cleaning.binary_label(events(spark, sf).withColumn("over", F.col("x") - 100), "over")
        .groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.max("label").alias("label"))
    )
    return cleaning.attach_labels(hourly(spark, sf).drop("label"), labels).select("series_id", "idx", r("x").alias("x"), "label")


@query("split_roles", f"WITH {DAILY_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, CAST(length(series_id) AS DOUBLE) AS static_0, orders AS observed_0, {rsql('total', 2)} AS observed_1, CAST(month(ts) AS DOUBLE) AS known_0 FROM daily")
def split_roles(spark: SparkSession, sf: str) -> DataFrame:
    df = daily(spark, sf).withColumns({"name_len": F.length("series_id"), "month": F.month("ts")})
    out = cleaning.split_roles(df, ["name_len"], ["orders", "total"], ["month"], ["series_id", "idx"], "ts")
    return out.select(
        "series_id",
        "idx",
        F.col("static")[0].alias("static_0"),
        F.col("observed")[0].alias("observed_0"),
        r(F.col("observed")[1], 2).alias("observed_1"),
        F.col("known")[0].alias("known_0"),
    )


# -- splits ------------------------------------------------------------------------------------------

BORDERS = (1200, 1600, 2000)


@query(
    "split_borders",
    f"""WITH {DAILY_SQL}, bounds(split, lo, hi) AS (VALUES ('train', 0, 1200), ('val', 1200 - 96, 1600), ('test', 1600 - 96, 2000))
SELECT series_id, CAST(idx AS BIGINT) AS idx, split FROM daily JOIN bounds ON idx >= lo AND idx < hi""",
)
def split_borders(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_borders(daily(spark, sf), BORDERS, history=96).select("series_id", "idx", "split")


RATIO_SQL = f"""{DAILY_SQL},
sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM daily)"""


@query(
    "split_ratio",
    f"""WITH {RATIO_SQL},
b AS (SELECT DISTINCT series_id, n, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS tr, n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS cut FROM sized),
bounds AS (
  SELECT series_id, 'train' AS split, 0 AS lo, tr AS hi FROM b UNION ALL
  SELECT series_id, 'val', tr - 24, cut FROM b UNION ALL
  SELECT series_id, 'test', cut - 24, n FROM b)
SELECT d.series_id, CAST(d.idx AS BIGINT) AS idx, split FROM daily d JOIN bounds b ON b.series_id = d.series_id AND d.idx >= lo AND d.idx < hi""",
)
def split_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_ratio(daily(spark, sf), history=24).select("series_id", "idx", "split")


@query("split_train_valid", f"WITH {RATIO_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, CASE WHEN idx < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM sized")
def split_train_valid(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_train_valid(daily(spark, sf)).select("series_id", "idx", "split")


@query("split_rows", f"WITH {DAILY_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, CASE WHEN idx < 400 THEN 'train' WHEN idx < 550 THEN 'val' ELSE 'test' END AS split FROM daily")
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_rows(daily(spark, sf)).select("series_id", "idx", "split")


@query("row_range", f"WITH {POINTS_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, x FROM points WHERE idx BETWEEN 10 AND 39")
def row_range(spark: SparkSession, sf: str) -> DataFrame:
    return splits.rows_between(points(spark, sf), 10, 30).select("series_id", "idx", "x")


# -- scaling -------------------------------------------------------------------------------------------

SPLIT_SQL = f"""{RATIO_SQL},
cut AS (SELECT *, CASE WHEN idx < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train' WHEN idx < n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM sized),
fit AS (SELECT series_id, avg(total) AS mt, stddev_pop(total) AS st, min(total) AS lt, max(total) AS ht,
               avg(orders) AS mo, stddev_pop(orders) AS so, min(orders) AS lo, max(orders) AS ho
        FROM cut WHERE split = 'train' GROUP BY 1),
own AS (SELECT series_id, split, max(total) AS ht, max(orders) AS ho FROM cut GROUP BY 1, 2)"""


def _split_daily(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_ratio(daily(spark, sf))


def _scaled(method: str, per_split: bool = False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = scaling.scale_splits(_split_daily(spark, sf), ["total", "orders"], method, per_split=per_split)
        return out.select("series_id", "idx", "split", r("total").alias("total"), r("orders").alias("orders"))

    return run


def _scale_sql(total: str, orders: str, join: str = "JOIN fit f ON f.series_id = c.series_id") -> str:
    return f"WITH {SPLIT_SQL} SELECT c.series_id, CAST(idx AS BIGINT) AS idx, c.split, {rsql(total)} AS total, {rsql(orders)} AS orders FROM cut c {join}"


def _nz(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 1 ELSE {x} END)"


query("scale_standard", _scale_sql(f"(total - mt) / {_nz('st')}", f"(orders - mo) / {_nz('so')}"))(_scaled("standard"))
query("scale_standard_eps", _scale_sql("(total - mt) / (st + 1e-8)", "(orders - mo) / (so + 1e-8)"))(_scaled("standard_eps"))
query("scale_minmax", _scale_sql("2 * (total - lt) / (ht - lt) - 1", f"2 * (orders - lo) / {_nz('(ho - lo)')} - 1"))(_scaled("minmax"))
query("scale_minmax_square", _scale_sql("pow((total - lt) / (ht - lt), 2)", f"pow((orders - lo) / {_nz('(ho - lo)')}, 2)"))(_scaled("minmax_square"))
query("scale_max_train", _scale_sql("2 * total / ht - 1", "2 * orders / ho - 1"))(_scaled("minmax_m1p1"))
query(
    "scale_max_per_split",
    _scale_sql("2 * total / ht - 1", "2 * orders / ho - 1", "JOIN own o ON o.series_id = c.series_id AND o.split = c.split"),
)(_scaled("minmax_m1p1", True))


INVERSE = {"standard": "standard", "minmax": "minmax", "square": "minmax_square", "top": "minmax_m1p1", "eps": "standard_eps", "flat": "standard_eps"}
FLAT = "CASE WHEN idx < 100 THEN 5.0 ELSE 7.0 END"  # constant where the scalers are fitted


@query(
    "scale_inverse",
    f"""WITH {DAILY_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('total', 3)} AS standard, {rsql('total', 3)} AS minmax, {rsql('CASE WHEN total >= lo THEN total ELSE 2 * lo - total END', 3)} AS square,
  {rsql('total', 3)} AS top, {rsql('total', 3)} AS eps, {rsql(FLAT, 3)} AS flat FROM daily JOIN (SELECT series_id, min(total) FILTER (idx < 100) AS lo FROM daily GROUP BY 1) USING (series_id)""",
)
def scale_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """All scalers fitted at once on the first rows, applied and taken back on all."""
    values = [F.when(F.col("idx") < 100, 5.0).otherwise(7.0) if n == "flat" else F.col("total") for n in INVERSE]
    df = daily(spark, sf).select("series_id", "idx", *[v.alias(n) for v, n in zip(values, INVERSE, strict=True)])
    stats = staged(scaling.fit_scaler(df.where("idx < 100"), list(INVERSE)))
    back = scaling.invert_scaler(scaling.apply_scaler(df, stats, list(INVERSE), INVERSE), stats, list(INVERSE), INVERSE)
    return back.select("series_id", "idx", *[r(n, 3).alias(n) for n in INVERSE])


WIN24_SQL = windows_sql("points", 24, 12)


def _win24(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding_windows(points(spark, sf), 24, 12)


def _long(df: DataFrame, col: str, *extra: str) -> DataFrame:
    return df.select("series_id", "w_start", *extra, F.posexplode(col).alias("pos", "v"))


@query(
    "window_instance_norm",
    f"""WITH {POINTS_SQL}, {WIN24_SQL}
SELECT series_id, w_start, CAST(pos AS INTEGER) AS pos, {rsql('(x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5)')} AS v
FROM wins WINDOW w AS (PARTITION BY series_id, w_start)""",
)
def window_instance_norm(spark: SparkSession, sf: str) -> DataFrame:
    out = _long(scaling.normalize_window(_win24(spark, sf), "x"), "x")
    return out.withColumn("v", r("v"))


@query(
    "window_norm_last",
    f"""WITH {POINTS_SQL}, {WIN24_SQL}
SELECT series_id, w_start, CAST(pos AS INTEGER) AS pos,
       {rsql('(x - last_value(x) OVER (PARTITION BY series_id, w_start ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / sqrt(var_pop(x) OVER (PARTITION BY series_id, w_start) + 1e-5)')} AS v
FROM wins""",
)
def window_norm_last(spark: SparkSession, sf: str) -> DataFrame:
    out = _long(scaling.normalize_window(_win24(spark, sf), "x", subtract_last=True), "x")
    return out.withColumn("v", r("v"))


@query("window_denorm", f"WITH {POINTS_SQL}, {WIN24_SQL} SELECT series_id, w_start, CAST(pos AS INTEGER) AS pos, {rsql('x')} AS v FROM wins")
def window_denorm(spark: SparkSession, sf: str) -> DataFrame:
    normed = scaling.normalize_window(_win24(spark, sf), "x", weight=1.5, bias=0.25)
    return _long(scaling.denormalize_window(normed, "x", weight=1.5, bias=0.25), "x").withColumn("v", r("v"))


@query(
    "window_subtract_last",
    f"""WITH {POINTS_SQL}, {WIN24_SQL}
SELECT a.series_id, a.w_start, CAST(a.pos AS INTEGER) AS pos, {rsql('a.x - b.x')} AS v, {rsql('a.x')} AS back
FROM wins a JOIN wins b ON a.series_id = b.series_id AND a.w_start = b.w_start AND b.pos = 23""",
)
def window_subtract_last(spark: SparkSession, sf: str) -> DataFrame:
    shifted = scaling.subtract_last(_win24(spark, sf), "x")
    both = scaling.add_last(shifted.withColumn("back", F.col("x")), "back", "x")
    zipped = both.withColumn("z", F.arrays_zip("x", "back"))
    out = _long(zipped, "z")
    return out.select("series_id", "w_start", "pos", r("v.x").alias("v"), r("v.back").alias("back"))


@query(
    "masked_stats",
    f"""WITH {POINTS_SQL}
SELECT series_id, count(*) FILTER (event_type <> 'error') AS observed, {rsql("avg(x) FILTER (event_type <> 'error')")} AS mean,
       {rsql("sqrt(var_pop(x) FILTER (event_type <> 'error') + 1e-5)")} AS std FROM points GROUP BY 1""",
)
def masked_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = scaling.masked_stats(events(spark, sf), F.col("x"), F.col("event_type") != "error", ["series_id"])
    return out.select("series_id", "observed", r("mean").alias("mean"), r("std").alias("std"))


# -- calendar ------------------------------------------------------------------------------------------


def _marks_sql(hour: str) -> str:
    return f"SELECT event_id, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, (isodow(ts) - 1)::INTEGER AS weekday, {hour}::INTEGER AS hour FROM events"


@query("calendar_marks", _marks_sql("hour(ts)"))
def calendar_marks(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", *calendar.calendar_marks())


@query("calendar_marks_daily", _marks_sql("0"))
def calendar_marks_daily(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", *calendar.calendar_marks(with_hour=False))


UNIT_SQL = {
    "second_of_minute": "floor(second(ts)) / 59.0 - 0.5",
    "minute_of_hour": "minute(ts) / 59.0 - 0.5",
    "hour_of_day": "hour(ts) / 23.0 - 0.5",
    "day_of_week": "(isodow(ts) - 1) / 6.0 - 0.5",
    "day_of_month": "(day(ts) - 1) / 30.0 - 0.5",
    "day_of_year": "(dayofyear(ts) - 1) / 365.0 - 0.5",
    "month_of_year": "(month(ts) - 1) / 11.0 - 0.5",
    "week_of_year": "(weekofyear(ts) - 1) / 52.0 - 0.5",
}


def _unit_query(name: str) -> None:
    @query(f"calendar_{name}", f"SELECT event_id, {rsql(UNIT_SQL[name], 9)} AS v FROM events")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return events(spark, sf).select("event_id", r(calendar.FEATURES[name]("ts"), 9).alias("v"))


for _name in UNIT_SQL:
    _unit_query(_name)


def _freq_query(freq: str, source: str, ts: str, key: str) -> None:
    names = calendar.BY_FREQUENCY[calendar.frequency_unit(freq)]
    cols = "".join(f", {rsql(UNIT_SQL[n].replace('ts', ts), 9)} AS {n}" for n in names)

    @query(f"time_features_{freq.lower()}", f"SELECT {key}{cols} FROM {source}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, source)
        feats = calendar.time_features(freq, ts)
        return df.select(key, *[r(c, 9).alias(n) for c, n in zip(feats, names, strict=True)])


_freq_query("15min", "events", "ts", "event_id")
_freq_query("h", "events", "ts", "event_id")
_freq_query("D", "orders", "o_orderdate", "o_orderkey")
_freq_query("W", "orders", "o_orderdate", "o_orderkey")
_freq_query("M", "orders", "o_orderdate", "o_orderkey")
_freq_query("S", "events", "ts", "event_id")


@query(
    "position_code",
    f"WITH {POINTS_SQL} SELECT series_id, CAST(idx AS BIGINT) AS idx, "
    + ", ".join(rsql(f"{'cos' if d % 2 else 'sin'}(idx * pow(10000, -{d - d % 2} / 8.0))") + f" AS pos_{d}" for d in range(8))
    + " FROM points",
)
def position_code(spark: SparkSession, sf: str) -> DataFrame:
    codes = calendar.position_code(F.col("idx").cast("double"), 8)
    return points(spark, sf).select("series_id", "idx", *codes).withColumns({f"pos_{d}": r(f"pos_{d}") for d in range(8)})


@query(
    "calendar_position_code",
    "SELECT event_id, " + ", ".join(rsql(f"{'cos' if d % 2 else 'sin'}(hour(ts) * pow(10000, -{d - d % 2} / 4.0))") + f" AS pos_{d}" for d in range(4)) + " FROM events",
)
def calendar_position_code(spark: SparkSession, sf: str) -> DataFrame:
    codes = calendar.position_code(F.hour("ts").cast("double"), 4)
    return events(spark, sf).select("event_id", *codes).withColumns({f"pos_{d}": r(f"pos_{d}") for d in range(4)})


# -- windows -------------------------------------------------------------------------------------------


@query("sliding_windows", f"WITH {POINTS_SQL}, {WIN24_SQL} SELECT series_id, CAST(w_start // 12 AS BIGINT) AS w_no, CAST(w_start AS BIGINT) AS w_start, CAST(w_start + 24 AS BIGINT) AS w_end, CAST(pos AS INTEGER) AS pos, x FROM wins")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _win24(spark, sf).select("series_id", "w_no", "w_start", "w_end", F.posexplode("x").alias("pos", "x"))


@query(
    "sliding_windows_single_series",
    """WITH one AS (SELECT 0 AS series_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value AS x FROM events),
"""
    + windows_sql("one", 96, 48)
    + f" SELECT CAST(w_start AS BIGINT) AS w_start, count(*) AS n, {rsql('sum(x)', 4)} AS total, max(x) AS top FROM wins GROUP BY 1",
)
def sliding_windows_single_series(spark: SparkSession, sf: str) -> DataFrame:
    one = ordering.add_index(events(spark, sf).select("event_id", "ts", "x"), keys=[], order=["ts", "event_id"])
    wins = windows.sliding_windows(one, 96, 48, keys=[])
    return wins.select(
        "w_start", F.size("x").cast("long").alias("n"), r(arrays.array_sum(F.col("x")), 4).alias("total"), F.array_max("x").alias("top")
    )


@query(
    "forecast_windows",
    f"""WITH {HOURLY_SQL}, {windows_sql('hourly', 36, 12, 'x, ts')},
parts AS (SELECT series_id, w_start, 'x' AS part, pos AS p, x, ts FROM wins WHERE pos < 24 UNION ALL
          SELECT series_id, w_start, 'y', pos - 12, x, ts FROM wins WHERE pos >= 12)
SELECT series_id, w_start, part, CAST(p AS INTEGER) AS pos, {rsql('x')} AS v, hour(ts)::INTEGER AS mark FROM parts""",
)
def forecast_windows(spark: SparkSession, sf: str) -> DataFrame:
    df = hourly(spark, sf).withColumn("hour", F.hour("ts"))
    wins = windows.forecast_windows(df, 24, 12, 12, ["x"], ["hour"], stride=12)
    zipped = [
        F.struct(F.lit(p).alias("part"), F.zip_with(f"x_{p}", f"hour_{p}", lambda v, m: F.struct(v.alias("v"), m.alias("mark"))).alias("z"))
        for p in ("x", "y")
    ]
    parts = wins.select("series_id", "w_start", F.explode(F.array(*zipped)).alias("s"))
    out = parts.select("series_id", "w_start", "s.part", F.posexplode("s.z").alias("pos", "z"))
    return out.select("series_id", "w_start", "part", "pos", r("z.v").alias("v"), "z.mark")


@query(
    "gap_check_time",
    f"""WITH {HOURLY_SQL}, {windows_sql('hourly', 24, 6, 'x, ts')}
SELECT series_id, w_start FROM wins GROUP BY 1, 2 HAVING max(ts) - min(ts) = INTERVAL 23 HOUR""",
)
def gap_check_time(spark: SparkSession, sf: str) -> DataFrame:
    wins = windows.sliding_windows(hourly(spark, sf), 24, 6, ["x", "ts"])
    return windows.keep_regular(wins, 3600).select("series_id", "w_start")


@query(
    "gap_check_index",
    f"""WITH {HOURLY_SQL}, steps AS (SELECT series_id, idx, CAST(epoch(ts) AS BIGINT) // 3600 AS step FROM hourly), {windows_sql('steps', 24, 6, 'step')}
SELECT series_id, w_start FROM wins GROUP BY 1, 2 HAVING max(step) - min(step) = 23""",
)
def gap_check_index(spark: SparkSession, sf: str) -> DataFrame:
    step = F.floor(ordering.epoch_micros("ts") / F.lit(3_600_000_000)).cast("long")
    wins = windows.sliding_windows(hourly(spark, sf).withColumn("step", step), 24, 6, ["step"])
    return windows.keep_regular_index(wins, "step").select("series_id", "w_start")


@query(
    "reconstruction_rows",
    f"""WITH {HOURLY_SQL}, {windows_sql('hourly', 24, 12, 'x, ts, label')},
ok AS (SELECT series_id, w_start FROM wins GROUP BY 1, 2 HAVING max(ts) - min(ts) = INTERVAL 23 HOUR)
SELECT w.series_id, w.w_start, CAST(pos AS INTEGER) AS pos, {rsql('x')} AS given, {rsql('x')} AS answer, label AS attack
FROM wins w JOIN ok ON ok.series_id = w.series_id AND ok.w_start = w.w_start""",
)
def reconstruction_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.reconstruction_rows(hourly(spark, sf), 24, 12, label="label", step_seconds=3600)
    out = rows.select("series_id", "w_start", F.posexplode(F.arrays_zip("given", "answer", "attack")).alias("pos", "z"))
    return out.select("series_id", "w_start", "pos", r("z.given").alias("given"), r("z.answer").alias("answer"), F.col("z.attack").alias("attack"))


@query(
    "prediction_rows",
    f"""WITH {HOURLY_SQL}, {windows_sql('hourly', 25, 12, 'x, ts, label')},
ok AS (SELECT series_id, w_start FROM wins GROUP BY 1, 2 HAVING max(ts) - min(ts) = INTERVAL 24 HOUR)
SELECT w.series_id, w.w_start, count(*) FILTER (pos < 23) AS given_n, {rsql('sum(x) FILTER (pos < 23)')} AS given_sum,
       {rsql('max(x) FILTER (pos = 23)')} AS answer, max(label) FILTER (pos = 23) AS attack
FROM wins w JOIN ok ON ok.series_id = w.series_id AND ok.w_start = w.w_start GROUP BY 1, 2""",
)
def prediction_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.prediction_rows(hourly(spark, sf), 24, 12, label="label", step_seconds=3600)
    return rows.select(
        "series_id",
        "w_start",
        F.size("given").cast("long").alias("given_n"),
        r(arrays.array_sum(F.col("given"))).alias("given_sum"),
        r("answer").alias("answer"),
        "attack",
    )


@query(
    "windows_by_split",
    f"""WITH {SPLIT_SQL},
ranked AS (SELECT series_id, split, row_number() OVER (PARTITION BY series_id, split ORDER BY idx) - 1 AS idx, orders FROM cut),
n AS (SELECT series_id, split, count(*) AS n FROM ranked GROUP BY 1, 2),
st AS (SELECT series_id, split, unnest(CASE WHEN split = 'test' THEN range(0, n - 47, 48) ELSE range(0, n - 47, 24) END) AS w_start FROM n WHERE n >= 48)
SELECT s.series_id, s.split, s.w_start, CAST(sum(r.orders) AS DOUBLE) AS orders
FROM st s JOIN ranked r ON r.series_id = s.series_id AND r.split = s.split AND r.idx BETWEEN s.w_start AND s.w_start + 47 GROUP BY 1, 2, 3""",
)
def windows_by_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = _split_daily(spark, sf).drop("idx")
    dense = ordering.add_index(parts, keys=["series_id", "split"], chunk=ordering.time_chunk("ts", 365 * DAY))
    wins = windows.windows_by_split(dense, 48, cols=["orders"])
    return wins.select("series_id", "split", "w_start", arrays.array_sum(F.col("orders")).alias("orders"))


@query("window_labels", f"WITH {HOURLY_SQL}, {windows_sql('hourly', 24, 24, 'label')} SELECT series_id, CAST(w_start // 24 AS BIGINT) AS w_no, w_start, CAST(pos AS INTEGER) AS pos, label FROM wins")
def window_labels(spark: SparkSession, sf: str) -> DataFrame:
    return windows.window_labels(windows.sliding_windows(hourly(spark, sf), 24, 24, ["label"]))


@query("centre_label", f"WITH {HOURLY_SQL}, {windows_sql('hourly', 24, 6, 'label')} SELECT series_id, w_start, label AS centre FROM wins WHERE pos = 12")
def centre_label(spark: SparkSession, sf: str) -> DataFrame:
    wins = windows.sliding_windows(hourly(spark, sf), 24, 6, ["label"])
    return windows.centre_label(wins).select("series_id", "w_start", "centre")


@query(
    "decoder_seed",
    f"""WITH {POINTS_SQL}, {windows_sql('points', 24, 12)}
SELECT series_id, w_start, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < 12 THEN x ELSE 0.0 END AS v FROM wins""",
)
def decoder_seed(spark: SparkSession, sf: str) -> DataFrame:
    return _long(windows.decoder_seed(_win24(spark, sf), "x", 12, 12), "seed")


@query(
    "patches",
    f"""WITH {POINTS_SQL}, {WIN24_SQL},
padded AS (SELECT series_id, w_start, pos, x FROM wins UNION ALL
           SELECT series_id, w_start, 24 + unnest(range(0, 4)), x FROM wins WHERE pos = 23),
grid AS (SELECT unnest(range(0, 6)) AS patch)
SELECT series_id, w_start, CAST(patch AS INTEGER) AS patch, CAST(pos - 4 * patch AS INTEGER) AS pos, x AS v
FROM padded JOIN grid ON pos BETWEEN 4 * patch AND 4 * patch + 7""",
)
def patches(spark: SparkSession, sf: str) -> DataFrame:
    cut = windows.patches(_win24(spark, sf), "x", 8, 4)
    out = cut.select("series_id", "w_start", F.posexplode("patches").alias("patch", "p"))
    return out.select("series_id", "w_start", "patch", F.posexplode("p").alias("pos", "v"))


@query(
    "segments_padded",
    f"""WITH {POINTS_SQL}, {WIN24_SQL},
padded AS (SELECT series_id, w_start, pos + 1 AS pos, x FROM wins UNION ALL SELECT series_id, w_start, 0, x FROM wins WHERE pos = 0)
SELECT series_id, w_start, CAST(pos // 5 AS INTEGER) AS segment, CAST(pos % 5 AS INTEGER) AS pos, x AS v FROM padded""",
)
def segments_padded(spark: SparkSession, sf: str) -> DataFrame:
    cut = windows.segments(_win24(spark, sf), "x", 5, pad_front=True)
    out = cut.select("series_id", "w_start", F.posexplode("segments").alias("segment", "p"))
    return out.select("series_id", "w_start", "segment", F.posexplode("p").alias("pos", "v"))


@query(
    "fold_period",
    f"""WITH {POINTS_SQL}, {WIN24_SQL},
padded AS (SELECT series_id, w_start, pos, x FROM wins UNION ALL SELECT series_id, w_start, 24 + unnest(range(0, 4)), 0.0 FROM wins WHERE pos = 0)
SELECT series_id, w_start, CAST(pos // 7 AS INTEGER) AS cycle, CAST(pos % 7 AS INTEGER) AS pos, x AS v FROM padded""",
)
def fold_period(spark: SparkSession, sf: str) -> DataFrame:
    cut = windows.fold_period(_win24(spark, sf), "x", 7)
    out = cut.select("series_id", "w_start", F.posexplode("folded").alias("cycle", "p"))
    return out.select("series_id", "w_start", "cycle", F.posexplode("p").alias("pos", "v"))


@query("even_odd", f"WITH {POINTS_SQL}, {WIN24_SQL} SELECT series_id, w_start, CAST(pos // 2 AS INTEGER) AS pos, max(x) FILTER (pos % 2 = 0) AS even, max(x) FILTER (pos % 2 = 1) AS odd FROM wins GROUP BY 1, 2, 3")
def even_odd(spark: SparkSession, sf: str) -> DataFrame:
    cut = windows.even_odd(_win24(spark, sf), "x").withColumn("z", F.arrays_zip("x_even", "x_odd"))
    return _long(cut, "z").select("series_id", "w_start", "pos", F.col("v.x_even").alias("even"), F.col("v.x_odd").alias("odd"))


@query(
    "chunked_views",
    f"""WITH {POINTS_SQL}, {WIN24_SQL}
SELECT series_id, w_start, 'continuous' AS view, CAST(pos // 6 AS INTEGER) AS chunk, CAST(pos % 6 AS INTEGER) AS pos, x AS v FROM wins UNION ALL
SELECT series_id, w_start, 'interval', CAST(pos % 4 AS INTEGER), CAST(pos // 4 AS INTEGER), x FROM wins""",
)
def chunked_views(spark: SparkSession, sf: str) -> DataFrame:
    cut = windows.chunked_views(_win24(spark, sf), "x", 6)
    both = F.array(*[F.struct(F.lit(n).alias("view"), F.col(f"x_{n}").alias("c")) for n in ("continuous", "interval")])
    out = cut.select("series_id", "w_start", F.explode(both).alias("s"))
    out = out.select("series_id", "w_start", "s.view", F.posexplode("s.c").alias("chunk", "p"))
    return out.select("series_id", "w_start", "view", "chunk", F.posexplode("p").alias("pos", "v"))


@query(
    "multi_scale_mean",
    f"""WITH {POINTS_SQL}, lv AS (SELECT unnest(range(0, 4)) AS level)
SELECT series_id, CAST(level AS INTEGER) AS level, CAST(idx // CAST(pow(2, level) AS BIGINT) AS BIGINT) AS pos, {rsql('avg(x)', 9)} AS x,
       min(hour(ts)) FILTER (idx % CAST(pow(2, level) AS BIGINT) = 0)::INTEGER AS hour
FROM points, lv GROUP BY 1, 2, 3 HAVING count(*) = max(CAST(pow(2, level) AS BIGINT))""",
)
def multi_scale_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = points(spark, sf).withColumn("hour", F.hour("ts"))
    return windows.multi_scale(df, 2, 3, marks=["hour"]).withColumn("x", r("x", 9))


@query(
    "multi_scale_max",
    f"""WITH {POINTS_SQL}, lv AS (SELECT unnest(range(0, 3)) AS level)
SELECT series_id, CAST(level AS INTEGER) AS level, CAST(idx // CAST(pow(3, level) AS BIGINT) AS BIGINT) AS pos, max(x) AS x
FROM points, lv GROUP BY 1, 2, 3 HAVING count(*) = max(CAST(pow(3, level) AS BIGINT))""",
)
def multi_scale_max(spark: SparkSession, sf: str) -> DataFrame:
    return windows.multi_scale(points(spark, sf), 3, 2, how="max")


@query(
    "lookbacks",
    f"""WITH {POINTS_SQL}, {WIN24_SQL}
SELECT series_id, w_start, m, CAST(pos - (24 - 6 * m) AS INTEGER) AS pos, x AS v FROM wins, (VALUES (1), (2), (4)) t(m) WHERE pos >= 24 - 6 * m""",
)
def lookbacks(spark: SparkSession, sf: str) -> DataFrame:
    cut = windows.lookbacks(_win24(spark, sf), "x", 6, [1, 2, 4])
    parts = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"x_back_{m}").alias("b")) for m in (1, 2, 4)])
    out = cut.select("series_id", "w_start", F.explode(parts).alias("s"))
    return out.select("series_id", "w_start", "s.m", F.posexplode("s.b").alias("pos", "v"))


@query(
    "windows_to_points",
    f"""WITH {POINTS_SQL}, {WIN24_SQL}, s AS (SELECT series_id, idx, x - avg(x) OVER (PARTITION BY series_id, w_start) AS d FROM wins)
SELECT series_id, CAST(idx AS BIGINT) AS idx, {rsql('avg(d * d)')} AS score FROM s GROUP BY 1, 2""",
)
def windows_to_points(spark: SparkSession, sf: str) -> DataFrame:
    wins = _win24(spark, sf).withColumn("m", arrays.array_mean(F.col("x")))
    scored = wins.withColumn("err", F.transform("x", lambda v: (v - F.col("m")) * (v - F.col("m"))))
    return windows.windows_to_points(scored, "err").withColumn("score", r("score"))

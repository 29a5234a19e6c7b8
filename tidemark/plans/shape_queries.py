"""Warping distances and augmentation of labelled windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import augment, dtw, dtw_search, mates
from tidemark.operators.ordering import add_index
from tidemark.plans.draws_sql import Sql, cell, integer, normal, uniform
from tidemark.plans.inputs import SHAPES_SQL, shapes
from tidemark.plans.registry import query, r, rsql
from tidemark.session import staged

LENGTH = 64
BAND = 7


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return mates.with_mates(shapes(spark, sf), 2)


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every window with the next one of its class by id, the last with the first: pairs that SQL can form too."""
    placed = staged(add_index(shapes(spark, sf), keys=["label"], order=["window_id"]))
    sizes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    offered = placed.select("label", F.col("idx").alias("_at"), F.col("window_id").alias("mate_id"), F.col("x").alias("mate_x"))
    return placed.join(sizes, "label").withColumn("_at", (F.col("idx") + 1) % F.col("_n")).join(offered, ["label", "_at"])


NEIGHBOURS_SQL = f"""{SHAPES_SQL},
pr AS (SELECT a.window_id, a.mate_id, a.x, b.x AS y FROM (
  SELECT window_id, x, coalesce(lead(window_id) OVER w, first_value(window_id) OVER w) AS mate_id FROM shapes WINDOW w AS (PARTITION BY label ORDER BY window_id)) a
  JOIN shapes b ON b.window_id = a.mate_id)"""


def _fronts_sql(cost: str, allowed: str, weight: float = 1.0) -> str:
    return f"""WITH RECURSIVE {NEIGHBOURS_SQL}, {_fronts_cte(cost, allowed, weight)}
SELECT window_id, mate_id, {rsql(f"f1[{LENGTH}]")} AS distance FROM dtw WHERE t = {2 * LENGTH - 2}"""


def _fronts_cte(cost: str, allowed: str, weight: float = 1.0, tag: str = "") -> str:
    """DTW of pr (window_id, mate_id, x, y) by anti-diagonals: lists f1 over i (from 1) of the cells (i, t - i), j = t - i + 2 from 1."""
    j = "(t + 3 - i)"  # of the front being made, t + 1
    return f"""dtw{tag} AS (
  SELECT window_id, mate_id, x, y, 0 AS t, list_transform(range(1, {LENGTH + 1}), lambda i: CASE WHEN i = 1 THEN {cost.replace("J", "1")} ELSE 'inf'::DOUBLE END) AS f1,
         list_transform(range(1, {LENGTH + 1}), lambda i: 'inf'::DOUBLE) AS f2 FROM pr{tag}
  UNION ALL
  SELECT window_id, mate_id, x, y, t + 1, list_transform(range(1, {LENGTH + 1}), lambda i: CASE WHEN {j} BETWEEN 1 AND {LENGTH} AND {allowed.replace("J", j)}
    THEN {cost.replace("J", j)} + least(coalesce(f2[i - 1], 'inf'), {weight} * f1[i], {weight} * coalesce(f1[i - 1], 'inf')) ELSE 'inf'::DOUBLE END), f1
  FROM dtw{tag} WHERE t < {2 * LENGTH - 2})"""


def _paths_cte(cost: str, allowed: str, tag: str = "") -> str:
    """path(window_id, mate_id, k, i, j): paths of pr, windows of up to full length, walked back from the last cells; of equal costs diagonal, then up, then left."""
    return f"""{_fronts_cte(cost, allowed, tag=tag)},
cells{tag} AS (SELECT window_id, mate_id, t, f1 AS f FROM dtw{tag}),
path AS (
  SELECT window_id, mate_id, 0 AS k, CAST(len(x) AS BIGINT) AS i, CAST(len(y) AS BIGINT) AS j FROM pr{tag}
  UNION ALL
  SELECT window_id, mate_id, k + 1, i - CASE WHEN d <= u AND d <= l THEN 1 WHEN u <= l THEN 1 ELSE 0 END, j - CASE WHEN d <= u AND d <= l THEN 1 WHEN u <= l THEN 0 ELSE 1 END
  FROM (SELECT p.window_id, p.mate_id, k, i, j, coalesce(CASE WHEN j > 1 THEN b.f[i - 1] END, 'inf') AS d, coalesce(a.f[i - 1], 'inf') AS u, coalesce(CASE WHEN j > 1 THEN a.f[i] END, 'inf') AS l
    FROM path p JOIN cells{tag} a ON a.window_id = p.window_id AND a.mate_id = p.mate_id AND a.t = i + j - 3 LEFT JOIN cells{tag} b ON b.window_id = p.window_id AND b.mate_id = p.mate_id AND b.t = i + j - 4))"""


def _mates_sql(k: int, include_self: bool = False) -> str:
    """mt(window_id, label, x, mate_no, mate_id, y): the drawn class mates of ``mates.with_mates``."""
    pool, tag = ("d.n", "any") if include_self else ("(d.n - 1)", "same")
    place = "(start + q.j * step) % d.n" if include_self else "(d.pos + 1 + (start + q.j * step) % (d.n - 1)) % d.n"
    return f"""{SHAPES_SQL},
pl AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {cell(0, Sql("window_id"))}, window_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM shapes),
dr AS (SELECT *, {integer(0, pool, 0, tag, Sql("window_id"))} AS start, greatest({pool} // greatest(least({k}, {pool}), 1), 1) AS step FROM pl d),
mt AS (SELECT d.window_id, d.label, d.x, q.j AS mate_no, o.window_id AS mate_id, o.x AS y FROM dr d JOIN range(0, {k}) q(j) ON q.j < least({k}, {pool}) JOIN pl o ON o.label = d.label AND o.pos = {place})"""


NEAR = f"least(greatest(i + k, 1), {LENGTH})", f"least(greatest(J + k, 1), {LENGTH})"
SHAPE_COST = f"sqrt(list_sum(list_transform(range(-3, 2), lambda k: pow(x[{NEAR[0]}] - y[{NEAR[1]}], 2))))"
ASYMMETRIC_SQL = f"""WITH RECURSIVE {NEIGHBOURS_SQL},
dtw AS (
  SELECT window_id, mate_id, x, y, 1 AS i, list_transform(range(1, {LENGTH + 1}), lambda j: CASE WHEN j <= 2 THEN abs(x[1] - y[j]) ELSE 'inf'::DOUBLE END) AS f FROM pr
  UNION ALL
  SELECT window_id, mate_id, x, y, i + 1, list_transform(range(1, {LENGTH + 1}), lambda j: abs(x[i + 1] - y[j]) + least(f[j], coalesce(f[j - 1], 'inf'), CASE WHEN j > 2 THEN f[j - 2] ELSE 'inf' END))
  FROM dtw WHERE i < {LENGTH})
SELECT window_id, mate_id, {rsql(f"f[{LENGTH}]")} AS distance FROM dtw WHERE i = {LENGTH}"""

# fronts of equal 2 i + j; a cell below that is not known yet stands for its own cost
WARP_SQL = f"""WITH RECURSIVE {NEIGHBOURS_SQL},
dtw AS (
  SELECT window_id, mate_id, x, y, 3 AS t, list_transform(range(1, {LENGTH + 1}), lambda i: CASE WHEN i = 1 THEN pow(x[1] - y[1], 2) ELSE 'inf'::DOUBLE END) AS f1,
         list_transform(range(1, {LENGTH + 1}), lambda i: 'inf'::DOUBLE) AS f2, list_transform(range(1, {LENGTH + 1}), lambda i: 'inf'::DOUBLE) AS f3 FROM pr
  UNION ALL
  SELECT window_id, mate_id, x, y, t + 1, list_transform(range(1, {LENGTH + 1}), lambda i: CASE WHEN t + 1 - 2 * i BETWEEN 1 AND {LENGTH} THEN pow(x[i] - y[t + 1 - 2 * i], 2) + least(
      coalesce(f3[i - 1], 'inf'), f1[i], CASE WHEN i < {LENGTH} AND t + 1 - 2 * i > 1 THEN pow(x[i + 1] - y[t - 2 * i], 2) ELSE 'inf' END, coalesce(f2[i - 1], 'inf'), coalesce(f1[i - 1], 'inf'))
    ELSE 'inf'::DOUBLE END), f1, f2
  FROM dtw WHERE t < {3 * LENGTH})
SELECT window_id, mate_id, {rsql(f"f1[{LENGTH}]")} AS distance FROM dtw WHERE t = {3 * LENGTH}"""


def _mate_counts_sql() -> str:
    return """SELECT e.vec_id AS window_id, CAST(least(2, n - 1) AS BIGINT) AS same, CAST(least(3, t - n) AS BIGINT) AS other
FROM embeddings e JOIN (SELECT label, count(*) AS n, (SELECT count(*) FROM embeddings) AS t FROM embeddings GROUP BY 1) c ON c.label = e.label"""


@query("class_mates", _mate_counts_sql())
def class_mates(spark: SparkSession, sf: str) -> DataFrame:
    """Number of distinct valid partners per window: same class without self, and other classes."""
    df = shapes(spark, sf)
    labels = df.select(F.col("window_id").alias("mate_id"), F.col("label").alias("mate_label"))
    count = lambda ok: F.count_distinct(F.when(ok, F.col("mate_id")))
    same_ok = (F.col("mate_label") == F.col("label")) & (F.col("mate_id") != F.col("window_id"))
    same = mates.with_mates(df, 2).join(labels, "mate_id").groupBy("window_id").agg(count(same_ok).alias("same"))
    others = mates.with_mates(df, 3, other_class=True).join(labels, "mate_id")
    other = others.groupBy("window_id").agg(count(F.col("mate_label") != F.col("label")).alias("other"))
    return same.join(other, "window_id")


def _distance_query(name: str, sql: str, **kwargs) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return dtw.dtw_distance(_neighbours(spark, sf), **kwargs).select("window_id", "mate_id", r("distance").alias("distance"))


_distance_query("dtw_asymmetric", ASYMMETRIC_SQL, steps="asymmetric")
_distance_query("dtw_symmetric_band", _fronts_sql("abs(x[i] - y[J])", f"abs(i - J) <= {BAND}"), steps="symmetric", window=BAND)
_distance_query("dtw_shape", _fronts_sql(SHAPE_COST, f"J BETWEEN i - {BAND} AND i + {BAND - 1}"), steps="symmetric", window=BAND, shape=True)


ABS_COST, IN_BAND = "abs(x[i] - y[J])", f"abs(i - J) <= {BAND}"
SHAPE_BAND = f"J BETWEEN i - {BAND} AND i + {BAND - 1}"


@query(
    "dtw_paths",
    f"""WITH RECURSIVE {_mates_sql(2)}, pr AS (SELECT window_id, mate_id, x, y FROM mt), {_paths_cte(ABS_COST, IN_BAND)}
SELECT window_id, mate_id, CAST(max(k) OVER (PARTITION BY window_id, mate_id) - k AS INTEGER) AS step, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j FROM path""",
)
def dtw_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = dtw.dtw_path(_pairs(spark, sf), steps="symmetric", window=BAND)
    return paths.select("window_id", "mate_id", F.posexplode("path").alias("step", "p")).select("window_id", "mate_id", "step", "p.i", "p.j")


@query(
    "dtw_nearest",
    f"""WITH RECURSIVE {SHAPES_SQL}, pr AS (SELECT a.window_id, b.window_id AS mate_id, a.x, b.x AS y FROM shapes a JOIN shapes b ON b.label = a.label AND b.window_id <> a.window_id WHERE a.window_id % 100 = 0),
{_fronts_cte(ABS_COST, IN_BAND)},
rk AS (SELECT window_id, mate_id, f1[{LENGTH}] AS d, row_number() OVER (PARTITION BY window_id ORDER BY f1[{LENGTH}], mate_id) AS rank FROM dtw WHERE t = {2 * LENGTH - 2})
SELECT window_id, CAST(rank AS INTEGER) AS rank, mate_id AS near_id, {rsql("d")} AS distance FROM rk WHERE rank <= 3""",
)
def dtw_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the windows whose id is divisible by 100, against all windows of their class."""
    return dtw_search.nearest(shapes(spark, sf), F.col("window_id") % 100 == 0, 3, BAND).withColumn("distance", r("distance"))


@query("dtw_weighted", _fronts_sql("abs(x[i] - y[J])", f"abs(i - J) <= {BAND}", 1.2))
def dtw_weighted(spark: SparkSession, sf: str) -> DataFrame:
    out = dtw.weighted_dtw_distance(_neighbours(spark, sf), metric="cityblock", window=BAND, weight=1.2)
    return out.select("window_id", "mate_id", r("distance").alias("distance"))


@query("dtw_unbanded_squared", WARP_SQL)
def dtw_unbanded_squared(spark: SparkSession, sf: str) -> DataFrame:
    out = dtw.weighted_dtw_distance(_neighbours(spark, sf), metric="sqeuclidean", warp=2)
    return out.select("window_id", "mate_id", r("distance").alias("distance"))


MEDOID_CTE = f"""{_mates_sql(6, include_self=True)},
two AS (SELECT a.window_id AS own, a.mate_no AS p, b.mate_no AS q, a.mate_id AS u, b.mate_id AS v FROM mt a JOIN mt b ON b.window_id = a.window_id),
pr AS (SELECT w.u AS window_id, w.v AS mate_id, s.x, t.x AS y FROM (SELECT DISTINCT u, v FROM two WHERE u < v) w JOIN shapes s ON s.window_id = w.u JOIN shapes t ON t.window_id = w.v),
{_fronts_cte(ABS_COST, IN_BAND)},
dist AS (SELECT window_id, mate_id, f1[{LENGTH}] AS d FROM dtw WHERE t = {2 * LENGTH - 2}),
each AS (SELECT own, p, q, u, v, coalesce(d, 0) AS d FROM two LEFT JOIN dist ON window_id = least(u, v) AND mate_id = greatest(u, v)),
best AS (SELECT own, p, row_number() OVER (PARTITION BY own ORDER BY round(sum(d), 9), p) AS place FROM each GROUP BY 1, 2)"""


@query(
    "class_medoids",
    f"""WITH RECURSIVE {MEDOID_CTE}
SELECT own AS window_id, label, CAST(p AS INTEGER) AS medoid, string_agg(q, ',' ORDER BY d, q) AS nearest, {rsql("max(d)")} AS farthest
FROM each JOIN best USING (own, p) JOIN shapes ON window_id = own WHERE place = 1 GROUP BY ALL""",
)
def class_medoids(spark: SparkSession, sf: str) -> DataFrame:
    pairs = mates.with_mates(shapes(spark, sf), 6, include_self=True)
    rows = mates.gather_mates(pairs, "window_id", ["x"], ["label"])
    out = dtw.medoid(rows, window=BAND)
    order = F.concat_ws(",", F.transform("medoid.order", lambda q: q.cast("string")))
    return out.select("window_id", "label", "medoid.medoid", order.alias("nearest"), r(F.element_at("medoid.distances", -1)).alias("farthest"))


# -- augmentation ------------------------------------------------------------------------------------------

WID = Sql("window_id")
POS = f"range(0, {LENGTH}) g(pos)"


def _read(values: str, at: str) -> str:
    """Linear interpolation of a list at a real position from 0 on, held at the end."""
    lo = f"CAST(floor({at}) AS BIGINT)"
    return f"({values}[{lo} + 1] + ({at} - {lo}) * ({values}[least({lo} + 2, len({values}))] - {values}[{lo} + 1]))"


def _resampled(values: str, n: str) -> str:
    return f"list_transform(range(0, {n}), lambda i: {_read(values, f'least(i * (len({values}) - 1.0) / greatest({n} - 1, 1), len({values}) - 1.0)')})"


def _spline_sql(tag: str, moved: bool) -> str:
    """curve(window_id, pos, w): the spline through six drawn knots at every position."""
    basis = augment.spline_basis(LENGTH, 6) * (np.linspace(0, LENGTH - 1.0, num=6) if moved else 1.0)
    cells = ", ".join(f"({i}, {k}, {float(v)!r}::DOUBLE)" for i, row in enumerate(basis) for k, v in enumerate(row))
    return f"""{SHAPES_SQL}, basis(pos, k, w) AS (VALUES {cells}),
knots AS (SELECT window_id, k, 1.0 + {normal(0, tag, "x", WID, Sql("k"))} * 0.2 AS v FROM shapes, range(0, 6) r(k)),
curve AS (SELECT window_id, pos, sum(w * v) AS w FROM knots JOIN basis USING (k) GROUP BY 1, 2)"""


def _order_sql(mode: str, bounds: str) -> str:
    """Segments in drawn order: b are the borders, s the segment (from 1)."""
    tag = f"permutation_{mode}"
    return f"""WITH {SHAPES_SQL}, d AS (SELECT *, {integer(1, 5, 0, tag, WID)} AS n FROM shapes), e AS (SELECT *, {bounds} AS b FROM d),
seg AS (SELECT window_id, label, x, b, s, row_number() OVER (PARTITION BY window_id ORDER BY {cell(0, tag, "order", WID, Sql("s"))}, s) AS o FROM e, range(1, 5) r(s) WHERE s <= n),
put AS (SELECT *, b[s + 1] - b[s] AS size, coalesce(sum(b[s + 1] - b[s]) OVER (PARTITION BY window_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM seg)
SELECT window_id, label, '_{{tag}}' AS tags, CAST(first + k AS INTEGER) AS pos, {rsql("x[b[s] + k + 1]")} AS x FROM put, range(0, {LENGTH}) q(k) WHERE k < size"""


def _point_sql(value: str) -> str:
    return f"WITH {SHAPES_SQL} SELECT window_id, label, '_{{tag}}' AS tags, CAST(pos AS INTEGER) AS pos, {rsql(value)} AS x FROM shapes, {POS}"


NOISE = normal(0, "jitter", "x", WID, Sql("pos"))
TARGET, PART = 58, 7  # points of a slice and of a warped part of 64
SLICED = _read("part", f"least(pos * {TARGET} / {LENGTH - 1.0}, {TARGET - 1.0})")


def _slice_sql(source: str, seed: int, wid: Sql = WID) -> str:
    start = integer(0, LENGTH - TARGET, seed, "slice", wid)
    return f"SELECT *, x[{start} + 1 : {start} + {TARGET}] AS part FROM {source}"


WARPED_SQL = f"""WITH {SHAPES_SQL},
d AS (SELECT *, CASE WHEN {integer(0, 2, 0, "warp_scale", WID)} = 0 THEN {PART // 2} ELSE {2 * PART} END AS cnt, {integer(1, LENGTH - PART - 1, 0, "warp_start", WID)} AS st FROM shapes),
p AS (SELECT *, x[st + 1 : st + {PART}] AS part FROM d),
w AS (SELECT *, list_concat(list_concat(x[1 : st], {_resampled("part", "cnt")}), x[st + {PART} + 1 : {LENGTH}]) AS whole FROM p),
o AS (SELECT *, {_resampled("whole", str(LENGTH))} AS made FROM w)
SELECT window_id, label, '_windowwarp' AS tags, CAST(pos AS INTEGER) AS pos, {rsql("made[pos + 1]")} AS x FROM o, {POS}"""
CUTS = f"""list_concat(list_concat([0], list_sort(list_transform(list_sort(list_transform(range(0, {LENGTH - 2}), lambda c: struct_pack(h := {cell(0, "permutation_random", "cut", WID, Sql("c"))}, i := c)))[1 : n - 1], lambda z: z.i))), [{LENGTH}])"""

STEP_SQL = {
    "jitter": _point_sql(f"x[pos + 1] + {NOISE} * 0.03"),
    "scaling": _point_sql(f"x[pos + 1] * (1.0 + {normal(0, 'scaling', 'x', WID)} * 0.1)"),
    "rotation": _point_sql(f"x[pos + 1] * CASE WHEN {uniform(0, 'rotation', 'x', WID)} < 0.5 THEN -1 ELSE 1 END"),
    "permutation": _order_sql("equal", f"list_transform(range(0, n + 1), lambda c: c * ({LENGTH} // n) + least(c, {LENGTH} % n))"),
    "randomperm": _order_sql("random", CUTS),
    "magwarp": f"WITH {_spline_sql('magnitude', False)} SELECT window_id, label, '_{{tag}}' AS tags, CAST(pos AS INTEGER) AS pos, {rsql('x[pos + 1] * w')} AS x FROM shapes JOIN curve USING (window_id)",
    "timewarp": f"""WITH {_spline_sql('time', True)}, axis AS (SELECT c.window_id, c.pos, least(greatest(c.w * {LENGTH - 1.0} / z.w, 0), {LENGTH - 1.0}) AS p FROM curve c JOIN curve z ON z.window_id = c.window_id AND z.pos = {LENGTH - 1})
SELECT window_id, label, '_{{tag}}' AS tags, CAST(pos AS INTEGER) AS pos, {rsql(_read('x', 'p'))} AS x FROM shapes JOIN axis USING (window_id)""",
    "windowslice": f"WITH {SHAPES_SQL}, c AS ({_slice_sql('shapes', 0)}) SELECT window_id, label, '_{{tag}}' AS tags, CAST(pos AS INTEGER) AS pos, {rsql(SLICED)} AS x FROM c, {POS}",
    "windowwarp": WARPED_SQL,
}


def _retimed_sql(cost: str, allowed: str) -> str:
    """A window read along its path to its mate, stretched to full length."""
    return f"""WITH RECURSIVE {_mates_sql(1)}, pr AS (SELECT window_id, mate_id, y AS x, x AS y FROM mt), {_paths_cte(cost, allowed)},
along AS (SELECT path.window_id, list(shapes.x[j] ORDER BY k DESC) AS v FROM path JOIN shapes ON shapes.window_id = path.window_id GROUP BY 1),
made AS (SELECT window_id, {_resampled("v", str(LENGTH))} AS v FROM along)
SELECT shapes.window_id, label, '_{{tag}}' AS tags, CAST(pos AS INTEGER) AS pos, {rsql("coalesce(v, x)[pos + 1]")} AS x FROM shapes LEFT JOIN made ON made.window_id = shapes.window_id, {POS}"""


AT = integer(1, LENGTH - 1, 0, "spawner", WID)
SPAWNER_SQL = f"""WITH RECURSIVE {_mates_sql(1)}, cut AS (SELECT window_id, x, y, {AT} AS c0 FROM mt),
pr AS (SELECT window_id, 0 AS mate_id, x[1 : c0] AS x, y[1 : c0] AS y FROM cut UNION ALL SELECT window_id, 1, x[c0 + 1 : {LENGTH}], y[c0 + 1 : {LENGTH}] FROM cut),
{_paths_cte(ABS_COST, IN_BAND)},
mean AS (SELECT path.window_id, list((pr.x[i] + pr.y[j]) / 2 ORDER BY path.mate_id, k DESC) AS v FROM path JOIN pr ON pr.window_id = path.window_id AND pr.mate_id = path.mate_id GROUP BY 1),
made AS (SELECT window_id, {_resampled("v", str(LENGTH))} AS v FROM mean)
SELECT shapes.window_id, label, '_{{tag}}' AS tags, CAST(pos AS INTEGER) AS pos, {rsql(f"coalesce(v, x)[pos + 1] + {normal(0, 'spawner_jitter', 'x', Sql('shapes.window_id'), Sql('pos'))} * 0.05")} AS x
FROM shapes LEFT JOIN made ON made.window_id = shapes.window_id, {POS}"""
WDBA_SQL = f"""WITH RECURSIVE {MEDOID_CTE},
near AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY d, q) AS k FROM each JOIN best USING (own, p) WHERE place = 1),
others AS (SELECT own, q, u, v, pow(0.5, d / dn) AS weight FROM near JOIN (SELECT own, d AS dn FROM near WHERE k = 2 AND d > 0) USING (own) WHERE q <> p),
pr2 AS (SELECT own AS window_id, q AS mate_id, a.x, b.x AS y FROM others JOIN shapes a ON a.window_id = u JOIN shapes b ON b.window_id = v),
{_paths_cte(ABS_COST, IN_BAND, "2")},
met AS (SELECT window_id, mate_id, i, max(j) AS j FROM path GROUP BY 1, 2, 3),
base AS (SELECT own AS window_id, x AS ux FROM near JOIN shapes ON window_id = u WHERE k = 1),
took AS (SELECT met.window_id, i, sum(weight) AS w, sum(weight * pr2.y[j]) AS v FROM met JOIN pr2 ON pr2.window_id = met.window_id AND pr2.mate_id = met.mate_id JOIN others ON own = met.window_id AND q = met.mate_id GROUP BY 1, 2)
SELECT shapes.window_id, label, '_{{tag}}' AS tags, CAST(pos AS INTEGER) AS pos, {rsql("(ux[pos + 1] + coalesce(v, 0)) / (1 + coalesce(w, 0))")} AS x
FROM shapes JOIN base ON base.window_id = shapes.window_id JOIN {POS} ON true LEFT JOIN took ON took.window_id = shapes.window_id AND took.i = pos + 1"""
STEP_SQL |= {"spawner": SPAWNER_SQL, "wdba": WDBA_SQL}
STEP_SQL |= {"rgw": _retimed_sql(ABS_COST, IN_BAND), "rgws": _retimed_sql(SHAPE_COST, SHAPE_BAND)}


def _step_query(step: str) -> None:
    sql = STEP_SQL.get(step)

    @query(f"augment_{step}", sql and sql.replace("{tag}", step))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = augment.augment(shapes(spark, sf), [step], LENGTH)
        return out.select("window_id", "label", "tags", F.posexplode("x").alias("pos", "x")).withColumn("x", r("x"))


for _step in augment.STEPS:
    _step_query(_step)


MOVED = f"x[pos + 1] * ({normal(0, 'scale', 'x', WID)} * 0.5 + 1.0) + {normal(0, 'shift', 'x', WID)} * 0.5 + {normal(0, 'jitter', 'x', WID, Sql('pos'))} * 0.5"


@query("augment_scale_shift_jitter", f"WITH {SHAPES_SQL} SELECT window_id, CAST(pos AS INTEGER) AS pos, {rsql(MOVED)} AS x FROM shapes, {POS}")
def augment_scale_shift_jitter(spark: SparkSession, sf: str) -> DataFrame:
    out = augment.scale_shift_jitter(shapes(spark, sf))
    return out.select("window_id", F.posexplode("x").alias("pos", "x")).withColumn("x", r("x"))


RID = Sql("rid")
CHAIN = f"(x[i + 1] + {normal(0, 'jitter', 'x', RID, Sql('i'))} * 0.03) * (1.0 + {normal(0, 'scaling', 'x', RID)} * 0.1)"


@query(
    "augment_rounds",
    f"""WITH {SHAPES_SQL}, r AS (SELECT *, window_id * 2 + round - 1 AS rid FROM shapes, range(1, 3) q(round)),
m AS (SELECT * REPLACE (list_transform(range(0, {LENGTH}), lambda i: {CHAIN}) AS x) FROM r), c AS ({_slice_sql('m', 0, RID)})
SELECT window_id, label, CAST(round AS INTEGER) AS round, '2_jitter_scaling_windowslice' AS tags, CAST(pos AS INTEGER) AS pos, {rsql(SLICED)} AS x FROM c, {POS}
UNION ALL SELECT window_id, label, 0, '', CAST(pos AS INTEGER), {rsql('x[pos + 1]')} FROM shapes, {POS}""",
)
def augment_rounds(spark: SparkSession, sf: str) -> DataFrame:
    out = augment.augment_rounds(shapes(spark, sf), ["jitter", "scaling", "windowslice"], LENGTH, 2)
    return out.select("window_id", "label", "round", "tags", F.posexplode("x").alias("pos", "x")).withColumn("x", r("x"))

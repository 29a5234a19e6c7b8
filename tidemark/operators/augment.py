"""Augmentation: new windows from labelled windows.

Input: ``window_id``, one array column per channel, and ``label`` for the class-guided
steps. Draws are hashes of (seed, step, window, channel), so results do not
depend on partitioning. Steps that only move or scale values are Spark
expressions; splines and warping run on Arrow batches.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import warping
from tidemark.functions.arrays import array_sum, let, pin
from tidemark.functions.draws import cell, integer, normal, uniform
from tidemark.functions.fourier import DOUBLES
from tidemark.operators.dtw import as_matrix, packed_distance, packed_path, present, sample_medoids
from tidemark.operators.mates import gather_mates, with_mates
from tidemark.session import staged

ID = "window_id"
ROUND = "round"
X = ("x",)
CHANNELS = T.ArrayType(DOUBLES)

# -- magnitude ---------------------------------------------------------------------------------------


def jitter(df: DataFrame, cols: Sequence[str] = X, sigma: float = 0.03, seed: int = 0, tag: str = "jitter") -> DataFrame:
    """Add normal noise to every point."""
    noise = lambda c, i: normal(seed, tag, c, F.col(ID), i) * sigma
    return df.withColumns({c: _noisy(c, noise) for c in cols})


def _noisy(c: str, noise: Callable[[str, Column], Column]) -> Column:
    return F.transform(c, lambda v, i: v + noise(c, i))


def scaling(df: DataFrame, cols: Sequence[str] = X, sigma: float = 0.1, seed: int = 0) -> DataFrame:
    """Multiply each channel of a window by one normal factor around 1."""
    factor = lambda c: 1.0 + normal(seed, "scaling", c, F.col(ID)) * sigma
    return df.withColumns({c: _each(c, factor(c), lambda v, f: v * f) for c in cols})


def _each(c: str, value: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return let(value, lambda f: F.transform(c, lambda v: fn(v, f)))


def rotation(df: DataFrame, cols: Sequence[str] = X, seed: int = 0) -> DataFrame:
    """Flip channels at random per window, and shuffle the channels once for all windows."""
    source = list(cols)
    random.Random(seed).shuffle(source)
    sign = lambda c: F.when(uniform(seed, "rotation", c, F.col(ID)) < 0.5, -1.0).otherwise(1.0)
    flipped = {c: _each(s, sign(c), lambda v, f: v * f) for c, s in zip(cols, source, strict=True)}
    return df.withColumns(flipped)


def scale_shift_jitter(df: DataFrame, cols: Sequence[str] = X, sigma: float = 0.5, seed: int = 0) -> DataFrame:
    """Scale, then shift, then jitter; scale, shift and noise are normal with the same spread.

    Scale and shift are one draw per window and channel, the noise is one per point.
    """
    draw = lambda name, c, *at: normal(seed, name, c, F.col(ID), *at) * sigma

    def moved(c: str) -> Column:
        parts = F.struct((draw("scale", c) + 1.0).alias("scale"), draw("shift", c).alias("shift"))
        return let(parts, lambda p: F.transform(c, lambda v, i: v * p["scale"] + p["shift"] + draw("jitter", c, i)))

    return df.withColumns({c: moved(c) for c in cols})


# -- order --------------------------------------------------------------------------------------------


def permutation(
    df: DataFrame, cols: Sequence[str] = X, max_segments: int = 5, mode: str = "equal", seed: int = 0
) -> DataFrame:
    """Cut a window into 1 .. max_segments-1 segments and shuffle them, all channels alike.

    ``equal`` segments differ by at most one point; ``random`` ones are cut at random points.
    """
    if mode not in ("equal", "random"):
        raise ValueError("mode must be 'equal' or 'random'")
    tag = f"permutation_{mode}"
    first = cols[0]
    pieces = integer(1, max_segments, seed, tag, F.col(ID)).cast("int")

    def bounds(n: Column) -> Column:
        length = F.size(first)
        if mode == "equal":
            q, extra = F.floor(length / n).cast("int"), length % n
            return F.transform(F.sequence(F.lit(0), n), lambda s: s * q + F.least(s, extra))
        places = F.transform(
            F.sequence(F.lit(0), length - 3), lambda i: F.struct(cell(seed, tag, "cut", F.col(ID), i).alias("h"), i.alias("i"))
        )
        chosen = F.array_sort(F.transform(F.slice(F.array_sort(places), F.lit(1), n - 1), lambda s: s["i"]))
        return F.concat(F.array(F.lit(0)), chosen, F.array(length))

    order = lambda n: F.transform(
        F.array_sort(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda s: F.struct(cell(seed, tag, "order", F.col(ID), s).alias("h"), s.alias("s")),
            )
        ),
        lambda s: s["s"],
    )
    plan = let(pieces, lambda n: F.struct(bounds(n).alias("b"), order(n).alias("o")))
    cut = lambda c: let(
        "_plan",
        lambda p: F.flatten(
            F.transform(
                p["o"],
                lambda s: F.slice(c, F.element_at(p["b"], s) + 1, F.element_at(p["b"], s + 1) - F.element_at(p["b"], s)),
            )
        ),
    )
    return df.withColumn("_plan", plan).withColumns({c: cut(c) for c in cols}).drop("_plan")


# -- resampling -----------------------------------------------------------------------------------------


def _read(a: Column, at: Column) -> Column:
    """Linear interpolation at a real position, held at both ends."""
    lo = F.floor(at).cast("int")
    hi = F.least(lo + 1, F.size(a) - 1)
    return F.element_at(a, lo + 1) + (at - lo) * (F.element_at(a, hi + 1) - F.element_at(a, lo + 1))


def resample(a: Column, count: Column | int) -> Column:
    """Array stretched or squeezed to ``count`` points, ends kept."""
    n = F.lit(count) if isinstance(count, int) else count
    last = lambda x: (F.size(x) - 1).cast("double")
    at = lambda x, i: F.least(i * last(x) / F.greatest(n - 1, F.lit(1)), last(x))
    return let(a, lambda x: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: _read(x, at(x, i))))


def window_slice(
    df: DataFrame, cols: Sequence[str] = X, ratio: float | Column = 0.9, seed: int = 0
) -> DataFrame:
    """Keep a random slice of a window and stretch it back to full length.

    Positions run from 0 to the slice length inclusive, so the last value is held
    for the final stretch.
    """
    length = F.size(cols[0])
    share = F.lit(ratio) if isinstance(ratio, float) else ratio
    target = F.ceil(share * length).cast("int")
    start = integer(0, F.greatest(length - target, F.lit(1)), seed, "slice", F.col(ID)).cast("int")
    cut = F.struct(target.alias("target"), start.alias("start"), length.alias("n"))

    def stretched(c: str) -> Column:
        def body(p: Column) -> Column:
            last = (p["target"] - 1).cast("double")
            at = lambda i: F.least(i * p["target"] / (p["n"] - 1), last)
            part = F.slice(c, p["start"] + 1, p["target"])
            return let(part, lambda x: F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda i: _read(x, at(i))))

        return let("_cut", lambda p: F.when(p["target"] >= p["n"], F.col(c)).otherwise(body(p)))

    return df.withColumn("_cut", cut).withColumns({c: stretched(c) for c in cols}).drop("_cut")


def window_warp(
    df: DataFrame, cols: Sequence[str] = X, ratio: float = 0.1, scales: Sequence[float] = (0.5, 2.0), seed: int = 0
) -> DataFrame:
    """Speed up or slow down a random part of a window, then stretch back to full length."""
    length = F.size(cols[0])
    size = F.ceil(F.lit(ratio) * length).cast("int")
    pick = integer(0, len(scales), seed, "warp_scale", F.col(ID)).cast("int")
    scale = F.element_at(F.array(*[F.lit(float(s)) for s in scales]), pick + 1)
    start = integer(1, length - size - 1, seed, "warp_start", F.col(ID)).cast("int")
    plan = F.struct(size.alias("size"), start.alias("start"), F.floor(size * scale).cast("int").alias("count"), length.alias("n"))

    def warped(c: str) -> Column:
        def body(p: Column) -> Column:
            part = resample(F.slice(c, p["start"] + 1, p["size"]), p["count"])
            rest = p["n"] - p["start"] - p["size"]
            whole = F.concat(F.slice(c, F.lit(1), p["start"]), part, F.slice(c, p["start"] + p["size"] + 1, rest))
            return resample(whole, p["n"])

        return let("_plan", body)

    return df.withColumn("_plan", plan).withColumns({c: warped(c) for c in cols}).drop("_plan")


# -- splines ----------------------------------------------------------------------------------------------


def spline_basis(length: int, knots: int) -> np.ndarray:
    """Matrix from knot values to a cubic spline on 0..length-1 (even knots, not-a-knot ends)."""
    at = np.linspace(0, length - 1.0, num=knots)
    step = at[1] - at[0]
    # unknown slopes m: interior continuity of the second derivative, not-a-knot at both ends
    left = np.zeros((knots, knots))
    right = np.zeros((knots, knots))
    for i in range(1, knots - 1):
        left[i, i - 1 : i + 2] = (1.0, 4.0, 1.0)
        right[i, i - 1], right[i, i + 1] = -3.0 / step, 3.0 / step
    left[0, [0, 2]] = (1.0, -1.0)
    right[0, :3] = np.array([-2.0, 4.0, -2.0]) / step
    left[-1, [-3, -1]] = (1.0, -1.0)
    right[-1, -3:] = np.array([-2.0, 4.0, -2.0]) / step
    slopes = np.linalg.solve(left, right)
    grid = np.arange(length, dtype=float)
    cell = np.clip(np.searchsorted(at, grid, side="right") - 1, 0, knots - 2)
    t = (grid - at[cell]) / step
    eye = np.eye(knots)
    h00, h10 = 2 * t**3 - 3 * t**2 + 1, t**3 - 2 * t**2 + t
    h01, h11 = -2 * t**3 + 3 * t**2, t**3 - t**2
    return (
        h00[:, None] * eye[cell] + h10[:, None] * step * slopes[cell] + h01[:, None] * eye[cell + 1] + h11[:, None] * step * slopes[cell + 1]
    )


def _knots(c: str, count: int, sigma: float, seed: int, tag: str) -> Column:
    draw = lambda k: 1.0 + normal(seed, tag, c, F.col(ID), k) * sigma
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), draw)


def magnitude_warp(
    df: DataFrame, length: int, cols: Sequence[str] = X, sigma: float = 0.2, knot: int = 4, seed: int = 0
) -> DataFrame:
    """Multiply by a smooth random curve: a cubic spline through normal knots around 1."""
    basis = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in spline_basis(length, knot + 2)])
    curve = lambda k: F.transform(basis, lambda row: array_sum(F.zip_with(row, k, lambda b, v: b * v)))
    warped = lambda c: F.zip_with(
        c, let(_knots(c, knot + 2, sigma, seed, "magnitude"), curve), lambda v, w: v * w
    )
    return df.withColumns({c: warped(c) for c in cols})


def time_warp(
    df: DataFrame, length: int, cols: Sequence[str] = X, sigma: float = 0.2, knot: int = 4, seed: int = 0
) -> DataFrame:
    """Resample along a smooth random time axis.

    The axis is a spline through the even knots, each moved by a normal factor, and
    scaled so that its end stays in place.
    """
    even = spline_basis(length, knot + 2) * np.linspace(0, length - 1.0, num=knot + 2)
    basis = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in even])
    end = float(length - 1)

    def axis(c: str) -> Column:
        curve = F.transform(basis, lambda row: array_sum(F.zip_with(row, f"_k_{c}", lambda b, v: b * v)))
        return let(curve, lambda a: F.transform(a, lambda v: F.least(F.greatest(v * end / F.element_at(a, -1), F.lit(0.0)), F.lit(end))))

    drawn = df.withColumns({f"_k_{c}": _knots(c, knot + 2, sigma, seed, "time") for c in cols})
    drawn = pin(drawn, *[f"_k_{c}" for c in cols])
    moved = lambda c: let(F.col(c), lambda x: F.transform(axis(c), lambda at: _read(x, at)))
    return drawn.withColumns({c: moved(c) for c in cols}).drop(*[f"_k_{c}" for c in cols])


# -- class guided -------------------------------------------------------------------------------------------


def _default_band(length: int, use_window: bool) -> int | None:
    return int(np.ceil(length / 10.0)) if use_window else None


def _lists(x: np.ndarray) -> list:
    """(time, channel) as channel lists."""
    return [list(c) for c in x.T]


def _unpack(df: DataFrame, cols: Sequence[str], packed: str, *drop: str) -> DataFrame:
    return df.withColumns({c: F.col(packed)[i] for i, c in enumerate(cols)}).drop(packed, *drop)


def spawner(
    df: DataFrame, length: int, cols: Sequence[str] = X, sigma: float = 0.05, seed: int = 0, label: str = "label"
) -> DataFrame:
    """Mean of a window and a class mate along a warping path forced through one random point, plus jitter.

    A window alone in its class only gets the jitter.
    """
    window = _default_band(length, True)

    @F.pandas_udf(CHANNELS)
    def run(own: pd.Series, mate: pd.Series, at: pd.Series) -> pd.Series:
        out = [_lists(as_matrix(a)) for a in own]
        rows = [k for k, m in enumerate(mate) if present(m)]
        a, b = [as_matrix(own.iloc[k]) for k in rows], [as_matrix(mate.iloc[k]) for k in rows]
        cut = [int(at.iloc[k]) for k in rows]
        heads = warping.paths_of([x[:t] for x, t in zip(a, cut)], [y[:t] for y, t in zip(b, cut)], "symmetric", window)
        tails = warping.paths_of([x[t:] for x, t in zip(a, cut)], [y[t:] for y, t in zip(b, cut)], "symmetric", window)
        for k, x, y, t, (hi, hj), (ti, tj) in zip(rows, a, b, cut, heads, tails):
            mean = (x[np.concatenate([hi, ti + t])] + y[np.concatenate([hj, tj + t])]) / 2
            out[k] = _lists(warping.stretch(mean, length))
        return pd.Series(out, dtype=object)

    pairs = with_mates(df, 1, ID, label, cols, seed)
    at = integer(1, length - 1, seed, "spawner", F.col(ID))
    packed = pairs.withColumns({"_a": F.array(*cols), "_b": F.array(*[f"mate_{c}" for c in cols]), "_t": at})
    mixed = pin(pin(packed, "_a", "_b", "_t").withColumn("_o", run.asNondeterministic()("_a", "_b", "_t")), "_o")
    out = _unpack(mixed, cols, "_o", "_a", "_b", "_t").select(*df.columns)
    return jitter(out, cols, sigma, seed, "spawner_jitter")


def random_guided_warp(
    df: DataFrame,
    length: int,
    cols: Sequence[str] = X,
    steps: str = "symmetric",
    use_window: bool = True,
    shape: bool = False,
    seed: int = 0,
    label: str = "label",
) -> DataFrame:
    """A window re-timed along its warping path to a random class mate."""
    window = _default_band(length, use_window)
    pairs = with_mates(df, 1, ID, label, cols, seed)
    mate = F.array(*[f"mate_{c}" for c in cols])
    packed = pairs.withColumns({"_a": F.array(*cols), "_b": F.when(F.col("mate_id").isNotNull(), mate)})
    return _retimed(packed, "_b", "_a", length, cols, steps, window, shape).select(*df.columns)


WARPED = T.StructType([T.StructField("w", CHANNELS), T.StructField("amount", T.DoubleType())])


def _retimed(
    df: DataFrame, proto: str, own: str, length: int, cols: Sequence[str], steps: str, window: int | None, shape: bool
) -> DataFrame:
    """Replace ``cols`` by the own window along its path to the prototype, stretched; adds how far it was warped.

    Without a prototype the window stays.
    """

    @F.pandas_udf(WARPED)
    def follow(p: pd.Series, w: pd.Series) -> pd.DataFrame:
        out, amount = [_lists(as_matrix(x)) for x in w], np.zeros(len(w))
        rows = [k for k, x in enumerate(p) if present(x)]
        x, y = [as_matrix(w.iloc[k]) for k in rows], [as_matrix(p.iloc[k]) for k in rows]
        for k, v, (_, j) in zip(rows, x, warping.paths_of(y, x, steps, window, shape)):
            out[k] = _lists(warping.stretch(v[j], length))
            amount[k] = np.abs(np.arange(length) - warping.stretch(np.asarray(j, float)[:, None], length)[:, 0]).sum()
        return pd.DataFrame({"w": pd.Series(out, dtype=object), "amount": amount})

    got = pin(pin(df, proto, own).withColumn("_r", follow.asNondeterministic()(proto, own)), "_r")
    return got.withColumns({**{c: F.col("_r.w")[i] for i, c in enumerate(cols)}, "warp_amount": F.col("_r.amount")}).drop("_r")


def barycenter(
    df: DataFrame,
    length: int,
    cols: Sequence[str] = X,
    batch_size: int = 6,
    steps: str = "symmetric",
    use_window: bool = True,
    seed: int = 0,
    label: str = "label",
) -> DataFrame:
    """Weighted warped average of a class sample around its medoid.

    Weights halve at the distance of the medoid's nearest neighbour; the medoid itself has
    weight one, and stands alone where that distance is zero. A point of the medoid
    takes from each sample the last point its path meets there.
    """
    window = _default_band(length, use_window)
    pairs = with_mates(df, batch_size, ID, label, cols, seed, include_self=True)
    rows = gather_mates(pairs, ID, cols, [c for c in df.columns if c != ID])
    found = rows.select(ID, "mates").join(sample_medoids(rows, "mates", steps, window, ID), ID)
    centred = found.withColumn("_u", F.get("mates", F.col("medoid")))
    nearest = F.get("near", F.lit(1))["d"]
    others = (
        centred.where(nearest > 0)
        .select(ID, "_u", "mates", "medoid", nearest.alias("_n"), F.explode("near").alias("_o"))
        .where("_o.q <> medoid")
        .select(ID, "_u", F.get("mates", F.col("_o.q")).alias("_v"), F.pow(F.lit(0.5), F.col("_o.d") / F.col("_n")).alias("weight"))
    )
    path = F.col("path")
    last = F.filter(path, lambda s, k: F.coalesce(F.get(path, k + 1)["i"] != s["i"], F.lit(True)))
    met = packed_path(others, "_u", "_v", steps, window).select(ID, "_v", "weight", F.explode(last).alias("_s"))
    taken = met.select(ID, F.col("_s.i").alias("i"), "weight", *[(F.col("weight") * F.get(F.get("_v", F.lit(c)), F.col("_s.j"))).alias(f"v{c}") for c in range(len(cols))])
    points = centred.select(ID, F.posexplode(F.arrays_zip(*[F.get("_u", F.lit(c)).alias(f"v{c}") for c in range(len(cols))])).alias("i", "_p"))
    base = points.select(ID, "i", F.lit(1.0).alias("weight"), *[F.col(f"_p.v{c}").alias(f"v{c}") for c in range(len(cols))])
    sums = base.unionByName(taken).groupBy(ID, "i").agg(*[(F.sum(f"v{c}") / F.sum("weight")).alias(f"v{c}") for c in range(len(cols))])
    means = sums.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("i", *[f"v{c}" for c in range(len(cols))]))).alias("_m"))
    joined = df.join(means, ID, "left")
    return joined.withColumns({c: F.coalesce(F.col("_m")[f"v{i}"], F.col(c)) for i, c in enumerate(cols)}).select(*df.columns)


def discriminative_warp(
    df: DataFrame,
    length: int,
    cols: Sequence[str] = X,
    batch_size: int = 6,
    steps: str = "symmetric",
    use_window: bool = True,
    shape: bool = False,
    variable_slice: bool = True,
    seed: int = 0,
    label: str = "label",
) -> DataFrame:
    """A window re-timed to the class mate that is closest to its class and farthest from the others.

    A mate's gain is its mean distance to the drawn windows of other classes less that to
    the other drawn mates; of equal gains the first drawn wins. With ``variable_slice``
    the result is sliced and stretched, less the more it was warped relative to the
    largest warp of all windows.
    """
    window = _default_band(length, use_window)
    rest = [c for c in df.columns if c != ID]
    pos = gather_mates(with_mates(df, -(-batch_size // 2), ID, label, cols, seed), ID, cols, rest, "_pos")
    neg = gather_mates(with_mates(df, batch_size // 2, ID, label, cols, seed, other_class=True), ID, cols, [], "_neg")
    rows = staged(pos.join(neg, ID).withColumn("_a", F.array(*cols)))
    marked = lambda c, same: F.transform(c, lambda w, q: F.struct(w.alias("w"), q.alias("q"), F.lit(same).alias("same")))
    against = rows.where((F.size("_pos") > 0) & (F.size("_neg") > 0)).withColumn("_all", F.concat(marked("_pos", True), marked("_neg", False)))
    pairs = against.select(ID, "_all", F.posexplode("_pos").alias("p", "_u")).select(ID, "p", "_u", F.explode("_all").alias("_o"))
    pairs = pairs.where(~F.col("_o.same") | (F.col("_o.q") != F.col("p"))).withColumn("_v", F.col("_o.w"))
    solved = packed_distance(pairs.select(ID, "p", "_u", "_v", F.col("_o.same").alias("same")), "_u", "_v", steps, window, shape, "d")
    mean = lambda same: F.coalesce(F.avg(F.when(F.col("same") == same, F.col("d"))), F.lit(0.0))
    gains = solved.groupBy(ID, "p").agg((mean(False) - mean(True)).alias("gain"))
    chosen = gains.groupBy(ID).agg(F.max_by("p", F.struct("gain", -F.col("p"))).alias("_best"))
    guided = rows.join(chosen, ID, "left").withColumn("_proto", F.get("_pos", F.col("_best")))
    out = _retimed(guided, "_proto", "_a", length, cols, steps, window, shape).select(*df.columns, "warp_amount")
    out = staged(out)
    if not variable_slice:
        return out.drop("warp_amount")
    # the largest warp of all windows, or of each round of ``augment_rounds``: one row per round
    by = [ROUND] if ROUND in df.columns else []
    top = out.groupBy(*by).agg(F.max("warp_amount").alias("_top"))
    joined = out.join(F.broadcast(top), by) if by else out.crossJoin(F.broadcast(top))
    share = F.when(F.col("_top") > 0, 0.9 + 0.1 * F.col("warp_amount") / F.col("_top")).otherwise(0.9)
    return window_slice(joined.withColumn("_share", share), cols, F.col("_share"), seed).select(*df.columns)


# -- chains ---------------------------------------------------------------------------------------------------

Step = Callable[[DataFrame, int, Sequence[str], int], DataFrame]

# Fixed order of the steps and their tags.
STEPS: dict[str, Step] = {
    "jitter": lambda d, n, c, s: jitter(d, c, seed=s),
    "scaling": lambda d, n, c, s: scaling(d, c, seed=s),
    "rotation": lambda d, n, c, s: rotation(d, c, seed=s),
    "permutation": lambda d, n, c, s: permutation(d, c, seed=s),
    "randomperm": lambda d, n, c, s: permutation(d, c, mode="random", seed=s),
    "magwarp": lambda d, n, c, s: magnitude_warp(d, n, c, seed=s),
    "timewarp": lambda d, n, c, s: time_warp(d, n, c, seed=s),
    "windowslice": lambda d, n, c, s: window_slice(d, c, seed=s),
    "windowwarp": lambda d, n, c, s: window_warp(d, c, seed=s),
    "spawner": lambda d, n, c, s: spawner(d, n, c, seed=s),
    "rgw": lambda d, n, c, s: random_guided_warp(d, n, c, seed=s),
    "rgws": lambda d, n, c, s: random_guided_warp(d, n, c, shape=True, seed=s),
    "wdba": lambda d, n, c, s: barycenter(d, n, c, seed=s),
    "dgw": lambda d, n, c, s: discriminative_warp(d, n, c, seed=s),
    "dgws": lambda d, n, c, s: discriminative_warp(d, n, c, shape=True, seed=s),
}


def augment(df: DataFrame, steps: Sequence[str], length: int, cols: Sequence[str] = X, seed: int = 0) -> DataFrame:
    """Apply the named steps in their fixed order; ``tags`` lists what was applied."""
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    chosen = [name for name in STEPS if name in steps]
    out = df
    for name in chosen:
        out = STEPS[name](out, length, cols, seed)
    return out.withColumn("tags", F.lit("".join(f"_{name}" for name in chosen)))


def augment_rounds(
    df: DataFrame, steps: Sequence[str], length: int, rounds: int, cols: Sequence[str] = X, seed: int = 0, extra_tag: str = "", keep: str = "all", label: str = "label"
) -> DataFrame:
    """Originals plus ``rounds`` augmented copies with their labels; ``round`` 0 is the original.

    Rounds are rows: every window is copied once per round under an id of its own, which all
    draws depend on, and mates share class and round. So the plan has one scan and one
    node per step whatever the number of rounds. ``keep='last'`` returns only the last round.
    """
    suffix = f"_{extra_tag}" if extra_tag else ""
    whole = dict(df.dtypes)[ID] in ("tinyint", "smallint", "int", "bigint")
    own_id = F.col(ID) * rounds + F.col(ROUND) - 1 if whole else F.concat_ws(":", ID, ROUND)
    made = F.sequence(F.lit(1), F.lit(rounds)) if keep == "all" else F.array(F.lit(rounds))
    hidden = {f"_own_{c}": F.when(F.col(ROUND) == 1, F.col(c)) for c in cols} if keep == "all" else {}
    copies = df.withColumn(ROUND, F.explode(made)).withColumns({"_id": F.col(ID), **hidden})
    if label in df.columns:
        copies = copies.withColumn("_label", F.col(label)).withColumn(label, F.struct(label, ROUND))
    out = augment(copies.withColumn(ID, own_id), steps, length, cols, seed)
    out = out.withColumns({ID: F.col("_id"), "tags": F.concat(F.lit(str(rounds)), "tags", F.lit(suffix))})
    if label in df.columns:
        out = out.withColumn(label, F.col("_label"))
    if keep != "all":
        return out.select(*df.columns, "tags", ROUND)
    # the first round brings the original along
    version = lambda n, tags, prefix: F.struct(n.alias(ROUND), tags.alias("tags"), *[F.col(f"{prefix}{c}").alias(c) for c in cols])
    new, old = version(F.col(ROUND), F.col("tags"), ""), version(F.lit(0), F.lit(extra_tag), "_own_")
    both = out.withColumn("_v", F.explode(F.when(F.col(ROUND) == 1, F.array(old, new)).otherwise(F.array(new))))
    return both.select(*[F.col(f"_v.{c}").alias(c) if c in cols else F.col(c) for c in df.columns], "_v.tags", f"_v.{ROUND}")

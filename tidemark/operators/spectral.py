"""Frequency analysis of windows: periods, shared spectra, delays and harmonics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import array_sum, let, pin
from tidemark.functions.draws import cell
from tidemark.functions.fourier import amplitude, circular_correlation, keep_bins, phase, rfft, strongest_part

KEYS = ("series_id",)


LONG = 256
"""Windows from this length on are summed as rows, shorter ones as array expressions."""


def spectrum_rows(windows: DataFrame, cols: Sequence[str] = ("x",), keys: Sequence[str] = KEYS, length: int | None = None) -> DataFrame:
    """One row per window, feature and frequency bin with its amplitude.

    Windows whose ``length`` is LONG or more become (position, bin) rows, which are summed
    where they are made, so a window leaves its task as its bins.
    """
    feature = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("_a")) for c in cols])
    ).alias("_f")
    features = windows.select(*keys, "w_start", feature).select(*keys, "w_start", "_f.feature", "_f._a")
    if length is not None and length >= LONG:
        points = features.select(*keys, "w_start", "feature", F.posexplode("_a").alias("_j", "_v"))
        cells = points.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(length // 2))))
        turn = F.lit(2 * math.pi) * (F.col("_j") * F.col("bin") % length) / length
        sums = cells.groupBy(*keys, "w_start", "feature", "bin").agg(F.sum(F.col("_v") * F.cos(turn)).alias("re"), F.sum(F.col("_v") * F.sin(turn)).alias("im"))
        return sums.select(*keys, "w_start", "feature", "bin", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amp"))
    spectra = features.select(*keys, "w_start", "feature", rfft("_a").alias("_s"))
    return spectra.select(*keys, "w_start", "feature", F.posexplode(amplitude(F.col("_s"))).alias("bin", "amp"))


def mean_spectrum(
    windows: DataFrame, cols: Sequence[str] = ("x",), by: Sequence[str] = (), keys: Sequence[str] = KEYS, length: int | None = None
) -> DataFrame:
    """Amplitude per bin averaged over windows and features (optionally per key)."""
    return spectrum_rows(windows, cols, keys, length).groupBy(*by, "bin").agg(F.avg("amp").alias("amp"))


def _top(df: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    # bins per group are bounded by the window length
    order = Window.partitionBy(*by).orderBy(F.desc("amp"), "bin")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dominant_periods(
    windows: DataFrame, length: int, k: int, cols: Sequence[str] = ("x",), by: Sequence[str] = (), keys: Sequence[str] = KEYS
) -> DataFrame:
    """The k strongest periods: length div bin, the constant bin excluded."""
    mean = mean_spectrum(windows, cols, by, keys, length).withColumn("amp", F.when(F.col("bin") == 0, 0.0).otherwise(F.col("amp")))
    top = _top(mean, k, by)
    period = F.when(F.col("bin") > 0, F.floor(F.lit(length) / F.col("bin"))).cast("long")
    return top.select(*by, "rank", "bin", period.alias("period"), "amp")


def window_period_weights(
    windows: DataFrame, bins: Sequence[int], cols: Sequence[str] = ("x",), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Amplitude of each window at the chosen bins, averaged over features."""
    rows = spectrum_rows(windows, cols, keys).where(F.col("bin").isin(list(bins)))
    return rows.groupBy(*keys, "w_start", "bin").agg(F.avg("amp").alias("weight"))


def shared_spectrum(windows: DataFrame, length: int, share: float = 0.2, cols: Sequence[str] = ("x",), keys: Sequence[str] = KEYS) -> DataFrame:
    """The strongest share of all bins over every window."""
    return _top(mean_spectrum(windows, cols, (), keys, length), int((length // 2 + 1) * share), ()).select("rank", "bin", "amp")


def spectrum_split(windows: DataFrame, bins: Sequence[int], col: str = "x") -> DataFrame:
    """Invariant part (the given bins) and variant part (the rest) of each window."""
    chosen = F.array(*[F.lit(int(b)) for b in bins])
    out = pin(windows.withColumn("invariant", keep_bins(col, chosen)), "invariant")
    return out.withColumn("variant", F.zip_with(col, "invariant", lambda x, y: x - y))


def dft_split(windows: DataFrame, k: int, col: str = "x") -> DataFrame:
    """Seasonal part from the k strongest non-constant bins of each window, trend is the rest.

    As in the definition with a strict comparison, the weakest of the k bins is cut too.
    """
    out = pin(windows.withColumn("seasonal", strongest_part(col, k)), "seasonal")
    return out.withColumn("trend", F.zip_with(col, "seasonal", lambda x, s: x - s))


def select_modes(spectrum: DataFrame, length: int, modes: int, method: str = "lowest", seed: int = 0) -> DataFrame:
    """Keep the lowest, or a seeded random choice, of the length/2 frequency bins."""
    half = length // 2
    modes = min(modes, half)
    if method == "lowest":
        return spectrum.where(F.col("bin") < modes)
    if method != "random":
        raise ValueError("method must be 'lowest' or 'random'")
    order = F.array_sort(
        F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda b: F.struct(cell(seed, "mode", b).alias("h"), b.alias("b")))
    )
    chosen = F.transform(F.slice(order, 1, modes), lambda s: s["b"])
    return spectrum.where(F.array_contains(chosen, F.col("bin")))


def autocorrelation(windows: DataFrame, query: str = "x", key: str | None = None, factor: float = 1.0) -> DataFrame:
    """Circular correlation of each window, its strongest lags and their softmax weights.

    The number of lags is int(factor * ln L). Adds ``corr`` and ``lags`` (array of ``lag, corr, weight``).
    """
    out = pin(windows.withColumn("corr", circular_correlation(query, key or query)), "corr")
    top = F.floor(F.lit(factor) * F.log(F.size("corr").cast("double"))).cast("int")
    ranked = F.slice(
        F.array_sort(F.transform("corr", lambda c, i: F.struct((-c).alias("minus"), i.alias("lag")))), F.lit(1), top
    )

    def weighted(top: Column) -> Column:
        grown = let(
            F.element_at(top, 1)["minus"], lambda best: F.transform(top, lambda s: F.exp(best - s["minus"]))
        )
        return let(
            grown,
            lambda e: let(
                array_sum(e),
                lambda total: F.zip_with(
                    top,
                    e,
                    lambda s, v: F.struct(s["lag"].alias("lag"), (-s["minus"]).alias("corr"), (v / total).alias("weight")),
                ),
            ),
        )

    return out.withColumn("lags", let(ranked, weighted))


def delay_aggregation(windows: DataFrame, value: str = "x", lags: str = "lags", name: str = "aggregated") -> DataFrame:
    """Weighted sum of the window rolled back by each of its lags."""

    def rolled(s: Column) -> Column:
        a = s["a"]
        at = lambda i, d: F.element_at(a, ((i + d) % F.size(a) + 1).cast("int"))
        return F.transform(
            a, lambda _, i: F.aggregate(s["lags"], F.lit(0.0), lambda acc, d: acc + d["weight"] * at(i, d["lag"]))
        )

    both = F.struct(F.col(value).alias("a"), F.col(lags).alias("lags"))
    return windows.withColumn(name, let(both, rolled))


def shared_lags(windows: DataFrame, factor: float = 1.0, length: int = 24, query: str = "x") -> DataFrame:
    """Lags chosen once from the correlation averaged over all windows."""
    corr = windows.select(F.posexplode(circular_correlation(query, query)).alias("lag", "corr"))
    mean = corr.groupBy("lag").agg(F.avg("corr").alias("corr"))
    k = int(factor * math.log(length))
    order = Window.orderBy(F.desc("corr"), "lag")  # at most `length` rows
    return mean.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def harmonics(windows: DataFrame, length: int, k: int, col: str = "x") -> DataFrame:
    """Strongest k harmonics of each window as array of ``f, amp, phase`` (constant and Nyquist bins skipped)."""
    out = pin(windows.withColumn("_s", rfft(col)), "_s")
    last = length // 2 - 1 if length % 2 == 0 else length // 2
    parts = F.zip_with(amplitude(F.col("_s")), phase(F.col("_s")), lambda a, p: F.struct(a.alias("a"), p.alias("p")))
    indexed = F.transform(
        parts,
        lambda s, i: F.struct(
            (-s["a"]).alias("minus"), i.alias("bin"), s["a"].alias("amp"), s["p"].alias("phase"), (i / F.lit(float(length))).alias("f")
        ),
    )
    usable = F.filter(indexed, lambda s: (s["bin"] >= 1) & (s["bin"] <= last))
    out = out.withColumn("_sorted", F.slice(F.array_sort(usable), 1, k))
    kept = F.transform(
        "_sorted",
        lambda s: F.struct(
            s["bin"].alias("bin"), s["f"].alias("f"), (s["amp"] / F.lit(float(length))).alias("amp"), s["phase"].alias("phase")
        ),
    )
    return out.withColumn("harmonics", kept).drop("_s", "_sorted")


def harmonic_curve(windows: DataFrame, start: int, stop: int, name: str) -> DataFrame:
    """Sum of the kept harmonics (both conjugates) at steps start..stop-1."""

    steps = F.sequence(F.lit(start), F.lit(stop - 1))
    wave = lambda h, t: 2.0 * h["amp"] * F.cos(F.lit(2 * math.pi) * h["f"] * t + h["phase"])
    curve = lambda hs: F.transform(
        steps, lambda t: F.aggregate(hs, F.lit(0.0), lambda acc, h: acc + wave(h, t))
    )
    return windows.withColumn(name, let("harmonics", curve))


def harmonic_extrapolation(windows: DataFrame, length: int, pred_len: int, k: int, col: str = "x") -> DataFrame:
    """Fitted harmonics over the window and ``pred_len`` steps beyond it (``season``)."""
    return harmonic_curve(harmonics(windows, length, k, col), 0, length + pred_len, "season")

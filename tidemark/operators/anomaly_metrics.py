"""Point-wise, segment-wise and ranking metrics for anomaly detection.

Input rows: keys, dense ``idx``, 0/1 ``label``, ``score`` (or 0/1 ``pred``). Runs of true
labels are found with two-level running totals over blocks of the index. What
is needed per segment is aggregated per (segment, block) first, so a segment
holding most of the rows is still counted by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import range_chunk, running_totals, with_halo
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import staged

KEYS = ("series_id",)
BLOCK = 1 << 16

# Smoothing constant of the ratios, and the default K grid in percent.
EPS = 1e-5
K_VALUES = (0, 1, 2, 3, 4, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100)


def confusion(pred: Column, label: Column) -> list[Column]:
    """TP, TN, FP, FN of 0/1 columns as aggregates."""
    return [
        F.sum(pred * label).cast("double").alias("tp"),
        F.sum((1 - pred) * (1 - label)).cast("double").alias("tn"),
        F.sum(pred * (1 - label)).cast("double").alias("fp"),
        F.sum((1 - pred) * label).cast("double").alias("fn"),
    ]


def ratios(eps: float = EPS) -> dict[str, Column]:
    """Precision, recall and F1 of tp, fp, fn columns."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(eps))
    recall = F.col("tp") / (F.col("tp") + F.col("fn") + F.lit(eps))
    return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall + F.lit(eps))}


def point_metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    """Counts, precision, recall and F1 without adjustment."""
    return df.groupBy(*by).agg(*confusion(F.col(pred), F.col(label))).withColumns(ratios())


def with_segments(
    df: DataFrame, label: str = "label", keys: Sequence[str] = KEYS, idx: str = "idx", block: int = BLOCK
) -> DataFrame:
    """Number the runs of true labels of each series: ``seg`` is null outside a run.

    Adds ``_chunk`` (block of the index), the unit of all per-segment partial sums.
    """
    spec = Window.partitionBy(*keys, "_block").orderBy(idx)
    starts = (
        with_halo(df, idx, block, 1, 0)
        .withColumn("_new", F.when((F.col(label) > 0) & (F.coalesce(F.lag(label).over(spec), F.lit(0)) == 0), 1).otherwise(0))
        .where("_own")
        .drop("_own")
        .withColumnRenamed("_block", "_chunk")  # an owned row's block: the running totals keep this partitioning
    )
    numbered = running_totals(starts, keys, [idx], {"_seg": F.col("_new")})
    return numbered.withColumn("seg", F.when(F.col(label) > 0, F.col("_seg"))).drop("_seg", "_new")


def segment_table(
    df: DataFrame, label: str = "label", keys: Sequence[str] = KEYS, idx: str = "idx", block: int = BLOCK
) -> DataFrame:
    """First and last index and length of each run of true labels."""
    rows = with_segments(df, label, keys, idx, block).where("seg is not null")
    return rows.groupBy(*keys, "seg").agg(
        F.min(idx).alias("start"), F.max(idx).alias("end"), F.count(F.lit(1)).alias("length")
    )


def _spread_back(rows: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Join per-segment totals to the rows of the segment.

    Each total is repeated for the blocks its segment touches, so the join runs on
    (block, segment) and no join key is hot, however long a segment is.
    """
    per_segment = rows.where("seg is not null").groupBy(*keys, "seg").agg(
        F.min("_chunk").alias("_from"), F.max("_chunk").alias("_to"), *[c.alias(n) for n, c in totals.items()]
    )
    spread = per_segment.withColumn("_chunk", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    return rows.join(spread, [*keys, "_chunk", "seg"], "left")


def adjust_predictions(
    df: DataFrame,
    k: float | None = None,
    pred: str = "pred",
    label: str = "label",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    block: int = BLOCK,
    keep_first: bool | None = None,
    name: str = "adjusted",
) -> DataFrame:
    """Point adjustment of 0/1 predictions.

    With ``k`` None one hit marks its whole segment (``keep_first`` leaves position 0
    unmarked unless it was hit itself, the default in this mode). With ``k`` given
    a segment is marked when it has a hit and at least k percent of it is hit.
    Adds ``filled``: 1 where the adjustment changed the prediction.
    """
    keep_first = (k is None) if keep_first is None else keep_first
    rows = staged(with_segments(df, label, keys, idx, block))
    joined = _spread_back(rows, keys, {"_hits": F.sum(pred), "_len": F.count(F.lit(1))})
    enough = F.col("_hits") > 0
    if k is not None:
        enough = enough & (F.col("_hits") * 100.0 >= F.lit(float(k)) * F.col("_len"))
    if keep_first:
        enough = enough & (F.col(idx) > 0)
    adjusted = F.when(F.coalesce(enough, F.lit(False)), 1).otherwise(F.col(pred))
    return joined.withColumn(name, adjusted).withColumn("filled", F.col(name) - F.col(pred)).select(
        *df.columns, name, "filled"
    )


def adjust_latency(
    df: DataFrame,
    k: float | None = None,
    pred: str = "pred",
    label: str = "label",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    block: int = BLOCK,
) -> DataFrame:
    """Detection delay per series.

    ``k`` None: points filled before the first hit over the number of detected
    segments. ``k`` given: all points filled over the number of segments.
    """
    rows = with_segments(df, label, keys, idx, block).where("seg is not null")
    partial = rows.groupBy(*keys, "seg").agg(
        F.min(idx).alias("_start"),
        F.min(F.when(F.col(pred) == 1, F.col(idx))).alias("_first"),
        F.sum(pred).alias("_hits"),
        F.count(F.lit(1)).alias("_len"),
    )
    if k is None:
        waited = F.when(F.col("_first").isNotNull(), F.col("_first") - F.greatest(F.col("_start"), F.lit(1)))
        waited = F.greatest(waited, F.lit(0))
        count = F.count("_first")
    else:
        marked = (F.col("_hits") > 0) & (F.col("_hits") * 100.0 >= F.lit(float(k)) * F.col("_len"))
        waited = F.when(marked, F.col("_len") - F.col("_hits"))
        count = F.count(F.lit(1))
    return partial.groupBy(*keys).agg(
        (F.coalesce(F.sum(waited), F.lit(0)) / (count + F.lit(EPS))).alias("latency"), count.alias("segments")
    )


# -- thresholds on a grid ---------------------------------------------------------------------------


def grid(start: float, end: float, steps: int) -> list[float]:
    """Thresholds start + (i + 1) * range / steps, accumulated step by step."""
    out, t = [], start
    for _ in range(steps):
        t += (end - start) / float(steps)
        out.append(t)
    return out


def grid_metrics(
    df: DataFrame,
    thresholds: Sequence[float],
    ks: Sequence[float] = (0,),
    score: str = "score",
    label: str = "label",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    block: int = BLOCK,
) -> DataFrame:
    """PA%K counts and ratios for every threshold and every K in one plan.

    Each score is replaced by the number of thresholds below it (its level), and
    rows are counted per (segment, level). A segment then has at most one row
    per threshold, and its hits at each threshold are a running total over
    levels. No job runs per threshold. A null or NaN score is above no threshold.
    """
    ordered = sorted(set(float(t) for t in thresholds))
    if len(ordered) > 1:
        # score > t  <=>  -score < -t; buckets are closed below, so cut on the negated score
        splits = [-float("inf"), *[-t for t in reversed(ordered)], float("inf")]
        cutter = Bucketizer(splits=splits, inputCol="_neg", outputCol="_bucket", handleInvalid="keep")
        levelled = cutter.transform(df.withColumn("_neg", -F.col(score).cast("double")))
        levelled = levelled.withColumn("_level", (F.lit(len(ordered)) - F.col("_bucket")).cast("int")).drop("_neg", "_bucket")
    else:
        levelled = df.withColumn("_level", F.when(F.col(score) > F.lit(ordered[0]), 1).otherwise(0))
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    levelled = levelled.withColumn("_level", F.when(known, F.col("_level")).otherwise(0))

    rows = with_segments(levelled, label, keys, idx, block)
    cells = staged(rows.groupBy(*keys, "seg", "_level").agg(F.count(F.lit(1)).alias("_n")))

    # normal points: false positives at threshold i are the points with level > i
    above = Window.partitionBy(*keys, "seg").orderBy(F.desc("_level"))
    runs = cells.withColumn("_hits", F.sum("_n").over(above)).withColumn(
        "_len", F.sum("_n").over(Window.partitionBy(*keys, "seg"))
    )
    # hits stay constant between one present level and the next lower present one:
    # a row holds for thresholds lower .. level - 1, so it enters the sums at lower
    # and leaves them at level; K enters through the number of Ks the segment passes
    is_seg = F.col("seg").isNotNull()
    k_sorted = sorted(float(k) for k in set(ks))
    k_array = F.array(*[F.lit(k) for k in k_sorted])
    lower = F.coalesce(F.lead("_level").over(above), F.lit(0))
    passed = F.size(F.filter(k_array, lambda k: F.col("_hits") * 100.0 >= k * F.col("_len")))
    spans = runs.withColumns({"_lower": lower, "_passed": F.when(is_seg, passed).otherwise(0)}).where("_level > _lower")
    edge = lambda t, sign: F.struct(F.col(t).alias("t"), F.lit(sign).alias("sign"))
    changes = spans.select(
        *keys, "seg", "_passed", "_len", "_hits", F.explode(F.array(edge("_lower", 1), edge("_level", -1))).alias("_e")
    )
    amount = lambda cond, value: F.sum(F.when(cond, F.col("_e.sign") * value).otherwise(0))
    summed = changes.groupBy(*keys, "_passed", F.col("_e.t").alias("_t")).agg(
        amount(is_seg, F.col("_hits")).alias("_hit"),
        amount(is_seg, F.col("_len") - F.col("_hits")).alias("_fill"),
        amount(~is_seg, F.col("_hits")).alias("_fp"),
    )
    # from here on at most (thresholds x Ks) rows per key
    each_k = F.explode(F.sequence(F.lit(1), F.lit(len(k_sorted)))).alias("_j")
    counts = summed.select("*", each_k).groupBy(*keys, "_j", "_t").agg(
        F.sum("_hit").alias("_hit"),
        F.sum(F.when(F.col("_j") <= F.col("_passed"), F.col("_fill")).otherwise(0)).alias("_fill"),
        F.sum("_fp").alias("_fp"),
    )
    totals = cells.groupBy(*keys).agg(
        F.sum(F.when(is_seg, F.col("_n")).otherwise(0)).alias("_pos"),
        F.sum(F.when(~is_seg, F.col("_n")).otherwise(0)).alias("_neg"),
        F.max("seg").alias("_segs"),
    )
    full = totals.select("*", each_k).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(len(ordered) - 1))))
    upto = Window.partitionBy(*keys, "_j").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto)
    at = full.join(counts, [*keys, "_j", "_t"], "left").withColumns(
        {"_hits": run("_hit"), "_filled": run("_fill"), "_false": run("_fp")}
    )
    out = at.select(
        *keys,
        F.element_at(k_array, F.col("_j")).alias("k"),
        F.element_at(_threshold_array(ordered), F.col("_t") + 1).alias("threshold"),
        (F.col("_hits") + F.col("_filled")).cast("double").alias("tp"),
        (F.col("_neg") - F.col("_false")).cast("double").alias("tn"),
        F.col("_false").cast("double").alias("fp"),
        (F.col("_pos") - F.col("_hits") - F.col("_filled")).cast("double").alias("fn"),
        (F.col("_filled") / (F.coalesce("_segs", F.lit(0)) + F.lit(EPS))).alias("latency"),
    )
    return out.withColumns(ratios())


def _threshold_array(ordered: Sequence[float]) -> Column:
    return F.array(*[F.lit(t) for t in ordered])


def best_threshold(metrics: DataFrame, keys: Sequence[str] = KEYS, descending: bool = False) -> DataFrame:
    """Per key and K the grid row with the best F1; on ties the first one searched wins."""
    first = F.col("threshold") if descending else -F.col("threshold")
    fields = ["threshold", "f1", "precision", "recall", "tp", "tn", "fp", "fn", "latency"]
    best = metrics.groupBy(*keys, "k").agg(F.max_by(F.struct(*fields), F.struct("f1", first)).alias("_b"))
    return best.select(*keys, "k", *[F.col(f"_b.{f}").alias(f) for f in fields])


def quantile_values(df: DataFrame, probabilities: Sequence[float], score: str = "score") -> list[float]:
    """Exact linear quantiles as numbers: one per probability reaches the driver."""
    return list(exact_quantiles(df, probabilities, score).first()["quantiles"])


def search_thresholds(
    df: DataFrame,
    start: float,
    end: float | None = None,
    steps: int = 1,
    k: float = 0,
    score: str = "score",
    label: str = "label",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
) -> DataFrame:
    """Best PA%K F1 over an even grid of thresholds, with ranking metrics."""
    thresholds = grid(start, start if end is None else end, 1 if end is None else steps)
    best = best_threshold(grid_metrics(df, thresholds, [k], score, label, keys, idx), keys)
    return best.join(ranking_metrics(df, keys, score, label), list(keys)) if keys else best.crossJoin(
        F.broadcast(ranking_metrics(df, keys, score, label))
    )


def search_validation_percentiles(
    valid: DataFrame,
    df: DataFrame,
    start: float,
    end: float,
    interval: float,
    k: float = 0,
    score: str = "score",
    label: str = "label",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
) -> DataFrame:
    """Best PA%K F1 over percentiles 100 - (i+1) * interval of validation scores."""
    count = int((end - start) // interval)
    thresholds = quantile_values(valid, [(100 - (i + 1) * interval) / 100 for i in range(count)], score)
    return best_threshold(grid_metrics(df, thresholds, [k], score, label, keys, idx), keys, descending=True)


def percentile_search(
    combined: DataFrame,
    df: DataFrame,
    ratio: float,
    score: str = "score",
    label: str = "label",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
) -> DataFrame:
    """Sequence metrics at the (100 - ratio) percentile of the combined scores, K = 0."""
    threshold = quantile_values(combined, [(100 - ratio) / 100], score)[0]
    return sequence_metrics(df, threshold, 0, score, label, keys, idx)


def sequence_metrics(
    df: DataFrame,
    threshold: float,
    k: float = 0,
    score: str = "score",
    label: str = "label",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
) -> DataFrame:
    """PA%K counts and ratios at one threshold with ROC-AUC, average precision and latency."""
    at = grid_metrics(df, [threshold], [k], score, label, keys, idx)
    ranking = ranking_metrics(df, keys, score, label)
    return at.join(ranking, list(keys)) if keys else at.crossJoin(F.broadcast(ranking))  # one row


def pa_k_table(
    df: DataFrame,
    ks: Sequence[float] = K_VALUES,
    steps: int = 1000,
    score: str = "score",
    label: str = "label",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
) -> DataFrame:
    """Best F1 per K over a grid from the 50th to the 99th percentile of all scores, beside the ROC-AUC of the scores themselves, which no K changes."""
    lo, hi = quantile_values(df, [0.5, 0.99], score)
    best = best_threshold(grid_metrics(df, grid(lo, hi, steps), ks, score, label, keys, idx), keys)
    ranking = ranking_metrics(df, keys, score, label).drop("average_precision")
    return best.join(ranking, list(keys), "left") if keys else best.crossJoin(F.broadcast(ranking))  # one row


def pa_k_auc(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Area under F1 over K (trapezoids), divided by 100."""
    spec = Window.partitionBy(*keys).orderBy("k")  # one row per K
    nxt = table.select(*keys, "k", "f1", F.lead("k").over(spec).alias("_k"), F.lead("f1").over(spec).alias("_f"))
    return nxt.groupBy(*keys).agg((F.sum((F.col("f1") + F.col("_f")) / 2 * (F.col("_k") - F.col("k"))) / 100.0).alias("pa_auc"))


# -- ranking metrics --------------------------------------------------------------------------------


def cumulative_counts(
    df: DataFrame, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label", chunks: int | None = None
) -> DataFrame:
    """Per distinct score, descending: true and false positives at threshold ``score >=`` it.

    Equal scores are merged before anything is ordered; the order itself is cut
    into quantile ranges of the score.
    """
    tied = staged(df.groupBy(*keys, score).agg(F.sum(label).alias("_pos"), F.sum(1 - F.col(label)).alias("_neg")))
    cut = range_chunk(tied.withColumn("_down", -F.col(score)), "_down", chunks)
    return running_totals(cut, keys, ["_down"], {"tp": F.col("_pos"), "fp": F.col("_neg")}).drop("_chunk", "_down")


def ranking_metrics(
    df: DataFrame, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label", chunks: int | None = None
) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null when only one class is present."""
    return cumulative_counts(df, keys, score, label, chunks).groupBy(*keys).agg(*_ranking_aggregates())


def _ranking_aggregates() -> list[Column]:
    # a tied group adds a trapezoid: its negatives times the mean of the positives before and after
    area = F.sum(F.col("_neg") * (F.col("tp") - F.col("_pos") / 2.0))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    both = (pos > 0) & (neg > 0)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return [
        F.when(both, area / (pos * neg)).alias("roc_auc"),
        F.when(both, F.sum(F.col("_pos") * precision) / pos).alias("average_precision"),
    ]


def with_class_totals(cum: DataFrame, keys: Sequence[str]) -> DataFrame:
    # an absent class gives null rates, not a division by zero
    size = lambda c: F.nullif(F.sum(c), F.lit(0))
    totals = cum.groupBy(*keys).agg(size("_pos").alias("_p"), size("_neg").alias("_n"))
    return cum.join(totals, list(keys)) if keys else cum.crossJoin(F.broadcast(totals))  # one row


def roc_points(df: DataFrame, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label") -> DataFrame:
    """False and true positive rate at every distinct score."""
    cum = with_class_totals(cumulative_counts(df, keys, score, label), keys)
    return cum.select(*keys, F.col(score).alias("threshold"), (F.col("fp") / F.col("_n")).alias("fpr"), (F.col("tp") / F.col("_p")).alias("tpr"))


def pr_points(
    df: DataFrame, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label", eps: float = 1e-8
) -> DataFrame:
    """Precision, recall and F1 at every distinct score."""
    cum = with_class_totals(cumulative_counts(df, keys, score, label), keys)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.col("_p")
    return cum.select(
        *keys,
        F.col(score).alias("threshold"),
        precision.alias("precision"),
        recall.alias("recall"),
        (2 * precision * recall / (precision + recall + F.lit(eps))).alias("f1"),
    )


def best_pr_f1(df: DataFrame, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label", eps: float = 1e-8) -> DataFrame:
    """Best F1 on the precision-recall curve (the lowest threshold among equals)."""
    points = pr_points(df, keys, score, label, eps)
    best = points.groupBy(*keys).agg(
        F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold"))).alias("_b")
    )
    return best.select(*keys, "_b.threshold", "_b.precision", "_b.recall", "_b.f1")


def youden_metrics(df: DataFrame, keys: Sequence[str] = KEYS, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold with the largest TPR - FPR (highest score first), and the metrics of ``score >= threshold``.

    Micro-averaged F1 of hard binary predictions is their accuracy; the ROC-AUC
    of hard predictions is (TPR + TNR) / 2. Where no threshold has a positive gap the
    threshold is null and nothing is predicted.
    """
    cum = with_class_totals(cumulative_counts(df, keys, score, label), keys)
    # J = tp/P - fp/N compared as integers, so equal gaps tie exactly
    gap = F.col("tp") * F.col("_n") - F.col("fp") * F.col("_p")
    best = cum.withColumn("_gap", gap).groupBy(*keys).agg(
        F.max_by(F.struct(F.col(score).alias("threshold"), "tp", "fp", "_p", "_n", "_gap"), F.struct("_gap", score)).alias("_b")
    )
    row = best.select(*keys, "_b.*")
    some = F.col("_gap") > 0
    row = row.withColumns({"threshold": F.when(some, F.col("threshold")), "tp": F.when(some, F.col("tp")).otherwise(0), "fp": F.when(some, F.col("fp")).otherwise(0)})
    tpr, fpr = F.col("tp") / F.col("_p"), F.col("fp") / F.col("_n")
    return row.select(
        *keys,
        "threshold",
        F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0)).alias("precision"),
        tpr.alias("recall"),
        ((F.col("tp") + F.col("_n") - F.col("fp")) / (F.col("_p") + F.col("_n"))).alias("f1_micro"),
        ((tpr + 1 - fpr) / 2).alias("roc_auc"),
    )


def best_segment_f1(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = KEYS, idx: str = "idx"
) -> DataFrame:
    """Best F1 when a segment counts by its lowest score and low scores are anomalous.

    Items (segments and single normal points) are ordered by score, equal scores
    in the order they end; the reported counts are those of the best step.
    """
    rows = staged(with_segments(df, label, keys, idx))
    segs = rows.where("seg is not null").groupBy(*keys, "seg").agg(
        F.min(score).alias("_score"), F.count(F.lit(1)).alias("_len"), F.max(idx).alias("_pos_idx")
    ).select(*keys, "_score", "_len", F.col("_len").alias("_hit"), "_pos_idx")
    normals = rows.where("seg is null").select(
        *keys, F.col(score).alias("_score"), F.lit(1).cast("long").alias("_len"), F.lit(0).cast("long").alias("_hit"), F.col(idx).alias("_pos_idx")
    )
    items = range_chunk(staged(segs.unionByName(normals)), ["_score", "_pos_idx"])
    cum = running_totals(items, keys, ["_score", "_pos_idx"], {"_predicted": F.col("_len"), "tp": F.col("_hit")})
    totals = df.groupBy(*keys).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_all"))
    cum = cum.join(totals, list(keys)) if keys else cum.crossJoin(F.broadcast(totals))  # one row
    counts = cum.withColumns(
        {
            "fp": (F.col("_predicted") - F.col("tp")).cast("double"),
            "fn": (F.col("_p") - F.col("tp")).cast("double"),
            "tn": (F.col("_all") - F.col("_predicted") - F.col("_p") + F.col("tp")).cast("double"),
            "tp": F.col("tp").cast("double"),
        }
    ).withColumns(ratios())
    fields = ["f1", "precision", "recall", "tp", "tn", "fp", "fn"]
    first = F.struct("f1", -F.col("_score"), -F.col("_pos_idx"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct(F.col("_score").alias("threshold"), *fields), first).alias("_b"))
    return best.select(*keys, "_b.threshold", *[F.col(f"_b.{f}").alias(f) for f in fields])


def lift_segments(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = KEYS, idx: str = "idx", name: str = "score"
) -> DataFrame:
    """Replace the scores inside each true segment by the segment's maximum."""
    rows = staged(with_segments(df, label, keys, idx))
    joined = _spread_back(rows, keys, {"_max": F.max(score)})
    return joined.select(*[F.coalesce("_max", score).alias(name) if c == score else F.col(c) for c in df.columns])


def composite_metrics(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = KEYS, idx: str = "idx"
) -> DataFrame:
    """ROC-AUC, average precision and best F1 after negating scores and lifting true segments."""
    lifted = lift_segments(df.withColumn(score, -F.col(score)), score, label, keys, idx)
    cum = with_class_totals(cumulative_counts(lifted, keys, score, label), keys)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("_p")
    f1 = F.max(2 * precision * recall / (precision + recall + F.lit(EPS))).alias("f1")
    return cum.groupBy(*keys).agg(*_ranking_aggregates(), f1)


def class_guard(metrics: DataFrame, df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """Zero the metrics of series whose labels are all equal, and say so in ``one_class``."""
    seen = df.groupBy(*keys).agg((F.min(label) == F.max(label)).alias("one_class"))
    joined = metrics.join(seen, list(keys)) if keys else metrics.crossJoin(F.broadcast(seen))  # one row
    return joined.withColumns({c: F.when(F.col("one_class"), 0.0).otherwise(F.col(c)) for c in cols})

"""Segment and ranking metrics against sequential loops written from their definitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import anomaly_metrics as am


def cases():
    rng = np.random.default_rng(11)
    out = []
    for n in (1, 2, 5, 30, 60):
        for p in (0.2, 0.6):
            out.append(((rng.random(n) < p).astype(int), np.round(rng.random(n), 1)))
    out.append((np.ones(8, int), rng.random(8)))
    out.append((np.zeros(8, int), rng.random(8)))
    out.append((np.array([1, 1, 1, 0, 0, 1]), np.array([0.1, 0.2, 0.9, 0.1, 0.8, 0.1])))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = [(s, i, int(lab), float(sc), int(sc > 0.6)) for s, (labels, scores) in enumerate(cases()) for i, (lab, sc) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "series_id int, idx long, label int, score double, pred int").cache()


def segments(label):
    out = []
    for i, v in enumerate(label):
        if v:
            if i and label[i - 1]:
                out[-1][1] = i
            else:
                out.append([i, i])
    return out


def adjust_loop(label, pred):
    """Once a segment is hit everything in it counts, position 0 only if hit itself."""
    out, waited, found = pred.copy(), 0, 0
    for s, e in segments(label):
        hits = [i for i in range(s, e + 1) if pred[i]]
        if hits:
            found += 1
            for i in range(s, e + 1):
                if i > 0 and not out[i]:
                    out[i] = 1
                    waited += i < hits[0]
    return out, waited / (found + 1e-5)


def pa_k_loop(label, pred, k):
    out, filled, segs = pred.copy(), 0, segments(label)
    for s, e in segs:
        hits = pred[s : e + 1].sum()
        if hits and 100 * hits >= k * (e - s + 1):
            out[s : e + 1] = 1
            filled += (e - s + 1) - hits
    return out, filled / (len(segs) + 1e-5)


def prf(label, pred):
    tp, tn = (pred * label).sum(), ((1 - pred) * (1 - label)).sum()
    fp, fn = (pred * (1 - label)).sum(), ((1 - pred) * label).sum()
    p, r = tp / (tp + fp + 1e-5), tp / (tp + fn + 1e-5)
    return 2 * p * r / (p + r + 1e-5), p, r, tp, tn, fp, fn


@pytest.mark.parametrize("block", [3, 4096])
def test_point_adjust(data, block):
    got = am.adjust_predictions(data, block=block).toPandas().sort_values(["series_id", "idx"])
    waits = am.adjust_latency(data, block=block).toPandas().set_index("series_id")["latency"]
    for s, (label, score) in enumerate(cases()):
        want, latency = adjust_loop(label, (score > 0.6).astype(int))
        assert got[got.series_id == s]["adjusted"].tolist() == want.tolist()
        if label.any():
            assert waits[s] == pytest.approx(latency)


@pytest.mark.parametrize("k", [0, 30, 50, 100])
def test_pa_k(data, k):
    got = am.adjust_predictions(data, k=k, block=4).toPandas().sort_values(["series_id", "idx"])
    for s, (label, score) in enumerate(cases()):
        want, _ = pa_k_loop(label, (score > 0.6).astype(int), k)
        assert got[got.series_id == s]["adjusted"].tolist() == want.tolist()


def test_grid_equals_a_loop_over_thresholds(data):
    thresholds, ks = am.grid(0.0, 1.0, 7) + [0.3, 0.6], [0, 40, 100]
    got = am.grid_metrics(data, thresholds, ks, block=4).toPandas().set_index(["series_id", "k", "threshold"]).sort_index()
    for s, (label, score) in enumerate(cases()):
        for k in ks:
            for t in thresholds:
                pred, latency = pa_k_loop(label, (score > t).astype(int), k)
                row = got.loc[(s, float(k), t)]
                f1, p, r, tp, tn, fp, fn = prf(label, pred)
                assert (row.tp, row.tn, row.fp, row.fn) == (tp, tn, fp, fn)
                assert row.f1 == pytest.approx(f1) and row.latency == pytest.approx(latency)


def test_first_best_threshold_wins(data):
    thresholds = am.grid(0.0, 1.0, 10)
    got = am.best_threshold(am.grid_metrics(data, thresholds, [20])).toPandas().set_index("series_id")
    for s, (label, score) in enumerate(cases()):
        best, at = -1.0, None
        for t in thresholds:
            f1 = prf(label, pa_k_loop(label, (score > t).astype(int), 20)[0])[0]
            if f1 > best:
                best, at = f1, t
        assert got.loc[s, "f1"] == pytest.approx(best) and got.loc[s, "threshold"] == at


def test_ranking(data):
    got = am.ranking_metrics(data, chunks=3).toPandas().set_index("series_id")
    for s, (label, score) in enumerate(cases()):
        pos, neg = score[label == 1], score[label == 0]
        if not len(pos) or not len(neg):
            assert pd.isna(got.loc[s, "roc_auc"])
            continue
        wins = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
        assert got.loc[s, "roc_auc"] == pytest.approx(wins)
        ap, last = 0.0, 0.0
        for t in sorted(set(score), reverse=True):
            hit = score >= t
            recall = label[hit].sum() / label.sum()
            ap += (recall - last) * label[hit].mean()
            last = recall
        assert got.loc[s, "average_precision"] == pytest.approx(ap)


def test_best_segment_f1(data):
    got = am.best_segment_f1(data).toPandas().set_index("series_id")
    for s, (label, score) in enumerate(cases()):
        items, ends = [], {e: (s0, e) for s0, e in segments(label)}
        for i, v in enumerate(label):
            if not v:
                items.append((score[i], 1, 0))
            elif i in ends:
                s0, e = ends[i]
                items.append((score[s0 : e + 1].min(), e - s0 + 1, e - s0 + 1))
        items.sort(key=lambda t: t[0])
        best, at, taken, tp = -1.0, None, 0, 0
        for sc, size, hit in items:
            taken, tp = taken + size, tp + hit
            p, r = tp / (taken + 1e-5), tp / (label.sum() + 1e-5)
            f1 = 2 * p * r / (p + r + 1e-5)
            if f1 > best:
                best, at = f1, sc
        assert got.loc[s, "f1"] == pytest.approx(best)
        if best > 0:
            assert got.loc[s, "threshold"] == pytest.approx(at)


def test_youden(data):
    got = am.youden_metrics(data).toPandas().set_index("series_id")
    for s, (label, score) in enumerate(cases()):
        if len(set(label)) < 2:
            continue
        best, at = 0.0, None
        for t in sorted(set(score), reverse=True):
            j = (score[label == 1] >= t).mean() - (score[label == 0] >= t).mean()
            if j > best + 1e-12:
                best, at = j, t
        if at is None:
            assert np.isnan(got.loc[s, "threshold"]) and got.loc[s, "recall"] == 0 and got.loc[s, "roc_auc"] == 0.5
        else:
            assert got.loc[s, "threshold"] == at
            assert got.loc[s, "f1_micro"] == pytest.approx(((score >= at).astype(int) == label).mean())


def test_recall_falls_with_k(data):
    out = am.grid_metrics(data, [0.5], [0, 50, 100]).toPandas().pivot(index="series_id", columns="k", values="recall")
    assert (out[0.0] >= out[50.0] - 1e-12).all() and (out[50.0] >= out[100.0] - 1e-12).all()


def test_staging_in_a_shared_folder_changes_nothing(data, tmp_path, monkeypatch):
    import tidemark.session as session

    want = am.adjust_predictions(data, k=30).orderBy("series_id", "idx").collect()
    best = am.best_threshold(am.grid_metrics(data, [0.2, 0.5], [0, 50])).orderBy("series_id", "k").collect()
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    assert am.adjust_predictions(data, k=30).orderBy("series_id", "idx").collect() == want
    assert am.best_threshold(am.grid_metrics(data, [0.2, 0.5], [0, 50])).orderBy("series_id", "k").collect() == best
    assert am.composite_metrics(data).count() == len(cases())
    assert len(list(tmp_path.iterdir())) >= 4


def test_one_class_series_give_null_not_an_error(data):
    for frame in (am.composite_metrics(data), am.best_pr_f1(data), am.roc_points(data), am.youden_metrics(data)):
        frame.toPandas()
    guarded = am.class_guard(am.ranking_metrics(data), data, ["roc_auc"]).toPandas().set_index("series_id")
    for s, (label, _) in enumerate(cases()):
        assert guarded.loc[s, "one_class"] == (len(set(label)) == 1)
        assert not guarded.loc[s, "one_class"] or guarded.loc[s, "roc_auc"] == 0


@pytest.mark.parametrize("thresholds", [[0.5], [0.5, 1.5, 3.0]])
def test_nan_is_above_no_threshold(spark, thresholds):
    rows = [(1, 0, 1, 2.0), (1, 1, 1, float("nan")), (1, 2, 1, 4.0), (1, 3, 0, float("nan")), (1, 4, 0, None)]
    df = spark.createDataFrame(rows, "series_id long, idx long, label int, score double")
    got = am.grid_metrics(df, thresholds, [0]).where("threshold = 0.5").first()
    assert (got.tp, got.fn, got.fp, got.tn) == (3, 0, 0, 2)

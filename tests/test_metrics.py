"""Metrics (A12-A17): golden arithmetic from the stored results, brute-force AUC/ROC."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import label as L
from quire.operators import metrics as M

# (TP, FP, FN, TN) -> accuracy, F2, as stored for six runs (FIXTURES.md §3)
GOLDEN = [
    (238, 661, 36, 1319, 0.690772, 0.596491),
    (236, 430, 38, 1550, 0.792369, 0.669694),
    (245, 730, 29, 1250, 0.663265, 0.591502),
    (241, 806, 33, 1174, 0.627773, 0.562296),
    (243, 762, 31, 1218, 0.648181, 0.578296),
    (247, 593, 27, 1387, 0.724933, 0.637913),
]


def _confusion_table(spark, tp, fp, fn, tn, run=0):
    rows = [(run, 1, 1)] * tp + [(run, 0, 1)] * fp + [(run, 1, 0)] * fn + [(run, 0, 0)] * tn
    return rows


def test_golden_confusions(spark):
    rows = []
    for i, (tp, fp, fn, tn, _, _) in enumerate(GOLDEN):
        rows += _confusion_table(spark, tp, fp, fn, tn, i)
    df = spark.createDataFrame(rows, "run int, labels int, predictions int")
    got = {r.run: r for r in M.classification_metrics(df, by=["run"]).collect()}
    for i, (tp, fp, fn, tn, acc, f2) in enumerate(GOLDEN):
        assert got[i].accuracy == pytest.approx(acc, abs=1e-6)
        assert got[i].f_beta_2_0 == pytest.approx(f2, abs=1e-6)
        assert got[i].precision == pytest.approx(tp / (tp + fp))
        assert got[i].recall == pytest.approx(tp / (tp + fn))
        assert got[i].support is None


def test_no_positive_predictions_gives_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "labels int, predictions int")
    r = M.classification_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.f_beta_2_0) == (0.0, 0.0, 0.0, 0.0)
    assert r.accuracy == pytest.approx(1 / 3)


def test_macro_and_micro(spark):
    y = [0, 0, 1, 1, 1, 2]
    p = [0, 1, 1, 1, 0, 2]
    df = spark.createDataFrame(list(zip(y, p)), "labels int, predictions int")
    micro = M.classification_metrics(df, average="micro").first()
    assert micro.f1 == pytest.approx(4 / 6)
    macro = M.classification_metrics(df, average="macro").first()
    per_class_f1 = [0.5, 2 / 3, 1.0]  # class 0: tp 1, fp 1, fn 1; class 1: tp 2, fp 1, fn 1
    assert macro.f1 == pytest.approx(sum(per_class_f1) / 3)


def _brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def _model_roc(labels, scores):
    """Reference ROC construction: distinct thresholds descending, collinear points dropped."""
    order = np.argsort(-np.asarray(scores), kind="mergesort")
    s = np.asarray(scores)[order]
    y = np.asarray(labels)[order]
    last = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[last]
    fps = (1 + last) - tps
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    tps, fps, thr = tps[keep], fps[keep], s[last][keep]
    return np.r_[0, fps] / fps[-1], np.r_[0, tps] / tps[-1], np.r_[thr[0] + 1, thr]


def test_auc_and_roc_against_brute_force(spark):
    rng = random.Random(7)
    labels = [rng.randint(0, 1) for _ in range(400)]
    scores = [round(rng.random() * 0.6 + 0.4 * y, 2) for y in labels]  # many ties
    df = spark.createDataFrame(list(zip(labels, scores)), "labels int, score double")
    assert M.roc_auc(df).first().auc == pytest.approx(_brute_auc(labels, scores), abs=1e-12)
    curve = sorted(M.roc_curve(df).collect(), key=lambda r: r.idx)
    fpr, tpr, thr = _model_roc(labels, scores)
    assert [r.fpr for r in curve] == pytest.approx(list(fpr))
    assert [r.tpr for r in curve] == pytest.approx(list(tpr))
    assert [r.threshold for r in curve] == pytest.approx(list(thr))
    assert len(curve) <= len(set(scores)) + 1


def test_cv_summary_and_unknown_metric(spark):
    folds = spark.createDataFrame([(0, 0.8, 0.5, 0.6, 0.4, 0.45, 0.55), (1, 0.6, 0.7, 0.6, 0.8, 0.75, 0.65)],
                                  "fold int, accuracy double, f1 double, precision double, recall double, "
                                  "f_beta_2_0 double, f_beta_0_5 double")
    out = {r.metric: r for r in M.cv_summary(folds, "f1").collect()}
    assert out["accuracy"].mean == pytest.approx(0.7)
    assert out["accuracy"].std == pytest.approx(np.std([0.8, 0.6], ddof=1))
    assert out["f1"].selected and not out["recall"].selected
    with pytest.raises(ValueError):
        M.cv_summary(folds, "auc")


def test_ensemble_summary_golden(spark):
    df = spark.createDataFrame([("m", .8047914818101154), ("m", .8025732031943212), ("m", .7950310559006211)],
                               "model string, acc double")
    r = M.ensemble_summary(df, ["model"], ["acc"]).first()
    assert r.acc_mean == pytest.approx(0.8007985803016859, abs=1e-12)
    assert r.acc_std == pytest.approx(0.005116487397813184, abs=1e-12)


def test_weighted_cross_entropy(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, 0.4)], "labels int, p double")
    w = L.balanced_class_weights(df, "labels").select("labels", "weight")
    got = M.weighted_cross_entropy(df, "labels", "p", w).first().loss
    wpos, wneg = 3 / (2 * 1), 3 / (2 * 2)
    expect = (wpos * -np.log(0.9) + wneg * -np.log(0.8) + wneg * -np.log(0.6)) / (wpos + 2 * wneg)
    assert got == pytest.approx(expect)


def test_positive_probability(spark):
    df = spark.createDataFrame([("relevant", 0.8), ("irrelevant", 0.7)], "l string, s double")
    out = [r.p for r in df.select(M.positive_probability(F.col("l"), F.col("s"), "relevant").alias("p")).collect()]
    assert out == pytest.approx([0.8, 0.3])


def test_rank_labels_and_ties(spark):
    df = spark.createDataFrame([([("a", 0.2), ("b", 0.5), ("c", 0.3)],), ([("x", 0.5), ("y", 0.5)],)],
                               "p array<struct<label:string,score:double>>")
    rows = df.select(M.rank_labels("p", 2).alias("r"), M.top_label("p").alias("t")).collect()
    assert [x.label for x in rows[0].r] == ["b", "c"] and rows[0].t.label == "b"
    assert rows[1].t.label == "y"  # tie: the last of a stable ascending sort

"""Classification metrics as distributed aggregates.

Confusion counts come from one ``groupBy(label, prediction).count()`` (map-
side partial aggregation, a handful of output rows), and every metric is
arithmetic on those counts. ROC/AUC aggregate to distinct scores first; the
cumulative sums over scores run per range of the distinct scores (plus an
offset), so no running window spans more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sampling import with_class_value

METRIC_NAMES = ("accuracy", "f1", "precision", "recall", "f_beta_2_0", "f_beta_0_5")


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _fbeta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b2 = beta * beta
    return _safe_div((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)


def confusion(df: DataFrame, label: str = "labels", pred: str = "predictions", by=()) -> DataFrame:
    """(by..., label, prediction, n)."""
    return df.groupBy(*by, F.col(label).alias("_y"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_cnt"))


def classification_metrics(df: DataFrame, label: str = "labels", pred: str = "predictions",
                           average: str = "binary", pos_label: int = 1, by=()) -> DataFrame:
    """Accuracy, f1, precision, recall, F2, F0.5 and support (null when averaged).

    binary scores `pos_label`; macro averages the per-class scores; micro uses
    global counts. Zero denominators give 0.
    """
    by = list(by)
    c = confusion(df, label, pred, by)
    total = F.sum("_cnt")
    correct = F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_cnt")).otherwise(0))
    if average == "binary":
        tp = F.sum(F.when((F.col("_y") == pos_label) & (F.col("_p") == pos_label), F.col("_cnt")).otherwise(0))
        fp = F.sum(F.when((F.col("_y") != pos_label) & (F.col("_p") == pos_label), F.col("_cnt")).otherwise(0))
        fn = F.sum(F.when((F.col("_y") == pos_label) & (F.col("_p") != pos_label), F.col("_cnt")).otherwise(0))
        agg = c.groupBy(*by).agg(total.alias("_n"), correct.alias("_ok"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
        return agg.select(
            *by,
            _safe_div(F.col("_ok"), F.col("_n")).alias("accuracy"),
            _fbeta(F.col("tp"), F.col("fp"), F.col("fn"), 1.0).alias("f1"),
            _safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
            _safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
            F.lit(None).cast("bigint").alias("support"),
            _fbeta(F.col("tp"), F.col("fp"), F.col("fn"), 2.0).alias("f_beta_2_0"),
            _fbeta(F.col("tp"), F.col("fp"), F.col("fn"), 0.5).alias("f_beta_0_5"),
        )
    # per-class counts: a class appears as truth or as prediction
    truth = c.groupBy(*by, F.col("_y").alias("_c")).agg(F.sum("_cnt").alias("_t"))
    predicted = c.groupBy(*by, F.col("_p").alias("_c")).agg(F.sum("_cnt").alias("_q"))
    hit = c.where(F.col("_y") == F.col("_p")).groupBy(*by, F.col("_y").alias("_c")).agg(F.sum("_cnt").alias("_tp"))
    per = (truth.join(predicted, by + ["_c"], "full").join(hit, by + ["_c"], "left")
           .na.fill(0, ["_t", "_q", "_tp"])
           .select(*by, "_c", F.col("_tp").alias("tp"), (F.col("_q") - F.col("_tp")).alias("fp"),
                   (F.col("_t") - F.col("_tp")).alias("fn"), F.col("_t")))
    acc = c.groupBy(*by).agg(_safe_div(correct, total).alias("accuracy"))
    if average == "micro":
        s = per.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        m = s.select(*by,
                     _fbeta(F.col("tp"), F.col("fp"), F.col("fn"), 1.0).alias("f1"),
                     _safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                     _safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                     _fbeta(F.col("tp"), F.col("fp"), F.col("fn"), 2.0).alias("f_beta_2_0"),
                     _fbeta(F.col("tp"), F.col("fp"), F.col("fn"), 0.5).alias("f_beta_0_5"))
    elif average == "macro":
        m = per.groupBy(*by).agg(
            F.avg(_fbeta(F.col("tp"), F.col("fp"), F.col("fn"), 1.0)).alias("f1"),
            F.avg(_safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
            F.avg(_safe_div(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"),
            F.avg(_fbeta(F.col("tp"), F.col("fp"), F.col("fn"), 2.0)).alias("f_beta_2_0"),
            F.avg(_fbeta(F.col("tp"), F.col("fp"), F.col("fn"), 0.5)).alias("f_beta_0_5"))
    else:
        raise ValueError(f"unsupported average {average!r}")
    joined = acc.join(m, by) if by else acc.withColumn("_one", F.lit(1)).join(m.withColumn("_one", F.lit(1)), "_one")
    return joined.select(*by, "accuracy", "f1", "precision", "recall",
                         F.lit(None).cast("bigint").alias("support"), "f_beta_2_0", "f_beta_0_5")


def rank_labels(probabilities, k: int | None = None) -> Column:
    """O2: (label, score) structs by descending score, first `k` kept.

    Ties keep the order a stable ascending sort would reverse, so the top
    label of tied scores is the last one listed (as in the original).
    """
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    asc = F.array_sort(p, lambda a, b: F.when(a["score"] < b["score"], -1).when(a["score"] > b["score"], 1)
                       .otherwise(0))
    desc = F.reverse(asc)
    return F.slice(desc, 1, k) if k else desc


def top_label(probabilities) -> Column:
    """O2: the arg-max (label, score) struct."""
    return F.element_at(rank_labels(probabilities, 1), 1)


def positive_probability(top_label: Column, top_score: Column, positive_label) -> Column:
    """M3: score of the positive label from the top (label, score)."""
    return F.when(top_label == F.lit(positive_label), top_score).otherwise(F.lit(1.0) - top_score)


def score_points(df: DataFrame, label: str = "labels", score: str = "score", by=()) -> DataFrame:
    """Distinct scores, descending, with per-score and cumulative counts.

    Columns: by..., idx (0-based, descending score), score, pos, neg, tps, fps,
    P, N, next_pos, next_neg (counts at the next lower score, null at the
    end), last_idx, max_score.

    The distinct scores are dealt to ranges of about the same size and stored
    with their range; sums run inside a range plus the offset of the ranges
    before it. The successor of a range's last score is the first score of the
    next range, carried over on the small per-range table. Ranges only decide
    *where* the work happens, the result is exact.
    """
    by = list(by)
    pts = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = pts.repartitionByRange(parts, *by, F.desc("score")).withColumn("_b", F.spark_partition_id())
    pts = cut_lineage(ranged, "roc-points")
    first = F.max_by(F.struct("pos", "neg"), "score")
    hist = pts.groupBy(*by, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"),
                                      F.count(F.lit(1)).alias("_bc"), first.alias("_first"),
                                      F.max("score").alias("_bmax"))
    order = Window.partitionBy(*by).orderBy("_b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offs = hist.select(*by, "_b",
                       F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_op"),
                       F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_on"),
                       F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_oc"),
                       F.lead("_first").over(order).alias("_nf"),
                       F.sum("_bp").over(whole).alias("P"), F.sum("_bn").over(whole).alias("N"),
                       (F.sum("_bc").over(whole) - 1).alias("last_idx"), F.max("_bmax").over(whole).alias("max_score"))
    inb = Window.partitionBy(*by, "_b").orderBy(F.desc("score"))
    run = inb.rowsBetween(Window.unboundedPreceding, 0)
    local = pts.select(*by, "_b", "score", "pos", "neg",
                       F.sum("pos").over(run).alias("_cp"), F.sum("neg").over(run).alias("_cn"),
                       F.row_number().over(inb).alias("_r"),
                       F.lead("pos").over(inb).alias("_lp"), F.lead("neg").over(inb).alias("_ln"))
    # one row per (group, range): small, broadcast by AQE
    return (local.join(offs, by + ["_b"])
            .select(*by, (F.col("_oc") + F.col("_r") - 1).alias("idx"), "score", "pos", "neg",
                    (F.col("_op") + F.col("_cp")).alias("tps"), (F.col("_on") + F.col("_cn")).alias("fps"),
                    "P", "N",
                    F.coalesce(F.col("_lp"), F.col("_nf.pos")).alias("next_pos"),
                    F.coalesce(F.col("_ln"), F.col("_nf.neg")).alias("next_neg"),
                    "last_idx", "max_score"))


def roc_curve(df: DataFrame, label: str = "labels", score: str = "score", by=()) -> DataFrame:
    """ROC points as rows (by..., idx, threshold, fpr, tpr).

    The origin (0, 0) has idx -1 and threshold max+1; collinear intermediate
    points are dropped (a point stays when the step to the next distinct
    score differs from the step into it); FPR/TPR are cumulative counts over
    N and P. Rows keep `idx`, their position among the distinct scores, so
    the kept points are ordered without a window over the whole curve.
    """
    by = list(by)
    return curve_of(score_points(df, label, score, by), by)


def curve_of(pts: DataFrame, by=()) -> DataFrame:
    """A13 from ``score_points``."""
    by = list(by)
    keep = (F.col("idx") == 0) | (F.col("idx") == F.col("last_idx")) | \
        (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    point = F.struct(F.col("idx"), F.col("score").alias("threshold"), _safe_div(F.col("fps"), F.col("N")).alias("fpr"),
                     _safe_div(F.col("tps"), F.col("P")).alias("tpr"))
    origin = F.struct(F.lit(-1).cast("bigint").alias("idx"), (F.col("max_score") + 1).alias("threshold"),
                      F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = F.when(F.col("idx") == 0, F.array(origin, point)).otherwise(F.array(point))
    return pts.where(keep).select(*by, F.explode(points).alias("p")).select(*by, "p.*")


def roc_auc(df: DataFrame, label: str = "labels", score: str = "score", by=()) -> DataFrame:
    """Exact area under the ROC curve (ties count half).

    Trapezoids per distinct score: neg_i * (tps_i - pos_i / 2) / (N * P).
    """
    by = list(by)
    return auc_of(score_points(df, label, score, by), by)


def auc_of(pts: DataFrame, by=()) -> DataFrame:
    """A14 from ``score_points``."""
    return pts.groupBy(*by).agg(
        _safe_div(F.sum(F.col("neg") * (F.col("tps") - F.col("pos") / 2.0)), F.max(F.col("N") * F.col("P"))).alias("auc"))


def cv_summary(fold_metrics: DataFrame, metric: str = "f1") -> DataFrame:
    """Mean and sample std of the supported metrics over folds (long format).

    Raises ValueError for an unsupported metric name; the chosen metric is
    flagged in the `selected` column.
    """
    if metric not in METRIC_NAMES:
        raise ValueError(f"no such metric to average: {metric}")
    long = fold_metrics.unpivot([c for c in fold_metrics.columns if c not in METRIC_NAMES], list(METRIC_NAMES),
                                "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")) \
        .withColumn("selected", F.col("metric") == F.lit(metric))


def weighted_cross_entropy(df: DataFrame, label: str, prob_pos: str, weights: DataFrame) -> DataFrame:
    """sum_i w_{y_i} * -ln p(y_i) / sum_i w_{y_i} (binary, p from prob_pos).

    `weights` is (label, weight), e.g. from ``balanced_class_weights``; it has
    one row per class, and its weights reach the rows without a shuffle.
    """
    p_true = F.when(F.col(label) == 1, F.col(prob_pos)).otherwise(F.lit(1.0) - F.col(prob_pos))
    j = with_class_value(df, label, weights.select(F.col(weights.columns[0]).alias(label), "weight"), "weight")
    return j.agg((F.sum(F.col("weight") * -F.log(p_true)) / F.sum("weight")).alias("loss"))


def ensemble_summary(df: DataFrame, group_cols, metric_cols) -> DataFrame:
    """Mean and sample std of each metric over the members of a group."""
    aggs = []
    for m in metric_cols:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*group_cols).agg(*aggs)

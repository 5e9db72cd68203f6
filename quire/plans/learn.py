"""Train, score and evaluate a binary text classifier (M1-M8), re-aimed on Spark.

The original fine-tunes pretrained transformers on one GPU; here the same
contract -- class-weighted cross-entropy on (text, labels), an evaluation on dev
after each epoch with the best one kept, predictions with per-label probabilities,
metrics on dev/test, k-fold CV, config sweeps -- is met by the linear classifiers
of ``linear``: words are hashed once in the JVM, each training pass sums the
gradients of all models at once on the executors, scoring is one pass for all
models, and every metric stays a Spark aggregate.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.sampling import stratified_kfold
from ..session import cut_lineage
from ..sources.io import LOG_ENTRY, write_curve, write_metrics, write_predictions
from . import linear
from .linear import LinearModel, Spec

# ---- FIXED VALUES: label names of the binary task ----
LABEL_NAMES = {0: "irrelevant", 1: "relevant"}


def train_classifier(df: DataFrame, text: str = "text", label: str = "labels", **config) -> LinearModel:
    """M1: fit the class-weighted model (A4) on rows with text and label."""
    spec = Spec(**config)
    rows = linear.training_rows(df, text, label, F.lit(1), size=spec.num_features)
    training = linear.fit_many(rows, [spec])
    if training.fits[0].error:
        raise ValueError(training.fits[0].error)
    return training.fits[0].model(training.vocabulary)


# ---- M1 by epochs ----

#: The fields of an epoch's log entry beside epoch and step.
_LOGGED = ("loss", "eval_accuracy", "eval_f1", "eval_precision", "eval_recall", "eval_f_beta_2.0", "eval_f_beta_0.5", "eval_loss")


def _held_out_metrics(found: dict) -> dict:
    """The metrics of one epoch from its confusion counts (A12 on the driver: four numbers)."""
    tp, fp, fn, tn = (found[k] for k in ("tp", "fp", "fn", "tn"))

    def share(a, b):
        return a / b if b else 0.0

    def f_beta(beta):
        return share((1 + beta**2) * tp, (1 + beta**2) * tp + beta**2 * fn + fp)

    return {"eval_accuracy": share(tp + tn, tp + fp + fn + tn), "eval_f1": f_beta(1), "eval_precision": share(tp, tp + fp),
            "eval_recall": share(tp, tp + fn), "eval_f_beta_2.0": f_beta(2), "eval_f_beta_0.5": f_beta(0.5),
            "eval_loss": found["loss"]}


class EpochRun:
    """A training run in the shared folder `path`: the state and the metrics of every finished epoch.

    An epoch is one accepted step of the optimiser over all training rows. It is committed
    as one Parquet file below ``epochs``; a run that is started again goes on from the last
    one, and loses the epoch that was under way. ``logs`` holds the run's log as
    ``sources.io.read_run_logs`` reads it (training type "finetuning").
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def epochs(self) -> DataFrame | None:
        try:
            found = self.spark.read.parquet(f"{self.path}/epochs/*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return found

    def commit(self, fit: linear.Fit, found: dict) -> None:
        s, y = fit.pairs[-1] if fit.pairs else (np.zeros(0), np.zeros(0))
        row = {"epoch": fit.epoch, "loss": float(fit.loss), "first": float(fit.first), "at": fit.at.tolist(),
               "gradient": fit.gradient.tolist(), "s": s.tolist(), "y": y.tolist(), **_held_out_metrics(found)}
        schema = "epoch int, loss double, first double, at array<double>, gradient array<double>, s array<double>, y array<double>, "
        schema += ", ".join(f"`{c}` double" for c in _LOGGED[1:])
        # one file: it is there as a whole or not at all
        (self.spark.createDataFrame([tuple(row.values())], schema).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/epochs/epoch-{fit.epoch:05d}"))

    def resume(self, fit: linear.Fit) -> None:
        """Put `fit` where the last committed epoch left it."""
        found = self.epochs()
        if found is None:
            return
        last = found.orderBy(F.desc("epoch")).limit(linear.MEMORY).toArrow().to_pylist()  # MEMORY rows
        if not last:
            return
        now = last[0]
        fit.at, fit.gradient = np.array(now["at"]), np.array(now["gradient"])
        fit.loss, fit.first, fit.epoch = now["loss"], now["first"], now["epoch"]
        # an epoch without curvature has repeated the pair before it: each pair once, oldest first
        pairs, seen = [], set()
        for r in reversed(last):
            key = (len(r["s"]), sum(r["s"]), sum(r["y"]))
            if r["s"] and key not in seen:
                seen.add(key)
                pairs.append((np.array(r["s"]), np.array(r["y"])))
        fit.pairs = pairs
        fit._next()

    def write_log(self, steps_per_epoch: int) -> str:
        """The run's log document, over all committed epochs (small: one entry an epoch)."""
        found = self.epochs()
        fields = {"epoch": F.col("epoch").cast("double"), "step": F.col("epoch").cast("bigint") * steps_per_epoch,
                  **{c: F.col(f"`{c}`") for c in _LOGGED}}
        entry = F.struct(*[fields.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in LOG_ENTRY.fields])
        doc = found.agg(F.max(fields["step"]).alias("global_step"), F.avg("loss").alias("average_loss"),
                        F.sort_array(F.collect_list(entry)).alias("log_history"))
        doc.coalesce(1).write.mode("overwrite").json(f"{self.path}/logs")
        return f"{self.path}/logs"

    def best(self, metric: str = "eval_f_beta_2.0") -> dict:
        """The epoch with the best dev metric; ties go to the earliest."""
        found = self.epochs().orderBy(F.desc(F.col(f"`{metric}`")), "epoch").limit(1)
        return found.toArrow().to_pylist()[0]


def train_by_epochs(train: DataFrame, dev: DataFrame, path: str, text: str = "text", label: str = "labels",
                    stop_after: int | None = None, **config) -> LinearModel:
    """M1 with epochs: evaluate on `dev` after each, keep the best by dev F2, go on from `path` if it has some.

    Both tables are one table of stored word counts; an epoch is one pass over it (more
    where a step is halved) that sums the training gradient and the dev confusion counts
    together. `stop_after` ends this call after so many epochs of its own.
    """
    spec = Spec(**config)
    both = train.select(text, label, F.lit(1).alias("_t")).unionByName(dev.select(text, label, F.lit(0).alias("_t")))
    rows = linear.training_rows(both, text, label, F.col("_t"), 1 - F.col("_t"), spec.num_features)
    training = linear.Training.begin(rows, [spec])
    fit, run = training.fits[0], EpochRun(train.sparkSession, path)
    if fit.error:
        raise ValueError(fit.error)
    run.resume(fit)
    began = fit.epoch
    while not fit.done and (stop_after is None or fit.epoch - began < stop_after):
        for found in training.run_pass().values():
            run.commit(fit, found)
    if run.epochs() is None:
        return fit.model(training.vocabulary)
    run.write_log(int(training.total[0]))
    best = run.best()
    model = fit.model(training.vocabulary, np.array(best["at"]))
    return dataclasses.replace(model, iterations=best["epoch"], loss=best["loss"])


def training_summary(model: LinearModel, spark) -> DataFrame:
    """One row about a fitted model: feature count, L-BFGS iterations, last loss."""
    return spark.createDataFrame([(model.size, model.iterations, model.loss)],
                                 "num_features int, iterations int, final_loss double")


def with_probabilities(scored: DataFrame, p, keep, names: dict) -> DataFrame:
    """The prediction columns of M2 from P(label 1) in column `p`; all null where it is."""
    name_map = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(int(k)), F.lit(v))])
    ids = F.array(F.lit(0), F.lit(1))
    both = F.array(1 - p, p)
    chosen = F.when(p > 0.5, 1).when(p.isNotNull(), 0)
    listed = F.transform(ids, lambda i: F.struct(F.element_at(name_map, i).alias("label"), F.element_at(both, i + 1).alias("score")))
    return scored.select(*keep, chosen.alias("prediction_id"), F.element_at(name_map, chosen).alias("prediction"),
                         F.when(p.isNotNull(), listed).alias("probabilities"),
                         F.when(p.isNotNull(), F.map_from_arrays(ids, both)).alias("probabilities_by_id"))


def predict(df: DataFrame, model: LinearModel, label_names=None, keep=None, text: str = "text") -> DataFrame:
    """M2: prediction id and name, probabilities by id and as (label, score) list."""
    keep = list(keep if keep is not None else df.columns)
    made = df.select(*keep, linear.features(text, model.size).alias("f"))
    scored = linear.score(made, [model], keep)
    return with_probabilities(scored, F.get("p", F.lit(0)), keep, label_names or LABEL_NAMES)


def positive_score(pred: DataFrame, positive_label: str = "relevant") -> DataFrame:
    """M3 on predictions: positive-class probability from the top (label, score)."""
    top = F.element_at(F.array_sort(F.col("probabilities"), lambda a, b: F.when(a["score"] < b["score"], -1)
                                    .when(a["score"] > b["score"], 1).otherwise(0)), -1)
    return pred.withColumn("probabilities_for_positive_label",
                           M.positive_probability(top["label"], top["score"], positive_label))


def evaluate(df: DataFrame, model: LinearModel, label: str = "labels", by=(), out_dir: str | None = None) -> DataFrame:
    """M4: predict -> S12 -> A12, A13 and A14 -> (S13). One row per `by` group.

    Documents are scored once: the predictions are stored and all metrics read
    that table; the ROC points are computed once for the AUC and the curve. With
    `out_dir` the metrics and the ROC curve (FPR, TPR, thresholds) are written
    beside them, as ``read_split_metrics`` reads them.
    """
    pred = positive_score(predict(df, model, keep=list(dict.fromkeys(["doc_id", label, *by]))))
    scored = pred.select(*by, F.col(label).alias("labels"), F.col("prediction_id").alias("predictions"),
                         "probabilities_for_positive_label", "doc_id")
    if out_dir:
        scored = scored.sparkSession.read.parquet(write_predictions(scored, f"{out_dir}/predictions"))
    else:
        scored = cut_lineage(scored, "predictions")
    return metrics_of(scored, by, out_dir)


def metrics_of(scored: DataFrame, by=(), out_dir: str | None = None) -> DataFrame:
    """A12 and A14 of stored predictions, per `by` group; with `out_dir` S13 and the curve (A13) too."""
    by = list(by)
    metrics = M.classification_metrics(scored, "labels", "predictions", "binary", by=by)
    points = M.score_points(scored, "labels", "probabilities_for_positive_label", by=by)
    if out_dir:
        points = cut_lineage(points, "roc-evaluation")
    auc = M.auc_of(points, by).withColumnRenamed("auc", "AUC")
    res = metrics.join(auc, by) if by else metrics.withColumn("_o", F.lit(1)).join(
        auc.withColumn("_o", F.lit(1)), "_o").drop("_o")
    if out_dir:
        write_metrics(res, f"{out_dir}/metrics")
        write_curve(M.curve_of(points, by), auc, f"{out_dir}/curve", by)
    return res


def report(splits: DataFrame, model: LinearModel, label: str = "labels") -> DataFrame:
    """M5: evaluate dev and test; the reported row is dev when dev has rows, else test."""
    per = evaluate(splits.where(F.col("split").isin("dev", "test")), model, label, by=["split"])
    has_dev = per.agg(F.max(F.when(F.col("split") == "dev", 1).otherwise(0)).alias("_has_dev"))
    chosen = per.withColumn("_o", F.lit(1)).join(has_dev.withColumn("_o", F.lit(1)), "_o").drop("_o")
    return chosen.withColumn("reported", F.when(F.col("_has_dev") == 1, F.col("split") == "dev")
                             .otherwise(F.col("split") == "test")).drop("_has_dev")


def final_score(report_df: DataFrame, metric: str = "f_beta_2_0") -> DataFrame:
    """M8: the configured metric of the reported split."""
    return report_df.where("reported").select("split", F.col(metric).alias("score"))


def fold_predictions(df: DataFrame, k: int = 10, text: str = "text", label: str = "labels", **config) -> DataFrame:
    """M6, first half: stratified folds (O10), k models trained together, each row scored by its fold's model.

    Row words are made once; a row trains the k - 1 models of the other folds, in one scan
    per step for all of them. Returns stored predictions with `fold`.
    """
    folded = stratified_kfold(df, "doc_id", label, k)
    every = F.lit((1 << k) - 1)
    mine = F.expr("shiftleft(bigint(1), int(fold))")
    spec = Spec(**config)
    rows = linear.training_rows(folded, text, label, every.bitwiseAND(F.bitwise_not(mine)), mine, spec.num_features,
                                keep=["doc_id", "fold"], name="fold-rows")
    training = linear.fit_many(rows, [spec] * k)
    failed = [f.error for f in training.fits if f.error]
    if failed:
        raise ValueError(failed[0])
    models = [f.model(training.vocabulary) for f in training.fits]
    scored = linear.score(rows.withColumn("fold", F.col("fold").cast("int")), models, ["doc_id", "fold", "label"], "fold",
                          [{i} for i in range(k)])
    p = F.get("p", F.col("fold"))
    return cut_lineage(scored.select("doc_id", "fold", F.col("label").alias("labels"), (p > 0.5).cast("int").alias("predictions"),
                                     p.alias("probabilities_for_positive_label")), "fold-predictions")


def cross_validate(df: DataFrame, k: int = 10, text: str = "text", label: str = "labels", metric: str = "f1",
                   **config) -> DataFrame:
    """M6: per fold fit on the others and evaluate on it; then A15."""
    per_fold = M.classification_metrics(fold_predictions(df, k, text, label, **config), "labels", "predictions", "binary", by=["fold"])
    return M.cv_summary(per_fold.drop("support"), metric)


def sweep(train: DataFrame, evaluation: DataFrame, configs, text: str = "text", label: str = "labels") -> DataFrame:
    """M7: one model per config; a failing config does not stop the others.

    Configs with the same number of features train together, over the same stored words,
    and score `evaluation` in one pass.
    """
    spark = train.sparkSession
    rows, specs = {}, {}
    for i, cfg in enumerate(configs):
        try:
            specs[i] = Spec(**cfg)
        except (TypeError, ValueError) as e:
            rows[i] = (i, str(cfg), "failed", f"{type(e).__name__}: {e}", None, None, None)
    for size in sorted({s.num_features for s in specs.values()}):
        mine = [i for i, s in specs.items() if s.num_features == size]
        stored = linear.training_rows(train, text, label, F.lit((1 << len(mine)) - 1), size=size, name="sweep-rows")
        training = linear.fit_many(stored, [specs[i] for i in mine])
        for i, fit in zip(mine, training.fits):
            if fit.error:
                rows[i] = (i, str(configs[i]), "failed", fit.error, None, None, None)
        good = [(i, fit.model(training.vocabulary)) for i, fit in zip(mine, training.fits) if not fit.error]
        if not good:
            continue
        made = evaluation.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(
            F.col(label).cast("int").alias("labels"), linear.features(text, size).alias("f"))
        run = F.array(*[F.lit(i) for i, _ in good])
        scored = linear.score(made, [m for _, m in good], ["labels"]).select(
            "labels", F.explode(F.arrays_zip(run.alias("run"), F.col("p").alias("p"))).alias("x"))
        scored = cut_lineage(scored.select("labels", "x.run", (F.col("x.p") > 0.5).cast("int").alias("predictions"),
                                           F.col("x.p").alias("probabilities_for_positive_label")), "sweep-predictions")
        for r in metrics_of(scored, ["run"]).collect():  # a row per config
            rows[r["run"]] = (r["run"], str(configs[r["run"]]), "ok", None, r["f1"], r["f_beta_2_0"], r["AUC"])
        for i, _ in good:
            rows.setdefault(i, (i, str(configs[i]), "failed", "ValueError: no rows to evaluate", None, None, None))
    return spark.createDataFrame(
        [rows[i] for i in sorted(rows)], "run int, config string, status string, error string, f1 double, f_beta_2_0 double, AUC double")

"""Training-run logs and their comparison.

Run logs are long rows (run, method, model, content, step, epoch, metric,
value). In the test data they are derived from ``events``: each user is one
JSON logs are read by ``quire.sources.io.read_run_logs`` into the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relate import logical_run_name
from ..operators.reshape import CONTENTS, METHODS, MODELS, method_comparison, metric_grid, quoted
from ..sources.io import CURVE_CHUNK, LOG_ENTRY, RUN_LOG, SPLIT_METRICS, read_run_logs, read_split_metrics, with_field
from ..sources.tables import table

# ---- FIXED VALUES: mapping of event types onto logged metrics ----
EVENT_METRIC = {
    "view": "eval_accuracy",
    "click": "eval_f1",
    "purchase": "eval_precision",
    "signup": "eval_recall",
    "error": "eval_loss",
}
# ---- FIXED VALUES: the eight metrics of a run table and their titles ----
RUN_METRICS = {
    "auc-dev": "Development AUC",
    "auc-test": "Test AUC",
    "eval_f1": "Development F1",
    "eval_f_beta_2.0": "Development F2",
    "test_f_beta_2.0": "Test F2",
    "test_f1": "Test F1",
    "test_precision": "Test Precision",
    "test_recall": "Test Recall",
}
# which of them an event is in the test data, for even and odd event ids
EVENT_RUN_METRIC = {
    "view": ("eval_f1", "test_f1"),
    "click": ("eval_f_beta_2.0", "test_f_beta_2.0"),
    "purchase": ("auc-dev", "auc-test"),
    "signup": ("test_precision", "test_precision"),
    "error": ("test_recall", "test_recall"),
}
LOG_METRICS = ("eval_accuracy", "eval_f1", "eval_loss", "eval_precision", "eval_recall")
EPOCHS = 5


def _event_rows(spark, sf_dir: str, metric, value) -> DataFrame:
    """Events as log rows with the given metric and value, in one scan."""
    ev = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"])
    pick = lambda values, idx: F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))
    uid = F.col("user_id")
    return ev.select(
        uid.alias("run_id"),
        F.concat(F.lpad((uid % 100).cast("string"), 2, "0"), F.lit("__"), F.lower(pick(MODELS, uid % 6))).alias("run_name"),
        pick(METHODS, uid % 7).alias("method"),
        pick(MODELS, uid % 6).alias("model"),
        pick(CONTENTS, uid % 8).alias("content"),
        F.col("event_id").alias("step"),
        ((F.col("event_id") % EPOCHS) + 1).cast("int").alias("epoch"),
        metric.alias("metric"),
        value.alias("value"),
    )


def run_log(spark, sf_dir: str) -> DataFrame:
    metric = F.lit(None).cast("string")
    for et, m in reversed(list(EVENT_METRIC.items())):
        metric = F.when(F.col("event_type") == et, F.lit(m)).otherwise(metric)
    return _event_rows(spark, sf_dir, metric, F.col("value") / (F.col("value") + F.lit(50.0)))


def run_metrics(spark, sf_dir: str) -> DataFrame:
    """The log rows of the eight run metrics (same columns as ``run_log``)."""
    odd = F.col("event_id") % 2 == 1
    metric = F.lit(None).cast("string")
    for kind, (a, b) in EVENT_RUN_METRIC.items():
        metric = F.when(F.col("event_type") == kind, F.when(odd, F.lit(b)).otherwise(F.lit(a))).otherwise(metric)
    return _event_rows(spark, sf_dir, metric, F.col("value") / (F.col("value") + 5.0))


def log_of_runs(spark, runs: dict) -> DataFrame:
    """Log rows of stored training runs: (method, model, content) -> the folder of its log."""
    out = None
    fields = [f.name for f in LOG_ENTRY.fields if f.name not in ("epoch", "step")]
    for i, ((method, model, content), path) in enumerate(sorted(runs.items())):
        log = read_run_logs(spark, path)
        rows = log.select("epoch", "step", *[quoted(f) for f in fields]).unpivot(
            ["epoch", "step"], [quoted(f) for f in fields], "metric", "value").where("value is not null")
        rows = rows.select(F.lit(i).cast("bigint").alias("run_id"), F.lit(f"{i:02d}__{model}").alias("run_name"),
                           F.lit(method).alias("method"), F.lit(model).alias("model"), F.lit(content).alias("content"),
                           "step", F.col("epoch").cast("int").alias("epoch"), "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def best_and_latest_step(log: DataFrame, metric: str = "eval_f1", greater_is_better: bool = True) -> DataFrame:
    """Per run the latest step and the step with the best `metric`
    (ties go to the later step)."""
    v = F.col("value") if greater_is_better else -F.col("value")
    best = F.max(F.when(F.col("metric") == metric, F.struct(v.alias("v"), F.col("step").alias("s"))))
    return log.groupBy("run_id").agg(F.max("step").alias("latest_step"), best["s"].alias("best_step"))


def metric_evolution(log: DataFrame, metrics=None) -> DataFrame:
    """(run, metric, epoch, step, value) in order, where a metric is present (0.0 counts).

    All metrics, losses included, unless `metrics` names some.
    """
    rows = log.where(F.col("metric").isNotNull() & F.col("value").isNotNull())
    if metrics is not None:
        rows = rows.where(F.col("metric").isin(*metrics))
    return rows.select("run_id", "metric", "epoch", "step", "value").orderBy("run_id", "metric", "step")


def optimal_epochs(log: DataFrame, metric: str = "eval_f1") -> DataFrame:
    """The epoch table: per (method, model, content) the epoch with the best
    mean `metric` (ties -> earliest epoch)."""
    per = (log.where(F.col("metric") == metric)
           .groupBy("method", "model", "content", "epoch").agg(F.avg("value").alias("_m")))
    best = F.max(F.struct(F.col("_m"), (-F.col("epoch")).alias("_ne")))
    return per.groupBy("method", "model", "content").agg((-best["_ne"]).alias("epoch"))


def value_at_epoch(log: DataFrame, epochs: DataFrame) -> DataFrame:
    """Per cell and metric, the first logged value (lowest step) at the chosen epoch."""
    j = log.where(F.col("value").isNotNull()).join(epochs, ["method", "model", "content", "epoch"])
    first = F.min(F.struct(F.col("step"), F.col("value")))
    return (j.groupBy("method", "model", "content", "metric")
            .agg(first["value"].alias("value")))


def assemble_runs(values: DataFrame, metrics=tuple(RUN_METRICS)) -> DataFrame:
    """One row per (method, model, content) with one column per metric."""
    return values.groupBy("method", "model", "content").pivot("metric", list(metrics)).agg(F.first("value"))


#: What a run must reach, and the two follow-ups (which it must exceed).
DEV_F2 = {"Development F2": 0.79}
FOLLOW_UPS = ({"Development AUC": 0.8, "Development F2": 0.8}, {"Development AUC": 0.79, "Development F2": 0.79})


def select_runs(runs: DataFrame, minimums: dict | None = None, strict: bool = False) -> DataFrame:
    """keep runs clearing every threshold (column -> minimum; development F2 by default).

    `strict` uses '>', as the follow-up selections do, instead of '>='.
    """
    cond = F.lit(True)
    for col, v in (minimums or DEV_F2).items():
        c = quoted(col)
        cond = cond & ((c > F.lit(v)) if strict else (c >= F.lit(v)))
    return runs.where(cond)


def complete_table(values: DataFrame) -> DataFrame:
    """One row per (method, content, model) with the eight metrics under their titles."""
    return assemble_runs(values).select(
        F.col("model").alias("Model"), F.col("method").alias("Training Method"), F.col("content").alias("Content Source"),
        *[quoted(m).alias(title) for m, title in RUN_METRICS.items()])


def write_run_files(log: DataFrame, path: str) -> tuple[str, str]:
    """The log as files: development metrics as run logs (S9), test metrics and AUCs as metric documents."""
    run = ["run_id", "run_name", "method", "model", "content"]
    dev = log.where(F.col("metric").isin("eval_f1", "eval_f_beta_2.0"))
    entry = F.struct(F.col("epoch").cast("double").alias("epoch"), "step",
                     *[F.when(F.col("metric") == m, F.col("value")).alias(m) for m in ("eval_f1", "eval_f_beta_2.0")])
    parts = dev.groupBy(*run, F.floor(F.col("step") / CURVE_CHUNK).alias("_chunk")).agg(
        F.max("step").alias("global_step"), F.sort_array(F.collect_list(entry)).alias("log_history"))
    parts.drop("_chunk").write.mode("overwrite").json(f"{path}/logs")
    field = {"test_f1": "f1", "test_f_beta_2.0": "f_beta_2.0", "test_precision": "precision", "test_recall": "recall",
             "auc-test": "AUC", "auc-dev": "AUC"}
    rest = log.where(F.col("metric").isin(*field)).withColumn(
        "split", F.when(F.col("metric") == "auc-dev", "dev").otherwise("test"))
    docs = rest.select(*run, "epoch", "step", "split", *[
        F.coalesce(*[F.when(F.col("metric") == m, F.col("value")) for m, g in field.items() if g == f]).alias(f)
        for f in dict.fromkeys(field.values())])
    docs.write.mode("overwrite").json(f"{path}/metrics")
    return f"{path}/logs", f"{path}/metrics"


def read_run_files(spark, logs: str, metrics: str) -> DataFrame:
    """What ``write_run_files`` wrote, as log rows again."""
    run = {"run_id": "bigint", "run_name": "string", "method": "string", "model": "string", "content": "string"}
    schema, other = RUN_LOG, SPLIT_METRICS
    for name, kind in run.items():
        schema, other = with_field(schema, name, kind), with_field(other, name, kind)
    for name, kind in (("epoch", "int"), ("step", "bigint"), ("split", "string")):
        other = with_field(other, name, kind)
    keep = [*run, "step", "epoch"]
    dev = read_run_logs(spark, logs, multi_line=False, schema=schema).withColumn("epoch", F.col("epoch").cast("int"))
    dev = dev.unpivot(keep, [quoted(c) for c in ("eval_f1", "eval_f_beta_2.0")], "metric", "value")
    test = read_split_metrics(spark, metrics, multi_line=False, schema=other, curve=False)
    test = test.unpivot([*keep, "split"], [quoted(c) for c in ("f1", "f_beta_2.0", "precision", "recall", "AUC")], "field", "value")
    name = F.when(F.col("field") == "AUC", F.concat(F.lit("auc-"), "split")).otherwise(F.concat(F.lit("test_"), "field"))
    test = test.select(*keep, name.alias("metric"), "value")
    return dev.unionByName(test).where("value is not null")


def compare_runs(log: DataFrame, names: DataFrame, metric: str = "eval_f1") -> dict[str, DataFrame]:
    """Log rows -> known runs (J8) -> values at the best epochs (J5) -> P1, P2, P6 -> F10."""
    known = log.join(match_run_names(log, names).select("run_id").distinct(), "run_id", "left_semi")
    values = value_at_epoch(known, optimal_epochs(known, metric))
    one = values.where(F.col("metric") == metric)
    complete = complete_table(values)
    return {
        "grid": metric_grid(one.where(F.col("method") == METHODS[-1]), "value", "model", "content", CONTENTS),
        "methods": method_comparison(one.where(F.col("model") == MODELS[-1]), "value", "content", "method", METHODS),
        "complete": complete,
        "selected": select_runs(complete),
    }


def match_run_names(log: DataFrame, names: DataFrame) -> DataFrame:
    """Join logs to a table keyed by logical run name (leading digits and '_' stripped)."""
    runs = log.select("run_id", "run_name").distinct().withColumn("logical_name", logical_run_name("run_name"))
    return runs.join(names, "logical_name")

"""Models that share features, passes and scoring: against plain numpy, Spark ML and separate fits."""

import dataclasses
import math
import zlib

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quire.plans import catalog as C
from quire.plans import classify as CL
from quire.plans import learn as LEARN
from quire.plans import linear
from quire.plans import runs as RUNS
from quire.sources import io as IO

from conftest import SF_SMALL

SIZE = 512


@pytest.fixture(scope="module")
def data(spark):
    return C.training_splits(spark, SF_SMALL).select("doc_id", "text", "labels", "split")


def test_features_are_hashed_words(spark):
    texts = ["The  Fox\nthe Ünd", "", None, "\t \n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["f"] for r in df.select(linear.features("text").alias("f")).collect()]
    want = [[zlib.crc32(w.encode()) % linear.SIZE for w in (t or "").lower().split()] for t in texts]
    assert got == want


def _matrix(rows, size):
    x = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        for j in r["f"]:
            x[i, j] += 1
    return x


def test_the_fit_is_the_minimum(spark, data):
    """The gradient vanishes in a plain numpy version of the objective, per model on its own rows and weights."""
    mask = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(3)
    rows = linear.training_rows(data, "text", "labels", mask, size=SIZE, keep=["doc_id"])
    specs = [linear.Spec(tol=1e-12, max_iter=400, num_features=SIZE, reg_param=r) for r in (0.01, 0.1)]
    training = linear.fit_many(rows, specs)
    local = rows.collect()
    x, y = _matrix(local, SIZE), np.array([r["label"] for r in local])
    for m, fit in enumerate(training.fits):
        mine = np.array([r["train"] >> m & 1 for r in local], bool)
        a, b = x[mine], y[mine]
        idf = np.where((a > 0).any(0), np.log((len(a) + 1) / ((a > 0).sum(0) + 1)), 0)
        weight = np.array([len(b) / (2 * (b == c).sum()) for c in (0, 1)])[b]
        w = np.zeros(SIZE)
        w[training.vocabulary] = fit.at[:-1]
        z = (a * idf) @ w + fit.at[-1]
        slope = weight * (1 / (1 + np.exp(-z)) - b) / weight.sum()
        gradient = np.append((a * idf).T @ slope + specs[m].reg_param * w, slope.sum())
        assert np.abs(gradient).max() < 1e-6
        assert np.allclose(fit.model(training.vocabulary).dense(), w * idf)


def test_agrees_with_spark_ml(spark, data):
    train = data.where("split = 'train'")
    model = LEARN.train_classifier(train, num_features=SIZE, tol=1e-12, max_iter=400)
    rows = linear.training_rows(train, "text", "labels", F.lit(1), size=SIZE, keep=["doc_id"])
    local = rows.collect()
    x, y = _matrix(local, SIZE), np.array([r["label"] for r in local])
    idf = np.log((len(x) + 1) / ((x > 0).sum(0) + 1)) * (x > 0).any(0)
    weight = [len(y) / (2 * (y == c).sum()) for c in (0, 1)]
    df = spark.createDataFrame([(float(b), float(weight[b]), (a * idf).tolist()) for a, b in zip(x, y)],
                               "label double, w double, a array<double>").withColumn("features", array_to_vector("a"))
    lr = LogisticRegression(weightCol="w", regParam=0.01, tol=1e-12, maxIter=500, standardization=False)
    fitted = Pipeline(stages=[lr]).fit(df).stages[-1]
    assert np.abs(fitted.coefficients.toArray() * idf - model.dense()).max() < 1e-3
    assert abs(fitted.intercept - model.intercept) < 1e-3


def test_together_is_as_separately_in_fewer_passes(spark, data):
    """Folds: k models in one fit, each row's words made once, against k fits of one model."""
    k = 4
    config = {"num_features": SIZE, "tol": 1e-12, "max_iter": 300}
    together = LEARN.fold_predictions(data, k, **config)
    fold = {r["doc_id"]: r["fold"] for r in together.collect()}
    p = {r["doc_id"]: r["probabilities_for_positive_label"] for r in together.collect()}
    assert set(fold.values()) == set(range(k)) and len(fold) == data.count()
    folds = spark.createDataFrame(list(fold.items()), "doc_id bigint, fold int")
    passes = 0
    for i in range(k):
        mine = data.join(folds, "doc_id").where(F.col("fold") != i)
        rows = linear.training_rows(mine, "text", "labels", F.lit(1), size=SIZE)
        training = linear.fit_many(rows, [linear.Spec(**config)])
        passes += training.passes
        alone = LEARN.predict(data.join(folds, "doc_id").where(F.col("fold") == i),
                              training.fits[0].model(training.vocabulary), keep=["doc_id"])
        for r in alone.collect():
            assert abs(r["probabilities_by_id"][1] - p[r["doc_id"]]) < 1e-5
    rows = linear.training_rows(data.join(folds, "doc_id"), "text", "labels",
                                F.lit((1 << k) - 1).bitwiseAND(F.bitwise_not(F.expr("shiftleft(1, fold)"))), size=SIZE)
    training = linear.fit_many(rows, [linear.Spec(**config)] * k)
    assert training.passes < passes / 2
    metrics = LEARN.cross_validate(data, k, **config).collect()
    assert {r["metric"] for r in metrics} >= {"f1", "accuracy"} and all(0 <= r["mean"] <= 1 for r in metrics)


def test_sweep_shares_words_by_number_of_features(spark, data):
    train, dev = data.where("split = 'train'"), data.where("split = 'dev'")
    configs = [{"num_features": 256, "max_iter": 9}, {"max_iter": -1}, {"num_features": 512, "reg_param": 0.3},
               {"num_features": 256, "reg_param": 0.3}, {"nonsense": 1}]
    rows = LEARN.sweep(train, dev, configs).collect()
    assert [r["status"] for r in rows] == ["ok", "failed", "ok", "ok", "failed"]
    for r, cfg in zip(rows, configs):
        if r["status"] == "ok":
            alone = LEARN.evaluate(dev, LEARN.train_classifier(train, **cfg)).first()
            assert (r["f1"], r["f_beta_2_0"]) == pytest.approx((alone["f1"], alone["f_beta_2_0"]), abs=1e-6)
            assert r["AUC"] == pytest.approx(alone["AUC"], abs=1e-6)


def test_training_without_rows_or_with_one_class(spark, data):
    with pytest.raises(ValueError):
        LEARN.train_classifier(data.where("false"))
    one = LEARN.train_classifier(data.where("labels = 1"), num_features=SIZE, max_iter=5)
    assert math.isfinite(one.intercept) and one.intercept > 0


# ---- epochs ----

CONFIG = {"num_features": SIZE, "max_iter": 8, "tol": 0.0}


def test_epochs_are_logged_and_the_best_is_kept(spark, data):
    train, dev = data.where("split = 'train'"), data.where("split <> 'train'")
    path = IO.scratch_path(spark, "epochs")
    model = LEARN.train_by_epochs(train, dev, path, **CONFIG)
    log = IO.read_run_logs(spark, f"{path}/logs").orderBy("step").collect()
    assert [r["epoch"] for r in log] == [float(i) for i in range(1, 9)]
    assert [r["step"] for r in log] == [int(i * train.count()) for i in range(1, 9)]
    assert all(a["loss"] >= b["loss"] for a, b in zip(log, log[1:]))
    best = max(log, key=lambda r: (r["eval_f_beta_2.0"], -r["epoch"]))
    assert model.iterations == best["epoch"]
    # the logged numbers are those of the model on dev
    found = LEARN.evaluate(dev, model).first()
    assert found["f_beta_2_0"] == pytest.approx(best["eval_f_beta_2.0"]) and found["f1"] == pytest.approx(best["eval_f1"])
    assert found["accuracy"] == pytest.approx(best["eval_accuracy"])


def test_a_run_goes_on_from_its_last_epoch(spark, data, monkeypatch):
    train, dev = data.where("split = 'train'"), data.where("split <> 'train'")
    whole, broken = IO.scratch_path(spark, "epochs"), IO.scratch_path(spark, "epochs")
    LEARN.train_by_epochs(train, dev, whole, **CONFIG)
    LEARN.train_by_epochs(train, dev, broken, stop_after=2, **CONFIG)
    passes = []
    real = linear.evaluate_points

    def failing(*args):
        passes.append(1)
        if len(passes) == 3:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(linear, "evaluate_points", failing)
    with pytest.raises(RuntimeError):
        LEARN.train_by_epochs(train, dev, broken, **CONFIG)
    monkeypatch.setattr(linear, "evaluate_points", real)
    before = LEARN.EpochRun(spark, broken).epochs().count()
    assert before == 4  # two epochs, two more, and the third of that call was lost
    LEARN.train_by_epochs(train, dev, broken, **CONFIG)
    a, b = ({r["epoch"]: r for r in LEARN.EpochRun(spark, p).epochs().collect()} for p in (whole, broken))
    assert set(a) == set(b) == set(range(1, 9))
    for i in a:
        assert a[i]["loss"] == pytest.approx(b[i]["loss"], rel=1e-6)


def test_run_operators_read_a_real_log(spark, data):
    train, dev = data.where("split = 'train'"), data.where("split <> 'train'")
    path = IO.scratch_path(spark, "epochs")
    LEARN.train_by_epochs(train, dev, path, **CONFIG)
    log = RUNS.log_of_runs(spark, {("finetuning", "xlmroberta", "trafilatura_fulltext"): f"{path}/logs"})
    steps = RUNS.best_and_latest_step(log, "eval_f_beta_2.0").first()
    assert steps["latest_step"] == 8 * train.count() >= steps["best_step"]
    assert RUNS.metric_evolution(log, ["eval_f1"]).count() == 8
    epochs = RUNS.optimal_epochs(log, "eval_f1")
    values = {r["metric"]: r["value"] for r in RUNS.value_at_epoch(log, epochs).collect()}
    best = max(log.where("metric = 'eval_f1'").collect(), key=lambda r: (r["value"], -r["epoch"]))
    assert values["eval_f1"] == best["value"] and epochs.first()["epoch"] == best["epoch"]


# ---- registry ----

@pytest.fixture(scope="module")
def two(data):
    train = data.where("split = 'train'")
    return [LEARN.train_classifier(train, num_features=SIZE, reg_param=r, max_iter=m) for r, m in ((0.01, 40), (1.0, 3))]


def test_registry_is_stored_and_found_by_name(spark, two):
    names = {f"{t}__{m}__{s}_v1": two[t == "finetuning"] for (s, m, t) in CL.one_model_for_all(two[0])}
    path = linear.save_registry(spark, names, IO.scratch_path(spark, "registry"))
    assert spark.read.parquet(f"{path}/models").count() == 2
    back = linear.load_registry(spark, path)
    assert set(back) == set(CL.one_model_for_all(two[0])) and len({id(m) for m in back.values()}) == 2
    for (s, m, t), model in back.items():
        assert np.array_equal(model.dense(), two[t == "finetuning"].dense())
        assert model.intercept == two[t == "finetuning"].intercept
    clash = {"pet_1000__xlmroberta__trafilatura_title": two[0], "x_pet_1000__xlmroberta__trafilatura_title": two[1]}
    with pytest.raises(ValueError):
        linear.load_registry(spark, linear.save_registry(spark, clash, IO.scratch_path(spark, "registry")))


def test_one_pass_equals_separate_predictions(spark, two):
    long = CL.document_contents(C._raw_docs(spark, SF_SMALL)).where("content_source <> 'trafilatura_abstract'")
    models = {k: two[(k[0] == "trafilatura_title") ^ (k[2] == "finetuning")] for k in CL.one_model_for_all(two[0])}
    out = CL.classify(long, models)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "crc32" not in plan  # words come from a stored table
    gated = {(r["doc_id"], r["content_source"]): r for r in CL.gate(long).collect()}
    alone = [{(r["doc_id"], r["content_source"]): r for r in
              LEARN.predict(long, m, keep=["doc_id", "content_source"]).collect()} for m in two]
    rows = out.collect()
    assert len(rows) == 4 * len(gated)
    differ = 0
    for r in rows:
        key = (r["doc_id"], r["content_source"])
        want = alone[(key[1] == "trafilatura_title") ^ (r["training_method"] == "finetuning")][key]
        assert (r["kept"], r["reason"]) == (gated[key]["kept"], gated[key]["reason"])
        if r["kept"]:
            assert (r["prediction_id"], r["prediction"]) == (want["prediction_id"], want["prediction"])
            assert [x["score"] for x in r["probabilities"]] == [x["score"] for x in want["probabilities"]]
            differ += alone[0][key]["prediction_id"] != alone[1][key]["prediction_id"]
        else:
            assert r["prediction_id"] is None and r["probabilities"] is None
    assert differ


def test_models_of_other_sources_are_null(spark, two):
    df = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "")], "s string, text string")
    made = df.withColumn("f", linear.features("text", SIZE))
    got = {r["s"]: r["p"] for r in linear.score(made, two, ["s"], "s", [{"a", "c"}, {"b"}]).collect()}
    assert got["a"][1] is None and got["b"][0] is None and got["c"][1] is None
    assert got["c"][0] == pytest.approx(1 / (1 + math.exp(-two[0].intercept)))
    other = dataclasses.replace(two[0], size=SIZE * 2)
    long = spark.createDataFrame([(1, "trafilatura_title", "x y")], "doc_id bigint, content_source string, text string")
    keys = list(CL.one_model_for_all(two[0]))
    with pytest.raises(ValueError):
        CL.classify(long, {keys[0]: two[0], keys[1]: other})

"""Faults that were found once: each with the input that showed it."""

import math
import re

from pyspark.sql import functions as F

from quire.functions import extract as X
from quire.operators import label as L
from quire.operators import relate as J
from quire.operators import sampling as S
from quire.plans import catalog as C
from quire.plans import classify as CL
from quire.plans import learn as LEARN
from quire.sources import io as IO
from quire.sources.tables import SPREAD, spread, table

from conftest import SF_SMALL


def test_pages_give_title_and_body(spark):
    rows = C.QUERIES["i2_gate"](spark, SF_SMALL).groupBy("content_source").count().collect()
    n = table(spark, SF_SMALL, "pages").count()
    assert {r["content_source"]: r["count"] for r in rows} == {"trafilatura_title": n, "trafilatura_fulltext": n}


def test_building_the_inputs_runs_only_schema_jobs(spark):
    sc = spark.sparkContext
    sc.setJobGroup("inputs", "inputs")
    try:
        C.corpus(spark, SF_SMALL)
        C.training_table(spark, SF_SMALL)
        jobs = sc.statusTracker().getJobIdsForGroup("inputs")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 4  # one per table that is opened


def test_spread_is_off_unless_set(spark):
    docs = table(spark, SF_SMALL, "documents")
    assert spread(docs) is docs
    spark.conf.set(SPREAD, "3")
    try:
        assert "RoundRobinPartitioning(3)" in spread(docs)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(SPREAD)


def test_row_keys_do_not_collide(spark):
    a = spark.createDataFrame([("x\u0001y", "z"), ("x", "y\u0001z"), (None, "-"), ("-", None)], "p string, q string")
    b = a.where(F.col("p") == "x").unionByName(a.where("p is null"))
    left = {tuple(r) for r in J.difference(a, b).collect()}
    assert left == {("x\u0001y", "z"), ("-", None)}


def test_numeric_subjects(spark):
    df = spark.createDataFrame([(-100000.5,), (math.nan,), (-99999.0,), (3.5,), (None,)], "s double")
    assert [r.h for r in df.select(L.has_subject("s").alias("h")).collect()] == [0, 0, 1, 1, 0]
    df = spark.createDataFrame([(-100001,), (0,), (None,)], "s bigint")
    assert [r.h for r in df.select(L.has_subject("s").alias("h")).collect()] == [1, 1, 0]
    df = spark.createDataFrame([("None",), ("",), ("x",), (None,)], "s string")
    assert [r.h for r in df.select(L.has_subject("s").alias("h")).collect()] == [0, 1, 1, 0]


def test_titles_decode_all_entities(spark):
    df = spark.createDataFrame([("<title>Caf&eacute; &#233; &ndash; x</title>",)], "html string")
    assert df.select(X.extract_title("html").alias("t")).first().t == "Café é – x"


def test_two_models_clean_each_text_once(spark):
    train = C.training_splits(spark, SF_SMALL).where("split = 'train'")
    one, two = (LEARN.train_classifier(train, max_iter=2, reg_param=r) for r in (0.1, 0.5))
    keys = list(CL.one_model_for_all(one))
    long = CL.document_contents(C._raw_docs(spark, SF_SMALL))
    models = {k: (one if i % 2 else two) for i, k in enumerate(keys)}
    out = CL.classify(long, models)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" not in plan and "translate(" not in plan
    assert out.count() == CL.classify(long, CL.one_model_for_all(one)).count()


def _row_exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_rows_are_not_shuffled_by_label_alone(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = table(spark, SF_SMALL, "labels", ["doc_id", "quality"]).withColumnRenamed("quality", "labels")
        w = L.balanced_class_weights(t, "labels").select("labels", "weight")
        weighted = S.with_class_value(t, "labels", w, "weight")
        assert "SortMergeJoin" not in weighted._jdf.queryExecution().executedPlan().toString()
        assert weighted.count() == t.where("labels is not null").count()
        split = S.split_stratified(t.where("labels is not null"), "doc_id", "labels")
        joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", split._jdf.queryExecution().executedPlan().toString())
        # the join that carries rows is on (label, bucket); class tables alone meet on the label
        assert any("," in j for j in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_draws_are_salted(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_DRAWS", 4)
    t = spark.createDataFrame([(i, int(i == 0)) for i in range(50)], "doc_id bigint, labels int")
    quota = spark.createDataFrame([(0, 100), (1, 200)], "labels int, _m int")
    drawn = S.sample_with_replacement(t, "doc_id", "labels", quota)
    assert {r["labels"]: r["count"] for r in drawn.groupBy("labels").count().collect()} == {0: 100, 1: 200}
    assert drawn.where("labels = 1").select("_draw").distinct().count() == 200


def test_evaluation_reads_documents_once_and_writes_the_curve(spark):
    test = C.training_splits(spark, SF_SMALL).where("split = 'test'")
    path = IO.scratch_path(spark, "evaluation")
    res = LEARN.evaluate(test, C.fitted_model(spark, SF_SMALL), out_dir=path)
    plan = res._jdf.queryExecution().optimizedPlan().toString()
    assert "training-splits" not in plan and "_features" not in plan
    schema = IO.with_field(IO.SPLIT_METRICS, "index", "array<bigint>")
    curve = IO.read_split_metrics(spark, f"{path}/curve", multi_line=False, schema=schema).orderBy("idx").collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (0.0, 0.0) and (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)
    assert abs(curve[0]["AUC"] - res.first()["AUC"]) < 1e-12


def test_errors_of_a_sweep_are_kept_whole(spark):
    splits = C.training_splits(spark, SF_SMALL)
    rows = LEARN.sweep(splits.where("split = 'train'"), splits.where("split = 'dev'"), [{"max_iter": -1}]).collect()
    assert rows[0]["status"] == "failed" and rows[0]["error"].endswith("maxIter given invalid value -1.")


def test_run_logs_are_chosen_by_training_type(spark, tmp_path):
    for run, name, f1 in (("a", "trainer_state.json", 0.5), ("a", "results.json", 0.1), ("b", "results.json", 0.7)):
        folder = tmp_path / run / "training_logs"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text('{"global_step": 3, "log_history": [{"epoch": 1.0, "step": 3, "eval_f1": %s}]}' % f1)
    got = {t: sorted(r["eval_f1"] for r in IO.read_run_logs(spark, str(tmp_path), training_type=t).collect())
           for t in ("finetuning", "pet")}
    assert got == {"finetuning": [0.5], "pet": [0.1, 0.7]}


def test_splits_are_sampled_and_loaded_from_a_directory(spark):
    t = spark.createDataFrame([(i, "" if i == 7 else f"text {i}", i % 2, "train" if i < 60 else "dev") for i in range(100)],
                              "doc_id bigint, content string, labels int, split string")
    path = IO.write_splits(t, IO.scratch_path(spark, "s3-test"), by=("split",))
    out = IO.load_labeled_path(spark, path, "content", "labels", "doc_id long, content string, labels int", splits=True,
                               downsample=0.5, shuffled=True)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 30, "dev": 20}

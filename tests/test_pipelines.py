"""Learner, inference (batch = stream), preparation, and the driver contract."""

import math
import os
import tempfile

import duckdb
import pytest

import __spark_entry__ as E
from quire.plans import catalog as C
from quire.plans import classify as CL
from quire.plans import learn as LEARN

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def model(spark):
    return C.fitted_model(spark, SF_SMALL)


def test_entry_contract(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["content_source", "has_subject", "count"] and len(rows) >= 4
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90


def test_predict_shapes(spark, model):
    test = C.training_splits(spark, SF_SMALL).where("split = 'test'")
    pred = LEARN.predict(test, model, keep=["doc_id", "labels"]).collect()
    assert pred
    for r in pred:
        assert r.prediction in ("irrelevant", "relevant")
        assert math.isclose(sum(p.score for p in r.probabilities), 1.0, rel_tol=1e-9)
        assert max(r.probabilities, key=lambda p: p.score).label == r.prediction


def test_sweep_records_failures(spark):
    sp = C.training_splits(spark, SF_SMALL)
    out = LEARN.sweep(sp.where("split = 'train'"), sp.where("split = 'dev'"),
                      [{"max_iter": 5}, {"max_iter": -1}]).collect()
    assert [r.status for r in out] == ["ok", "failed"]


def test_markup_overrides_even_with_null(spark, model):
    docs = spark.createDataFrame(
        [(1, "<doc><text>Real content about olive tree pests in Spain</text></doc>", "A given title that is long",
          None, None, None)],
        "doc_id long, xml_tei string, trafilatura_title string, trafilatura_abstract string, "
        "trafilatura_fulltext string, translation_title string")
    out = CL.classify_documents(docs, CL.one_model_for_all(model)).collect()
    sources = {r.content_source for r in out}
    assert sources == {"trafilatura_fulltext"}  # parsed title is null and replaces the given one
    assert all(r.kept and r.prediction is not None for r in out)


def test_batch_equals_stream(spark, model):
    from quire.streaming.classify_stream import run_to_completion
    docs = C._page_docs(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="quire-stream-")
    docs.repartition(3).write.parquet(f"{base}/in")
    models = CL.one_model_for_all(model)
    streamed = run_to_completion(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", models)
    batch = CL.classify_documents(spark.read.parquet(f"{base}/in"), models)
    key = ["doc_id", "content_source", "bert_model_name", "training_method", "kept", "reason", "prediction"]
    assert streamed.select(*key).exceptAll(batch.select(*key)).count() == 0
    assert batch.select(*key).exceptAll(streamed.select(*key)).count() == 0
    assert streamed.count() == batch.count() > 0


def _norm(v):
    if v is None:
        return (0,)
    if isinstance(v, float):
        return (1, round(v, 9))
    if isinstance(v, (int, str, bool)):
        return (1, v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", ["a5_value_counts", "t16_clean_text", "o7_split_stratified", "o8_split_balanced",
                                  "a13_roc_curve", "f8_quality_gate", "x4_relevant_sentences", "j5_value_at_epoch"])
def test_oracle_parity_small(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(sdf.columns)
    srows = sorted(tuple(_norm(r[c]) for c in order) for r in sdf.collect())
    drows = sorted(tuple(_norm(r[dcols.index(c)]) for c in order) for r in res.fetchall())
    assert srows == drows


def test_prepare_checkpoints_in_shared_dir(spark):
    assert spark.conf.get("spark.checkpoint.dir")
    out = C.e1_prepare(spark, SF_SMALL)
    assert set(r.scheme for r in out.select("scheme").distinct().collect()) == {"unbalanced", "balanced_dev_train",
                                                                              "pet_50"}
    assert os.path.isdir(spark.conf.get("spark.checkpoint.dir"))

"""I3 with state: nested results of a stream equal the batch form."""

import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest

from quire.plans import catalog as C
from quire.plans import classify as CL
from quire.plans.linear import LinearModel
from quire.streaming import classify_stream as S

from conftest import SF_SMALL

START = datetime(2024, 1, 1)
COLUMNS = ["doc_id", "xml_tei", "trafilatura_title", "trafilatura_abstract", "trafilatura_fulltext", "translation_title"]


@pytest.fixture(scope="module")
def models():
    rng = np.random.default_rng(3)
    two = [LinearModel(256, np.arange(256), rng.normal(size=256), 0.1) for _ in range(2)]
    return {k: two[k[2] == "finetuning"] for k in CL.one_model_for_all(two[0])}


def put(spark, rows, folder):
    spark.createDataFrame(rows, S.TIMED_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def found(df):
    return sorted(((r["doc_id"], r["results"]) for r in df.collect()), key=str)


def test_sources_of_a_document_in_several_batches_and_after_a_restart(spark, models):
    base = tempfile.mkdtemp(prefix="quire-nested-")
    title, body = "A long title about olive tree pests", "The bacterium infects olive trees in the south of Italy every year"
    other = "Another body that tells of vines and the insects that feed on them"
    at = lambda m: START + timedelta(minutes=m)
    first = [(1, None, title, None, None, None, at(0)), (2, None, title, None, body, None, at(1)), (3, None, "short", None, body, title, at(2))]
    second = [(1, None, None, None, body, None, at(30)), (2, None, title, None, body, None, at(31)),  # 2 comes again, unchanged
              (4, None, None, body, None, None, at(32))]
    third = [(1, None, None, other, None, None, at(50)), (5, "<doc><text>" + other + "</text></doc>", None, None, None, None, at(55))]
    run = lambda: S.nested_to_completion(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", models, max_files_per_trigger=1)
    put(spark, first, f"{base}/in")
    put(spark, second, f"{base}/in")
    assert run().count() == 0  # nothing is complete yet
    put(spark, third, f"{base}/in")
    S.close_stream(spark, f"{base}/in", START + timedelta(days=1))
    streamed = found(run())  # goes on from the checkpoint
    rows = spark.createDataFrame([r[:-1] for r in [*first, second[0], second[2], *third]], S.DOC_SCHEMA)
    assert streamed == found(CL.classify_documents(rows, models, nested=True))
    assert [len(r) for _, r in streamed] == [12, 8, 12, 4, 4]
    assert found(run()) == streamed  # no rows twice


def test_a_later_session_is_a_result_of_its_own(spark, models):
    base = tempfile.mkdtemp(prefix="quire-nested-")
    body = "The bacterium infects olive trees in the south of Italy every year"
    put(spark, [(1, None, None, None, body, None, START)], f"{base}/in")
    put(spark, [(9, None, None, None, body, None, START + timedelta(hours=5))], f"{base}/in")
    run = lambda: S.nested_to_completion(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", models, max_files_per_trigger=1)
    assert [d for d, _ in found(run())] == [1]
    put(spark, [(1, None, None, body + " again", None, None, START + timedelta(hours=6))], f"{base}/in")
    S.close_stream(spark, f"{base}/in", START + timedelta(days=1))
    got = found(run())
    assert [(d, len(r), {x["content_source"] for x in r}) for d, r in got if d == 1] == [
        (1, 4, {"trafilatura_abstract"}), (1, 4, {"trafilatura_fulltext"})]


def test_the_query_equals_the_batch(spark):
    streamed = C.i3_nested_stream(spark, SF_SMALL)
    batch = CL.classify_documents(C._page_docs(spark, SF_SMALL), C.fitted_models(spark, SF_SMALL), nested=True, tags=C.X.PAGE_TAGS)
    assert found(streamed) == found(batch)

"""Joins (J2, J4, J7, J8), markup extraction (X1-X5) and the corpus profile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import extract as X
from quire.operators import label as L
from quire.operators import relate as J


def test_difference_removes_all_copies_and_nulls_match(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert sorted(tuple(r) for r in J.difference(a, b).collect()) == [(3, "y")]


def test_registry_match_requires_all_three_parts(spark):
    names = spark.createDataFrame([("TRAFILATURA_TITLE_pet_1000_xlmroberta",), ("title_finetuning",),
                                   ("translated_title_finetuning_multilingual_bert_x",)], "model_dir string")
    got = {(r.model_dir, r.content_source, r.bert_model_name, r.training_method)
           for r in J.registry_match(names).collect()}
    assert got == {("TRAFILATURA_TITLE_pet_1000_xlmroberta", "trafilatura_title", "xlmroberta", "pet_1000"),
                   ("translated_title_finetuning_multilingual_bert_x", "translated_title", "multilingual_bert",
                    "finetuning")}


def test_label_maps_and_run_names(spark):
    df = spark.createDataFrame([(0, "05__xlm-roberta-base"), (1, "12_mbert_")], "y int, run string")
    names = {0: "irrelevant", 1: "relevant"}
    rows = df.select(J.label_name("y", names).alias("n"), J.logical_run_name("run").alias("r")).collect()
    assert [(r.n, r.r) for r in rows] == [("irrelevant", "xlm-roberta-base"), ("relevant", "mbert")]


def test_parse_markup():
    html = ("<html><head><title> A &amp; B </title><script>var x='<text>';</script></head>"
            "<body><abstract>None</abstract><text><p>One</p><p>Two <b>bold</b></p></text>"
            "<text>second</text></body></html>")
    assert X.parse_markup(html) == ("A & B", None, "OneTwo bold")
    assert X.parse_markup(None) == (None, None, None)
    assert X.parse_markup("<title></title>") == (None, None, None)


def test_native_title_matches_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a = pages.select("page_id", X.extract_title("html").alias("t1"),
                     X.extract_fields("html", X.PAGE_TAGS)["title"].alias("t2"))
    assert a.where(~F.col("t1").eqNullSafe(F.col("t2"))).count() == 0


def test_keyword_sentences(spark):
    df = spark.createDataFrame([("Oak wilt spreads. Nothing here! Fusarium found\nsoaked fields",),
                                ("no keyword at all",), (None,)], "t string")
    rows = df.select(X.contains_keywords("t").alias("k"), X.relevant_sentences("t").alias("s")).collect()
    assert rows[0].k and rows[0].s == "Oak wilt spreads..Fusarium found.soaked fields"
    assert (rows[1].k, rows[1].s) == (False, None)
    assert (rows[2].k, rows[2].s) == (False, None)


def test_length_profile_matches_numpy(spark):
    texts = ["a b c", "a", "", "one two three four five six", "x y", None, "p q r s"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = L.length_profile(df, "t").first()
    n = np.array([len(t.split()) if t is not None else 0 for t in texts], dtype=float)
    assert r["count"] == len(n)
    assert r["mean"] == pytest.approx(n.mean()) and r["std"] == pytest.approx(n.std(ddof=1))
    assert (r["p25"], r["p50"], r["p75"]) == pytest.approx(tuple(np.percentile(n, [25, 50, 75])))
    assert (r["min"], r["max"]) == (n.min(), n.max())


def test_dedupe_or_labels(spark):
    df = spark.createDataFrame([("Olive trees infected in the region", None), ("Olive trees infected in the region", "s"),
                                ("Olive trees infected in the region", None), ("Home", "s"), (None, "s")],
                               "trafilatura_title string, sujet string")
    rows = L.dedupe_or_label(df, "trafilatura_title").collect()
    assert [(r.trafilatura_title, r.has_subject) for r in rows] == [("Olive trees infected in the region", 1)]


def test_compat_rules_reject_texts_starting_with_s(spark):
    df = spark.createDataFrame([("Same long enough title text here", "s")], "trafilatura_title string, sujet string")
    assert L.dedupe_or_label(df, "trafilatura_title").count() == 0


def test_metric_evolution_keeps_zero_and_skips_absent(spark):
    from quire.plans.runs import metric_evolution
    log = spark.createDataFrame([(1, 1, 10, "eval_f1", 0.0), (1, 2, 20, "eval_f1", None), (1, 2, 21, "eval_loss", 0.3),
                                 (1, 3, 30, "eval_f1", 0.5)],
                                "run_id long, epoch int, step long, metric string, value double")
    rows = sorted((r.epoch, r.value) for r in metric_evolution(log, ["eval_f1"]).collect())
    assert rows == [(1, 0.0), (3, 0.5)]

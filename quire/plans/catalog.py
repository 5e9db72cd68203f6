"""

Each entry takes (spark, sf_dir) and returns a DataFrame over the given
tables (or data Spark derives from them), so its work grows with the data.
Inputs follow the mapping of ``quire.sources.tables``:

* corpus: documents LEFT JOIN labels (title = first line, fulltext = text)
* training table: labelled documents (doc_id, text, labels = quality)
* scored table: the training table with a deterministic score per document
  (hash of the doc id, shifted by the label) and a 0.5-threshold prediction
* run logs: events mapped onto training-run metric logs (``plans.runs``)
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import rules as R
from ..functions import text as T
from ..operators import label as L
from ..operators import metrics as M
from ..operators import relate as J
from ..operators import reshape as P
from ..operators import sampling as O
from ..session import cut_lineage, shuffles_dropped
from ..sources.tables import raw_corpus, spread, table, training_table
from . import runs as RUNS

QUERIES = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- inputs

def corpus(spark, sf_dir):
    return raw_corpus(spark, sf_dir)


#: The four content columns of a document.
CONTENT = ("trafilatura_title", "trafilatura_abstract", "trafilatura_fulltext", "translation_title")


def contents(spark, sf_dir, ids=("doc_id", "sujet")):
    """All content columns as rows: (ids..., content_source, text)."""
    return P.content_unpivot(corpus(spark, sf_dir).select(*ids, *CONTENT), ids, CONTENT)


def cleaned_contents(spark, sf_dir, ids=("doc_id", "sujet")):
    return contents(spark, sf_dir, ids).withColumn("text", T.clean_text(F.col("text")))


def docs(spark, sf_dir, cols=("doc_id", "text")):
    return spread(table(spark, sf_dir, "documents", list(cols)))


def pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages", ["page_id", "html"]))


def scored(spark, sf_dir):
    """Training table + deterministic score in (0, 1) and prediction."""
    t = training_table(spark, sf_dir)
    u = O.hash32(F.col("doc_id"), salt="score") / F.lit(4294967296.0)
    score = (F.floor(u * 60) + F.col("labels") * 40 + F.lit(0.5)) / F.lit(100.0)
    return t.select("doc_id", "labels", score.alias("score"),
                    (score >= 0.5).cast("int").alias("predictions"))


def row_type():
    """The content type of a row of `contents`."""
    return T.content_type_col("content_source")


def deduped(spark, sf_dir):
    """A2 over all cleaned content columns at once: (content_source, text, has_subject)."""
    return L.dedupe_or_label(cleaned_contents(spark, sf_dir), "text", "sujet", keep_titles=True,
                             content_type_of=T.content_type_col("content_source"), groups=["content_source"])


def run_values(spark, sf_dir):
    """J5 over the eight run metrics."""
    log = RUNS.run_metrics(spark, sf_dir)
    return RUNS.value_at_epoch(log, RUNS.optimal_epochs(log))


def complete_runs(spark, sf_dir):
    return RUNS.complete_table(run_values(spark, sf_dir))


def model_names(spark):
    return spark.createDataFrame([(m.lower(), m) for m in P.MODELS], "logical_name string, model_label string")


# ---------------------------------------------------------------- T: text cleaning

def _doc_fn(name, fn, src="text"):
    @query(name)
    def q(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", fn(F.col(src)).alias("out"))
    q.__name__ = name
    return q


_doc_fn("t1_normalize_hyphens", T.normalize_hyphens)


@query("t2_strip_tags")
def t2_strip_tags(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.strip_tags("html").alias("out"))


@query("t3_strip_urls")
def t3_strip_urls(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.strip_urls(T.strip_tags("html")).alias("out"))


_doc_fn("t4_strip_dates", T.strip_dates)
_doc_fn("t5_strip_hours", T.strip_hours)
_doc_fn("t6_strip_boilerplate", T.strip_boilerplate)
_doc_fn("t7_normalize_quotes", T.normalize_quotes)
_doc_fn("t8_trim_ws_hyphen", T.trim_ws_hyphen)
_doc_fn("t9_collapse_ws", T.collapse_ws)
_doc_fn("t10_drop_short_suffix", lambda c: T.drop_short_suffix(T.drop_short_suffix(T.collapse_ws(c), "-"), "|"))
_doc_fn("t11_fix_quotes", T.fix_quotes)
_doc_fn("t12_strip_emoji", T.strip_emoji)
_doc_fn("t13_strip_control", T.strip_control)
_doc_fn("t14_trim_punct", T.trim_punct)
_doc_fn("t15_trim_digits", T.trim_digits)


@query("t16_clean_text")
def t16_clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean_text"))


@query("t17_clean_columns")
def t17_clean_columns(spark, sf_dir):
    return T.clean_columns(corpus(spark, sf_dir).select("doc_id", *CONTENT), CONTENT)


@query("t18_token_count")
def t18_token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_count("text").alias("n_tokens"))


@query("t19_content_type")
def t19_content_type(spark, sf_dir):
    long = contents(spark, sf_dir)
    return long.select("doc_id", "content_source", T.content_type_col("content_source").alias("content_type"))


@query("t20_encode_fixed")
def t20_encode_fixed(spark, sf_dir):
    enc = T.encode_fixed(F.col("text"), max_len=100)
    return docs(spark, sf_dir).select("doc_id", enc["input_ids"].alias("input_ids"),
                                      enc["attention_mask"].alias("attention_mask"))


# ---------------------------------------------------------------- F: predicates

def _pred(name, fn):
    """A predicate over every content column of every document."""
    @query(name)
    def q(spark, sf_dir):
        return contents(spark, sf_dir).select("doc_id", "content_source", fn(F.col("text")).alias("flag"))
    q.__name__ = name
    return q


_pred("f1_has_content", R.has_content)
_pred("f2_is_too_short", R.is_too_short)
_pred("f3_is_known_dubious", R.is_known_dubious)
_pred("f4_is_error_message", R.is_error_message)
_pred("f5_is_site_name", R.is_site_name)
_pred("f6_is_boilerplate", lambda c: R.is_boilerplate(c, row_type()))
_pred("f6_is_boilerplate_strict", lambda c: R.is_boilerplate(c, row_type(), "strict"))
_pred("f7_to_be_kept", lambda c: R.to_be_kept(c, row_type(), keep_titles=False))
_pred("f7_to_be_kept_strict", lambda c: R.to_be_kept(c, row_type(), False, "strict"))


@query("f8_quality_gate")
def f8_quality_gate(spark, sf_dir):
    c = cleaned_contents(spark, sf_dir, ["doc_id"])
    g = c.select("doc_id", "content_source", R.quality_gate(F.col("text"), row_type()).alias("_g"))
    return g.select("doc_id", "content_source", F.col("_g.kept").alias("kept"), F.col("_g.reason").alias("reason"))


@query("f9_drop_missing")
def f9_drop_missing(spark, sf_dir):
    """Rows complete in every content column and the subject, with the share of rows that were dropped."""
    c = corpus(spark, sf_dir).select("doc_id", "sujet", *CONTENT)
    cols = ["sujet", *CONTENT]
    lost = L.missing_report(c, cols).select("n_rows_with_missing", "pct_rows_with_missing")
    return O.with_scalars(L.drop_missing(c, cols), lost)


@query("f10_select_runs")
def f10_select_runs(spark, sf_dir):
    return RUNS.select_runs(complete_runs(spark, sf_dir))


@query("f10_follow_up")
def f10_follow_up(spark, sf_dir):
    return RUNS.select_runs(complete_runs(spark, sf_dir), RUNS.FOLLOW_UPS[0], strict=True)


# ---------------------------------------------------------------- A: labelling and profiles

@query("a1_has_subject")
def a1_has_subject(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", L.has_subject("sujet").alias("has_subject"))


@query("a2_dedupe_or_label")
def a2_dedupe_or_label(spark, sf_dir):
    return deduped(spark, sf_dir)


@query("a3_class_proportions")
def a3_class_proportions(spark, sf_dir):
    return L.class_proportions(training_table(spark, sf_dir), "labels")


@query("a4_class_weights")
def a4_class_weights(spark, sf_dir):
    return L.balanced_class_weights(training_table(spark, sf_dir), "labels")


@query("a5_value_counts")
def a5_value_counts(spark, sf_dir):
    """Flagship: clean all contents -> drop scrape failures -> dedupe + OR labels -> class balance."""
    return L.value_counts(deduped(spark, sf_dir), "has_subject", by=["content_source"])


@query("a6_length_profile")
def a6_length_profile(spark, sf_dir):
    return L.length_profile(docs(spark, sf_dir), "text")


@query("a7_overview")
def a7_overview(spark, sf_dir):
    counts, profile = L.overview(corpus(spark, sf_dir), "trafilatura_fulltext", "sujet")
    wide = counts.groupBy().pivot("has_subject", [0, 1]).agg(F.first("count"))
    wide = wide.select(F.coalesce(F.col("0"), F.lit(0)).alias("n_negative"), F.coalesce(F.col("1"), F.lit(0)).alias("n_positive"))
    return O.with_scalars(profile, wide)


@query("a8_split_statistics")
def a8_split_statistics(spark, sf_dir):
    """Split sizes per content source and scheme (unbalanced, balanced, few-shot 50)."""
    d = cut_lineage(deduped(spark, sf_dir), "deduped")
    g = ["content_source"]
    uns = O.split_stratified(d, "text", "has_subject", groups=g).withColumn("scheme", F.lit("unbalanced"))
    bal = cut_lineage(O.split_balanced(d, "text", "has_subject", groups=g), "balanced")
    few = O.split_few_shot(bal, "text", 50, groups=g).withColumn("scheme", F.lit("pet_50"))
    allx = uns.unionByName(bal.withColumn("scheme", F.lit("balanced_dev_train")), allowMissingColumns=True) \
        .unionByName(few, allowMissingColumns=True)
    return allx.groupBy("content_source", "scheme").pivot("split", ["train", "dev", "test", "unlabeled"]).agg(
        F.count(F.lit(1)).alias("size"), F.sum("has_subject").alias("positives"),
        F.sum(1 - F.col("has_subject")).alias("negatives"))


@query("a9_distinct_texts")
def a9_distinct_texts(spark, sf_dir):
    return L.distinct_texts(docs(spark, sf_dir), "text")


@query("a10_column_profile")
def a10_column_profile(spark, sf_dir):
    return L.column_profile(corpus(spark, sf_dir), [*CONTENT, "sujet", "quality"])


@query("a11_missing_report")
def a11_missing_report(spark, sf_dir):
    return L.missing_report(corpus(spark, sf_dir), [*CONTENT, "sujet"])


@query("a12_classification_metrics")
def a12_classification_metrics(spark, sf_dir):
    return M.classification_metrics(scored(spark, sf_dir), "labels", "predictions", "binary")


@query("a12_macro_metrics")
def a12_macro_metrics(spark, sf_dir):
    return M.classification_metrics(scored(spark, sf_dir), "labels", "predictions", "macro")


@query("a13_roc_curve")
def a13_roc_curve(spark, sf_dir):
    return M.roc_curve(scored(spark, sf_dir), "labels", "score")


@query("a14_roc_auc")
def a14_roc_auc(spark, sf_dir):
    return M.roc_auc(scored(spark, sf_dir), "labels", "score")


@query("a15_cv_summary")
def a15_cv_summary(spark, sf_dir):
    folds = O.stratified_kfold(scored(spark, sf_dir), "doc_id", "labels", k=5)
    per_fold = M.classification_metrics(folds, "labels", "predictions", "binary", by=["fold"]).drop("support")
    return M.cv_summary(per_fold, "f1")


@query("a16_weighted_cross_entropy")
def a16_weighted_cross_entropy(spark, sf_dir):
    s = scored(spark, sf_dir)
    w = L.balanced_class_weights(s, "labels").select("labels", "weight")
    return M.weighted_cross_entropy(s, "labels", "score", w)


@query("a17_ensemble_summary")
def a17_ensemble_summary(spark, sf_dir):
    log = RUNS.run_log(spark, sf_dir)
    runs = RUNS.assemble_runs(RUNS.value_at_epoch(log, RUNS.optimal_epochs(log)), RUNS.LOG_METRICS)
    return M.ensemble_summary(runs, ["model"], RUNS.LOG_METRICS)


# ---------------------------------------------------------------- O: ordering, sampling, splitting

@query("o1_shuffle")
def o1_shuffle(spark, sf_dir):
    t = training_table(spark, sf_dir).select("doc_id", "labels")
    return O.hash_rank(t, "doc_id", (), salt="shuffle", rank_col="position")


@query("o2_top_label")
def o2_top_label(spark, sf_dir):
    s = scored(spark, sf_dir)
    probs = F.array(F.struct(F.lit("irrelevant").alias("label"), (1 - F.col("score")).alias("score")),
                    F.struct(F.lit("relevant").alias("label"), F.col("score").alias("score")))
    top = M.top_label(probs)
    return s.select("doc_id", top["label"].alias("top_label"), top["score"].alias("top_score"))


@query("o3_downsample")
def o3_downsample(spark, sf_dir):
    return O.downsample(training_table(spark, sf_dir).select("doc_id", "labels"), "doc_id", 0.1)


@query("o4_split_ordered")
def o4_split_ordered(spark, sf_dir):
    t = training_table(spark, sf_dir).select("doc_id", "labels")
    return O.split_ordered(t, ["doc_id"], 0.8, 0.1, 0.1)


@query("o5_sample_by_class")
def o5_sample_by_class(spark, sf_dir):
    t = training_table(spark, sf_dir).select("doc_id", "labels")
    return O.sample_by_class(t, "doc_id", "labels", fraction=0.3)


@query("o6_sample_with_replacement")
def o6_sample_with_replacement(spark, sf_dir):
    t = training_table(spark, sf_dir).select("doc_id", "labels")
    quota = O.class_counts(t, "labels").select("labels", O._trunc(F.col("_n") * 0.4).alias("_m"))
    return O.sample_with_replacement(t, "doc_id", "labels", quota)


@query("o7_split_stratified")
def o7_split_stratified(spark, sf_dir):
    return O.split_stratified(training_table(spark, sf_dir).select("doc_id", "labels"), "doc_id", "labels")


@query("o8_split_balanced")
def o8_split_balanced(spark, sf_dir):
    return O.split_balanced(training_table(spark, sf_dir).select("doc_id", "labels"), "doc_id", "labels")


@query("o9_split_few_shot")
def o9_split_few_shot(spark, sf_dir):
    bal = O.split_balanced(training_table(spark, sf_dir).select("doc_id", "labels"), "doc_id", "labels")
    return O.split_few_shot(bal, "doc_id", 50)


@query("o10_stratified_kfold")
def o10_stratified_kfold(spark, sf_dir):
    return O.stratified_kfold(training_table(spark, sf_dir).select("doc_id", "labels"), "doc_id", "labels", 10)


@query("o11_best_latest_step")
def o11_best_latest_step(spark, sf_dir):
    return RUNS.best_and_latest_step(RUNS.run_log(spark, sf_dir), "eval_f1")


@query("o12_metric_evolution")
def o12_metric_evolution(spark, sf_dir):
    return RUNS.metric_evolution(RUNS.run_log(spark, sf_dir))


@query("o13_split_dataset")
def o13_split_dataset(spark, sf_dir):
    """Every deduped content column split both ways: (content_source, scheme, split, text, has_subject, _draw)."""
    d = cut_lineage(deduped(spark, sf_dir), "deduped")
    g = ["content_source"]
    uns = O.split_stratified(d, "text", "has_subject", groups=g).withColumn("scheme", F.lit("unbalanced"))
    bal = O.split_balanced(d, "text", "has_subject", groups=g).withColumn("scheme", F.lit("balanced_dev_train"))
    return uns.withColumn("_draw", F.lit(None).cast("bigint")).unionByName(bal)


# ---------------------------------------------------------------- J, U: joins and set operations

@query("j1_positional_join")
def j1_positional_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    left = d.select(F.col("doc_id").alias("row_id"), "text")
    right = d.select(F.col("doc_id").alias("row_id"), "lang")
    return J.positional_join(left, right, "row_id")


@query("j2_difference")
def j2_difference(spark, sf_dir):
    t = training_table(spark, sf_dir).select("doc_id", "labels")
    sample = O.sample_by_class(t, "doc_id", "labels", fraction=0.1)
    return J.difference(t, sample)


@query("j3_fan_out")
def j3_fan_out(spark, sf_dir):
    c = corpus(spark, sf_dir).select("doc_id", F.col("trafilatura_title").alias("trafilatura_title"),
                                     F.col("trafilatura_abstract").alias("trafilatura_abstract"),
                                     F.col("trafilatura_fulltext").alias("trafilatura_fulltext"),
                                     F.col("translation_title").alias("translated_title"))
    long = P.content_unpivot(c, ["doc_id"], list(J.CONTENT_SOURCES))
    return J.fan_out(long, J.model_registry(spark)).select("doc_id", "content_source", "bert_model_name",
                                                          "training_method")


@query("j4_registry_match")
def j4_registry_match(spark, sf_dir):
    log = RUNS.run_log(spark, sf_dir)
    src = F.element_at(F.array(*[F.lit(s) for s in J.CONTENT_SOURCES]), ((F.col("run_id") % 4) + 1).cast("int"))
    bert = F.element_at(F.array(*[F.lit(s) for s in J.BERT_MODELS]), ((F.col("run_id") % 2) + 1).cast("int"))
    meth = F.element_at(F.array(*[F.lit(s) for s in J.TRAINING_METHODS]), ((F.floor(F.col("run_id") / 2) % 2) + 1).cast("int"))
    names = log.select("run_id").distinct().select(
        "run_id", F.concat(F.upper(src), F.lit("_"), meth, F.lit("_"), bert, F.lit("_run"), F.col("run_id").cast("string"))
        .alias("model_dir"))
    return J.registry_match(names, "model_dir")


@query("j5_value_at_epoch")
def j5_value_at_epoch(spark, sf_dir):
    log = RUNS.run_log(spark, sf_dir)
    return RUNS.value_at_epoch(log, RUNS.optimal_epochs(log, "eval_f1"))


@query("j6_assemble_runs")
def j6_assemble_runs(spark, sf_dir):
    """The eight metrics of each run at its best epoch."""
    return RUNS.assemble_runs(run_values(spark, sf_dir))


@query("j7_label_map")
def j7_label_map(spark, sf_dir):
    names = {0: "irrelevant", 1: "relevant"}
    t = training_table(spark, sf_dir)
    named = t.select("doc_id", J.label_name("labels", names).alias("label_name"))
    return named.select("doc_id", "label_name", J.label_id("label_name", names).alias("label_id"))


@query("j8_run_name_match")
def j8_run_name_match(spark, sf_dir):
    log = RUNS.run_log(spark, sf_dir)
    return RUNS.match_run_names(log, model_names(spark)).select("run_id", "run_name", "logical_name", "model_label")


@query("u1_union_samples")
def u1_union_samples(spark, sf_dir):
    t = training_table(spark, sf_dir).select("doc_id", "labels")
    s = O.sample_by_class(t, "doc_id", "labels", fraction=0.2)
    return O.shuffle(J.union_samples([s.where(F.col("labels") == 1), s.where(~F.col("labels").eqNullSafe(1))]), "doc_id")


# ---------------------------------------------------------------- P: reshaping

def _metric_values(spark, sf_dir, metric="eval_f1"):
    log = RUNS.run_log(spark, sf_dir)
    v = RUNS.value_at_epoch(log, RUNS.optimal_epochs(log, "eval_f1"))
    return v.where(F.col("metric") == metric)


@query("p1_metric_grid")
def p1_metric_grid(spark, sf_dir):
    v = _metric_values(spark, sf_dir).where(F.col("method") == "PET 1000")
    return P.metric_grid(v, "value", "model", "content", P.CONTENTS)


@query("p2_method_comparison")
def p2_method_comparison(spark, sf_dir):
    v = _metric_values(spark, sf_dir).where(F.col("model") == "XLM-RoBERTa")
    return P.method_comparison(v, "value", "content", "method", P.METHODS)


@query("p3_transpose")
def p3_transpose(spark, sf_dir):
    grid = p1_metric_grid(spark, sf_dir)
    return P.transpose(grid, "model", P.CONTENTS, "content", P.MODELS)


@query("p4_fill_missing")
def p4_fill_missing(spark, sf_dir):
    return P.fill_missing(p1_metric_grid(spark, sf_dir), 0.0, P.CONTENTS)


@query("p5_content_unpivot")
def p5_content_unpivot(spark, sf_dir):
    return contents(spark, sf_dir, ["doc_id"])


@query("p6_complete_table")
def p6_complete_table(spark, sf_dir):
    return complete_runs(spark, sf_dir)


# ---------------------------------------------------------------- X: extraction

@query("x1_extract_title")
def x1_extract_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.extract_title("html").alias("title"))


@query("x1_extract_fields")
def x1_extract_fields(spark, sf_dir):
    f = X.extract_fields("html", X.PAGE_TAGS)
    return pages(spark, sf_dir).select("page_id", f["title"].alias("title"), f["abstract"].alias("abstract"),
                                       f["fulltext"].alias("fulltext"))


@query("x2_add_parsed_columns")
def x2_add_parsed_columns(spark, sf_dir):
    p = pages(spark, sf_dir).withColumnRenamed("html", "trafilatura_extracted_xml_tei")
    return X.add_parsed_columns(p, tags=X.PAGE_TAGS).drop("trafilatura_extracted_xml_tei")


@query("x3_contains_keywords")
def x3_contains_keywords(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.contains_keywords("text").alias("has_keyword"))


@query("x4_relevant_sentences")
def x4_relevant_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.relevant_sentences("text").alias("sentences"))


@query("x4_abbreviations")
def x4_abbreviations(spark, sf_dir):
    """Words before a full stop in all documents, and how likely each is an abbreviation."""
    return X.abbreviation_scores(docs(spark, sf_dir), "text")


@query("x4_learned_sentences")
def x4_learned_sentences(spark, sf_dir):
    """X4 with a splitter that knows the abbreviations learned from all documents."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", X.relevant_sentences("text", X.learn_abbreviations(d, "text")).alias("sentences"))


@query("x5_add_sentence_columns")
def x5_add_sentence_columns(spark, sf_dir):
    c = corpus(spark, sf_dir).select("doc_id", "trafilatura_abstract", "trafilatura_fulltext")
    return X.add_sentence_columns(c, ["trafilatura_abstract", "trafilatura_fulltext"], keep_content=True)


# ---------------------------------------------------------------- S: sources and sinks

from ..sources import io as IO  # noqa: E402


@query("s1_read_table")
def s1_read_table(spark, sf_dir):
    path = IO.write_csv(table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]),
                        IO.scratch_path(spark, "s1"))
    schema = "doc_id long, text string, lang string, source string"
    return IO.read_table(spark, path, schema, columns=["doc_id", "text", "lang"], rename={"text": "content"},
                         shuffle_key="doc_id")


@query("s2_read_splits")
def s2_read_splits(spark, sf_dir):
    sp = O.split_stratified(training_table(spark, sf_dir).select("doc_id", "labels"), "doc_id", "labels")
    path = IO.scratch_path(spark, "s2")
    sp.write.mode("overwrite").partitionBy("split").options(**IO.CSV_WRITE_OPTIONS).csv(path)
    return IO.read_splits(spark, path, "doc_id long, labels int").select("doc_id", "labels", "split")


@query("s3_load_labeled")
def s3_load_labeled(spark, sf_dir):
    """A directory of splits, loaded for training and shuffled."""
    sp = O.split_stratified(training_table(spark, sf_dir), "doc_id", "labels").withColumnRenamed("text", "content")
    path = IO.write_splits(sp, IO.scratch_path(spark, "s3"), by=("split",))
    return IO.load_labeled_path(spark, path, "content", "labels", "doc_id long, content string, labels int", splits=True,
                                shuffled=True)


def _columns_store(spark, sf_dir):
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]).withColumnRenamed("doc_id", "row_id")
    return IO.write_columns(d, IO.scratch_path(spark, "s4"))


@query("s4_write_columns")
def s4_write_columns(spark, sf_dir):
    return spark.read.parquet(_columns_store(spark, sf_dir))


@query("s5_read_columns")
def s5_read_columns(spark, sf_dir):
    return IO.read_columns(spark, _columns_store(spark, sf_dir), ["text", "lang"])


@query("s6_reduce_columns")
def s6_reduce_columns(spark, sf_dir):
    return IO.reduce_columns(raw_corpus(spark, sf_dir))


@query("s7_write_datasets")
def s7_write_datasets(spark, sf_dir):
    path = IO.write_datasets(deduped(spark, sf_dir), IO.scratch_path(spark, "s7"))
    return spark.read.parquet(path).select("content_source", "text", "has_subject")


@query("s8_write_splits")
def s8_write_splits(spark, sf_dir):
    t = training_table(spark, sf_dir).select("doc_id", "labels")
    uns = O.split_stratified(t, "doc_id", "labels").withColumn("_draw", F.lit(None).cast("bigint")) \
        .withColumn("scheme", F.lit("unbalanced"))
    bal = O.split_balanced(t, "doc_id", "labels").withColumn("scheme", F.lit("balanced_dev_train"))
    path = IO.write_splits(uns.unionByName(bal), IO.scratch_path(spark, "s8"), by=("scheme", "split"))
    back = spark.read.options(**IO.CSV_OPTIONS).schema("doc_id long, labels int, _draw long, scheme string, split string") \
        .csv(path)
    return back.select("doc_id", "labels", "_draw", "scheme", "split")


def _log_entries(spark, sf_dir):
    log = RUNS.run_log(spark, sf_dir)
    fields = [F.col("epoch").cast("double").alias("epoch"), F.col("step")]
    fields += [F.when(F.col("metric") == m, F.col("value")).alias(m) for m in RUNS.LOG_METRICS]
    return log.select("run_id", F.struct(*fields).alias("entry"))


CHUNK = 1024  # entries per written document: bounds every collected group


@query("s9_read_run_logs")
def s9_read_run_logs(spark, sf_dir):
    """Run logs written as JSON documents and read back exploded.

    Each document holds at most CHUNK consecutive steps of one run (its
    log_history), so no run -- however many steps it logged -- is gathered
    into one task."""
    entries = _log_entries(spark, sf_dir).withColumn("_chunk", F.floor(F.col("entry.step") / CHUNK))
    docs = entries.groupBy("run_id", "_chunk").agg(
        F.max("entry.step").alias("global_step"),
        F.avg("entry.eval_loss").alias("average_loss"),
        F.sort_array(F.collect_list("entry")).alias("log_history")).drop("_chunk")
    path = IO.scratch_path(spark, "s9")
    docs.write.mode("overwrite").json(path)
    schema = IO.with_field(IO.RUN_LOG, "run_id", "bigint")
    back = IO.read_run_logs(spark, path, multi_line=False, schema=schema)
    return back.select("run_id", "step", "epoch", *RUNS.LOG_METRICS)


@query("s10_read_split_metrics")
def s10_read_split_metrics(spark, sf_dir):
    """Per-fold ROC curves written as metric documents and read back."""
    folds = O.stratified_kfold(scored(spark, sf_dir), "doc_id", "labels", k=5)
    points = cut_lineage(M.score_points(folds, "labels", "score", by=["fold"]), "fold-points")
    auc = M.auc_of(points, ["fold"]).withColumnRenamed("auc", "AUC")
    path = IO.write_curve(M.curve_of(points, ["fold"]), auc, IO.scratch_path(spark, "s10"), ["fold"])
    schema = IO.with_field(IO.with_field(IO.SPLIT_METRICS, "fold", "int"), "index", "array<bigint>")
    return IO.read_split_metrics(spark, path, multi_line=False, schema=schema, keep=["fold"]).drop("metrics_path")


@query("s11_read_metric_text")
def s11_read_metric_text(spark, sf_dir):
    log = RUNS.run_log(spark, sf_dir)
    runs = RUNS.assemble_runs(RUNS.value_at_epoch(log, RUNS.optimal_epochs(log)), RUNS.LOG_METRICS)
    ens = M.ensemble_summary(runs, ["model"], ["eval_f1"]).select(
        F.concat(F.lit("eval_f1-"), F.col("model")).alias("name"), F.col("eval_f1_mean").alias("mean"),
        F.col("eval_f1_std").alias("std"))
    path = IO.write_metric_text(ens, IO.scratch_path(spark, "s11"))
    return IO.read_metric_text(spark, path)


@query("s12_write_predictions")
def s12_write_predictions(spark, sf_dir):
    s = scored(spark, sf_dir).withColumnRenamed("score", "probabilities_for_positive_label")
    path = IO.write_predictions(s, IO.scratch_path(spark, "s12"))
    return spark.read.parquet(path)


@query("s13_write_metrics")
def s13_write_metrics(spark, sf_dir):
    m = M.classification_metrics(scored(spark, sf_dir), "labels", "predictions", "binary")
    path = IO.write_metrics(m, IO.scratch_path(spark, "s13"))
    return spark.read.schema("accuracy double, f1 double, precision double, recall double, support long, "
                             "f_beta_2_0 double, f_beta_0_5 double").json(path)


# ---------------------------------------------------------------- M: learn

from . import classify as CL  # noqa: E402
from . import learn as LEARN  # noqa: E402
from . import linear as LIN  # noqa: E402

_MODELS = {}
_SPLITS = {}
#: Documents that a few-shot model ("pet_1000") learns from.
FEW_SHOTS = 1000


def data_version(spark, sf_dir, names=("documents", "labels")):
    """A checksum of the input files' names, sizes and times: what is kept of a session belongs to it."""
    found = []
    for name in names:
        files = table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        found.append(files.distinct().agg(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()[0])
    return (spark.sparkContext.applicationId, sf_dir, *found)


def training_contents(spark, sf_dir):
    """Labelled documents with cleaned content columns and their split, written once
    per session and state of the input to the shared checkpoint folder; training,
    prediction and the reports all read that table instead of re-cleaning."""
    key = data_version(spark, sf_dir)
    if key not in _SPLITS:
        text = docs(spark, sf_dir, ("doc_id", "text", "lang"))
        labels = table(spark, sf_dir, "labels", ["doc_id", "quality"]).withColumnRenamed("quality", "labels")
        first = F.substring_index("text", "\n", 1)
        columns = {"trafilatura_title": first, "trafilatura_abstract": F.get(F.split("text", "\n"), 1),
                   "trafilatura_fulltext": F.col("text"), "translated_title": F.when(F.col("lang") == "en", first)}
        wide = text.join(labels, "doc_id").select("doc_id", "labels", *[T.clean_text(c).alias(n) for n, c in columns.items()])
        _SPLITS[key] = cut_lineage(O.split_stratified(wide, "doc_id", "labels"), "training-splits")
    return _SPLITS[key]


def training_splits(spark, sf_dir):
    """The cleaned, split training table: (doc_id, text, labels, split), text being the full text."""
    return training_contents(spark, sf_dir).select("doc_id", F.col("trafilatura_fulltext").alias("text"), "labels", "split")


def fitted_models(spark, sf_dir):
    """The registry of trained models, per state of the input and session (M and I queries share it).

    A model per content source and training method -- "finetuning" learns from all training
    rows, "pet_1000" from the FEW_SHOTS with the smallest hashes -- all trained in the same
    passes over one stored table, saved under the names of run folders and loaded by them.
    """
    key = data_version(spark, sf_dir)
    if key not in _MODELS:
        train = training_contents(spark, sf_dir).where(F.col("split") == "train")
        shots = train.select("doc_id").orderBy(O.hash32(F.col("doc_id"), salt="few-shot"), "doc_id").limit(FEW_SHOTS)
        few = train.join(F.broadcast(shots.withColumn("few", F.lit(1))), "doc_id", "left")  # FEW_SHOTS rows
        long = few.unpivot(["labels", "few"], list(J.CONTENT_SOURCES), "content_source", "text")
        cells = [(s, t) for s in J.CONTENT_SOURCES for t in J.TRAINING_METHODS]
        mask = F.lit(0)
        for i, (s, t) in enumerate(cells):
            mine = (F.col("content_source") == s) & (F.lit(t == "finetuning") | F.col("few").isNotNull())
            mask = mask.bitwiseOR(F.when(mine, F.lit(1 << i)).otherwise(0))
        training = LIN.fit_many(LIN.training_rows(long, "text", "labels", mask), [LIN.Spec()] * len(cells))
        models = {f"{t}__{m}__{s}": fit.model(training.vocabulary) for (s, t), fit in zip(cells, training.fits) if not fit.error
                  for m in J.BERT_MODELS[:1]}
        names = {n.replace(J.BERT_MODELS[0], m): model for n, model in models.items() for m in J.BERT_MODELS}
        _MODELS[key] = LIN.load_registry(spark, LIN.save_registry(spark, names, IO.scratch_path(spark, "registry")))
    return _MODELS[key]


def fitted_model(spark, sf_dir):
    """The registered model of full texts."""
    return fitted_models(spark, sf_dir)[("trafilatura_fulltext", "xlmroberta", "finetuning")]


@query("m1_train_classifier")
def m1_train_classifier(spark, sf_dir):
    return LEARN.training_summary(fitted_model(spark, sf_dir), spark)


def _epoch_log(spark, sf_dir):
    """The log of a training run with epochs, as log rows."""
    sp, path = training_splits(spark, sf_dir), IO.scratch_path(spark, "m1-run")
    LEARN.train_by_epochs(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "dev"), path, max_iter=10, tol=0.0)
    return RUNS.log_of_runs(spark, {("finetuning", "xlmroberta", "trafilatura_fulltext"): f"{path}/logs"})


@query("m1_epoch_log")
def m1_epoch_log(spark, sf_dir):
    """O12 over the log of a real training run: dev metrics after each of ten epochs."""
    return RUNS.metric_evolution(_epoch_log(spark, sf_dir))


@query("m1_best_epoch")
def m1_best_epoch(spark, sf_dir):
    """O11 and J5 over the log of a real training run: its best step by dev F2 and the metrics at the best epoch."""
    log = cut_lineage(_epoch_log(spark, sf_dir), "m1-log")
    values = RUNS.value_at_epoch(log, RUNS.optimal_epochs(log, "eval_f_beta_2.0"))
    return RUNS.best_and_latest_step(log, "eval_f_beta_2.0").crossJoin(values.select("metric", "value"))


@query("m2_first_epoch_ids")
def m2_first_epoch_ids(spark, sf_dir):
    """Predicted ids of a model that has learned from all labelled documents for one epoch (a step down the
    gradient), for every document with a word: features, weights and scoring against plain SQL."""
    model = LEARN.train_classifier(training_table(spark, sf_dir), max_iter=1)
    out = LEARN.predict(docs(spark, sf_dir), model, keep=["doc_id", "text"])
    return out.where(T.token_count("text") > 0).select("doc_id", "prediction_id")


@query("m2_predict")
def m2_predict(spark, sf_dir):
    test = training_splits(spark, sf_dir).where(F.col("split") == "test")
    return LEARN.predict(test, fitted_model(spark, sf_dir), keep=["doc_id", "labels"])


@query("m2_predicted_rows")
def m2_predicted_rows(spark, sf_dir):
    """Which rows M2 scores, with labels, and that each has two probabilities that sum to one."""
    p = m2_predict(spark, sf_dir)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x["score"])
    return p.select("doc_id", "labels", F.size("probabilities").cast("bigint").alias("n_probabilities"),
                    (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("m3_positive_probability")
def m3_positive_probability(spark, sf_dir):
    top = o2_top_label(spark, sf_dir)
    return top.select("doc_id", M.positive_probability(F.col("top_label"), F.col("top_score"), "relevant")
                      .alias("probabilities_for_positive_label"))


@query("m4_evaluate")
def m4_evaluate(spark, sf_dir):
    test = training_splits(spark, sf_dir).where(F.col("split") == "test")
    return LEARN.evaluate(test, fitted_model(spark, sf_dir), out_dir=IO.scratch_path(spark, "m4"))


@query("m5_report")
def m5_report(spark, sf_dir):
    return LEARN.report(training_splits(spark, sf_dir), fitted_model(spark, sf_dir))


@query("m6_cross_validate")
def m6_cross_validate(spark, sf_dir):
    t = training_table(spark, sf_dir).withColumn("text", T.clean_text(F.col("text")))
    return LEARN.cross_validate(t, metric="f1")


@query("m6_fold_sizes")
def m6_fold_sizes(spark, sf_dir):
    """The folds that M6 trains and validates on: rows and positives of each."""
    folds = O.stratified_kfold(training_table(spark, sf_dir).select("doc_id", "labels"), "doc_id", "labels", 10)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("labels").alias("n_positive"))


@query("m7_sweep")
def m7_sweep(spark, sf_dir):
    sp = training_splits(spark, sf_dir)
    configs = [{"reg_param": 0.01}, {"reg_param": 0.1}, {"max_iter": -1}]
    return LEARN.sweep(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "dev"), configs)


@query("m8_final_score")
def m8_final_score(spark, sf_dir):
    return LEARN.final_score(m5_report(spark, sf_dir), "f_beta_2_0")


# ---------------------------------------------------------------- I: inference

def _raw_docs(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.lit(None).cast("string").alias("xml_tei"), "trafilatura_title",
                                        "trafilatura_abstract", "trafilatura_fulltext", "translation_title")


def _page_docs(spark, sf_dir):
    return pages(spark, sf_dir).select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("xml_tei"),
        *[F.lit(None).cast("string").alias(c) for c in ("trafilatura_title", "trafilatura_abstract",
                                                         "trafilatura_fulltext", "translation_title")])


@query("i1_classify")
def i1_classify(spark, sf_dir):
    long = CL.document_contents(_raw_docs(spark, sf_dir))
    return CL.classify(long, fitted_models(spark, sf_dir))


@query("i1_first_epoch_ids")
def i1_first_epoch_ids(spark, sf_dir):
    """I1 with a registry of two models, each of which has learned from half of the labelled documents
    (even and odd doc_id) for one epoch: the predicted id of every kept content source that has a word."""
    rows = LIN.training_rows(training_table(spark, sf_dir), "text", "labels", F.expr("if(doc_id % 2 = 0, 1, 2)"))
    training = LIN.fit_many(rows, [LIN.Spec(max_iter=1)] * 2)
    even, odd = (fit.model(training.vocabulary) for fit in training.fits)
    registry = {(s, m, t): even if t == "finetuning" else odd for s, m, t in CL.one_model_for_all(even)}
    out = CL.classify(CL.document_contents(_raw_docs(spark, sf_dir)), registry)
    return out.where("kept").select("doc_id", "content_source", "bert_model_name", "training_method", "prediction_id")


@query("i2_classify_documents")
def i2_classify_documents(spark, sf_dir):
    return CL.classify_documents(_page_docs(spark, sf_dir), fitted_models(spark, sf_dir), tags=X.PAGE_TAGS)


@query("i2_gate")
def i2_gate(spark, sf_dir):
    """I2 up to the gate: every content source of every page, kept or why not."""
    long = CL.gate(CL.document_contents(_page_docs(spark, sf_dir), tags=X.PAGE_TAGS))
    return long.select("doc_id", "content_source", "kept", "reason")


@query("i1_gate")
def i1_gate(spark, sf_dir):
    """I1 up to the gate: every content source of every document."""
    return CL.gate(CL.document_contents(_raw_docs(spark, sf_dir))).select("doc_id", "content_source", "kept", "reason")


@query("i3_classify_stream")
def i3_classify_stream(spark, sf_dir):
    from ..streaming.classify_stream import run_to_completion
    base = IO.scratch_path(spark, "i3")
    _page_docs(spark, sf_dir).repartition(4).write.mode("overwrite").parquet(f"{base}/incoming")
    return run_to_completion(spark, f"{base}/incoming", f"{base}/results", f"{base}/checkpoint",
                             fitted_models(spark, sf_dir), tags=X.PAGE_TAGS)


@query("i3_nested_stream")
def i3_nested_stream(spark, sf_dir):
    """One nested result a page from a stream in which every page comes twice, five minutes apart in event
    time: the repeated texts are dropped as already classified."""
    from datetime import datetime, timedelta

    from ..streaming import classify_stream as STREAM
    base = IO.scratch_path(spark, "i3n")
    docs, first = _page_docs(spark, sf_dir), datetime(2024, 1, 1)
    minute = F.make_interval(mins=F.pmod(F.xxhash64("doc_id"), F.lit(30)).cast("int"))
    timed = docs.withColumn("received", F.lit(first) + minute)
    timed.unionByName(timed.withColumn("received", F.col("received") + F.expr("INTERVAL 5 MINUTES"))).repartition(4).write.parquet(
        f"{base}/incoming")
    STREAM.close_stream(spark, f"{base}/incoming", first + timedelta(days=1))
    return STREAM.nested_to_completion(spark, f"{base}/incoming", f"{base}/results", f"{base}/checkpoint",
                                       fitted_models(spark, sf_dir), tags=X.PAGE_TAGS)


@query("i4_gate_report")
def i4_gate_report(spark, sf_dir):
    return CL.gate_report(corpus(spark, sf_dir))


# ---------------------------------------------------------------- E: end-to-end plans

from . import prepare as PREP  # noqa: E402


def raw_with_markup(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.withColumn("trafilatura_extracted_xml_tei", PREP.markup_of(
        F.col("trafilatura_title"), F.col("trafilatura_abstract"), F.col("trafilatura_fulltext")))


@query("e1_prepare")
def e1_prepare(spark, sf_dir):
    return PREP.prepare(raw_with_markup(spark, sf_dir), few_shot=(50,))


#: Records in one file of E1's CSV table: a compressed file is read by one task.
CSV_RECORDS = 10_000


@query("e1_prepare_files")
def e1_prepare_files(spark, sf_dir):
    """E1 from a CSV table to written datasets and splits, read back."""
    base = IO.scratch_path(spark, "e1")
    raw = raw_with_markup(spark, sf_dir)
    with shuffles_dropped(spark):
        path = IO.write_csv(raw.select(*[c.strip().split()[0] for c in PREP.RAW_SCHEMA.split(",")]), f"{base}/input",
                            compression="gzip", maxRecordsPerFile=CSV_RECORDS)
    return PREP.split_table(spark, PREP.prepare_files(spark, path, f"{base}/out", few_shot=(50,)))


@query("e2_compare_runs")
def e2_compare_runs(spark, sf_dir):
    """Run files written and read back, compared, and the runs that are worth keeping."""
    logs, metrics = RUNS.write_run_files(RUNS.run_metrics(spark, sf_dir), IO.scratch_path(spark, "e2"))
    return RUNS.compare_runs(RUNS.read_run_files(spark, logs, metrics), model_names(spark))["selected"]

"""Classify documents with a model registry.

A document carries up to four content sources. Markup, when present, is
parsed once (X1) and *replaces* title, abstract and full text -- even with
nulls. Every source is cleaned (T16), unpivoted to long rows, gated (F8), its
words are hashed once, and one pass scores all distinct models of the registry
that are meant for the source; then the rows are matched to the registry's
entries (J3, broadcast registry of fixed size). Everything up to the optional
nested re-grouping is stateless, so the same function runs on a stream (I3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import extract_fields
from ..functions.rules import quality_gate
from ..functions.text import clean_text, content_type_col
from ..operators.relate import CONTENT_SOURCES
from ..session import cut_lineage
from . import linear
from .learn import LABEL_NAMES, with_probabilities

SOURCE_COLUMNS = {
    "trafilatura_title": "trafilatura_title",
    "trafilatura_abstract": "trafilatura_abstract",
    "trafilatura_fulltext": "trafilatura_fulltext",
    "translated_title": "translation_title",
}
RESULT_COLUMNS = ("doc_id", "content_source", "bert_model_name", "training_method", "kept", "reason",
                  "prediction", "prediction_id", "probabilities")
_PRED_TYPE = "array<struct<label:string,score:double>>"


def gate(long_df: DataFrame) -> DataFrame:
    """I1, first half: (kept, reason) per (document, source) row."""
    g = quality_gate(F.col("text"), content_type_col("content_source"))
    return long_df.withColumn("_g", g).select(*long_df.columns, F.col("_g.kept").alias("kept"),
                                              F.col("_g.reason").alias("reason"))


def _registry_df(spark, rows) -> DataFrame:
    return spark.createDataFrame(sorted(rows), "content_source string, bert_model_name string, training_method string, _m int")


def classify(long_df: DataFrame, models: dict, extra=()) -> DataFrame:
    """Gate, score kept rows, then fan out to the registered models (J3); columns `extra` stay.

    `models` maps (content_source, bert_model_name, training_method) -- the
    registry -- to a ``linear.LinearModel``; entries may share one. The gate
    and the words of a text are computed once, and one pass over the rows
    scores every distinct model that is registered for a row's source; only
    then are the rows multiplied out to registry entries, through a broadcast
    of the registry rows (fixed size). Rejected rows get null prediction fields.

    No filter is put on the gate result: Catalyst would push it below the
    projection and evaluate the gate twice. Rejected rows are instead scored
    on an empty text (trivial work) and their prediction fields nulled.
    """
    spark = long_df.sparkSession
    distinct, entries, sources = [], [], []
    for key, model in sorted(models.items(), key=lambda x: x[0]):
        at = next((i for i, m in enumerate(distinct) if m is model), None)
        if at is None:
            at = len(distinct)
            distinct.append(model)
            sources.append(set())
        sources[at].add(key[0])
        entries.append((*key, at))
    if len({m.size for m in distinct}) != 1:
        raise ValueError("the models of a registry share their number of features")
    gated = gate(long_df.select("doc_id", "content_source", "text", *extra).where(F.col("content_source").isin(*{k[0] for k in models})))
    made = gated.select("doc_id", "content_source", "kept", "reason", *extra,
                        linear.features(F.when(F.col("kept"), F.col("text")), distinct[0].size).alias("f"))
    if len(distinct) > 1 and not long_df.isStreaming:
        # parsing, cleaning and the gate cost far more than the scores: what they give is stored
        made = cut_lineage(made, "classify-words")
    scored = linear.score(made, distinct, ["doc_id", "content_source", "kept", "reason", *extra], "content_source", sources)
    matched = scored.join(F.broadcast(_registry_df(spark, entries)), "content_source")
    p = F.when(F.col("kept"), F.get("p", F.col("_m")))
    keep = ["doc_id", "content_source", "bert_model_name", "training_method", "kept", "reason", *extra]
    return with_probabilities(matched.withColumn("p", p), F.col("p"), keep, LABEL_NAMES).select(*RESULT_COLUMNS, *extra)


def document_contents(docs: DataFrame, markup_col: str = "xml_tei", tags=None, extra=()) -> DataFrame:
    """I2, front half: parse markup where present, clean all four sources, unpivot.

    `tags` names the elements that hold the fields (X1's by default).

    Output: (doc_id, extra..., content_source, text) for non-null cleaned sources.
    """
    has = F.col(markup_col).isNotNull()
    parsed = docs.withColumn("_p", F.when(has, extract_fields(F.col(markup_col), tags)))
    cols = {
        "trafilatura_title": F.when(has, F.col("_p.title")).otherwise(F.col("trafilatura_title")),
        "trafilatura_abstract": F.when(has, F.col("_p.abstract")).otherwise(F.col("trafilatura_abstract")),
        "trafilatura_fulltext": F.when(has, F.col("_p.fulltext")).otherwise(F.col("trafilatura_fulltext")),
        "translated_title": F.col("translation_title"),
    }
    wide = parsed.select("doc_id", *extra, *[clean_text(c).alias(name) for name, c in cols.items()])
    long = wide.unpivot(["doc_id", *extra], list(CONTENT_SOURCES), "content_source", "text")
    return long.where(F.col("text").isNotNull())


def classify_documents(docs: DataFrame, models: dict, markup_col: str = "xml_tei",
                       nested: bool = False, tags=None) -> DataFrame:
    """Documents -> one result row per (document, source, registered model).

    With `nested=True` the rows are gathered back per document (a document's
    results are bounded by sources x models).
    """
    out = classify(document_contents(docs, markup_col, tags), models)
    if not nested:
        return out
    return out.groupBy("doc_id").agg(nested_results().alias("results"))


def nested_results():
    """The results of one document as an array, in the order of source, model and method."""
    return F.sort_array(F.collect_list(F.struct(*[c for c in RESULT_COLUMNS if c != "doc_id"])))


def gate_report(docs: DataFrame, markup_col: str | None = None, tags=None) -> DataFrame:
    """I4: rejected and kept counts by (content_source, reason)."""
    if markup_col:
        long = document_contents(docs, markup_col, tags)
    else:
        wide = docs.select("doc_id", *[clean_text(F.col(c)).alias(s) for s, c in SOURCE_COLUMNS.items()])
        long = wide.unpivot(["doc_id"], list(CONTENT_SOURCES), "content_source", "text").where(F.col("text").isNotNull())
    return gate(long).groupBy("content_source", "reason").agg(F.count(F.lit(1)).alias("n"))


def one_model_for_all(model: linear.LinearModel) -> dict:
    """Registry mapping every (source, model name, method) combination to one fitted model."""
    from ..operators.relate import BERT_MODELS, TRAINING_METHODS
    return {(s, m, t): model for s in CONTENT_SOURCES for m in BERT_MODELS for t in TRAINING_METHODS}

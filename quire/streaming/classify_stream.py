"""Classify arriving documents with Structured Streaming.

The original serves one request at a time; here new document files landing
in a folder are classified incrementally. Two forms:

* ``classify_stream``: long rows. The per-document work of I2 is stateless
  (parse, clean, unpivot, gate, score, stream-static join with the broadcast
  registry), so no watermark or state store is involved and the output is
  append-only.
* ``classify_nested_stream``: one nested result a document, as the batch form
  ``classify_documents(nested=True)`` gives it. A document's sources may come
  in several files and micro-batches, and more than once. Two states, both
  bounded by the watermark on ``received``: a text that its document has had
  classified already is dropped before it is scored, and the results of a
  document wait in a session until no more of them can come.

``availableNow`` processes everything that is there and stops, which keeps
the jobs restartable from their checkpoints after a failure (exactly-once
file sink); the states go on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.classify import classify, classify_documents, document_contents, nested_results

DOC_SCHEMA = ("doc_id long, xml_tei string, trafilatura_title string, trafilatura_abstract string, "
              "trafilatura_fulltext string, translation_title string")
#: Documents with the time when they arrived.
TIMED_SCHEMA = DOC_SCHEMA + ", received timestamp"


def _documents(spark: SparkSession, source_dir: str, schema: str, max_files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)


def _start(out: DataFrame, sink_dir: str, checkpoint: str):
    return (out.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(sink_dir))


def classify_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, models: dict,
                    max_files_per_trigger: int = 64, tags=None):
    """Start the stream (parquet files -> classification -> parquet sink); returns the query."""
    stream = _documents(spark, source_dir, DOC_SCHEMA, max_files_per_trigger)
    return _start(classify_documents(stream, models, tags=tags), sink_dir, checkpoint)


def run_to_completion(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                      models: dict, tags=None) -> DataFrame:
    q = classify_stream(spark, source_dir, sink_dir, checkpoint, models, tags=tags)
    q.awaitTermination()
    return spark.read.parquet(sink_dir)


def classify_nested_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, models: dict,
                           late: str = "1 hour", gap: str = "1 hour", max_files_per_trigger: int = 64, tags=None):
    """Start the stream of nested results (doc_id, results); returns the query.

    Rows that are more than `late` behind the newest one may be dropped. A document's
    results come out once the watermark is `gap` past its last row; rows of its own that
    arrive after that are a document of their own. ``close_stream`` lets the last ones out.
    """
    docs = _documents(spark, source_dir, TIMED_SCHEMA, max_files_per_trigger).withWatermark("received", late)
    long = document_contents(docs, tags=tags, extra=("received",))
    fresh = long.withColumn("_text", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["doc_id", "content_source", "_text"])
    rows = classify(fresh.drop("_text"), models, extra=("received",))
    nested = rows.groupBy("doc_id", F.session_window("received", gap)).agg(nested_results().alias("results"))
    return _start(nested.select("doc_id", "results"), sink_dir, checkpoint)


def close_stream(spark: SparkSession, source_dir: str, received) -> None:
    """Put a row without contents into the source folder, so that the watermark reaches `received` less the lateness."""
    names = [f.split()[0] for f in TIMED_SCHEMA.split(", ")]
    row = tuple(received if n == "received" else None for n in names)
    spark.createDataFrame([row], TIMED_SCHEMA).coalesce(1).write.mode("append").parquet(source_dir)


def nested_to_completion(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, models: dict, tags=None,
                         **options) -> DataFrame:
    classify_nested_stream(spark, source_dir, sink_dir, checkpoint, models, tags=tags, **options).awaitTermination()
    return spark.read.schema(_NESTED).parquet(sink_dir)


_NESTED = ("doc_id bigint, results array<struct<content_source: string, bert_model_name: string, training_method: string, kept: boolean, "
           "reason: string, prediction: string, prediction_id: int, probabilities: array<struct<label: string, score: double>>>>")

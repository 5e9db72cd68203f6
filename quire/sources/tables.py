"""Input tables and the corpus views derived from them.

The given parquet tables are mapped onto the domain schema of the original

* ``raw_corpus``: documents LEFT JOIN labels. A document's first line is its
  title, its second line its abstract, the whole text its full text; English
  titles double as the "translated title". ``sujet`` (the subject) is the
  document's source when it is labelled toxic.
* ``training_table``: labelled documents as (doc_id, text, labels=quality).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CONTENT_COLUMNS = ("trafilatura_title", "trafilatura_abstract", "trafilatura_fulltext", "translation_title")


def table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Session setting: deal the rows of a bare scan to so many partitions (off unless set).
SPREAD = "spark.quire.scanPartitions"


def spread(df: DataFrame) -> DataFrame:
    """A bare scan, dealt out anew where the session asks for it.

    For runs over one small file, whose single split would leave all cores but
    one idle; the local bench sets it. No plan is run to find that out.
    """
    want = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(want)) if want else df


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]))
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    lines = F.split(F.col("text"), "\n")
    return (
        docs.join(labels, "doc_id", "left")
        .select(
            "doc_id",
            F.substring_index("text", "\n", 1).alias("trafilatura_title"),
            F.get(lines, 1).alias("trafilatura_abstract"),
            F.col("text").alias("trafilatura_fulltext"),
            F.when(F.col("lang") == "en", F.substring_index("text", "\n", 1)).alias("translation_title"),
            F.when(F.col("toxic") == 1, F.col("source")).alias("sujet"),
            "quality",
            "lang",
        )
    )


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled training table: (doc_id, text, labels)."""
    docs = spread(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return docs.join(labels, "doc_id").select("doc_id", "text", F.col("quality").alias("labels"))

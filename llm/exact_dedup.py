"""Exact dedup against a persistent digest index.

The index is a table (digest, doc_id) bucketed and sorted by digest. New data is reduced to
its distinct digests (partial maxima before the shuffle), anti-joined with the index by
sort-merge -- the index side needs no shuffle -- and what is new is appended, bucket by
bucket. Data that is fed from the largest doc_ids down therefore keeps the largest one.

Texts are equal when identical, no normalisation. Defined cases: a null text equals an
empty one; of equal rows with the same doc_id one row counts as kept; null doc_ids come
last, and stay only where no other row has the text; other columns are ignored; an empty
table gives an empty result and adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir, cut_lineage

from .common import free_name, id_and_text, join_groups

class DigestIndex:
    """A bucketed and sorted table of digests; `path` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, doc_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.path = path

    @classmethod
    def fresh(cls, spark: SparkSession) -> DigestIndex:
        """A new, empty index in the shared folder, with a bucket for each shuffle partition."""
        name = f"digests_{uuid.uuid4().hex[:12]}"
        return cls(spark, name, f"{checkpoint_dir(spark).rstrip('/')}/quire-index/{name}",
                   int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append the digests of `rows` (digest, doc_id) that the index lacks, with their largest doc_id."""
        # stored, as the optimiser would else push the anti-join below the maxima, to all rows of a hot text
        first = cut_lineage(rows.groupBy("digest").agg(F.max("doc_id").alias("doc_id")), "digests-first")
        new = first.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        (new.repartition(self.buckets, "digest").write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest), stored: texts are read and hashed once."""
    return cut_lineage(id_and_text(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("digest")), "digests")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`; adds them to `index`.

    The rows are fed in two batches, the upper half of the doc_ids first.
    """
    rows = digests(docs)
    index = index or DigestIndex.fresh(rows.sparkSession)
    middle = rows.agg(F.percentile_approx("doc_id", 0.5), F.count(F.lit(1))).first()
    upper = F.coalesce(F.col("doc_id") > F.lit(middle[0]), F.lit(False))
    index.add(rows.where(upper))
    index.add(rows.where(~upper))

    own = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last"))
    groups = own.join(index.read().withColumnRenamed("doc_id", "keep_id"), "digest")
    return join_groups(rows, groups, ["digest"], "group_size", middle[1]).select(
        "doc_id", "keep_id", "group_size", ((F.col("row") == F.col("last.row")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """`docs` with one row of each text: the largest doc_id's."""
    digest = free_name(docs, "digest")
    result = exact_duplicates(docs, index)
    pair = ["doc_id", F.col("text_sha256").alias(digest)]
    drop = result.where("not kept").select(*pair).subtract(result.where("kept").select(*pair))
    marked = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    on = [marked["doc_id"].eqNullSafe(drop["doc_id"]), marked[digest] == drop[digest]]
    # what is left of equal rows with one doc_id shares their partition already
    return marked.join(drop, on, "left_anti").dropDuplicates(["doc_id", digest]).select(docs.columns)

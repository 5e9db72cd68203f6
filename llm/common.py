"""What the operators share: their input columns and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: str = "text") -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null.

    Each word becomes one letter and the white space goes; an array of all words, as
    ``regexp_count`` makes one, would fill the executors' memory with garbage.
    """
    short = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(short, "\x20\t\n\x0b\x0c\r", "")).cast("bigint")


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of whatever columns `docs` has; a null text is empty."""
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))


#: Groups with more than this share of the rows are broadcast: at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """`rows` inner-joined with `groups`, which has one row per key and its number of rows in `size`.

    Large groups are broadcast, so none of their rows are shuffled to one task; the rest
    meet in a sort-merge join whose keys have few rows each.
    """
    hot = groups.where(F.col(size) > max(1, int(total * HOT_SHARE)))
    found = rows.join(F.broadcast(hot), on, "left")
    rest = found.where(F.col(size).isNull()).select(rows.columns).join(groups, on)
    return found.where(F.col(size).isNotNull()).select(rest.columns).unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of `edges` (a, b); label: the smallest node reachable.

    Alternates "large star" and "small star" (Kiveris et al. 2014): each node's larger,
    then its smaller, neighbours are hooked onto its smallest one, until every edge points
    at its component's smallest node. Each step is a partial minimum and a join, so no task
    holds a component; only a count and a checksum of the edges come to the driver.
    """
    def key(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges, name)
    before = key(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.where("a <> b").distinct(), name)
        after = key(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())

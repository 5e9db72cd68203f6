"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the K smallest distinct hashes of a document's shingles, ascending. Sketches
of a document's parts merge into the sketch of the whole: the K smallest of their union.
From two sketches: the resemblance is the share of the K smallest of the union that both
hold; the distinct shingle count follows from the K-th smallest hash; containment and
intersection follow from both. With fewer than K shingles all are exact.

Words are lower-cased (A-Z) runs between white space, WORDS of them a shingle. Only built-in
functions run; a document's shingles stay inside its row, so nothing is shuffled for them.

Defined cases: a null text is empty; a text without words has an empty sketch, which
resembles another empty one by 1 and any other by 0; a text with fewer words than a shingle
has the whole sequence as its one shingle; other columns are ignored; an empty table
gives an empty result. The next document is the next row in the order of (doc_id, text),
null doc_ids being before all others; the last row's is the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text

WORDS = 5
K = 256
#: Hashes are shifted to 63 bits, so that they are not negative.
TOP = float(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    spaced = F.translate(text, UPPER + "\t\n\x0b\x0c\r", LOWER + "     ")
    return F.transform(F.filter(F.split(spaced, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """Hashes of all runs of `n` words, not distinct, from an array column of word hashes."""
    first = F.sequence(F.lit(1), F.size(words) - n + 1)
    many = F.transform(first, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(n)]), 1))
    one = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(words.cast("array<string>"), " ")), 1))
    return F.when(F.size(words) >= n, many).when(F.size(words) > 0, one).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merge(x: Column, y: Column, k: int = K) -> Column:
    return bottom(F.concat(x, y), k)


def merge_parts(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """(key, sketch): the sketches of all parts of a key merged; no task gathers a key's parts.

    The K smallest hashes of a key are found by ranks in two steps, first inside 64 salts.
    """
    rows = parts.select(key, F.explode_outer(sketch).alias("h")).distinct()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(64)))
    for by in ((key, "salt"), (key,)):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("h")))).where(F.col("r") <= k)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias(sketch))


def resemblance(x: Column, y: Column, k: int = K) -> Column:
    """Estimated |A & B| / |A | B| of the sets behind two sketches."""
    union = merge(x, y, k)
    both = F.array_intersect(x, y)
    return F.when(F.size(union) == 0, 1.0).otherwise(
        F.size(F.array_intersect(both, union)).cast("double") / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(x: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(x) < k, F.size(x).cast("double")).otherwise((k - 1) * TOP / F.element_at(x, k))


def containment(x: Column, y: Column, k: int = K) -> Column:
    """Estimated |A & B| / |A|."""
    both = resemblance(x, y, k) * distinct_shingles(merge(x, y, k), k)
    return F.when(F.size(x) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(x, k)))


def as_text(sketch: Column) -> Column:
    """A sketch as hexadecimal digits, 16 a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprint(docs: DataFrame, n: int = WORDS, k: int = K) -> DataFrame:
    """`docs` (any columns with a text) with `sketch`."""
    return (docs.withColumn("words", word_hashes(F.coalesce("text", F.lit(""))))
            .withColumn("sketch", bottom(shingle_hashes(F.col("words"), n), k)).drop("words"))


def range_starts(keys: DataFrame) -> list[int]:
    """The first key of each of at most four times as many ranges of `keys` (key) as there are shuffle partitions."""
    parts = 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    return sorted(r["key"] for r in ranged.collect())


def place(key: Column, starts: list[int]) -> Column:
    """Which range a key is in, from 0, found in two steps of about the root of their number."""
    step = max(int(len(starts) ** 0.5), 1)
    coarse = F.size(F.filter(F.lit(starts[::step]), lambda s: s <= key)) - 1
    return coarse * step + F.size(F.filter(F.slice(F.lit(starts), coarse * step + 1, step), lambda s: s <= key)) - 1


def with_next(rows: DataFrame) -> DataFrame:
    """`rows` (key, text, sketch to be) with next_text and next_sketch, those of the next row.

    Rows are shuffled once, to ranges of keys; the first row of each range goes to the
    range before it too, as the next one of that range's last row. No task orders all rows.
    """
    starts = range_starts(rows.select("key"))
    if not starts:
        return fingerprint(rows).select("*", F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    part = place(F.col("key"), starts)
    here = F.struct(part.alias("part"), F.lit(False).alias("ghost"))
    before = F.struct(F.pmod(part - 1, F.lit(len(starts))).alias("part"), F.lit(True).alias("ghost"))
    to = F.when(F.col("key").isin(starts), F.array(here, before)).otherwise(F.array(here))
    sent = rows.withColumn("to", F.explode(to)).select(*rows.columns, "to.part", "to.ghost").repartition("part")
    following = Window.partitionBy("part").orderBy("ghost", "key", "text")
    found = fingerprint(sent).withColumn("next_text", F.lead("text").over(following)).withColumn(
        "next_sketch", F.lead("sketch").over(following))
    return found.where("not ghost").drop("part", "ghost")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text: the last floor(n_chars / 4) characters replaced by the first as many of
    the next document.
    """
    rows = id_and_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-2**63)))
    both = with_next(rows).withColumn("n_chars", F.length("text").cast("bigint"))
    both = both.withColumn("edited", F.expr(
        "left(text, cast(n_chars - floor(n_chars / 4) as int)) || left(next_text, cast(floor(n_chars / 4) as int))"))
    both = both.select("doc_id", "n_chars", F.col("sketch").alias("own"), "next_sketch", F.col("edited").alias("text"))
    both = fingerprint(both)
    return both.select("doc_id", "n_chars", F.sha2("text", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
                       as_text(F.col("sketch")).alias("edited_fingerprint"),
                       resemblance(F.col("own"), F.col("sketch")).alias("near_edited"),
                       resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"))

"""Importance resampling towards a target distribution, ranked by a distributed LSD radix sort.

Weights are scored with arrays: a task turns each text's words into bucket numbers, counts
them in one array of ``buckets`` cells (the corpus and the target alike), and a second pass
looks the documents' buckets up in the array of log-ratio gains. A document's score is its
weight plus Gumbel noise from a hash of its id, so the highest scores are a draw without
replacement by weight.

The draw is sorted by the composite key (score down, doc_id up, null ids last), digit by
digit from the least significant one. A pass is a stable counting sort over all partitions:

* every (part, digit) is counted;
* the exclusive prefix over digits, and inside a digit over the parts in order, is where
  that digit of that part begins in the output;
* a row's destination is that offset plus the number of rows of the same digit before it in
  its part; destinations are dense, so ``part = destination // rows`` deals the next pass
  equal parts whatever the ties or the skew of the keys.

After the last pass the destination is the rank. Each pass is stored, so a lost executor
costs one part of one pass. Rows below the lowest score that can be drawn -- exact, from the
counts of the integer scores -- need no rank and skip the passes.

To the driver come one row per bucket, per distinct integer score and per digit value
(``2**DIGIT_BITS`` at most); a task holds at most about PART_ROWS rows of a part.

Defined cases: a null text has no words; a document without features has weight 0; null
doc_ids hash as an empty id and come last among ties; repeated rows are ranked one by one;
an empty target makes every gain that of no target counts; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

from . import words
from .common import free_name, id_and_text

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
DIGIT_BITS = 16
PART_ROWS = 1 << 18
#: What separates words: every byte of `[\x00-\x2F\x3A-\x60\x7B-\x7F]`, upper-case letters taken as lower case.
TABLE = words.byte_table(b for b in range(128) if not chr(b).isalnum())


def text_buckets(data: bytes, buckets: int, longest: int) -> tuple[np.ndarray, int]:
    """(bucket of every run of 1 to `longest` words of a text, number of its words).

    The CRC of a longer run goes on from that of the run without its last word.
    """
    parts, count, tail = [], 0, []
    for piece in words.word_pieces(data, TABLE):
        count += len(piece)
        crc = np.fromiter(map(zlib.crc32, piece), np.uint32, len(piece))
        parts.append(crc % np.uint32(buckets))
        if longest > 1:
            piece = tail + piece
            runs = [zlib.crc32(w) for w in piece]
            for n in range(2, longest + 1):
                runs = [zlib.crc32(b" " + piece[i + n - 1], c) for i, c in enumerate(runs[: max(len(piece) - n + 1, 0)])]
                # of the words carried over, only runs that end in this piece are new
                new = runs[max(len(tail) - n + 1, 0):]
                parts.append(np.array(new, np.uint32) % np.uint32(buckets))
            tail = piece[-(longest - 1):]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)).astype(np.int64), count


def _texts(batch: pa.RecordBatch):
    data, at = words.text_buffer(batch.column(batch.schema.get_field_index("text")))
    return (data[a:b].tobytes() for a, b in zip(at[:-1], at[1:]))


def bucket_counts(docs: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in words.slices(batches):
            for text in _texts(b):
                total += np.bincount(text_buckets(text, buckets, longest)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The whole-number gain of each bucket, from counts of the corpus and of the target."""
    over, under = float(s.sum() + len(s)), float(t.sum() + len(t))
    return np.array([math.floor(1000 * math.log(float(b + 1) * over / (float(a + 1) * under)))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of `docs` (doc_id, text)."""
    def run(batches):
        for b in words.slices(batches):
            count, size, total = (np.zeros(len(b), np.int64) for _ in range(3))
            for i, text in enumerate(_texts(b)):
                found, count[i] = text_buckets(text, len(gain), longest)
                size[i], total[i] = len(found), gain[found].sum()
            weight = np.where(size > 0, total // np.maximum(size, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (count, size, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def with_score(df: DataFrame, seed: int) -> DataFrame:
    """`df` with `score`: weight plus the Gumbel noise of its id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return df.withColumn("score", F.col("weight") + noise)


def digits(df: DataFrame, low: int, high: int, top: int, span: int, nulls: bool) -> list:
    """The composite key's digits as columns, least significant first.

    Fields, least significant first: doc_id's bits below the highest in which the least and
    the largest id differ (sign bit flipped, so that order is unsigned order), one bit for a
    null id, and how far the score is below `top`.
    """
    def cut(col, bits):
        count = -(-bits // DIGIT_BITS)
        width = -(-bits // max(count, 1))
        return [(F.shiftrightunsigned(col, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int"), width)
                for i in range(count)]

    ident = F.coalesce(F.col("doc_id"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
    bits = ((low ^ high) & ((1 << 64) - 1)).bit_length()
    score = F.lit(top) - F.col("score")
    if nulls:
        score, span = score * 2 + F.col("doc_id").isNull().cast("int"), 2 * span + 1
    return cut(ident, bits) + cut(score, span.bit_length())


def counting_pass(rows: DataFrame, digit, per_part: int) -> DataFrame:
    """One stable counting sort of `rows` (part, pos, ...): their new positions and parts."""
    rows = rows.withColumn("digit", digit)
    counts = cut_lineage(rows.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("n")), "resample-counts")
    total = {r["digit"]: r["n"] for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect()}  # 2**DIGIT_BITS at most
    known = np.array(sorted(total), np.int64)
    begins = np.cumsum([0, *(total[d] for d in known.tolist())])[:-1]
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("digit").orderBy("part")) - F.col("n"))
    columns = [c for c in rows.columns if c not in ("part", "pos", "digit")]

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(np.argsort(left.column("pos").to_numpy(), kind="stable"))
        digit = left.column("digit").to_numpy()
        order = np.argsort(digit, kind="stable")
        left, digit = left.take(order), digit[order]
        first = np.flatnonzero(np.append(True, digit[1:] != digit[:-1])) if len(digit) else np.zeros(0, np.int64)
        mine = right.column("digit").to_numpy()
        by = np.argsort(mine)
        start = begins[np.searchsorted(known, digit[first])] + right.column("before").to_numpy()[by][
            np.searchsorted(mine[by], digit[first])]
        run = np.diff(np.append(first, len(digit)))
        dest = np.repeat(start - first, run) + np.arange(len(digit))
        return pa.table([pa.array(dest // per_part), pa.array(dest), *(left.column(c) for c in columns)],
                        names=["part", "pos", *columns])

    schema = "part bigint, pos bigint, " + ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in columns)
    moved = rows.groupBy("part").cogroup(offsets.select("part", "digit", "before").groupBy("part")).applyInArrow(place, schema)
    return cut_lineage(moved, "resample-pass")


def radix_ranked(rows: DataFrame, total: int, top: int, least: int) -> DataFrame:
    """`rows` (row, doc_id, score, ...) with `pos`: their place by score down, doc_id up.

    `total`: number of rows; `top` and `least`: the largest and smallest score.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    per_part = max(-(-total // parts), 1)
    low, high, nulls = rows.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.col("doc_id").isNull())).first()
    rows = rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), F.col("row").alias("pos"),
                       *[c for c in rows.columns if c != "row"])
    for digit, _ in digits(rows, low or 0, high or 0, top, top - least, bool(nulls)):
        rows = counting_pass(rows, digit, per_part)
    return rows


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`; rank is null for what isn't drawn."""
    docs = id_and_text(docs)
    gain = gains(bucket_counts(docs, buckets, longest),
                 bucket_counts(target.select(F.coalesce("text", F.lit("")).alias("text")), buckets, longest))
    scored = cut_lineage(with_score(weights(docs, gain, longest), seed)
                         .withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    fit = F.col("n_words") >= min_words
    # whole thousandths of a logarithm: some ten thousand values, whatever the input
    found = sorted(((r["score"], r["n"]) for r in scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()),
                   reverse=True)
    draw = sum(n for _, n in found) * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    total, cutoff = 0, 0
    for score, n in found:
        total, cutoff = total + n, score
        if total >= draw:
            break
    can = fit & (F.col("score") >= cutoff)
    ranked = radix_ranked(scored.where(can).select("row", *columns), total, found[0][0], cutoff)
    rank = F.when(F.col("pos") < draw, F.col("pos") + 1)
    return ranked.select(*columns, rank.alias("rank")).unionByName(
        scored.where(~can).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **kw) -> DataFrame:
    """The rows of `docs` whose doc_id is drawn, with their rank in a column of a free name (`rank`)."""
    name = free_name(docs, "rank")
    drawn = resample(docs, target, **kw).where("rank is not null and doc_id is not null")
    drawn = drawn.groupBy("doc_id").agg(F.min("rank").alias(name))
    return docs.join(drawn, docs["doc_id"] == drawn["doc_id"]).select(*[docs[c] for c in docs.columns], name)

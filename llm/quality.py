"""Quality by compression: zstandard dictionaries built from good and bad labelled text.

A text is cut into pieces of PIECE bytes; each is compressed with the dictionary of the good
and with that of the bad texts. The difference of the compressed sizes, divided by the size
of the text, says which dictionary knows it better. A logistic calibration on labelled texts
that the dictionaries haven't seen turns it into the score (label 1 is good); each class
weighs there as much as all its labels.

Bounds, all parameters: at most SAMPLE labelled texts of each class reach the driver, the
smallest by a hash of doc_id; every second one trains the dictionaries (SAMPLE_BYTES of
each class at most), the others calibrate. All documents are scored over their whole text.

Defined cases: null text is empty; an empty text has no difference and gets the calibrated
score of 0; labels that are null, or whose doc_id is null, count as no label; if a class
has too few texts for a dictionary, every score is the share of good labels (1 without
labels); repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import id_and_text

THRESHOLD = 0.3
SAMPLE = 4000
SAMPLE_BYTES = 12 << 20
DICTIONARY = 112 << 10
LEVEL = 3
PIECE = 512


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def pieces(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


def dictionary(texts: list[str]) -> bytes | None:
    """A trained dictionary; None where there is too little text for one."""
    some, size = [], 0
    for t in texts:
        for p in pieces(t):
            if size < SAMPLE_BYTES and len(p) >= 16:
                some.append(p)
                size += len(p)
    if len(some) < 16:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(size // 8, 1024)), some).as_bytes()
    except zstandard.ZstdError:
        return None


class Measure:
    """The normalised difference of compressed sizes under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False,
            write_dict_id=False) for d in (good, bad)]

    def __call__(self, text: str) -> float:
        cut = pieces(text)
        good, bad = (sum(len(c.compress(p)) for p in cut) for c in self.by)
        return (bad - good) / max(sum(map(len, cut)), 1)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """At most SAMPLE (label, text) of each class, in the order of a hash; the labels of each class."""
    given = (labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    given = given.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64(F.lit(9), "doc_id"))
    count = {0: 0, 1: 0} | {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    some = [given.where(F.col("label") == y).orderBy("h", "doc_id").limit(SAMPLE) for y in (0, 1)]
    rows = docs.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")  # 2 * SAMPLE rows at most
    return [(r[0], r[1]) for r in rows.orderBy("h", "doc_id", "text").select("label", "text").collect()], count


def calibrate(x: np.ndarray, y: np.ndarray, weight=1.0, steps: int = 100) -> tuple[float, float]:
    """(a, b) of sigmoid(a x + b), by Newton steps."""
    w, m = np.zeros(2), np.stack([x, np.ones(len(x))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -40, 40)))
        step = np.linalg.solve((m * (weight * p * (1 - p))[:, None]).T @ m + 1e-4 * np.eye(2), m.T @ (weight * (p - y)) + 1e-4 * w)
        w -= np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame):
    """((good dictionary, bad dictionary) or None, a, b)."""
    rows, count = sample(docs, labels)
    by = {y: [t for label, t in rows if label == y] for y in (0, 1)}
    dictionaries = [dictionary(by[y][::2]) for y in (1, 0)]
    if None in dictionaries:
        share = (count[1] + 1) / (count[0] + count[1] + 1)
        return None, 0.0, float(np.log(share / (1 - share))) if share < 1 else 40.0
    measure = Measure(*dictionaries)
    rest = [(measure(t), y) for y in (0, 1) for t in by[y][1::2]]
    stands = np.array([max(count[y] / SAMPLE, 1.0) for _, y in rest])  # labels that a sampled one stands for
    a, b = calibrate(np.array([x for x, _ in rest]), np.array([y for _, y in rest], float), stands)
    return tuple(dictionaries), a, b


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, difference) for every row of `docs`."""
    docs = id_and_text(docs)
    dictionaries, a, b = fit(docs, labels)

    def run(batches):
        measure = Measure(*dictionaries) if dictionaries else lambda text: 0.0
        for batch in words.slices(batches):
            x = np.array([measure(t) for t in batch.column(1).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(x)], ["doc_id", "score", "difference"])

    scored = docs.mapInArrow(run, "doc_id bigint, score double, difference double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference")

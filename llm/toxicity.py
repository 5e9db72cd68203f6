"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over word and word-prefix presence is trained with numpy from confirmed
toxic examples (positive) and any other documents (unlabelled) under the class-prior
corrected risk of Kiryo et al. 2017, ``prior * Rp+ + max(0, Ru- - prior * Rp-)``: where the
second part falls below zero, a step climbs back instead of fitting the unlabelled toxic
documents as clean. The class prior is the share of toxic rows among the labelled ones;
they also calibrate the score (Platt), each class weighing as much as all its labels. The
calibration is cross-fitted: a labelled row is scored by a model whose FOLDS-th of the
sample it was not in, so no positive calibrates a score that it was trained to have.

Bounds, all parameters: at most MAX_POSITIVE positives, MAX_UNLABELLED unlabelled documents
and MAX_CALIBRATION other labelled ones are learned from, each set being the smallest by a
hash of doc_id, one text for each doc_id; the FEATURES features that tell most are chosen by
counts in Spark, and only which of them a sampled text has reaches the driver. Every
document is scored over its whole text.

Defined cases: null text is empty and gets the score of a document without features; labels
that are null, or whose doc_id is null, count as no label; without positives in the training
rows every score is 0; repeated rows are scored alike; of a doc_id with several texts one is
learned from; ``keep_clean`` judges each row by its own text, whatever its doc_id; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

from . import words
from .common import id_and_text

THRESHOLD = 0.7
SPACE = 1 << 22
PREFIXES = (4, 5, 6)
FEATURES = 4096
#: Log-likelihood gain of a feature over its rate among the unlabelled rows, at least.
MIN_GAIN = 3.0
MAX_POSITIVE = 4000
MAX_CALIBRATION = 4000
MAX_UNLABELLED = 12000
FOLDS = 4


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def present(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features): the distinct hashed words and prefixes of each text."""
    h, row = words.hash_words_and_prefixes(col, words.ALPHANUMERIC, PREFIXES)
    pair = np.unique(row.astype(np.int64) * SPACE + (h % np.uint64(SPACE)).astype(np.int64))
    return pair // SPACE, pair % SPACE


def _features(batches):
    for b in words.slices(batches):
        row, f = present(b.column(b.schema.get_field_index("text")))
        at = np.searchsorted(row, np.arange(len(b) + 1))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "label")),
             pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(f, pa.int32()))], ["doc_id", "label", "features"])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, tuple[float, float]]:
    """(training sample (doc_id, label, features), stored; class prior; labels that a sampled one of class 0
    and of class 1 stands for). label: 1, 0, or -1 for unlabelled."""
    given = (labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    given = given.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    h = F.xxhash64(F.lit(5), "doc_id")
    count, positive = given.agg(F.count("label"), F.sum("label")).first()
    positive = positive or 0
    stands = (max((count - positive) / MAX_CALIBRATION, 1.0), max(positive / MAX_POSITIVE, 1.0))
    ids = docs.where("doc_id is not null").select("doc_id", F.lit(-1).alias("label")).distinct()
    parts = [(given.where("label = 1"), MAX_POSITIVE), (given.where("label = 0"), MAX_CALIBRATION), (ids, MAX_UNLABELLED)]
    some = None
    for part, bound in parts:
        part = part.orderBy(h, "doc_id").limit(bound)
        some = part if some is None else some.unionByName(part)
    # at most the sum of the three bounds, and one text each
    rows = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.mapInArrow(_features, "doc_id bigint, label int, features array<int>")
    return cut_lineage(rows, "toxicity-sample"), positive / max(count, 1), stands


def part_of(key: str = "doc_id") -> Column:
    """The part of the sample that a document's rows, labelled and unlabelled, are in."""
    return F.pmod(F.xxhash64(F.lit(9), key), F.lit(FOLDS))


def choose(rows: DataFrame, count: int) -> list[np.ndarray]:
    """The `count` features whose presence differs most between positives and unlabelled rows:
    over the whole sample, then without each of its parts. One count of the features serves all."""
    rows = rows.where("label <> 0").withColumn("part", part_of())
    found = rows.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows a part
    sizes = {(r["part"], r["label"]): r["n"] for r in found}
    each = [F.sum(((F.col("label") == y) & (F.col("part") == i)).cast("double")).alias(f"c{i}_{k}")
            for i in range(FOLDS) for k, y in enumerate((-1, 1))]
    counts = cut_lineage(rows.select("part", "label", F.explode("features").alias("feature")).groupBy("feature").agg(*each),
                         "toxicity-counts")
    out = []
    for without in range(-1, FOLDS):
        parts = [i for i in range(FOLDS) if i != without]
        p, u = (sum(sizes.get((i, y), 0) for i in parts) for y in (1, -1))
        if not p:
            out.append(np.zeros(0, np.int64))
            continue
        pos = sum((F.col(f"c{i}_1") for i in parts), F.lit(0.0))
        expected = (sum((F.col(f"c{i}_0") for i in parts), F.lit(0.0)) + 0.5) / max(u, 1) * p
        gain = pos * F.log(F.greatest(pos, F.lit(0.5)) / expected) - (pos - expected)
        best = (counts.select("feature", pos.alias("pos"), expected.alias("expected"), gain.alias("gain"))
                .where((F.col("pos") >= min(3, p)) & (F.col("pos") >= 1.5 * F.col("expected")) & (F.col("gain") > MIN_GAIN))
                .orderBy(F.desc("gain"), "feature").limit(count))
        out.append(np.sort(np.array([r["feature"] for r in best.collect()], np.int64)))  # FEATURES at most
    return out


def matrix(rows: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part and label by row; rows and columns of the chosen features that the sampled texts have)."""
    def run(batches):
        for b in batches:
            lists = b.column(2)
            f, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            place = np.searchsorted(chosen, f)
            hit = chosen[np.minimum(place, max(len(chosen) - 1, 0))] == f if len(chosen) else np.zeros(len(f), bool)
            row = np.repeat(np.arange(len(b)), np.diff(at))[hit]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(len(b) + 1)), pa.int32()), pa.array(place[hit].astype(np.int16)))],
                ["part", "label", "at"])

    rows = rows.select(part_of().alias("part"), "label", "features", "doc_id")
    found = rows.mapInArrow(run, "part bigint, label int, at array<smallint>").toArrow()
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = found.column("at").combine_chunks()
    label = found.column("label").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    return found.column("part").to_numpy(), label, row, lists.flatten().to_numpy().astype(np.int64)


def _log_loss(z):
    return np.logaddexp(0, -z)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(label, row, feature, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4):
    """(features that occur, weights, bias): logistic model under the non-negative PU risk (Adam, whole batch)."""
    chosen, col = np.unique(feature, return_inverse=True)
    k = len(chosen)
    n = len(label)
    isp, isu = label == 1, label == -1
    p, u = max(isp.sum(), 1), max(isu.sum(), 1)
    w = np.zeros(k + 1)
    w[-1] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0
    m, v, mean = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + w[-1]
        negative = _log_loss(-z[isu]).sum() / u - prior * _log_loss(-z[isp]).sum() / p
        g = np.zeros(n)
        up, down = -_sigmoid(-z), _sigmoid(z)  # slopes of the losses for "toxic" and "clean"
        if negative >= 0:
            g[isp] += prior / p * (up[isp] - down[isp])
            g[isu] += down[isu] / u
        else:
            g[isp] += prior / p * down[isp]
            g[isu] -= down[isu] / u
        grad = np.append(np.bincount(col, g[row], k), g.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps // 2:  # steps back and forth at the bound of the risk cancel out
            mean += w / (steps - steps // 2)
    return chosen, mean[:-1], mean[-1]


def platt(z, y, weight=None, steps: int = 100) -> tuple[float, float]:
    """(a, b) of sigmoid(a z + b) fitted by Newton steps with Platt's smoothed targets and a > 0."""
    weight = np.ones(len(y)) if weight is None else weight
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones(len(z))], 1)
    c = np.array([1.0, 0.0])
    for _ in range(steps):
        s = _sigmoid(x @ c)
        h = (x * (weight * s * (1 - s))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (s - target)))
        c = c - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(c[0]), float(c[1])) if c[0] > 0 else (1.0, 0.0)


def cross_fitted(part, label, row, col, chosen: np.ndarray, allowed: list[np.ndarray], prior: float) -> np.ndarray:
    """z of every row from a model whose features and weights come from the other parts of the sample.

    `chosen` are the features behind `col`, `allowed` those chosen without each part.
    """
    z = np.zeros(len(label))
    for i in range(FOLDS):
        mine = part == i
        number = np.cumsum(~mine) - 1
        kept = ~mine[row] & np.isin(chosen, allowed[i])[col]
        at, w, b = train(label[~mine], number[row[kept]], col[kept], prior)
        dense = np.zeros(len(chosen))
        dense[at] = w
        z[mine] = (np.bincount(row, dense[col], len(label)) + b)[mine]
    return z


def fit(docs: DataFrame, labels: DataFrame):
    """The model as (chosen features, weights, bias), calibrated; None without positives."""
    rows, prior, stands = sample(docs, labels)
    final, *allowed = choose(rows, FEATURES)
    chosen = np.unique(np.concatenate([final, *allowed]))  # (FOLDS + 1) x FEATURES at most
    part, label, row, col = matrix(rows, chosen)
    if not (label == 1).any():
        return None
    kept = np.isin(chosen, final)[col]
    at, w, b = train(label, row[kept], col[kept], prior)
    known = label >= 0
    z = cross_fitted(part, label, row, col, chosen, allowed, prior)
    slope, shift = platt(z[known], label[known], np.array(stands)[label[known]])
    return chosen[at], w * slope, b * slope + shift


def _scores(batch: pa.RecordBatch, text: int, model, at) -> np.ndarray:
    if model is None:
        return np.zeros(len(batch))
    row, f = present(batch.column(text))
    f = at[f]
    return _sigmoid(np.bincount(row[f >= 0], model[1][f[f >= 0]], len(batch)) + model[2])


def _places(model) -> np.ndarray:
    at = np.full(SPACE, -1, np.int32)
    if model:
        at[model[0]] = np.arange(len(model[0]))
    return at


def score(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """`docs` (doc_id, text, ...) as (doc_id, score)."""
    def run(batches):
        at = _places(model)
        for b in words.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b, 1, model, at))], ["doc_id", column])

    return docs.mapInArrow(run, f"doc_id bigint, {column} double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    docs = id_and_text(docs)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose own text the model doesn't reject: no join, no shuffle."""
    model = fit(id_and_text(docs), labels)
    text = docs.columns.index("text")

    def run(batches):
        at = _places(model)
        for b in words.slices(batches):
            yield b.filter(pa.array(_scores(b, text, model, at) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)

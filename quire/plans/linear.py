"""Linear text classifiers that share their features, their training passes and their scoring.

Features are counts of hashed words, made once in the JVM and stored as arrays of bucket
numbers (repeats are counts). A model is a weighted logistic regression over TF-IDF; its IDF
depends on the rows that train it, so it is folded into the weights: ``z = sum over words of
idf[j] * w[j], + intercept``. That lets k models -- cross-validation folds, configurations of
a sweep, or the entries of a registry -- read the same stored counts:

* training: each pass over the rows sums the losses and gradients of all k models at their
  current points (``evaluate_points``: numpy in the tasks, sums by feature in a shuffle) and
  the k L-BFGS optimisers take one step each on the driver. A row trains the models whose
  bit is set in its ``train`` mask and is counted in the confusion matrix of those whose
  bit is set in ``held``;
* scoring: one pass computes every model that a row needs (``score``).

The driver holds k x (number of features that occur) numbers, ``SIZE`` features at most,
times the optimiser's memory; nothing of the size of the rows.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..operators.relate import registry_match
from ..session import cut_lineage

# task code travels by value: workers need no package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 1 << 18
#: Models of one fit: their bits are one bigint.
MAX_MODELS = 62
#: Words whose values are held together in a task.
CHUNK = 1 << 18
#: L-BFGS pairs kept, sufficient decrease, shorter steps tried before a fit gives up.
MEMORY, DECREASE, SHORTER = 8, 1e-4, 30
# rows of a pass that aren't features
_BIAS, _LOSS, _TP, _FP, _FN, _TN, _HELD_LOSS, _HELD_WEIGHT = range(-1, -9, -1)


def features(text, size: int = SIZE) -> Column:
    """The hashed, lower-cased words of a text (T18) as an array of bucket numbers, repeats included."""
    c = F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))
    return F.transform(tokens(F.lower(c)), lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int"))


@dataclass(frozen=True)
class Spec:
    """How one model is trained."""
    reg_param: float = 0.01
    max_iter: int = 15
    tol: float = 1e-3
    min_doc_freq: int = 1
    num_features: int = SIZE

    def __post_init__(self):
        for name, value, ok in (("regParam", self.reg_param, self.reg_param >= 0), ("maxIter", self.max_iter, self.max_iter >= 0),
                                ("tol", self.tol, self.tol >= 0), ("minDocFreq", self.min_doc_freq, self.min_doc_freq >= 0),
                                ("numFeatures", self.num_features, self.num_features > 0)):
            if not ok:
                raise ValueError(f"{name} given invalid value {value}.")


@dataclass
class LinearModel:
    """P(label 1) = sigmoid(sum of `weights` of a text's features + intercept); IDF is in the weights."""
    size: int
    index: np.ndarray
    weights: np.ndarray
    intercept: float
    iterations: int = 0
    loss: float | None = None

    def dense(self) -> np.ndarray:
        out = np.zeros(self.size)
        out[self.index] = self.weights
        return out


# ---- passes over the rows ----

def _chunks(column: pa.Array):
    """(first row, last row, bucket numbers, offsets) of pieces of a list column with about CHUNK numbers each."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy()
    begin, rows = 0, len(column)
    while begin < rows:
        end = int(np.searchsorted(at, at[begin] + CHUNK, "right")) - 1
        end = min(max(end, begin + 1), rows)
        yield begin, end, values[at[begin]: at[end]], at[begin: end + 1] - at[begin]
        begin = end


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(at) - 1), at[1:] > at[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, at[:-1][some])
    return out


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def evaluate_points(rows: DataFrame, points: list, class_weight: np.ndarray, place) -> tuple[np.ndarray, np.ndarray]:
    """Sums over `rows` (label, train, held, f) of every model at its point: (features, (models, features)).

    `points`: (weights of the vocabulary, intercept, bit) per model; `class_weight`: (models, 2);
    `place`: a broadcast array from bucket numbers to places in the vocabulary. A negative
    "feature" is a sum that isn't a gradient (``_BIAS`` and so on).
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((points, class_weight))  # models x vocabulary numbers

    def run(batches):
        (points, class_weight), at_of = sent.value, place.value
        size = len(points[0][0])
        gradient = np.zeros((len(points), size))
        other = np.zeros((8, len(points)))
        for batch in batches:
            label = batch.column(0).to_numpy()
            train, held = (batch.column(i).to_numpy() for i in (1, 2))
            for begin, end, f, at in _chunks(batch.column(3)):
                f, count = at_of[f], np.diff(at)
                y, sign = label[begin:end], 2.0 * label[begin:end] - 1
                for m, (w, b, bit) in enumerate(points):
                    mine = (train[begin:end] >> bit & 1).astype(bool)
                    out = (held[begin:end] >> bit & 1).astype(bool)
                    if not mine.any() and not out.any():
                        continue
                    z = _row_sums(w[f], at) + b
                    weight = class_weight[m][y]
                    loss = np.logaddexp(0, -sign * z) * weight
                    slope = np.where(mine, (_sigmoid(z) - y) * weight, 0)
                    gradient[m] += np.bincount(f, np.repeat(slope, count), size)
                    other[0, m] += slope.sum()
                    other[1, m] += loss[mine].sum()
                    if out.any():
                        said = z > 0
                        for k, (p, q) in enumerate(((1, 1), (1, 0), (0, 1), (0, 0))):
                            other[2 + k, m] += (out & (said == p) & (y == q)).sum()
                        other[6, m] += loss[out].sum()
                        other[7, m] += weight[out].sum()
        at = np.flatnonzero(gradient.any(axis=0))
        index = np.concatenate([at, -1 - np.arange(8)])
        values = np.concatenate([gradient[:, at], other.T], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), *map(pa.array, values)],
                                         ["feature", *(f"m{i}" for i in range(len(points)))])

    names = [f"m{i}" for i in range(len(points))]
    sums = rows.select("label", "train", "held", "f").mapInArrow(run, "feature int, " + ", ".join(f"{n} double" for n in names))
    try:
        found = sums.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # features that occur
    finally:
        sent.destroy()
    feature = found.column("feature").to_numpy()
    return feature, np.array([found.column(n).to_numpy() for n in names]).reshape(len(names), -1)


def _bit(column: str, bit: int) -> Column:
    return F.shiftright(F.col(column), bit).bitwiseAND(F.lit(1))


def document_frequencies(rows: DataFrame, models: int) -> tuple[np.ndarray, np.ndarray]:
    """(features that occur, (models, features) rows that train the model and have the feature)."""
    each = rows.select("train", F.explode(F.array_distinct("f")).alias("feature"))
    found = each.groupBy("feature").agg(*[F.sum(_bit("train", m)).alias(f"m{m}") for m in range(models)]).orderBy("feature").toArrow()
    return (found.column("feature").to_numpy().astype(np.int64),
            np.array([found.column(f"m{m}").to_numpy() for m in range(models)], float).reshape(models, -1))


# ---- optimisers ----

@dataclass
class Fit:
    """One L-BFGS run: give `trial()` its loss and gradient by `observe()` until `done`.

    It ends after `max_iter` epochs, or where a full step no longer lowers the loss by `tol`
    of itself, or the gradient has fallen to `tol` of its first size.
    """
    spec: Spec
    idf: np.ndarray
    scale: np.ndarray  # about the inverse of the loss's curvature, by weight
    at: np.ndarray  # weights of the features that occur, then the intercept
    loss: float | None = None
    gradient: np.ndarray | None = None
    pairs: list = field(default_factory=list)
    first: float = 0.0
    epoch: int = 0
    step: float = 0.0
    tries: int = 0
    done: bool = False
    error: str | None = None

    def direction(self) -> np.ndarray:
        q, alphas = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        q *= self.scale
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ (self.scale * y))
        for (s, y), a in zip(self.pairs, reversed(alphas)):
            q += (a - (y @ q) / (s @ y)) * s
        return -q

    def trial(self) -> np.ndarray:
        return self.at if self.loss is None else self.at + self.step * self.direction()

    def _next(self, gained: float = np.inf) -> None:
        size = np.linalg.norm(self.gradient)
        self.first = self.first or size
        self.done = (self.epoch >= self.spec.max_iter or size <= self.spec.tol * self.first
                     or gained <= self.spec.tol * abs(self.loss))
        self.step, self.tries = 1.0 if self.pairs else 1.0 / max(np.linalg.norm(self.direction()), 1.0), 0

    def observe(self, loss: float, gradient: np.ndarray) -> bool:
        """Take the loss and gradient at the trial point; True where that ends an epoch."""
        if self.loss is None:
            self.loss, self.gradient = loss, gradient
            self._next()
            return False
        d = self.direction()
        slope = self.step * (self.gradient @ d)
        if loss > self.loss + DECREASE * slope:
            # the least of the parabola through both losses and the slope, but a step that is a tenth to a half
            self.step *= min(max(-slope / (2 * (loss - self.loss - slope)), 0.1), 0.5)
            self.tries += 1
            self.done = self.tries >= SHORTER
            return False
        s = self.step * d
        y = gradient - self.gradient
        self.at = self.at + s
        if s @ y > 1e-12 * (s @ s):
            self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        gained = self.loss - loss if not self.tries else np.inf
        self.loss, self.gradient, self.epoch = loss, gradient, self.epoch + 1
        self._next(gained)
        return True

    def model(self, vocabulary: np.ndarray, at: np.ndarray | None = None) -> LinearModel:
        w = self.at if at is None else at
        return LinearModel(self.spec.num_features, vocabulary, w[:-1] * self.idf, float(w[-1]), self.epoch, self.loss)


@dataclass
class Training:
    """Fits that share rows (label, train, held, f), in lockstep; ``passes`` counts the scans of the rows."""
    rows: DataFrame
    vocabulary: np.ndarray
    class_weight: np.ndarray
    total: np.ndarray
    fits: list[Fit]
    place: object  # broadcast: bucket number -> place in the vocabulary
    passes: int = 0

    @classmethod
    def begin(cls, rows: DataFrame, specs: list[Spec]) -> Training:
        if len(specs) > MAX_MODELS:
            raise ValueError(f"more than {MAX_MODELS} models in one fit")
        size = {s.num_features for s in specs}
        if len(size) != 1:
            raise ValueError("models of one fit share their number of features")
        k = len(specs)
        counts = np.zeros((k, 2))
        by_label = rows.groupBy("label").agg(*[F.sum(_bit("train", m)).alias(f"m{m}") for m in range(k)]).collect()  # a row per class
        for r in by_label:
            counts[:, r["label"]] = [r[f"m{m}"] for m in range(k)]
        rows_of = counts.sum(axis=1)
        classes = (counts > 0).sum(axis=1)
        # A4: n / (classes * n_c), within the rows that train the model
        weight = np.where(counts > 0, rows_of[:, None] / np.maximum(classes[:, None] * counts, 1), 1.0)
        vocabulary, df = document_frequencies(rows, k)
        fits = []
        for m, spec in enumerate(specs):
            idf = np.where((df[m] > 0) & (df[m] >= spec.min_doc_freq), np.log((rows_of[m] + 1) / (df[m] + 1)), 0.0)
            curvature = np.append(idf**2 * df[m] / max(rows_of[m], 1), 1.0) / 4 + np.append(np.full(len(idf), spec.reg_param), 0)
            fits.append(Fit(spec, idf, 1 / np.maximum(curvature, 1e-6), np.zeros(len(vocabulary) + 1)))
            if not rows_of[m]:
                fits[m].done, fits[m].error = True, "ValueError: no rows to train on"
        place = np.zeros(size.pop(), np.int32)
        place[vocabulary] = np.arange(len(vocabulary))
        return cls(rows, vocabulary, weight, (weight * counts).sum(axis=1), fits, rows.sparkSession.sparkContext.broadcast(place))

    def run_pass(self) -> dict[int, dict]:
        """One scan for all fits that aren't done; held-out counts of those that ended an epoch with it."""
        active = [m for m, fit in enumerate(self.fits) if not fit.done]
        trials = {m: self.fits[m].trial() for m in active}
        points = [(w[:-1] * self.fits[m].idf, w[-1], m) for m, w in trials.items()]
        feature, sums = evaluate_points(self.rows, points, self.class_weight[active], self.place)
        self.passes += 1
        ended = {}
        place = {int(f): i for i, f in enumerate(feature) if f < 0}
        known = feature >= 0
        cell = feature[known]
        for i, m in enumerate(active):
            fit, w, total = self.fits[m], trials[m], self.total[m]
            other = {k: float(sums[i][place[k]]) for k in place}
            gradient = np.zeros(len(w))
            gradient[cell] = sums[i][known] / total
            gradient[:-1] = gradient[:-1] * fit.idf + fit.spec.reg_param * w[:-1]
            gradient[-1] = other[_BIAS] / total
            loss = other[_LOSS] / total + fit.spec.reg_param / 2 * float(w[:-1] @ w[:-1])
            if fit.observe(loss, gradient):
                ended[m] = {"tp": other[_TP], "fp": other[_FP], "fn": other[_FN], "tn": other[_TN],
                            "loss": other[_HELD_LOSS] / other[_HELD_WEIGHT] if other[_HELD_WEIGHT] else None}
        return ended

    def run(self) -> list[LinearModel]:
        while any(not fit.done for fit in self.fits):
            self.run_pass()
        return [fit.model(self.vocabulary) for fit in self.fits]


def training_rows(df: DataFrame, text: str, label: str, train: Column, held: Column | None = None, size: int = SIZE,
                  keep=(), name: str = "training-rows") -> DataFrame:
    """`df` as stored rows (keep..., label, train, held, f): words are made once for all fits and passes."""
    held = F.lit(0) if held is None else held
    rows = df.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(
        *keep, F.col(label).cast("int").alias("label"), train.cast("bigint").alias("train"),
        held.cast("bigint").alias("held"), features(text, size).alias("f"))
    return cut_lineage(rows, name)


def fit_many(rows: DataFrame, specs: list[Spec]) -> Training:
    """Train a model per spec over stored `rows`; bit m of `train` marks the rows of model m."""
    training = Training.begin(rows, specs)
    training.run()
    return training


# ---- scoring ----

def score(df: DataFrame, models: list[LinearModel], keep, source: str | None = None, sources=None) -> DataFrame:
    """`df` (..., f) as (keep..., p): P(label 1) of every model, in one pass.

    With `source`, a column of `keep`, and `sources`, the sets of its values that each
    model is meant for, other models give null on a row.
    """
    keep = list(keep)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))])
    sent = df.sparkSession.sparkContext.broadcast([(m.dense(), m.intercept) for m in models])  # models x SIZE numbers at most
    k, place = len(models), keep.index(source) if source else None

    def run(batches):
        weights = sent.value
        for batch in batches:
            n = len(batch)
            p, known = np.zeros((n, k)), np.ones((n, k), bool)
            if place is not None:
                of = batch.column(place).dictionary_encode()
                names, code = of.dictionary.to_pylist(), of.indices.to_numpy(zero_copy_only=False)
                table = np.array([[x in sources[m] for m in range(k)] for x in names], bool).reshape(-1, k)
                known = table[code.astype(np.int64)] if n else known
            for begin, end, f, at in _chunks(batch.column(batch.schema.get_field_index("f"))):
                for m, (w, b) in enumerate(weights):
                    if known[begin:end, m].any():
                        p[begin:end, m] = _sigmoid(_row_sums(w[f], at) + b)
            cells = pa.array(p.ravel(), mask=~known.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)],
                                              pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), cells)],
                                             [*keep, "p"])

    return df.select(*keep, "f").mapInArrow(run, schema)


# ---- a stored registry ----

def save_registry(spark: SparkSession, models: dict[str, LinearModel], path: str) -> str:
    """Models under the names of their run folders (J4 reads source, model and method from them).

    A model that stands under several names is stored once.
    """
    distinct: dict[int, tuple[int, LinearModel]] = {}
    rows = []
    for name, model in sorted(models.items()):
        number, _ = distinct.setdefault(id(model), (len(distinct), model))
        rows.append((name, number))
    spark.createDataFrame(rows, "model_dir string, model_id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
    table = pa.table({"model_id": pa.array([n for n, _ in distinct.values()], pa.int32()),
                      "size": pa.array([m.size for _, m in distinct.values()], pa.int32()),
                      "features": pa.array([m.index.astype(np.int32) for _, m in distinct.values()], pa.list_(pa.int32())),
                      "weights": pa.array([m.weights.astype(float) for _, m in distinct.values()], pa.list_(pa.float64())),
                      "intercept": pa.array([m.intercept for _, m in distinct.values()], pa.float64()),
                      "iterations": pa.array([m.iterations for _, m in distinct.values()], pa.int32()),
                      "loss": pa.array([m.loss for _, m in distinct.values()], pa.float64())})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/models")
    return path


def load_registry(spark: SparkSession, path: str) -> dict[tuple, LinearModel]:
    """(content_source, bert_model_name, training_method) -> model, for every combination that a stored name holds.

    Names with the same stored model share one object, so it is scored once. The registry
    reaches the driver: a model is at most SIZE numbers. A combination that two stored
    models claim is an error.
    """
    stored = {}
    for r in spark.read.parquet(f"{path}/models").toArrow().to_pylist():
        stored[r["model_id"]] = LinearModel(r["size"], np.array(r["features"], np.int64), np.array(r["weights"], float),
                                            r["intercept"], r["iterations"], r["loss"])
    out: dict[tuple, LinearModel] = {}
    for r in registry_match(spark.read.parquet(f"{path}/names")).collect():  # at most names x combinations
        key = (r["content_source"], r["bert_model_name"], r["training_method"])
        model = stored[r["model_id"]]
        if out.setdefault(key, model) is not model:
            raise ValueError(f"two stored models claim {key}")
    return out


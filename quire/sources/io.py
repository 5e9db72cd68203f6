"""Sources and sinks.

Formats: CSV (quoted, multi-line text), JSON (documents or lines), text and
Parquet. Readers take explicit schemas where the layout is known (no
inference pass over the data). Writers overwrite their target, as the
original did when it replaced a directory.

Multi-line CSV cannot be split by Spark's reader; ``read_table`` cuts files into
ranges of records itself (``records``). What is read more than once should still be
kept as Parquet (``ingest_csv``), for column pruning and predicate pushdown.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import downsample as _downsample
from ..operators.sampling import hash32, shuffle, with_scalars
from ..session import checkpoint_dir
from . import records

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "lineSep": "\n",
}
CSV_WRITE_OPTIONS = dict(CSV_OPTIONS, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
                         quoteAll="false")
SPLIT_NAMES = ("train", "test", "dev")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quire-io/{name}-{uuid.uuid4().hex[:12]}"


# ---- S1 / S2 / S3: tables and splits ----

def write_csv(df: DataFrame, path: str, **options) -> str:
    df.write.mode("overwrite").options(**CSV_WRITE_OPTIONS, **options).csv(path)
    return path


def read_table(spark: SparkSession, path: str, schema=None, columns=None, rename=None,
               shuffle_key: str | None = None, seed=None, whole_files: bool = False) -> DataFrame:
    """CSV -> keep `columns` -> seeded shuffle -> rename (in that order).

    Files are cut into ranges of records (``records``), so one large file is read by many
    tasks; `whole_files` reads each in one task, for files whose quotes aren't paired.
    """
    if whole_files:
        reader = spark.read.options(**CSV_OPTIONS)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "false")
        df = reader.csv(path)
    else:
        df = records.read_csv(spark, path, schema if schema is not None else records.header_of(spark, path, CSV_OPTIONS), CSV_OPTIONS)
    if columns:
        df = df.select(*columns)
    if shuffle_key:
        df = shuffle(df, shuffle_key, seed) if seed is not None else shuffle(df, shuffle_key)
    if rename:
        df = df.withColumnsRenamed(rename)
    return df


def ingest_csv(spark: SparkSession, csv_path: str, parquet_path: str, schema=None) -> DataFrame:
    """Read a (multi-line) CSV once and keep it as Parquet."""
    read_table(spark, csv_path, schema).write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def _relative(path: str, files) -> tuple[str, list[str]]:
    """(the root of `path` as the files' URIs have it, decoded; the files' decoded paths below it)."""
    names = [unquote(f) for f in files]
    authority = re.compile("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?")
    want = "/" + authority.sub("", path).strip("/")
    roots = set()
    for name in names:
        at = name.find(want, authority.match(name).end())
        if at < 0 or name[at + len(want): at + len(want) + 1] not in ("", "/"):
            raise ValueError(f"{name} is not below {path}")
        roots.add(name[: at + len(want)])
    root = roots.pop()
    return root, [n[len(root) + 1:] for n in names]


def read_splits(spark: SparkSession, path: str, schema=None, fmt: str = "csv", columns=None, rename=None,
                shuffle_key: str | None = None, seed=None) -> DataFrame:
    """A directory whose entries are named after splits -> one table with `split`.

    Each entry directly under `path` -- a file, or a folder of part files -- whose name
    contains 'train', 'test' or 'dev' contributes its rows to every split it names (three
    independent tests, as in the original); other entries are ignored, but a directory
    without any that matches is an error, like a path that doesn't exist. Names are taken
    from the files' decoded paths below `path`, so blanks, '%' and repeated names are
    fine. Then, per split: keep `columns`, shuffle by `shuffle_key`, rename, in that
    order. A single file is one table without `split`.
    """
    reader = spark.read.options(**CSV_OPTIONS) if fmt == "csv" else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.format(fmt).option("recursiveFileLookup", "true").load(path)
        files = df.inputFiles()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise ValueError(f"{path} is neither a file nor a directory") from e
    if not files:
        raise ValueError(f"{path} holds no files")
    root, below = _relative(path, files)
    split = []
    if below != [""]:
        entries = {b.split("/")[0] for b in below}
        if not any(s in e for s in SPLIT_NAMES for e in entries):
            raise ValueError(f"no entry of {path} is named after a split: {sorted(entries)[:20]}")
        # a URI has '+' as it is, which url_decode would make a blank
        decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        # file:/a and file:///a are the same place
        local = F.regexp_replace(decoded, "^file:/+", "file:/")
        start = len(re.sub("^file:/+", "file:/", root)) + 2
        entry = F.substring_index(F.substr(local, F.lit(start)), "/", 1)
        names = F.filter(F.array(*[F.lit(s) for s in SPLIT_NAMES]), lambda s: entry.contains(s))
        df = df.withColumn("split", F.explode(names))
        split = ["split"]
    if columns:
        df = df.select(*columns, *[c for c in split if c not in columns])
    if shuffle_key:
        order = [hash32(F.col(shuffle_key), **({} if seed is None else {"seed": seed}), salt="shuffle"), F.col(shuffle_key)]
        df = df.orderBy(*split, *order)
    return df.withColumnsRenamed(rename) if rename else df


def load_labeled(df: DataFrame, text_col: str, label_col: str, downsample: float | None = None,
                 key: str = "doc_id", shuffled: bool = False) -> DataFrame:
    """S3: project to (text, labels); '' -> null; drop rows with any null;
    optionally keep round(n * downsample) rows (seeded, O3) and shuffle them.

    A `split` column stays, and each split is sampled for itself.
    """
    out = df.select(F.nullif(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                    F.col(label_col).cast("int").alias("labels"), *[c for c in (key, "split") if c in df.columns])
    out = out.na.drop(subset=["text", "labels"])
    order = key if key in out.columns else "text"
    if downsample is not None:
        out = _downsample(out, order, downsample, groups=[c for c in out.columns if c == "split"])
    return shuffle(out, order) if shuffled else out


def load_labeled_path(spark: SparkSession, path: str, text_col: str, label_col: str, schema=None, splits: bool = False,
                      columns=None, rename=None, **options) -> DataFrame:
    """S3 from a CSV table, or (`splits`) from a directory of splits; `columns` and `rename` as in
    ``read_splits`` (so `text_col` is the new name), other options as in ``load_labeled``."""
    read = read_splits if splits else read_table
    return load_labeled(read(spark, path, schema, columns=columns, rename=rename), text_col, label_col, **options)


# ---- S4 / S5 / S6: column store ----

def write_columns(df: DataFrame, path: str, row_id: str = "row_id", **options) -> str:
    """Persist all columns (Parquet is columnar: each column is stored apart)."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return path


def read_columns(spark: SparkSession, path: str, cols, row_id: str = "row_id") -> DataFrame:
    """Read one or several stored columns, aligned by `row_id`."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    df = spark.read.parquet(path)
    unknown = [c for c in cols if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; available: {df.columns}")
    return df.select(row_id, *cols)


SCRAPED_COLUMNS = ("trafilatura_title", "trafilatura_abstract", "trafilatura_fulltext", "translation_title")
ANNOTATED_COLUMNS = ("sujet",)


def reduce_columns(df: DataFrame, keep=("doc_id",) + SCRAPED_COLUMNS + ANNOTATED_COLUMNS) -> DataFrame:
    """Keep the scraped and annotated columns only (pruned at the scan)."""
    return df.select(*[c for c in keep if c in df.columns])


# ---- S7 / S8: datasets and splits ----

def write_datasets(long_df: DataFrame, path: str, **options) -> str:
    """One cleaned dataset per content source (partition directories)."""
    long_df.write.mode("overwrite").options(**options).partitionBy("content_source").parquet(path)
    return path


def csv_line(df: DataFrame, columns) -> Column:
    """A CSV record as text: numbers as they are, everything else in quotes (its quotes doubled), null as nothing."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(c):
        text = F.col(c).cast("string")
        if not isinstance(kinds[c], T.NumericType):
            text = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(text, F.lit(""))

    return F.concat_ws(",", *map(cell, columns))


def write_splits(df: DataFrame, path: str, by=("scheme", "content_source", "split"), fmt: str = "csv", **options) -> str:
    """<scheme>/<content_source>/<split> layout; CSV quotes non-numeric fields and the header.

    Spark's CSV writer quotes all fields or those that need it, so the records are written
    as text, in folders ``part=<k>`` of one file each that begins with the header: the rows
    of a split are dealt to as many of them as there are shuffle partitions.
    """
    by = [c for c in by if c in df.columns]
    if fmt != "csv":
        df.write.mode("overwrite").options(**options).partitionBy(*by).format(fmt).save(path)
        return path
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in df.columns if c not in by]
    header = ",".join('"' + c.replace('"', '""') + '"' for c in columns)
    lines = df.select(*by, F.pmod(F.xxhash64(*columns), F.lit(parts)).alias("part"), csv_line(df, columns).alias("_line"))
    # the rows of a folder are in one task already
    first = F.row_number().over(Window.partitionBy(*by, "part").orderBy("part")) == 1
    lines = lines.repartition(*by, "part").withColumn("_first", first)
    value = F.when(F.col("_first"), F.concat(F.lit(header + "\n"), "_line")).otherwise(F.col("_line"))
    lines.select(*by, "part", value.alias("value")).write.mode("overwrite").options(**options).partitionBy(*by, "part").text(path)
    return path


# ---- S9 / S10 / S11: run logs and metric files ----

LOG_ENTRY = T.StructType([
    T.StructField("epoch", T.DoubleType()), T.StructField("step", T.LongType()),
    T.StructField("learning_rate", T.DoubleType()), T.StructField("loss", T.DoubleType()),
    T.StructField("loss_steps", T.DoubleType()),
    T.StructField("eval_accuracy", T.DoubleType()), T.StructField("eval_f1", T.DoubleType()),
    T.StructField("eval_precision", T.DoubleType()), T.StructField("eval_recall", T.DoubleType()),
    T.StructField("eval_f_beta_2.0", T.DoubleType()), T.StructField("eval_f_beta_0.5", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
])
RUN_LOG = T.StructType([
    T.StructField("global_step", T.LongType()), T.StructField("average_loss", T.DoubleType()),
    T.StructField("log_history", T.ArrayType(LOG_ENTRY)),
])


def with_field(schema: T.StructType, name: str, type_name: str) -> T.StructType:
    """A copy of `schema` with one more field (StructType.add would mutate it)."""
    types = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
             "array<bigint>": T.ArrayType(T.LongType())}
    dtype = types[type_name]
    return T.StructType(list(schema.fields) + [T.StructField(name, dtype)])


# ---- FIXED VALUES: the log file of a run, by how it was trained ----
LOG_FILES = {"finetuning": "trainer_state.json", "pet": "results.json"}


def read_run_logs(spark: SparkSession, path: str, multi_line: bool = True, schema=RUN_LOG,
                  training_type: str | None = None) -> DataFrame:
    """Run logs -> one row per log entry (run_path, pos, entry fields...).

    With `training_type`, `path` is a tree of run folders and only the files
    that such runs log to are read.
    """
    reader = spark.read.schema(schema).option("multiLine", str(multi_line).lower())
    if training_type is not None:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", LOG_FILES[training_type])
    df = reader.json(path)
    df = df.withColumn("run_path", F.col("_metadata.file_path"))
    keep = [c for c in df.columns if c not in ("log_history",)]
    ex = df.select(*keep, F.posexplode("log_history").alias("pos", "entry"))
    return ex.select(*keep, "pos", "entry.*")


SPLIT_METRICS = T.StructType([
    T.StructField("accuracy", T.DoubleType()), T.StructField("f1", T.DoubleType()),
    T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType()),
    T.StructField("support", T.LongType()),
    T.StructField("f_beta_2.0", T.DoubleType()), T.StructField("f_beta_0.5", T.DoubleType()),
    T.StructField("AUC", T.DoubleType()),
    T.StructField("FPR", T.ArrayType(T.DoubleType())), T.StructField("TPR", T.ArrayType(T.DoubleType())),
    T.StructField("thresholds", T.ArrayType(T.DoubleType())),
])


def read_split_metrics(spark: SparkSession, path: str, multi_line: bool = True, schema=SPLIT_METRICS,
                       curve: bool = True, keep=()) -> DataFrame:
    """Scalar metrics, or (curve=True) one row per ROC point with the fields in `keep`."""
    df = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path) \
        .withColumn("metrics_path", F.col("_metadata.file_path"))
    if not curve:
        return df.drop("FPR", "TPR", "thresholds")
    place = F.col("index") if "index" in df.columns else F.when(F.size("FPR") > 0, F.sequence(F.lit(0), F.size("FPR") - 1))
    z = F.arrays_zip(place.alias("idx"), F.col("FPR").alias("fpr"), F.col("TPR").alias("tpr"), F.col("thresholds").alias("threshold"))
    return df.select("metrics_path", *keep, "AUC", F.explode(z).alias("p")).select(
        "metrics_path", *keep, "AUC", "p.idx", "p.fpr", "p.tpr", "p.threshold")


#: Points in one written document: bounds every group that is gathered.
CURVE_CHUNK = 1024


def write_curve(curve: DataFrame, auc: DataFrame, path: str, by=()) -> str:
    """ROC points (by..., idx, fpr, tpr, threshold) and AUC as metric documents for ``read_split_metrics``.

    A curve of any length is cut into documents of CURVE_CHUNK positions.
    """
    by = list(by)
    points = F.sort_array(F.collect_list(F.struct("idx", "fpr", "tpr", "threshold")))
    parts = curve.groupBy(*by, F.floor(F.col("idx") / CURVE_CHUNK).alias("_chunk")).agg(points.alias("_p")).select(
        *by, F.col("_p.idx").alias("index"), F.col("_p.fpr").alias("FPR"), F.col("_p.tpr").alias("TPR"),
        F.col("_p.threshold").alias("thresholds"))
    (parts.join(auc, by) if by else with_scalars(parts, auc)).write.mode("overwrite").json(path)
    return path


METRIC_LINE = r"^(.+?): ([-+0-9.eE]+|nan|NaN) \+- ([-+0-9.eE]+|nan|NaN)$"


def read_metric_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines '<name>: <mean> +- <std>' -> (name, mean, std)."""
    t = spark.read.text(path).where(F.col("value").rlike(METRIC_LINE))
    return t.select(F.regexp_extract("value", METRIC_LINE, 1).alias("name"),
                    F.regexp_extract("value", METRIC_LINE, 2).cast("double").alias("mean"),
                    F.regexp_extract("value", METRIC_LINE, 3).cast("double").alias("std"))


def write_metric_text(df: DataFrame, path: str, name: str = "name", mean: str = "mean", std: str = "std") -> str:
    line = F.concat(F.col(name), F.lit(": "), F.col(mean).cast("string"), F.lit(" +- "),
                    F.coalesce(F.col(std).cast("string"), F.lit("0")))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


# ---- S12 / S13: predictions and metrics ----

def write_predictions(df: DataFrame, path: str) -> str:
    """Labels, predictions, probabilities_for_positive_label, then what else `df` has."""
    first = ["labels", "predictions", "probabilities_for_positive_label"]
    df.select(*first, *[c for c in df.columns if c not in first]).write.mode("overwrite").parquet(path)
    return path


def write_metrics(df: DataFrame, path: str) -> str:
    """Metrics rows as JSON (a handful of rows: one file)."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path

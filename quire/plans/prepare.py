"""Dataset preparation end to end.

raw table -> reduce (S6) -> parse markup (X2) -> clean (T17) -> [checkpoint]
-> long table (content_source, text, sujet) -> dedupe + label (A2)
-> splits, unbalanced and balanced (O13) -> few-shot (O9) -> split table (S8).

All content columns travel as one long table keyed by ``content_source``:
dedupe, class counts, quotas and ranks are grouped by it, so the number of
jobs does not grow with the number of columns. The points where the
original writes files become Parquet tables in the shared checkpoint folder
(``cut_lineage``): after parsing and cleaning, after de-duplication (the
datasets, read by all split schemes) and after the balanced split (the
few-shot splits are cut from it). A lost executor re-reads them instead of
recomputing, and each is computed once.

``prepare_files`` is the same from a CSV table to written datasets and splits, in
stages that a later run takes up where an earlier one stopped.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import add_parsed_columns
from ..functions.text import clean_columns, content_type_col
from ..operators.label import dedupe_or_label
from ..operators.sampling import split_balanced, split_few_shot, split_stratified
from ..session import cut_lineage, shuffles_dropped
from ..sources.io import ANNOTATED_COLUMNS, read_table, reduce_columns, write_columns, write_datasets, write_splits

PARSED = ["parsed_trafilatura_title", "parsed_trafilatura_abstract", "parsed_trafilatura_fulltext"]


def markup_of(title, abstract, fulltext):
    """Wrap the three fields into minimal markup (escaping &, <, >)."""
    def esc(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                         F.lit(">"), F.lit("&gt;"))

    def el(tag, c):
        return F.when(c.isNotNull(), F.concat(F.lit(f"<{tag}>"), esc(c), F.lit(f"</{tag}>"))).otherwise(F.lit(""))
    return F.concat(F.lit("<TEI>"), el("title", title), el("abstract", abstract), el("text", fulltext), F.lit("</TEI>"))


def clean_long(raw: DataFrame, columns=None, checkpoint: bool = True) -> DataFrame:
    """Parse, clean and unpivot: (doc_id, content_source, text, sujet)."""
    columns = columns or PARSED + ["translation_title"]
    parsed = add_parsed_columns(reduce_columns(raw, ("doc_id", "trafilatura_extracted_xml_tei",
                                                     "translation_title", "sujet")))
    cleaned = clean_columns(parsed.select("doc_id", "sujet", *columns), columns)
    if checkpoint:
        cleaned = cut_lineage(cleaned, "cleaned")
    return cleaned.unpivot(["doc_id", "sujet"], list(columns), "content_source", "text")


def datasets(long: DataFrame) -> DataFrame:
    """The cleaned datasets: (text, has_subject, content_source), distinct texts with their label (A2)."""
    g = ["content_source"]
    return dedupe_or_label(long, "text", "sujet", keep_titles=True, content_type_of=content_type_col("content_source"),
                           groups=g).select("text", "has_subject", "content_source")


def unbalanced_splits(d: DataFrame, stored: bool = False) -> DataFrame:
    return (split_stratified(d, "text", "has_subject", groups=["content_source"], stored=stored)
            .withColumn("_draw", F.lit(None).cast("bigint")).withColumn("scheme", F.lit("unbalanced")))


def few_shot_splits(bal: DataFrame, few_shot, stored: bool = False) -> list[DataFrame]:
    return [split_few_shot(bal, "text", n, groups=["content_source"], stored=stored).withColumn("scheme", F.lit(f"pet_{n}"))
            for n in few_shot]


def prepare(raw: DataFrame, columns=None, few_shot=(50,), checkpoint: bool = True) -> DataFrame:
    """The split table (text, has_subject, split, _draw, content_source, scheme)."""
    d = datasets(clean_long(raw, columns, checkpoint))
    if checkpoint:  # the cleaned datasets (S7): read by all three split schemes
        d = cut_lineage(d, "datasets")
    bal = split_balanced(d, "text", "has_subject", groups=["content_source"])
    if checkpoint:  # the balanced splits (S8): the few-shot splits are cut from them
        bal = cut_lineage(bal, "balanced")
    out = unbalanced_splits(d).unionByName(bal.withColumn("scheme", F.lit("balanced_dev_train")))
    for x in few_shot_splits(bal, few_shot):
        out = out.unionByName(x)
    return out


# ---- E1 from file to files ----

RAW_SCHEMA = ("doc_id long, trafilatura_extracted_xml_tei string, trafilatura_title string, trafilatura_abstract string, "
              "trafilatura_fulltext string, translation_title string, sujet string")


class Stages:
    """Stages of a job in the shared folder `path`, each finished once for each input and parameters.

    A stage's key is a digest of its name, its parameters and the keys (or file states) that
    it reads. It writes to a folder named by that key; then one row in one file of the
    manifest says that it is done. That file is there as a whole or not at all, so a stage that
    was broken off is run again from its start, and a finished one never.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def finished(self) -> dict[str, str]:
        """key -> folder of the stages that are done."""
        try:
            rows = self.spark.read.schema("stage string, key string, folder string").parquet(f"{self.path}/manifest/*").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        return {r["key"]: r["folder"] for r in rows}  # a row a stage

    def run(self, stage: str, reads, write, **parameters) -> tuple[str, str]:
        """(key, folder) of `stage`; `write` is called with the folder unless it is done already."""
        key = hashlib.sha256(json.dumps([stage, list(reads), parameters], sort_keys=True, default=str).encode()).hexdigest()[:32]
        done = self.finished()
        if key not in done:
            folder = f"{self.path}/{stage}/{key}"
            with shuffles_dropped(self.spark):  # the next stage reads the folder
                write(folder)
            (self.spark.createDataFrame([(stage, key, folder)], "stage string, key string, folder string").coalesce(1)
             .write.mode("overwrite").parquet(f"{self.path}/manifest/{stage}-{key}"))
            done[key] = folder
        return key, done[key]


def file_state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0]
    return str(found)


#: How the stages are stored: texts take some 40 % less room than with Parquet's usual codec.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "5"}


def prepare_files(spark: SparkSession, csv_path: str, out_dir: str, columns=None, few_shot=(50,), schema=RAW_SCHEMA) -> dict[str, str]:
    """E1 from a CSV table (S1) to stored columns (S4), datasets (S7) and splits (S8); the folders by stage.

    A run that is started again, with the same input and parameters, goes on after the last
    finished stage; another input or parameter runs what depends on it.
    """
    s = Stages(spark, out_dir)
    columns = list(columns or PARSED + ["translation_title"])
    read = spark.read.parquet
    raw_key, raw = s.run("raw", [csv_path, file_state(spark, csv_path)], lambda f: write_columns(
        read_table(spark, csv_path, schema), f, "doc_id", **STORED), schema=str(schema))
    kept = ("doc_id", "trafilatura_extracted_xml_tei", "translation_title", *ANNOTATED_COLUMNS)
    parsed_key, parsed = s.run("parsed", [raw_key], lambda f: write_columns(
        add_parsed_columns(reduce_columns(read(raw), kept)).select("doc_id", "sujet", *columns), f, "doc_id", **STORED), columns=columns)
    clean_key, cleaned = s.run("cleaned", [parsed_key], lambda f: write_columns(
        clean_columns(read(parsed), columns), f, "doc_id", **STORED))
    data_key, data = s.run("datasets", [clean_key], lambda f: write_datasets(
        datasets(read(cleaned).unpivot(["doc_id", "sujet"], columns, "content_source", "text")), f, **STORED))

    def store_splits(df, f):
        return write_splits(df, f, ("content_source", "split"), "parquet", **STORED)

    uns = s.run("unbalanced", [data_key], lambda f: store_splits(unbalanced_splits(read(data), stored=True), f))
    bal_key, bal = s.run("balanced", [data_key], lambda f: store_splits(
        split_balanced(read(data), "text", "has_subject", groups=["content_source"], stored=True)
        .withColumn("scheme", F.lit("balanced_dev_train")), f))
    out = {"raw": raw, "parsed": parsed, "cleaned": cleaned, "datasets": data, "unbalanced": uns[1], "balanced_dev_train": bal}
    for n in few_shot:
        out[f"pet_{n}"] = s.run(f"pet_{n}", [bal_key], lambda f, n=n: store_splits(
            few_shot_splits(read(bal).drop("scheme"), [n], stored=True)[0], f))[1]
    return out


def split_table(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """The split table of E1, read back from the folders of ``prepare_files``."""
    names = ["text", "has_subject", "split", "_draw", "content_source", "scheme"]
    out = None
    for scheme, folder in folders.items():
        if scheme in ("raw", "parsed", "cleaned", "datasets"):
            continue
        part = spark.read.parquet(folder).withColumn("scheme", F.lit(scheme)).select(*names)
        out = part if out is None else out.unionByName(part)
    return out

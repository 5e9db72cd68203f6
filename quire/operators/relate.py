"""Joins and set operations.

Equi-joins are written plainly and left to Catalyst/AQE (sort-merge or
runtime-broadcast). Explicit ``broadcast`` is only used for tables whose size
is fixed by construction (the model registry: sources x models x methods).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- FIXED VALUES: registry vocabulary of the inference service ----
CONTENT_SOURCES = ("trafilatura_title", "trafilatura_abstract", "trafilatura_fulltext", "translated_title")
TRAINING_METHODS = ("pet_1000", "finetuning")
BERT_MODELS = ("multilingual_bert", "xlmroberta")


def positional_join(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Side-by-side columns of two tables stored separately, by row id."""
    return left.join(right, row_id)


def row_key(df: DataFrame, cols=None) -> Column:
    """A null-safe value key over all columns cast to string (sha2 of the tuple).

    Each part stands behind its length (nulls behind none), so no two tuples
    give the same string, whatever characters they hold.
    """
    cols = cols or df.columns
    text = [F.col(c).cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts), 256)


def difference(a: DataFrame, b: DataFrame, cols=None) -> DataFrame:
    """Rows of `a` whose string tuple is not in `b` (all duplicates go; null equals null).

    An anti join on a fixed-width hash of the tuple keeps the shuffle key small
    even for wide text rows.
    """
    cols = cols or a.columns
    bk = b.select(row_key(b, cols).alias("_rk")).distinct()
    return a.withColumn("_rk", row_key(a, cols)).join(bk, "_rk", "left_anti").drop("_rk")


def model_registry(spark) -> DataFrame:
    """All (content_source, bert_model_name, training_method) combinations: 16 rows."""
    rows = [(s, m, t) for s in CONTENT_SOURCES for m in BERT_MODELS for t in TRAINING_METHODS]
    return spark.createDataFrame(rows, "content_source string, bert_model_name string, training_method string")


def fan_out(long_docs: DataFrame, models: DataFrame, source_col: str = "content_source") -> DataFrame:
    """Each non-null content source meets only the models trained on it.

    A caller's table may be of any size, so AQE decides whether it is broadcast.
    """
    return long_docs.where(F.col("text").isNotNull()).join(models, source_col)


def registry_match(names: DataFrame, name_col: str = "model_dir") -> DataFrame:
    """run/model directory names -> (source, model, method) they contain.

    The original tests every registry combination against every name
    (substring containment of all three parts). Here each name keeps only the
    vocabulary entries it contains (three tiny fixed arrays) and the
    combinations of those are exploded: same matches, no cross product.
    """
    low = F.lower(F.col(name_col))

    def present(values):
        return F.filter(F.array(*[F.lit(v) for v in values]), lambda v: low.contains(v))

    return (names
            .withColumn("content_source", F.explode(present(CONTENT_SOURCES)))
            .withColumn("bert_model_name", F.explode(present(BERT_MODELS)))
            .withColumn("training_method", F.explode(present(TRAINING_METHODS))))


def label_name(c, names: dict) -> Column:
    """Id -> name through a map literal."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(int(k)), F.lit(v))])
    return F.element_at(m, c if isinstance(c, Column) else F.col(c))


def label_id(c, names: dict) -> Column:
    """Name -> id."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(v), F.lit(int(k)))])
    return F.element_at(m, c if isinstance(c, Column) else F.col(c))


def logical_run_name(c) -> Column:
    """Strip leading digits, then flanking '_' ('05__xlm-roberta-base' -> 'xlm-roberta-base')."""
    c = c if isinstance(c, Column) else F.col(c)
    return F.btrim(F.regexp_replace(c, r"^[0-9]+", ""), F.lit("_"))


def union_samples(samples) -> DataFrame:
    """Stack per-class samples."""
    return reduce(lambda a, b: a.unionByName(b), samples)

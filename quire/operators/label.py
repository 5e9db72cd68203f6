"""Labelling, de-duplication and corpus profiles.

All of these are aggregates with a map-side partial phase: a text copied a
million times (one hot group) reaches the shuffle at most once per map task.
Exact quantiles are computed from a value histogram (group by value, then a
window over the *distinct values*), never by collecting the raw values of a
group into one buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import to_be_kept
from ..functions.text import content_type, token_count
from ..session import cut_lineage


def has_subject(c) -> Column:
    """A1: 1 when a subject is present, else 0.

    Text counts unless it is 'None'; whole numbers always count; fractional
    numbers count from -99999 up, so NaN and the usual "missing" codes don't.
    The column's type is a constant of the plan, so only one branch is left.
    """
    c = F.col(c) if isinstance(c, str) else c
    kind = F.typeof(c)
    number = c.try_cast("double")
    present = F.when(kind.isin("float", "double") | kind.startswith("decimal"), (number >= -99999) & ~F.isnan(number)) \
        .otherwise(c.isNotNull() & (c.cast("string") != F.lit("None")))
    return F.coalesce(present.cast("int"), F.lit(0))


def dedupe_or_label(df: DataFrame, text_col: str, subject_col: str = "sujet",
                    keep_titles: bool = True, rule_set: str = "compat", content_type_of=None,
                    groups=(), sort: bool = False) -> DataFrame:
    """A2: one row per distinct kept text; label 1 if any copy has a subject.

    Keep-ness depends only on the text, so it is computed per row next to the
    text and folded into the group with ``bool_or``; the filter then reads an
    aggregate output. That placement matters: a filter on an expression of a
    computed text column would be pushed below the projection and re-evaluate
    the (expensive) text expression inside the predicate. The aggregate is
    partial on the map side, so a text copied millions of times reaches the
    shuffle once per task. Output: (groups..., text_col, has_subject).

    `groups` names independent datasets (e.g. content_source); the content
    type is then read per row from `content_type_of` (a Column), otherwise
    it comes from the column name.
    """
    ctype = content_type_of if content_type_of is not None else content_type(text_col)
    if ctype is None:
        raise ValueError(f"cannot infer content type from column name {text_col!r}")
    flagged = df.select(*groups, text_col, has_subject(F.col(subject_col)).alias("_hs"),
                        to_be_kept(F.col(text_col), ctype, keep_titles=keep_titles, rule_set=rule_set).alias("_kf"))
    agg = flagged.groupBy(*groups, text_col).agg(F.max("_hs").alias("has_subject"), F.bool_or("_kf").alias("_kept"))
    out = agg.where(F.col("_kept")).select(*groups, text_col, "has_subject")
    # the original returns the groups in text order; a global sort (range
    # shuffle) is only worth it when the result is written in that order
    return out.orderBy(*groups, text_col) if sort else out


def class_proportions(df: DataFrame, label_col: str = "labels") -> DataFrame:
    """A3: (label, n, proportion)."""
    w = Window.partitionBy()
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("proportion", F.col("n") / F.sum("n").over(w))


def balanced_class_weights(df: DataFrame, label_col: str = "labels") -> DataFrame:
    """A4: n / (k * n_c) per class (the 'balanced' inverse frequency)."""
    w = Window.partitionBy()
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    return counts.select(
        label_col, "n_c",
        (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"),
    )


def value_counts(df: DataFrame, col: str = "has_subject", by=()) -> DataFrame:
    """A5: count per value (within `by`), most frequent first."""
    return df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("count")).orderBy(*by, F.desc("count"), col)


def _histogram_stats(df: DataFrame, value_col: str) -> DataFrame:
    """Histogram of distinct values with cumulative ranks and global totals.

    The distinct values are dealt to ranges of about the same size and stored with
    their range; sums run inside a range plus the offset of the ranges before it, so
    no task holds the whole histogram, however many distinct values there are.
    """
    hist = df.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hist = cut_lineage(hist.repartitionByRange(parts, value_col).withColumn("_b", F.spark_partition_id()), "histogram")
    ranges = hist.groupBy("_b").agg(F.sum("_n").alias("_bn"), F.sum(F.col(value_col) * F.col("_n")).alias("_bs"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # one row per range: spark.sql.shuffle.partitions at most
    offsets = ranges.select("_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"), F.sum("_bn").over(whole).alias("_tot"),
                            (F.sum("_bs").over(whole) / F.sum("_bn").over(whole)).alias("_mean"))
    upto = Window.partitionBy("_b").orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    local = hist.withColumn("_hi", F.sum("_n").over(upto))
    return local.join(F.broadcast(offsets), "_b").select(
        value_col, "_n", (F.col("_off") + F.col("_hi") - F.col("_n")).alias("_lo"), (F.col("_off") + F.col("_hi")).alias("_hi"),
        "_tot", "_mean")


def _quantile_aggs(value_col: str, probs):
    """Exact linear-interpolation quantiles (numpy/pandas default) over _histogram_stats rows."""
    aggs = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("_tot") - 1)
        k0 = F.floor(pos)
        v0 = F.max(F.when((F.col("_lo") <= k0) & (k0 < F.col("_hi")), F.col(value_col)))
        v1 = F.max(F.when((F.col("_lo") <= k0 + 1) & (k0 + 1 < F.col("_hi")), F.col(value_col)))
        frac = F.max(pos - k0)
        aggs.append((v0 + F.coalesce(frac * (v1 - v0), F.lit(0.0))).cast("double").alias(f"q{int(round(p * 100))}"))
    return aggs


def exact_quantiles(df: DataFrame, value_col: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """One row with exact quantiles q<p*100> of `value_col`."""
    return _histogram_stats(df, value_col).agg(*_quantile_aggs(value_col, probs))


def length_profile(df: DataFrame, text_col: str) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max of token counts."""
    n = df.select(token_count(F.col(text_col)).alias("n_tokens"))
    h = _histogram_stats(n, "n_tokens")
    q = _quantile_aggs("n_tokens", (0.25, 0.5, 0.75))
    dev2 = F.col("_n") * (F.col("n_tokens") - F.col("_mean")) * (F.col("n_tokens") - F.col("_mean"))
    return h.agg(
        F.coalesce(F.max("_tot"), F.lit(0)).alias("count"),
        F.max("_mean").alias("mean"),
        F.sqrt(F.sum(dev2) / (F.max("_tot") - 1)).alias("std"),
        F.min("n_tokens").alias("min"),
        q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"),
        F.max("n_tokens").alias("max"),
    )


def overview(df: DataFrame, text_col: str, subject_col: str = "sujet"):
    """A2 (keep_titles forced to True), then A5 and A6."""
    clean = dedupe_or_label(df, text_col, subject_col, keep_titles=True)
    return value_counts(clean, "has_subject"), length_profile(clean, text_col)


def distinct_texts(df: DataFrame, text_col: str, approx: bool = False) -> DataFrame:
    """Number of unique non-null texts (their digests are shuffled, not the texts)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(f(F.sha2(F.col(text_col).cast("string"), 256)).alias("n_distinct"))


def column_profile(df: DataFrame, cols=None) -> DataFrame:
    """A10: non-null count per column (long format: column, non_null)."""
    cols = cols or df.columns
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "non_null")


def missing_report(df: DataFrame, cols=None) -> DataFrame:
    """Total nulls over the columns and their share of all rows.

    '' counts as missing (blank -> null), as in the original loader.
    """
    cols = cols or df.columns
    def miss(c):
        col = F.col(c)
        blank = (col.cast("string") == F.lit("")) if dict(df.dtypes)[c] == "string" else F.lit(False)
        return F.when(col.isNull() | blank, 1).otherwise(0)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(sum(miss(c) for c in cols)).alias("n_missing"),
        F.sum(F.when(sum(miss(c) for c in cols) > 0, 1).otherwise(0)).alias("n_rows_with_missing"),
    ).withColumn("pct_rows_with_missing", F.round(F.col("n_rows_with_missing") * 100.0 / F.col("n_rows"), 6))


def drop_missing(df: DataFrame, cols=None) -> DataFrame:
    """blank -> null, then drop rows with any null in `cols`."""
    cols = cols or df.columns
    fixed = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c, t in df.dtypes if c in cols and t == "string"})
    return fixed.na.drop(subset=list(cols))

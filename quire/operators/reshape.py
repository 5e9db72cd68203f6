"""Pivots and unpivots.

Pivots always get an explicit value list: Spark then skips the extra job that
would collect the distinct pivot values to the driver, and the output schema
is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- FIXED VALUES: names used by the original result tables ----
MODELS = ("BERT-base", "mBERT", "Bio-Link-BERT", "SciBERT", "RoBERTa-base", "XLM-RoBERTa")
CONTENTS = (
    "Title", "Abstract", "Full text", "Translated Title",
    "Phrases with Keywords (Abstract)", "Phrases with Keywords + O.C (Abstract)",
    "Phrases with Keywords (Full text)", "Phrases with Keywords + O.C (Full text)",
)
METHODS = ("Unbalanced Finetuning", "Balanced Finetuning", "PET 50", "PET 100", "PET 200", "PET 500", "PET 1000")


def metric_grid(long: DataFrame, value: str = "value", row: str = "model", col: str = "content",
                col_values=CONTENTS) -> DataFrame:
    """One metric as a row x column grid (first value per cell)."""
    return long.groupBy(row).pivot(col, list(col_values)).agg(F.first(value))


def method_comparison(long: DataFrame, value: str = "value", row: str = "content", col: str = "method",
                      col_values=METHODS) -> DataFrame:
    """Content x method for one model and metric, columns in fixed order."""
    return long.groupBy(row).pivot(col, list(col_values)).agg(F.first(value))


def quoted(name: str):
    """Column by exact name (grid headers contain dots and spaces)."""
    return F.col("`" + name.replace("`", "``") + "`")


def transpose(wide: DataFrame, key: str, columns, new_key: str, new_columns) -> DataFrame:
    """Swap rows and columns of a grid (unpivot, then pivot)."""
    long = wide.unpivot([quoted(key)], [quoted(c) for c in columns], new_key, "_v")
    return long.groupBy(new_key).pivot(key, list(new_columns)).agg(F.first("_v"))


def fill_missing(df: DataFrame, value: float = 0.0, cols=None) -> DataFrame:
    """Null metric -> 0.0."""
    cols = list(cols) if cols else [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(float(value))) for c in cols})


def content_unpivot(df: DataFrame, id_cols, content_cols, name: str = "content_source",
                    value: str = "text") -> DataFrame:
    """P5: the content columns become rows (id..., content_source, text)."""
    return df.unpivot(list(id_cols), list(content_cols), name, value)

"""Multi-line CSV files read by many tasks.

Spark reads a ``multiLine`` CSV file in one task, as a line end inside quotes isn't the end
of a record. Here the text reader splits files into byte ranges of whole lines, and a
line's quotes tell where records end:

1. every range's number of quotes is counted (one row a range);
2. its prefix over the ranges of a file says whether a range begins inside quotes;
3. a second scan joins the lines of a range to records: a line ends a record where the
   quotes so far are even in number. What a range has before its first whole record and
   after its last one are pieces; only these (two a range at most) are shuffled, to be put
   together in the order of the ranges;
4. Spark's own CSV parser (``from_csv``) reads the records.

A file must quote as RFC 4180 says: a field with a quote, a separator or a line end stands
in quotes, its quotes doubled. A quote inside an unquoted field would pair with the next
one. Records end with "\\n".
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the lines with the file and the start of the byte range that they are read in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _odd(value: Column) -> Column:
    return (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2


def ranges(lines: DataFrame) -> DataFrame:
    """(file, at, open): whether a byte range begins inside quotes. A row a range."""
    counted = lines.groupBy("file", "at").agg((F.sum(_odd(F.col("value"))) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "at", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _joined(batches):
    """Lines of a partition, range by range, as records: (file, at, first, piece, value); piece is null for a whole
    record, 0 for what ends or goes on with one that began before the range, 1 for what begins one that goes on
    after it; first: whether it begins its file."""
    now, inside, head, held, first = None, False, False, [], False

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string()))], ["file", "at", "first", "piece", "value"])

    for b in batches:
        rows = []
        odd = pc.bit_wise_and(pc.count_substring(b.column(3), '"'), 1).to_pylist()
        files, ats, opens, values = (b.column(i).to_pylist() for i in range(4))
        for i, value in enumerate(values):
            key = (files[i], ats[i])
            if key != now:
                if held:
                    rows.append((*now, first, 0 if head else 1, "\n".join(held)))
                now, inside, head, held, first = key, opens[i], opens[i], [], ats[i] == 0
            held.append(value)
            inside = inside != bool(odd[i])
            if not inside:
                rows.append((*key, first, 0 if head else None, "\n".join(held)))
                head, held, first = False, [], False
        if rows:
            yield out(rows)
    if held:
        yield out([(*now, first, 0 if head else 1, "\n".join(held))])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(first, value): the records of the CSV files at `path` as text; first: whether it is its file's first."""
    lines = _lines(spark, path)
    # a row for each byte range that begins inside quotes; broadcast, as the lines' order must stay
    began = ranges(lines).where("open")
    started = lines.join(F.broadcast(began), ["file", "at"], "left").select(
        "file", "at", F.coalesce("open", F.lit(False)).alias("open"), "value")
    found = started.mapInArrow(_joined, "file string, at bigint, first boolean, piece int, value string")
    whole = found.where("piece is null").select("first", "value")
    # a piece that begins a record (1) opens a group; the pieces (0) of the following ranges belong to it
    order = Window.partitionBy("file").orderBy("at", "piece")
    grouped = found.where("piece is not null").withColumn("record", F.sum("piece").over(order))
    parts = F.sort_array(F.collect_list(F.struct("at", "piece", "value")))
    put = grouped.groupBy("file", "record").agg(parts.alias("p"), F.bool_or("first").alias("first"))
    return whole.unionByName(put.select("first", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value")))


def read_csv(spark: SparkSession, path: str, schema, options: dict) -> DataFrame:
    """The records at `path` as columns of `schema` (DDL or StructType), without each file's header record."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    records = read_records(spark, path)
    if options.get("header") == "true":
        records = records.where(~F.col("first"))
    keep = {k: v for k, v in options.items() if k in ("quote", "escape", "sep", "encoding", "nullValue", "emptyValue", "mode")}
    return records.where(F.col("value") != "").select(F.from_csv("value", ddl, keep).alias("r")).select("r.*")


def header_of(spark: SparkSession, path: str, options: dict) -> T.StructType:
    """The columns of the header, all as strings."""
    return spark.read.options(**options).option("inferSchema", "false").csv(path).schema

"""Multi-line CSV in byte ranges: equal to the reader that takes a file in one task."""

import random

import pytest
from pyspark.sql import functions as F

from quire.sources import io as IO
from quire.sources import records

SCHEMA = "id long, text string, more string"
HARD = ['a "quoted" word', 'two\nlines', '\n', '"', '""', 'ends with a quote"', '"starts', 'a,b', '', None, ' spaced ', "tab\t", '"\n"', '\n\n\n',
        'crlf\r\nline', "plain", '",\n",', 'ünï\ncödé "日本"', "x" * 300, 'many\n' * 40, '"a"\n' * 30]


def same(spark, path, schema=SCHEMA):
    got = IO.read_table(spark, path, schema)
    want = IO.read_table(spark, path, schema, whole_files=True)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    return got


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [23, 150, 1000, 1 << 20])
def test_equal_to_the_present_reader(spark, small_ranges, size):
    rng = random.Random(size)
    rows = [(i, rng.choice(HARD), rng.choice(HARD)) for i in range(120)]
    path = IO.write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(2), IO.scratch_path(spark, "records"))
    small_ranges(size)
    got = same(spark, path)
    assert got.count() == 120
    if size == 150:
        lines = records._lines(spark, path)
        assert lines.rdd.getNumPartitions() > 20  # two files, many tasks
        assert records.ranges(lines).where("open").count() > 3


def test_header_names_and_other_writers(spark, small_ranges, tmp_path):
    (tmp_path / "one.csv").write_text('"id","a ""b""\n,c",more\n1,"x\ny",2\n\n3,"",\n4,short\n5,"l\n\n\nast",6', newline="")
    small_ranges(9)
    same(spark, str(tmp_path), None)
    df = same(spark, str(tmp_path), "id int, text string, more int")
    assert [r["id"] for r in df.orderBy("id").collect()] == [1, 3, 4, 5]
    (tmp_path / "only_header.csv").write_text("id,a,b\n")
    assert same(spark, str(tmp_path / "only_header.csv"), "id int, a string, b int").count() == 0


def test_one_record_over_many_ranges(spark, small_ranges):
    text = "\n".join(f'line {i} "q" ,' for i in range(400))
    rows = [(1, "first", None), (2, text, text), (3, "last", "end\n")]
    path = IO.write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(1), IO.scratch_path(spark, "records"))
    small_ranges(100)
    got = {r["id"]: r for r in same(spark, path).collect()}
    assert got[2]["text"] == text and got[2]["more"] == text


def test_columns_shuffle_and_rename(spark):
    df = spark.createDataFrame([(i, f"t\n{i}", "m") for i in range(50)], SCHEMA)
    path = IO.write_csv(df, IO.scratch_path(spark, "records"))
    out = IO.read_table(spark, path, SCHEMA, columns=["id", "text"], rename={"text": "content"}, shuffle_key="id")
    assert out.columns == ["id", "content"]
    ids = [r["id"] for r in out.collect()]
    assert ids != sorted(ids) and sorted(ids) == list(range(50))
    assert out.where(F.col("content").contains("\n")).count() == 50

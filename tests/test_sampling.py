"""Splitting and sampling (O1-O13): golden sizes, exact ranks, invariants."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import sampling as O

# (N, positives) -> test neg/pos, balanced dev per class, balanced train per class (FIXTURES.md §3)
GOLDEN_SIZES = [
    (16222, 2305, (1391, 230), 811, 6488),
    (22535, 2741, (1978, 274), 1126, 9014),
    (4050, 1088, (296, 108), 202, 1620),
]


def _table(spark, n, positives, parts=8):
    return (spark.range(n, numPartitions=parts).withColumnRenamed("id", "doc_id")
            .withColumn("labels", (F.col("doc_id") < positives).cast("int")))


def _counts(df):
    return {(r.split, r.labels): r["count"] for r in df.groupBy("split", "labels").count().collect()}


@pytest.mark.parametrize("n,pos,test_np,dev_bal,train_bal", GOLDEN_SIZES)
def test_golden_split_sizes(spark, n, pos, test_np, dev_bal, train_bal):
    t = _table(spark, n, pos)
    uns = _counts(O.split_stratified(t, "doc_id", "labels"))
    assert (uns[("test", 0)], uns[("test", 1)]) == test_np
    assert (uns[("dev", 0)], uns[("dev", 1)]) == test_np  # dev keeps the proportions too
    assert sum(uns.values()) == n
    bal = _counts(O.split_balanced(t, "doc_id", "labels"))
    assert (bal[("test", 0)], bal[("test", 1)]) == test_np
    assert bal[("dev", 0)] == bal[("dev", 1)] == dev_bal
    assert bal[("train", 0)] == bal[("train", 1)] == train_bal


def test_few_shot_sizes(spark):
    t = _table(spark, 16222, 2305)
    bal = O.split_balanced(t, "doc_id", "labels").cache()
    few = O.split_few_shot(bal, "doc_id", 1000).groupBy("split").count().collect()
    sizes = {r.split: r["count"] for r in few}
    assert sizes["train"] == 2000 and sizes["unlabeled"] == 2 * 6488 - 2000
    assert sizes["dev"] == 1622 and sizes["test"] == 1621
    bal.unpersist()


def test_hash_rank_equals_global_window(spark):
    t = _table(spark, 5000, 1700)
    ranked = O.hash_rank(t, "doc_id", ["labels"], salt="class")
    w = Window.partitionBy("labels").orderBy(O.hash32(F.col("doc_id"), salt="class"), "doc_id")
    brute = t.withColumn("_brute", F.row_number().over(w))
    j = ranked.join(brute, ["doc_id", "labels"])
    assert j.where(F.col("_rank") != F.col("_brute")).count() == 0
    assert j.count() == 5000


def test_splits_are_disjoint_and_partition_independent(spark):
    a = O.split_stratified(_table(spark, 3000, 500, parts=1), "doc_id", "labels")
    b = O.split_stratified(_table(spark, 3000, 500, parts=7), "doc_id", "labels")
    assert a.select("doc_id").distinct().count() == 3000
    diff = a.join(b, ["doc_id", "labels"]).where(a.split != b.split).count()
    assert diff == 0


def test_split_groups_are_independent(spark):
    t1 = _table(spark, 2000, 300).withColumn("src", F.lit("a"))
    t2 = _table(spark, 1000, 500).withColumn("src", F.lit("b"))
    both = O.split_stratified(t1.unionByName(t2), "doc_id", "labels", groups=["src"])
    alone = O.split_stratified(t2, "doc_id", "labels")
    got = both.where("src = 'b'")
    assert got.exceptAll(alone).count() == 0 and alone.exceptAll(got).count() == 0


def test_ordered_split_and_fraction_check(spark):
    t = _table(spark, 1000, 100)
    out = {r.split: r["count"] for r in O.split_ordered(t, ["doc_id"]).groupBy("split").count().collect()}
    assert out == {"train": 800, "dev": 100, "test": 100}
    first_dev = O.split_ordered(t, ["doc_id"]).where("split = 'dev'").agg(F.min("doc_id")).first()[0]
    assert first_dev == 800
    with pytest.raises(ValueError):
        O.split_ordered(t, ["doc_id"], 0.7, 0.2, 0.1)


def test_downsample_exact_size(spark):
    t = _table(spark, 1235, 100)
    assert O.downsample(t, "doc_id", 0.1).count() == round(123.5)  # half-even: 124
    assert O.downsample(t, "doc_id", 0.5).count() == round(617.5)


def test_with_replacement_handles_a_single_row_class(spark):
    t = _table(spark, 1001, 1)  # one positive: every positive draw hits it
    quota = spark.createDataFrame([(0, 300), (1, 300)], "labels int, _m long")
    drawn = O.sample_with_replacement(t, "doc_id", "labels", quota)
    c = {r.labels: r["count"] for r in drawn.groupBy("labels").count().collect()}
    assert c == {0: 300, 1: 300}
    assert drawn.where("labels = 1").select("doc_id").distinct().count() == 1


def test_kfold_balanced_folds(spark):
    folds = O.stratified_kfold(_table(spark, 1000, 200), "doc_id", "labels", k=10)
    sizes = {(r.fold, r.labels): r["count"] for r in folds.groupBy("fold", "labels").count().collect()}
    assert all(sizes[(f, 1)] == 20 and sizes[(f, 0)] == 80 for f in range(10))


def test_splits_of_stored_tables_are_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "BUCKET_BITS", 3)  # so that cuts go through buckets
    rows = [(f"t{i}", int(i % 7 == 0), "abc"[i % 3]) for i in range(900)] + [("one", 1, "d"), ("two", 0, "d")]
    rows += [(None, 1, "a"), (None, 0, "b"), ("n", None, "a"), ("m", 1, None), ("t0", 1, "a"), ("t5", 0, "c")]
    spark.createDataFrame(rows, "text string, label int, source string").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")

    def found(x):
        return sorted((tuple(r) for r in x.collect()), key=str)

    for groups in (["source"], []):
        assert found(O.split_stratified(df, "text", "label", groups=groups, stored=True)) == \
            found(O.split_stratified(df, "text", "label", groups=groups))
        bal = O.split_balanced(df, "text", "label", groups=groups)
        assert found(O.split_balanced(df, "text", "label", groups=groups, stored=True)) == found(bal)
        for n in (0, 5, 10_000):
            few = O.split_few_shot(bal, "text", n, groups=groups)
            assert found(O.split_few_shot(bal, "text", n, groups=groups, stored=True)) == found(few)


def test_rank_cuts_reach_the_same_rows(spark, tmp_path):
    spark.range(20_000).selectExpr("md5(cast(id as string)) AS text", "cast(id % 5 = 0 as int) AS label").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")

    def third(cnt):
        return cnt.select("label", F.floor(F.col("_cnt") / 3).alias("_q"))

    cut, counts = O.rank_cuts(df, "text", ["label"], ["_q"], facts=third)
    assert {r["label"]: r["_cnt"] for r in counts.collect()} == {0: 16_000, 1: 4_000}
    ranked, _ = O.rank_table(df, "text", ["label"], facts=third)
    want = {r["text"] for r in ranked.where("_rank <= _q").collect()}
    assert len(want) == 5333 + 1333 and {r["text"] for r in cut.where("_q").collect()} == want

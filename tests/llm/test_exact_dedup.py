import hashlib
import uuid

from llm import exact_dedup
from llm_fixtures import documents, none, odd, sf  # noqa: F401


def test_keeps_the_largest_id(documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    last, size = {}, {}
    for d, t in rows.items():
        last[t] = max(d, last.get(t, d))
        size[t] = size.get(t, 0) + 1
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(documents).collect()}
    assert got.keys() == rows.keys()
    for d, t in rows.items():
        want = (last[t], size[t], last[t] == d, hashlib.sha256(t.encode()).hexdigest())
        assert tuple(got[d])[1:] == want
    assert exact_dedup.keep_one(documents).count() == len(last)


def test_new_data_meets_the_index(spark, documents, tmp_path):
    name = f"digests_{uuid.uuid4().hex[:8]}"
    index = exact_dedup.DigestIndex(spark, name, str(tmp_path / "index"), 4)
    upper, lower = documents.where("doc_id >= 100"), documents.where("doc_id < 100")
    exact_dedup.keep_one(upper, index).count()
    texts = {r["text"] for r in upper.collect()}
    again = exact_dedup.DigestIndex(spark, name, str(tmp_path / "index"), 4)
    kept = [r["text"] for r in exact_dedup.keep_one(lower, again).collect()]
    assert sorted(kept) == sorted({r["text"] for r in lower.collect()} - texts)
    assert again.read().count() == len({r["text"] for r in documents.collect()})
    # the index side is read by bucket, without a shuffle
    plan = spark.sql("SELECT 1 AS x").crossJoin(again.read())._jdf.queryExecution().toString()
    assert "Bucketed: " in plan or "SelectedBucketsCount" in plan


def test_hot_group_and_odd_rows(spark, odd, none):
    hot = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('t', id), 'same') AS text")
    got = exact_dedup.exact_duplicates(hot).where("not kept").count()
    assert got == 1999
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert len(rows) == 14
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["keep_id"] == 3 and by[3][0]["kept"] and not by[2][0]["kept"]
    assert by[9][0]["keep_id"] == 9 and by[7][0]["keep_id"] == 7
    assert sorted(r["kept"] for r in by[11]) == [False, True] == sorted(r["kept"] for r in by[None])
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 10
    assert exact_dedup.exact_duplicates(none).count() == 0 == exact_dedup.keep_one(none).count()

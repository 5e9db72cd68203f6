import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import mixing, queries
from llm_fixtures import documents, none, odd, sf  # noqa: F401


def test_targets():
    t = mixing.targets({"b": 100, "a": 10, "c": 1000, None: 50})
    assert list(t) == ["a", "b", "c", None]
    assert sum(t.values()) == pytest.approx(1.5 * 1160)
    assert t["a"] == 20 and t["b"] == 200 and t[None] == 100
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_tree_splits_exactly_and_alike():
    quota = np.array([1000, 30, 0, 7])
    s = mixing.split(quota, 13)
    assert s.sum(axis=0).tolist() == quota.tolist() and (s == mixing.split(quota, 13)).all()
    assert s.sum(axis=1).max() - s.sum(axis=1).min() <= 4


def check(df):
    want = Counter()
    for r in df.collect():
        want[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    rows = mixing.amounts(df).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == want[r["source"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    goal = mixing.targets(dict(want))
    for s in goal:
        assert target[s] == pytest.approx(goal[s])
        assert abs(taken[s] - goal[s]) <= max(largest[s] / 2, 1)
    return rows


def test_amounts_and_reruns(documents, spark):
    rows = check(documents)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.amounts(documents.repartition(7)).collect()))


def test_one_block_is_stopped_inside(spark):
    df = spark.range(40).selectExpr("id AS doc_id", "repeat('w ', 50) AS text", "if(id < 30, 'a', 'b') AS source")
    check(df)


def test_mix_takes_each_document_as_often_as_planned(documents):
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.amounts(documents).collect() if r["copies"]})
    out = mixing.mix(documents, shards=5)
    assert out.columns == documents.columns
    assert Counter(r["doc_id"] for r in out.collect()) == want


def test_odd_rows(odd, none):
    rows = mixing.amounts(odd).collect()
    assert len(rows) == 14 and mixing.amounts(none).count() == 0
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == 0


def test_query_counts_what_the_shards_hold(documents, odd, none, sf, spark, monkeypatch):
    for df in (documents, odd):
        assert sorted(map(str, mixing.drawn_amounts(df).collect())) == sorted(map(str, mixing.amounts(df).collect()))
    assert mixing.drawn_amounts(none).count() == 0
    # a pass that is lost on the way to the shards must not go unseen
    whole = mixing.shard_of_draws
    monkeypatch.setattr(mixing, "shard_of_draws", lambda *a: [d for d in whole(*a) if d[2]])
    with pytest.raises(Exception, match="shards differ from the plan"):
        queries.op10_mixing(spark, sf).collect()


def test_every_shard_is_one_partition_and_holds_what_the_tree_gave_it(spark, documents, monkeypatch):
    sized, plans, fixes = mixing.mix_plan(documents)
    shards = 23
    rows = mixing.deal(sized, sized, plans, fixes, shards).select("shard", "source", "block", "pass", F.spark_partition_id().alias("part")).collect()
    assert {r["shard"] for r in rows} == {r["part"] for r in rows} and all(r["shard"] == r["part"] for r in rows)
    assert len({r["part"] for r in rows}) == shards
    # a draw is whole in one shard, also one that a fix has added
    where = {}
    for r in rows:
        assert where.setdefault((r["source"], r["block"], r["pass"]), r["shard"]) == r["shard"]
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5000)
    words = sum(p.target for p in plans)
    assert mixing.shards_for(plans, 5000) == -(-words // 5000)
    assert mixing.shards_for(plans, 1) == mixing.MAX_SHARDS and mixing.shards_for(plans, 10**12) == 1


def test_stops_are_the_nearest_hash(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(s, int(h), int(n)) for s in ("a", "b", None) for h, n in zip(rng.integers(0, 2**63, 300), rng.integers(1, 50, 300))]
    rows += [("a", rows[5][1], 9), ("c", 2**63 - 1, 7), ("d", 0, 7), ("d", 1, 7)]
    df = spark.createDataFrame(rows, "source string, h bigint, size bigint")
    total = Counter()
    for s, _, n in rows:
        total[s] += n
    for share in (0.0001, 0.3, 0.77, 1.0):
        want = {s: n * share for s, n in total.items()}
        plain = {}
        for s in total:
            by_hash = Counter()
            for t, h, n in rows:
                if t == s:
                    by_hash[h] += n
            so_far, plain[s] = 0, frozenset()
            for h in sorted(by_hash):
                so_far += by_hash[h]
                if so_far - by_hash[h] / 2 <= want[s]:
                    plain[s] |= {h}
        for bits in (14, 3):
            monkeypatch.setattr(mixing, "BLOCK_BITS", bits)
            got = mixing.stops(df, want)
            for s in total:
                assert {h for t, h, _ in rows if t == s and h <= got[s]} == plain[s]

import re

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm import near_dedup, words
from llm_fixtures import documents, none, odd, sf  # noqa: F401


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbZz é日\t\n \x0b\x1c\x00", max_size=12)), max_size=6))
def test_word_hashes_follow_the_words(texts):
    hashes, at = words.hash_words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.LOWER)) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    flat = [w for t in want for w in t]
    assert len(dict.fromkeys(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_slices_keep_all_rows_and_cut_long_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 900_000] * 5 + [None, "y" * 5_000_000, ""])], ["text"])
    parts = list(words.slices([batch]))
    assert sum(map(len, parts)) == 8 and len(parts) >= 4


def test_components_equal_brute_force(documents):
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    for n in (4, 5):
        assert found(near_dedup.near_duplicates(documents, n=n)) == brute.near_components(docs, n, 80)


def test_pairs_that_only_meet_across_components_are_linked(spark):
    # each text drops a stretch of one base text: neighbours are similar, the ends are not
    base = [f"w{i}" for i in range(220)]
    docs = {i: " ".join(base[: 200 - 12 * i] + [f"v{i}"] + base[212 - 12 * i:]) for i in range(12)}
    docs |= {100 + i: " ".join(base[8 * i:]) for i in range(12)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert found(near_dedup.near_duplicates(df, n=4)) == brute.near_components(docs, 4, 80)


def test_exactly_four_fifths_is_a_link(spark):
    a = [f"w{i}" for i in range(12)]
    docs = {1: " ".join(a), 2: " ".join(a[:-1] + ["z"]), 3: " ".join(a[:-2])}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert found(near_dedup.near_duplicates(df, n=4)) == brute.near_components(docs, 4, 80)


def test_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd, n=4).collect()
    assert len(rows) == 14
    got = {r["doc_id"]: r for r in rows}
    assert (got[6]["component_id"], got[6]["kept"]) == (1, False)
    assert got[2]["n_shingles"] == got[3]["n_shingles"] == got[8]["n_shingles"] == 0 and got[3]["kept"]
    assert (got[9]["component_id"], got[9]["n_shingles"]) == (7, 1)
    assert got[4]["n_shingles"] == 5
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and near_dedup.keep_one(none).count() == 0


def test_one_id_of_two_texts_links_both(spark):
    """Rows of one doc_id are one document: what is near either text is linked, and so are texts without words."""
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " word"), (3, b + " word"), (4, " ".join(f"c{i}" for i in range(50))), (1, ""), (5, ""),
            (None, a), (None, "only here and without an id"), (6, b), (7, "x y z w v"), (7, None), (8, "x y z w v")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n in (4, 5):
        got = near_dedup.near_duplicates(df, n=n).collect()
        assert len(got) == len(rows)
        component = {}
        for r in got:
            component.setdefault(r["doc_id"], set()).add(r["component_id"])
        assert component == {1: {1}, 2: {1}, 3: {1}, 6: {1}, 4: {4}, 5: {5}, None: {None}, 7: {7}, 8: {7}}
        assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 1) == [0, 101 - n, 101 - n]
    assert {r["doc_id"] for r in near_dedup.keep_one(df).collect()} == {None, 1, 4, 5, 7}


def test_a_pair_comes_out_of_one_bucket(spark):
    """Pairs that share many keys are made once, and none of those that pass the bounds is left out."""
    base = [f"w{i}" for i in range(200)]
    docs = {i: " ".join(base[:4 * i] + [f"v{i}"] + base[4 * i + 1:]) for i in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    side = near_dedup.SIDE
    reps = near_dedup.signatures(df, 5, side, near_dedup.WIDTH).select(F.col("doc_id").alias("cls"), "small")
    keys = near_dedup.table_keys(reps, side)
    sets = near_dedup.full_sets(df, 5).withColumnRenamed("doc_id", "cls").join(reps, "cls")
    got = near_dedup.rest_pairs(keys.withColumn("label", F.col("cls")), sets, 80, side).collect()
    shared = {}
    for r in keys.collect():
        shared.setdefault(r["key"], set()).add(r["cls"])
    want = {(x, y) for c in shared.values() for x in c for y in c if x > y}
    sets = {d: brute.shingle_set(t, 5) for d, t in docs.items()}
    near = {(x, y) for x, y in want if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert len(near) > 700 and near <= {(r["a"], r["b"]) for r in got} <= want
    assert len(got) == len({(r["a"], r["b"]) for r in got})

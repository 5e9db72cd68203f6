import hashlib

import numpy as np
from brute import shingle_set
from pyspark.sql import functions as F

from llm import fingerprints
from llm_fixtures import documents, none, odd, sf  # noqa: F401


def edited(docs):
    """doc_id -> (text, edited text, next text)."""
    ids = sorted(docs)
    out = {}
    for i, d in enumerate(ids):
        t, after = docs[d], docs[ids[(i + 1) % len(ids)]]
        q = len(t) // 4
        out[d] = (t, t[: len(t) - q] + after[:q], after)
    return out


def jaccard(a, b):
    a, b = shingle_set(a, 5), shingle_set(b, 5)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_documents(documents):
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    want = edited(docs)
    rows = fingerprints.edited_fingerprints(documents).collect()
    assert len(rows) == len(docs)
    off, seen = [], {}
    for r in rows:
        t, e, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        off += [r["near_edited"] - jaccard(t, e), r["near_next"] - jaccard(t, after)]
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert seen.setdefault(e, r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert np.abs(off).max() < 0.12 and np.mean(np.abs(off)) < 0.01


def test_one_document_is_its_own_next(spark):
    df = spark.createDataFrame([(5, "abcdefgh")], "doc_id bigint, text string")
    assert fingerprints.edited_fingerprints(df).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_sketch_estimates(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    df = spark.createDataFrame([(text(0, 6004), text(3000, 9004))], "text string, other string")
    df = fingerprints.fingerprint(df).withColumnRenamed("sketch", "x").withColumnRenamed("text", "t").withColumnRenamed("other", "text")
    df = fingerprints.fingerprint(df).withColumnRenamed("sketch", "y")
    r = df.select(fingerprints.resemblance(F.col("x"), F.col("y")).alias("r"), fingerprints.containment(F.col("x"), F.col("y")).alias("c"),
                  fingerprints.distinct_shingles(F.col("x")).alias("n")).first()
    assert abs(r["r"] - 1 / 3) < 0.1 and abs(r["c"] - 0.5) < 0.15 and abs(r["n"] / 6000 - 1) < 0.2


def test_parts_merge_into_the_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), [int(h) for h in np.sort(rng.integers(0, 2**62, 300))[:64]]) for i in range(40)] + [(9, [])]
    df = spark.createDataFrame(rows, "k bigint, s array<bigint>")
    got = {r["k"]: list(r["s"]) for r in fingerprints.merge_parts(df, "k", "s", 64).collect()}
    for k in range(3):
        assert got[k] == sorted({h for i, s in rows if i == k for h in s})[:64]
    assert got[9] == []


def test_odd_rows(odd, none):
    rows = fingerprints.edited_fingerprints(odd).collect()
    assert len(rows) == 14
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["fingerprint"] == got[3]["fingerprint"] == got[8]["fingerprint"] == "" and got[2]["near_next"] == 1.0
    assert got[1]["fingerprint"] == got[6]["fingerprint"] and len(got[7]["fingerprint"]) == 16 and got[7]["fingerprint"] == got[9]["fingerprint"]
    assert got[4]["n_chars"] == 630_000 and len(got[4]["fingerprint"]) == 16 * 5
    assert fingerprints.edited_fingerprints(none).count() == 0

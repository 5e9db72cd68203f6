"""Resampling against a plain version: counts, weights, scores, draw and ranks."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import resampling, words
from llm_fixtures import documents, none, odd, sf  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_buckets(text, longest=1, buckets=10_000):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def plain(docs, target, percent=10, min_words=20, longest=1, buckets=10_000):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_buckets(text, longest, buckets)[0])
    for text in target:
        t.update(plain_buckets(text, longest, buckets)[0])
    over, under = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * over / ((s[b] + 1) * under))) for b in s}
    rows = []
    for doc_id, text in docs:
        f, count = plain_buckets(text, longest, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, count])
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_a_plain_version(spark, sf, documents):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    texts = [r["text"] for r in target.collect()]
    assert found(resampling.resample(documents, target)) == plain(docs, texts)
    assert found(resampling.resample(documents, target, percent=60, min_words=3, longest=3)) == plain(docs, texts, 60, 3, 3)


def test_ranks_do_not_depend_on_digits_and_parts(spark, sf, documents, monkeypatch):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = found(resampling.resample(documents, target, percent=100))
    monkeypatch.setattr(resampling, "DIGIT_BITS", 3)
    monkeypatch.setattr(resampling, "PART_ROWS", 17)
    assert found(resampling.resample(documents, target, percent=100)) == want


def test_radix_order_of_wide_keys(spark):
    """Ids of the whole 64-bit range, nulls, and a score that a third of the rows share."""
    rng = np.random.default_rng(1)
    ids = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, None, None, *(int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 200))]
    rows = [(i, d, 5 if i % 3 == 0 else int(rng.integers(-40, 40))) for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "row bigint, doc_id bigint, score bigint")
    scores = [r[2] for r in rows]
    got = resampling.radix_ranked(df, len(rows), max(scores), min(scores)).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(rows)))
    want = sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0))
    assert [(r["doc_id"], r["score"]) for r in got] == [(d, s) for _, d, s in want]


def test_ties_fill_the_draw_by_id(spark):
    """Equal weights and a coarse key: of rows with the cutoff's score the smallest ids are drawn."""
    df = spark.createDataFrame([(i, i // 2, 7) for i in range(100)], "row bigint, doc_id bigint, score bigint")
    got = resampling.radix_ranked(df, 100, 7, 7).orderBy("pos").collect()
    assert [r["doc_id"] for r in got] == [i // 2 for i in range(100)]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("The quick Über-brown fox; jumps " * 50).encode()
    want = {n: sorted(resampling.text_buckets(text, 10_000, n)[0].tolist()) for n in (1, 2, 4)}
    assert want[4] == sorted(plain_buckets(text.decode(), 4)[0])
    monkeypatch.setattr(words, "PIECE_BYTES", 37)
    for n, found in want.items():
        got, count = resampling.text_buckets(text, 10_000, n)
        assert (sorted(got.tolist()), count) == (found, 300)


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("play work the same",), (None,), ("",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    texts = ["play work the same", "", ""]
    assert found(resampling.resample(odd, target, 50, 2)) == plain(rows, texts, 50, 2)
    assert found(resampling.resample(odd, target.where("false"), 100, 1)) == plain(rows, [], 100, 1)
    assert resampling.resample(none, target).count() == 0
    assert all(r["rank"] is None for r in resampling.resample(odd, target, 0).collect())
    drawn = resampling.drawn_documents(odd, target, percent=50, min_words=2)
    assert drawn.columns == [*odd.columns, "rank"] and drawn.count() > 0


@pytest.mark.parametrize("name", ["rank", "RANK"])
def test_drawn_documents_keep_a_clashing_column(spark, odd, name):
    target = spark.createDataFrame([("play",)], "text string")
    docs = odd.withColumnRenamed("rep", name)
    assert resampling.drawn_documents(docs, target, percent=100, min_words=1).columns == [*docs.columns, "_rank"]

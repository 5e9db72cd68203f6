import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import LOWER

from llm import bloom_lm
from llm_fixtures import documents, none, odd, sf  # noqa: F401


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def brute_base(docs):
    count = Counter()
    for d, t in docs:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(tokens(t))
    total, distinct = sum(count.values()), len(count)
    out = []
    for d, t in docs:
        w = tokens(t)
        out.append((d, len(w), sum(count[x] > 0 for x in w), total,
                    sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)))
    return out


def check(df):
    want = sorted(brute_base([(r["doc_id"], r["text"]) for r in df.collect()]), key=str)
    rows = bloom_lm.scores(df).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-9)
    return rows


@pytest.mark.parametrize("heavy", [bloom_lm.HEAVY, 40])
def test_base_scores_are_exact(documents, monkeypatch, heavy):
    monkeypatch.setattr(bloom_lm, "HEAVY", heavy)  # with 40 most tokens take the join
    rows = check(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    # at this size training texts are known by heart, so only the others compare
    base, model = np.array([(r["base_score"], r["score"]) for r in rows if r["held_out"]]).T
    assert np.corrcoef(base, model)[0, 1] > 0.95


def test_filter_gives_back_the_quantised_counts(spark):
    rng = np.random.default_rng(5)
    gram = rng.integers(-2**62, 2**62, 5000)
    count = np.maximum(rng.zipf(1.5, 5000).clip(max=10**6), 1)
    df = spark.createDataFrame([(1, int(g), int(c)) for g, c in zip(gram, count)], "n int, gram bigint, c bigint")
    table = bloom_lm.build(df, 1.0)
    got = bloom_lm.levels(table, gram.view(np.uint64), 1)
    assert (got >= bloom_lm.level(count, 1.0)).all() and (got == bloom_lm.level(count, 1.0)).mean() > 0.99
    other = rng.integers(-2**62, 2**62, 5000).view(np.uint64)
    assert (bloom_lm.levels(table, other, 1) > 0).mean() < 0.01
    assert (np.abs(np.log2(bloom_lm.count_of(bloom_lm.level(count, 1.0), 1.0) / count)) <= 0.5).all()


def test_ngram_counts(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "GATHER", 50)
    texts = ["a b a b c", "a b", "", "b c b c"] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    want1, want2 = Counter(), Counter()
    for t in texts:
        w = tokens(t)
        want1.update(w)
        want2.update(zip([None, *w], w))
    rows = bloom_lm.ngram_counts(df, 0, 31).collect()
    assert sorted(r["c"] for r in rows if r["n"] == 1) == sorted(want1.values())
    assert sorted(r["c"] for r in rows if r["n"] == 2) == sorted(c for c in want2.values() if c >= 31)


def test_odd_rows(odd, none):
    check(odd)
    assert bloom_lm.scores(none).count() == 0


def test_rarer_ngrams_keep_their_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "ENTRIES", 8)  # the filter has the n-grams of an eighth of the tokens or more
    monkeypatch.setattr(bloom_lm, "GATHER", 20)
    texts = ["a b a c", "a b a d", "a a b", "e f", "e f g", "", "h", "a b x y"] * 3
    docs = [(i, t) for i, t in enumerate(texts)]
    one, two = Counter(), Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w], w))
    total = sum(one.values())
    least = total / 8

    def count(c):
        return bloom_lm.count_of(bloom_lm.level(c, least), least) if c >= least else c

    def score(text):
        out, w = 0.0, tokens(text)
        for x, y in zip([None, *w], w):
            c = count(two[x, y])
            p2 = max(c - bloom_lm.DISCOUNT, 0) / max(count(one[x]), c, 1)
            out += math.log10(bloom_lm.MIX * p2 + (1 - bloom_lm.MIX) * min((count(one[y]) or 0.5) / total, 1))
        return out

    assert 0 < sum(c < least for c in two.values()) < len(two)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in bloom_lm.scores(df).collect()}
    assert got == pytest.approx({d: score(t) for d, t in docs}, rel=1e-9)

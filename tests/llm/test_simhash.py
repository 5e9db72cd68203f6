"""SimHash components against brute force."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import brute
from llm import simhash, words
from llm_fixtures import documents, none, odd, sf  # noqa: F401


def plain_fingerprint(text, n):
    w = brute.SPACED.findall((text or "").translate(brute.LOWER))
    runs = [" ".join(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, n=4, radius=4):
    """[(doc_id, fingerprint, component)] of [(doc_id, text)]; one doc_id is one document."""
    fps = [plain_fingerprint(t, n) for _, t in rows]
    ids = sorted({d for d, _ in rows if d is not None})
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            e = rows[j][0]
            if d is not None and e is not None and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return sorted(((d, f"{f:016x}", None if d is None else root(d)) for (d, _), f in zip(rows, fps)), key=str)


def check(df, **kw):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(df, n=4, **kw).collect()), key=str)
    want = plain_components(rows, radius=kw.get("radius", 4))
    assert got == want
    return got


def test_components_equal_brute_force(documents):
    got = check(documents)
    assert len({r[2] for r in got}) < len(got)
    check(documents, tile=7, radius=12)


def test_small_tiles_and_chains(spark, monkeypatch):
    """Texts that drift word by word: neighbours link, the ends only through them."""
    monkeypatch.setattr(simhash, "SUBTILE", 5)
    base = [f"w{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(base[i:] + [f"v{k}" for k in range(i)])) for i in range(0, 120, 2)]
    rows += [(5000 + i, " ".join(base[:100 + i])) for i in range(0, 200, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for tile in (3, 10, 1 << 14):
        check(df, tile=tile)


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    for _ in range(20):
        seeds = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 2), dtype=np.uint64), axis=1)
        fp = np.unique(seeds[rng.integers(0, 8, 300)] ^ flips)
        half = rng.random(len(fp)) < 0.5
        for a, b in ((fp, None), (fp[half], fp[~half])):
            groups = simhash.Groups(len(fp))
            x, y = simhash.tile_links(a, b, 4)
            assert all(v > w for v, w in zip(x.tolist(), y.tolist())) and len(set(x.tolist())) == len(x)
            groups.join(np.searchsorted(fp, x), np.searchsorted(fp, y))
            want = simhash.Groups(len(fp))
            near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
            if b is not None:
                near &= half[:, None] != half[None, :]
            want.join(*np.nonzero(near))
            every = np.arange(len(fp))
            assert (groups.root(every) == want.root(every)).all()


def test_popcounts_are_bounds():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    gap = np.abs(simhash.quarter_counts(a) - simhash.quarter_counts(b)).sum(axis=1)
    assert (gap <= np.bitwise_count(a ^ b)).all()


def test_a_large_group_gives_few_links(spark):
    """Fingerprints that are all near each other: a link a row of a tile pair, not a link a pair."""
    one = [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in one], "fp bigint")
    rows = simhash.links(df, 4, 1 << 14).collect()
    assert len(rows) <= 3 * len(one)


def test_fingerprints_in_pieces(monkeypatch):
    texts = [("Alpha beta\tgamma delta\x0bÉpsilon 😀 zeta " * 40).encode(), b"", b"one two", b" \n ", b"a b c d"]
    want = [plain_fingerprint(t.decode(), 4) for t in texts]
    assert simhash.fingerprint(texts, 4).tolist() == want
    monkeypatch.setattr(words, "PIECE_BYTES", 11)
    monkeypatch.setattr(simhash, "_CHUNK", 3)
    assert simhash.fingerprint(texts, 4).tolist() == want
    assert simhash.fingerprint([], 4).tolist() == []


def test_spark_hash_is_the_same(spark):
    """Spark's xxhash64 of a string is XXH64 with seed 42."""
    for text in ("", "a b c d", "ü" * 50):
        got = spark.sql("SELECT xxhash64(:t) AS h", {"t": text}).first()["h"]
        assert got == np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64)


def test_odd_rows(spark, odd, none):
    check(odd)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(none).count() == 0
    assert {r["doc_id"] for r in kept.collect()} >= {None, 1, 2, 4, 5}


def test_one_id_of_two_texts_links_both(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, a), (5, b), (6, "c d e f")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


@pytest.mark.parametrize("texts", [[None, "a"], []])
def test_sliced_batches(texts):
    col = pa.array(["skip me", *texts], pa.string()).slice(1)
    data, at = words.text_buffer(col)
    assert len(simhash.fingerprint([data[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], 4)) == len(texts)

"""SimHash near-dedup by a tiled exact comparison of fingerprints.

A document's fingerprint has a bit set where over half of its shingles' 64-bit hashes have
it. Equal fingerprints are one node from the start. The distinct ones are dealt to tiles of
one population count and about TILE rows each; two fingerprints can't be within the radius
if their population counts differ beyond it, so a tile meets only the tiles of population
counts up to ``radius`` away, each pair of tiles once. A task holds the two tiles of a pair
as arrays, cuts them to subtiles in the order of the population counts of the four 16-bit
quarters, skips subtile pairs whose quarter counts differ beyond the radius in sum, and
compares the others with exclusive-or and bit counts. Nothing is sampled, capped or hashed
away: every pair within the radius is found.

Links aren't listed pair by pair: a tile pair gives at most one link for each of its rows (to the
smallest fingerprint that it is connected with inside the tile pair), and subtiles that are
one component already aren't compared again, so a large group of near copies stays linear.

The number of compared pairs still grows with the square of the number of distinct
fingerprints, over the share of pairs that the counts skip (about four fifths).

Defined cases: null text is empty; a text without words has the fingerprint zero and links
like any other; with fewer words than a shingle the whole sequence is the one shingle; a
null doc_id links with nothing and has no component; rows that repeat a doc_id are one
document, whose texts all link it; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

from . import words
from .common import components, id_and_text, join_groups

WORDS = 5
RADIUS = 4
SEED = 42
#: Distinct fingerprints of a tile, about: a pair of tiles is one row of twice 128 KB.
TILE = 1 << 14
SUBTILE = 256
#: Separators of words.
TABLE = words.byte_table([32, *range(9, 14)])
#: Hashes whose bits are unpacked together.
_CHUNK = 1 << 15


def shingle_hashes(data: bytes, n: int, seed: int = SEED):
    """XXH64 of each `n`-word shingle of a text, repeats included, in arrays of bounded size."""
    tail, some = [], False
    for piece in words.word_pieces(data, TABLE):
        piece = tail + piece
        tail = piece[-(n - 1):] if n > 1 else []
        if len(piece) < n:
            continue
        some = True
        joined = b" ".join(piece)
        starts = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, piece), np.int64, len(piece)) + 1, out=starts[1:])
        begins, ends = starts[: len(piece) - n + 1].tolist(), (starts[n:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        yield np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends)], np.uint64)
    if not some and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(runs, 64): how many hashes of each run, which begin at `starts`, have each bit (most significant first)."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprint(texts, n: int, seed: int = SEED) -> np.ndarray:
    """The fingerprints of some texts (bytes)."""
    count, size = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    waiting, rows, held = [], [], 0

    def flush():
        if waiting:
            sizes = np.array([len(h) for h in waiting])
            np.add.at(count, rows, _bit_counts(np.concatenate(waiting), np.cumsum(sizes) - sizes))
            waiting.clear()
            rows.clear()

    for i, text in enumerate(texts):
        for h in shingle_hashes(text, n, seed):
            size[i] += len(h)
            for at in range(0, len(h), _CHUNK):
                waiting.append(h[at: at + _CHUNK])
                rows.append(i)
                held += len(waiting[-1])
                if held >= _CHUNK:
                    flush()
                    held = 0
    flush()
    return np.packbits(2 * count > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, fp) for every row of `docs`."""
    def run(batches):
        for b in words.slices(batches):
            data, at = words.text_buffer(b.column(1))
            fp = fingerprint([data[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, fp bigint")


class Groups:
    """Connected groups of numbered things; a group's name is its smallest member."""

    def __init__(self, count: int):
        self.parent = np.arange(count)

    def root(self, x: np.ndarray) -> np.ndarray:
        x = self.parent[x]
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            x, y = self.root(x), self.root(y)
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def quarter_counts(fp: np.ndarray) -> np.ndarray:
    """(fingerprints, 4): the population counts of the 16-bit quarters."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest connected one) over the pairs of tile `a` with tile `b` -- or, for None, with itself."""
    whole = np.sort(a if b is None else np.concatenate([a, b]))
    groups = Groups(len(whole))

    def cut(fp):
        counts = quarter_counts(fp)
        order = np.lexsort(counts.T[::-1])
        fp, counts = fp[order], counts[order]
        starts = np.arange(0, len(fp), SUBTILE)
        return (fp, np.searchsorted(whole, fp), starts,
                np.minimum.reduceat(counts, starts, axis=0), np.maximum.reduceat(counts, starts, axis=0))

    fa, na, sa, low_a, high_a = cut(a)
    fb, nb, sb, low_b, high_b = cut(a if b is None else b)
    for k, i in enumerate(sa):
        # the counts of two subtiles differ by at least the gaps between their ranges
        gap = np.maximum(low_b - high_a[k], 0) + np.maximum(low_a[k] - high_b, 0)
        x, mine = fa[i: i + SUBTILE, None], na[i: i + SUBTILE]
        for j in sb[(gap.sum(axis=1) <= radius) & ((sb >= i) if b is None else True)]:
            other = nb[j: j + SUBTILE]
            names = groups.root(np.concatenate([mine, other]))
            if (names == names[0]).all():
                continue
            hit = np.bitwise_count(x ^ fb[None, j: j + SUBTILE]) <= radius
            left, right = np.nonzero(hit)
            if len(left):
                groups.join(mine[left], other[right])
    name = groups.root(np.arange(len(whole)))
    linked = np.flatnonzero(name != np.arange(len(whole)))
    return whole[linked], whole[name[linked]]


def tile_pairs(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """(t, u, a, b): the fingerprints of every pair of tiles t <= u that may hold links; b is empty where t = u."""
    spark = distinct.sparkSession
    counted = distinct.select("fp", F.bit_count("fp").alias("p"))
    size = {r["p"]: r["n"] for r in counted.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 at most
    tiles = [-(-size.get(p, 0) // tile) for p in range(65)]
    first = np.cumsum([0, *tiles]).tolist()

    def of(values) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("p") + 1).cast("bigint")

    salt = F.pmod(F.xxhash64(F.lit(1), "fp"), of([max(n, 1) for n in tiles]))
    dealt = counted.withColumn("t", of(first[:65]) + salt)
    dealt = dealt.groupBy("t", "p").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # about `tile` rows a group
    dealt = cut_lineage(dealt, "simhash-tiles")
    last = of([first[min(p + radius, 64) + 1] - 1 for p in range(65)])
    least = of([first[max(p - radius, 0)] for p in range(65)])
    left = dealt.select("t", F.explode(F.sequence(F.col("t"), last)).alias("u"), F.col("fps").alias("a"))
    right = dealt.select(F.explode(F.sequence(least, F.col("t"))).alias("t"), F.col("t").alias("u"), F.col("fps").alias("b"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(parts, "t", "u").join(right.repartition(parts, "t", "u").hint("merge"), ["t", "u"])


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that connect all pairs within `radius` bits."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                t, u, a, b = (batch.column(k)[i] for k in range(4))
                a = np.asarray(a.values).view(np.uint64)
                b = None if t.as_py() == u.as_py() else np.asarray(b.values).view(np.uint64)
                x, y = tile_links(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return tile_pairs(distinct, radius, tile).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, n: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`."""
    rows = cut_lineage(fingerprints(docs, n), "simhash-rows")
    known = rows.where("doc_id is not null")
    of = cut_lineage(known.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    edges = links(of.select("fp"), radius, tile)
    # a doc_id of several texts links their fingerprints
    many = known.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b < c").select("doc_id", "b")
    if many.limit(1).count():
        edges = edges.unionByName(known.distinct().join(many, "doc_id").select(F.col("fp").alias("a"), "b"))
    label = components(edges, "simhash-components")
    named = of.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    name = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut_lineage(named.join(name, "label").select("fp", "n", "component_id"), "simhash-names")
    total = rows.count()
    found = join_groups(known, named, ["fp"], "n", total).select("doc_id", "fp", "component_id").unionByName(
        rows.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("bigint").alias("component_id")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """`docs` without near-duplicates: the rows of each group's smallest doc_id stay, and those without a doc_id."""
    drop = near_duplicates(docs, **kw).where("doc_id <> component_id").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)

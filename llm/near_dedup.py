"""MinHash near-dedup with tensored banding.

Two collections, A and B, of ``side`` small hashes each are computed per document; a small
hash joins ``width`` minhashes. A document's table keys are all pairs (A[i], B[j]), so
``side**2`` tables cost only ``2 * side * width`` minhashes. Two documents of similarity s
share a key with probability ``(1 - (1 - s**width)**side)**2``; by default that is 0.9999 at
s = 0.8 and more above. Every candidate is confirmed on the full shingle sets.

No bucket emits its pairs. Documents with equal shingle sets are one class from the start;
then each member of a bucket is compared with the bucket's smallest member only, and what
is confirmed is merged into components. Pairs of one bucket that are still in different
components are compared too, behind two exact bounds (set sizes, and the parity bitmaps
below), so no link among the candidates is lost.

Parity bitmap: each shingle flips one of ``BITS`` bits. Two sets differ in at least as many
shingles as their bitmaps differ in bits, which bounds the intersection from above.

Defined cases: null text is empty; a text without words has an empty set and links with
nothing; a text with fewer words than a shingle has the whole sequence as its one shingle;
a null doc_id links with nothing and is kept; rows that repeat a doc_id count as one
document that all its texts link, one without words too; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

from . import words
from .common import components, id_and_text, join_groups

WORDS = 5
PERCENT = 80
SIDE = 14
WIDTH = 3
LONGS = 32
BITS = 64 * LONGS


def shingles(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each row, sorted; offsets of the rows in them)."""
    h, at = words.hash_words(col)
    length = np.diff(at)
    mult = np.random.default_rng(11).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    full = max(len(h) - n + 1, 0)
    s = np.zeros(full, np.uint64)
    for k in range(n):
        s += h[k: k + full] * mult[k]
    row = np.repeat(np.arange(len(length)), length)
    whole = row[:full] == row[n - 1: n - 1 + full]
    s, row = words.mix(s[whole]), row[:full][whole]
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        extra = [words.mix(np.sum(h[at[i]: at[i + 1]] * mult[:length[i]], keepdims=True, dtype=np.uint64)
                           + np.uint64(length[i]))[0] for i in short]
        s, row = np.concatenate([s, np.array(extra, np.uint64)]), np.concatenate([row, short])
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.searchsorted(row[new], np.arange(len(length) + 1))


def small_hashes(s: np.ndarray, at: np.ndarray, count: int, width: int) -> np.ndarray:
    """`count` hashes of `width` minhashes each for every row that has shingles."""
    rng = np.random.default_rng(23)
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), count), np.uint64)
    for c in range(count):
        for _ in range(width):
            low = np.minimum.reduceat(words.mix(s * (rng.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1))), starts)
            out[:, c] = words.mix(out[:, c] * np.uint64(31) + low)
        out[:, c] += np.uint64(c)
    return out


def _lists(values: np.ndarray, offsets) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, n: int, side: int, width: int) -> DataFrame:
    """(doc_id, n, h1, h2, small): set size, 128 bits of the set, and the small hashes."""
    def run(batches):
        for b in words.slices(batches):
            s, at = shingles(b.column(1), n)
            size = np.diff(at)
            small = small_hashes(s, at, 2 * side, width)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(size), *map(pa.array, _set_hashes(s, at)),
                _lists(small.ravel(), np.concatenate([[0], np.cumsum((size > 0) * 2 * side)]))],
                ["doc_id", "n", "h1", "h2", "small"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, small array<bigint>")


def _set_hashes(s: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """128 bits of every row's set."""
    return [words.per_row(words.mix(x), at).view(np.int64)
            for x in (s * np.uint64(0x9E3779B97F4A7C15), s + np.uint64(0x632BE59BD9B4E019))]


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, h1, h2, shingles, bits): the shingle set, its hashes and its parity bitmap."""
    def run(batches):
        for b in words.slices(batches):
            s, at = shingles(b.column(1), n)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            place = row * BITS + ((s >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)
            odd = (np.bincount(place, minlength=(len(at) - 1) * BITS) & 1).astype(np.uint8)
            bits = np.packbits(odd).view(np.uint64)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(at)), *map(pa.array, _set_hashes(s, at)), _lists(s, at),
                _lists(bits, np.arange(len(at)) * LONGS)], ["doc_id", "n", "h1", "h2", "shingles", "bits"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, shingles array<bigint>, bits array<bigint>")


def table_keys(reps: DataFrame, side: int) -> DataFrame:
    """(cls, key) for the keys that combine small hashes which other documents have too.

    A document's key can only be shared if both halves are, so halves that nobody shares
    are dropped before the pairs are formed.
    """
    halves = reps.select("cls", F.posexplode("small").alias("i", "v"))
    shared = halves.groupBy("i", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    mine = halves.join(shared, ["i", "v"]).groupBy("cls").agg(F.collect_list(F.struct("i", "v")).alias("h"))
    a, b = F.filter("h", lambda x: x["i"] < side), F.filter("h", lambda x: x["i"] >= side)
    return mine.select("cls", F.explode(F.flatten(F.transform(
        a, lambda x: F.transform(b, lambda y: F.xxhash64(x["v"], y["v"]))))).alias("key"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(x, "a").join(y, "b")
            .where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"))


def links(docs: DataFrame, classes: DataFrame, reps: DataFrame, n: int, percent: int, side: int) -> DataFrame:
    """(node, label): components over all confirmed pairs of classes that share a table key."""
    text, keys = id_and_text(docs), table_keys(reps, side)
    first = keys.groupBy("key").agg(F.min("cls").alias("b"), F.max("cls").alias("last")).where("b < last")
    met = cut_lineage(keys.join(first.select("key", "b"), "key"), "near-keys")
    # a class's set is made from the text of its smallest doc_id that has this very set
    ids = classes.join(met.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("rep").alias("doc_id"), "h1", "h2", "n")
    made = full_sets(text.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), n)
    sets = made.join(ids, ["doc_id", "h1", "h2", "n"]).join(reps, "cls").dropDuplicates(["cls"])
    sets = cut_lineage(sets.select("cls", "n", "shingles", "bits", "small"), "near-sets")
    star = met.select(F.col("cls").alias("a"), "b").where("a <> b").distinct()
    label = components(cut_lineage(confirm(star, sets, percent), "near-links"), "near-stars")
    rest = rest_pairs(still_apart(met, label), sets, percent, side)
    more = confirm(rest.join(star, ["a", "b"], "left_anti"), sets, percent)
    return components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), "near-all")


def still_apart(met: DataFrame, label: DataFrame) -> DataFrame:
    """(cls, key, label) of the buckets whose members are in more than one component."""
    mine = (met.select("cls", "key").join(label.withColumnRenamed("node", "cls"), "cls", "left")
            .withColumn("label", F.coalesce("label", "cls")))
    apart = mine.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    return mine.join(apart, "key", "left_semi")


def rest_pairs(mine: DataFrame, sets: DataFrame, percent: int, side: int) -> DataFrame:
    """Pairs (a, b) of a bucket in different components that pass both bounds.

    A pair meets in as many buckets as it shares keys; it counts in the one of the first
    small hash that both have in A and the first one in B, so it comes out once.
    """
    mine = mine.join(sets.select("cls", "n", "small", *[F.get("bits", F.lit(i)).alias(f"w{i}") for i in range(LONGS)]), "cls")
    l, r = mine.alias("l"), mine.alias("r")
    differ = sum((F.bit_count(F.col(f"l.w{i}").bitwiseXOR(F.col(f"r.w{i}"))) for i in range(1, LONGS)),
                 F.bit_count(F.col("l.w0").bitwiseXOR(F.col("r.w0"))))
    total = F.col("l.n") + F.col("r.n")
    # |x & y| <= (|x| + |y| - differ) / 2, and similar pairs need 100 |x & y| >= percent |x | y|
    near = ((100 + percent) * (total - differ) >= 2 * percent * total)
    equal = F.zip_with("l.small", "r.small", lambda x, y: F.when(x == y, x))
    one, two = (F.get(F.array_compact(F.slice(equal, at, side)), F.lit(0)) for at in (1, side + 1))
    met = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.cls") > F.col("r.cls"))
                 & (F.col("l.label") != F.col("r.label")) & (100 * F.col("l.n") >= percent * F.col("r.n"))
                 & (100 * F.col("r.n") >= percent * F.col("l.n")) & near & (F.col("l.key") == F.xxhash64(one, two)))
    return met.select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT,
                    side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`."""
    base = cut_lineage(signatures(docs, n, side, width), "near-signatures")
    # equal sets are one class, whatever the doc_ids of its rows
    same = base.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("of"))
    # numbered in the order of their smallest doc_ids, so that a bucket's smallest member is its first document
    ordered = same.orderBy(F.col("rep").asc_nulls_last(), "h1", "h2", "n")
    classes = cut_lineage(ordered.withColumn("cls", F.monotonically_increasing_id()), "near-classes")
    joined = join_groups(base.where("n > 0"), classes, ["h1", "h2", "n"], "of", base.count())
    rows = cut_lineage(joined.select("doc_id", "n", "cls", F.when(F.col("doc_id") == F.col("rep"), F.col("small")).alias("small"))
                       .unionByName(base.where("n = 0").select("doc_id", "n", F.lit(None).cast("bigint").alias("cls"),
                                                               F.lit(None).cast("array<bigint>").alias("small"))), "near-rows")
    reps = rows.where("small is not null").dropDuplicates(["cls"]).select("cls", "small")
    classes = classes.where("rep is not null")
    label = links(docs, classes, reps, n, percent, side)
    # rows of one doc_id are one document, whatever their texts
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("cls").alias("with_words"), F.count(F.lit(1)).alias("rows"))
    many = ids.where("lo <> hi or (lo is not null and with_words < rows)").select("doc_id", "lo")
    several = many.limit(1).count() > 0
    if several:
        many = cut_lineage(many, "near-many")
        edges = label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(
            rows.where("cls is not null").select("doc_id", "cls").distinct().join(many, "doc_id").select(F.col("cls").alias("a"), F.col("lo").alias("b")))
        label = components(edges, "near-ids")
    named = classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    name = named.groupBy("label").agg(F.min("rep").alias("component"))
    named = cut_lineage(named.join(name, "label").select("cls", "of", "component"), "near-names")
    found = join_groups(rows.where("cls is not null").select("doc_id", "n", "cls"), named, ["cls"], "of", base.count()).select(
        "doc_id", "n", "component")
    if several:
        wordless = rows.where("cls is null").select("doc_id", "n").join(many, "doc_id", "left")
        found = found.unionByName(wordless.join(named.select(F.col("cls").alias("lo"), "component"), "lo", "left")
                                  .select("doc_id", "n", "component"))
    else:
        found = found.unionByName(rows.where("cls is null").select("doc_id", "n", F.lit(None).cast("bigint").alias("component")))
    # rows of a class without any doc_id
    found = found.unionByName(rows.where("cls is not null and doc_id is null").join(classes.select("cls"), "cls", "left_anti")
                              .select("doc_id", "n", F.lit(None).cast("bigint").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """`docs` without near-duplicates: the smallest doc_id of each group stays."""
    drop = near_duplicates(docs, **kw).where("not kept").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)

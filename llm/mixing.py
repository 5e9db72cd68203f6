"""Mixing sources to target weights by a splitting tree of hypergeometric draws.

A document's size is its number of words. Each source's documents fall into disjoint blocks
by the high bits of a seeded hash; the low bits permute them inside the block. A source's
target is met by whole passes over its blocks and a last pass that stops where the target
is reached, so its block quota is exact. The tree splits the quotas of all sources among
the output shards: each node halves its shards and gives the left half a
multivariate-hypergeometric draw of its blocks, seeded by the node, down to single shards.
A shard takes the next blocks of each source's permutation, so shards are disjoint, and
shuffles them locally by a hash. All choices are hashes of (seed, doc_id) or draws seeded
by (seed, node): reruns agree, and nothing depends on the partitioning.

The pass that stops does so at the document nearest the target; up to FIXES single
documents per source are then added or left out where that comes nearer. An added document
whose block isn't drawn in that pass is a draw of its own in the tree.

There are as many shards as the mix has SHARD_WORDS, up to MAX_SHARDS; each is one partition
of the output. The place where a source's last pass stops is found by sums over cells of the
hash, refined inside the cell that holds the target, so no task orders a source's rows.

Only one row per source and per block or cell reaches the driver: MAX_SOURCES sources at
most (more is an error) and about 2**BLOCK_BITS blocks, or cells of a step, in all.

Defined cases: null text has size 0; a null source is a source of its own, last in order;
sources without words have target 0 and give nothing; null doc_ids share a place in the
permutation; rows are mixed one by one, also repeated ones; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

from .common import word_count


WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SHARD_WORDS = 1 << 21
MAX_SHARDS = 1 << 14
SEED = 17
FIXES = 3
BLOCK_BITS = 14
MAX_SOURCES = 100_000


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """source -> target words; sources by code point, null last, weigh `weights` in turn."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        left, of = total - sum(out.values()), sum(weigh[s] for s in free)
        over = [s for s in free if left * weigh[s] / of > cap * sizes[s]]
        if not over:
            out |= {s: left * weigh[s] / of for s in free}
            break
        out |= {s: cap * sizes[s] for s in over}
        free = [s for s in free if s not in out]
    return {s: float(out[s]) for s in order}


def split(quota: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): how many of each source's block draws every shard gets."""
    out = np.zeros((shards, len(quota)), np.int64)

    def node(low, high, q):
        if high - low == 1:
            out[low] = q
            return
        half = (low + high) // 2
        total = int(q.sum())
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(
            q, total * (half - low) // (high - low), method="marginals")
        node(low, half, left)
        node(half, high, q - left)

    node(0, shards, np.asarray(quota, np.int64))
    return out


@dataclass
class Plan:
    """What the mix takes of one source."""
    source: str | None
    size: int
    target: float
    bits: int
    passes: int
    cutoff: int | None  # the last hash of the pass that stops


def hashed(key: Column) -> Column:
    """A 63-bit hash, not negative, in permuted order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.coalesce(key.cast("string"), F.lit("null"))), 1)



def sizes_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, h), stored: texts are read and counted once."""
    return cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), "source",
        word_count().alias("size"),
        hashed(F.col("doc_id")).alias("h")), "mix-sizes")


def _local(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def plan(sized: DataFrame) -> list[Plan]:
    """One Plan per source."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size = {r["source"]: r["size"] for r in found}
    total = max(sum(size.values()), 1)
    plans = [Plan(s, size[s], t, int(np.log2(max(size[s] / total * 2**BLOCK_BITS, 1))),
                  *((int(t // size[s]), None) if size[s] else (0, None))) for s, t in targets(size).items()]
    if not plans:
        return plans
    cutoff = stops(sized.where("size > 0"), {p.source: p.target - p.passes * p.size for p in plans if p.size})
    for p in plans:
        p.cutoff = cutoff.get(p.source)
    return plans


def stops(sized: DataFrame, want: dict) -> dict:
    """source -> the last hash of a pass that stops nearest `want` words; sources that want none have none.

    A step sums the words of the cells of a hash range and goes on inside the cell where the
    sum reaches what is wanted, until that cell is one hash: it is taken if its middle is in.
    """
    spark = sized.sparkSession
    # (first hash of the range, its bits, words before it)
    open_, out = {s: (0, 63, 0) for s, w in want.items() if w > 0}, {}
    while open_:
        width = max(BLOCK_BITS - int(np.ceil(np.log2(len(open_)))), 1)
        table = F.broadcast(_local(spark, [(s, low, bits) for s, (low, bits, _) in open_.items()],
                                   "s string, low bigint, bits int"))  # MAX_SOURCES rows at most
        inside = sized.join(table, F.col("source").eqNullSafe(F.col("s"))).where("shiftright(h, bits) = shiftright(low, bits)")
        cells = inside.groupBy("s", F.expr(f"shiftright(h - low, greatest(bits - {width}, 0))").alias("cell")).agg(
            F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last")).collect()  # about 2**BLOCK_BITS rows
        by_source: dict = {}
        for r in cells:
            by_source.setdefault(r["s"], []).append((r["cell"], r["words"], r["first"], r["last"]))
        left = {}
        for s, (low, bits, before) in open_.items():
            mine = sorted(by_source[s])
            for cell, size, first, last in mine:
                if before + size < want[s] and cell != mine[-1][0]:
                    before += size
                elif first == last:
                    out[s] = first if before + size / 2 <= want[s] else first - 1
                    break
                else:
                    step = max(bits - width, 0)
                    left[s] = (low + (cell << step), step, before)
                    break
        open_ = left
    return out


def copies(df: DataFrame, plans: list[Plan], fixes: dict, key: str = "doc_id", of: str = "source") -> DataFrame:
    """`df` with the columns of its source's plan and `copies`; fixes: (source, doc_id) -> change."""
    spark = df.sparkSession
    change = {}
    for (s, d), n in fixes.items():
        change.setdefault(s, []).append((d, n))
    rows = [(p.source, p.size, p.target, p.bits, p.passes, -1 if p.cutoff is None else p.cutoff,
             change.get(p.source, [])) for p in plans]
    table = _local(spark, rows, "mix_source string, source_size bigint, target double, bits int, passes int, "
                                "cutoff bigint, fixes array<struct<id: bigint, n: int>>")
    out = df.join(F.broadcast(table), F.col(of).eqNullSafe(F.col("mix_source")))  # MAX_SOURCES rows at most
    more = F.aggregate(F.filter("fixes", lambda x: x["id"] == F.col(key)), F.lit(0), lambda a, x: a + x["n"])
    return out.withColumn("copies", F.col("passes") + (hashed(F.col(key)) <= F.col("cutoff")).cast("int") + more)


def fix(sized: DataFrame, plans: list[Plan]) -> dict:
    """(source, doc_id) -> +1 or -1 for the documents whose change brings a source nearest its target."""
    fixes = {}
    once = sized.groupBy("source", "doc_id").agg(F.sum("size").alias("size")).where("size > 0 and doc_id is not null")
    for _ in range(FIXES):
        took = copies(sized, plans, fixes).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
        taken = {r["source"]: r["taken"] for r in took.collect()}  # a row per source
        gap = [(p.source, p.target - taken[p.source]) for p in plans if taken.get(p.source) is not None]
        if not any(abs(g) >= 1 for _, g in gap):
            break
        table = F.broadcast(_local(sized.sparkSession, gap, "gap_source string, gap double"))  # MAX_SOURCES rows at most
        x = copies(once, plans, fixes).join(table, F.col("source").eqNullSafe(F.col("gap_source")))
        x = x.where(F.when(F.col("gap") > 0, F.col("copies") < int(CAP)).otherwise(F.col("copies") > 0))
        x = x.withColumn("off", F.abs(F.abs("gap") - F.col("size"))).where("off < abs(gap)")
        best = x.groupBy("source").agg(F.min(F.struct("off", "doc_id", F.signum("gap").cast("int").alias("n"))).alias("b"))
        found = best.collect()  # a row per source
        if not found:
            break
        for r in found:
            k = (r["source"], r["b"]["doc_id"])
            fixes[k] = fixes.get(k, 0) + r["b"]["n"]
    return fixes


def mix_plan(docs: DataFrame) -> tuple[DataFrame, list[Plan], dict]:
    sized = sizes_of(docs)
    plans = plan(sized)
    return sized, plans, fix(sized, plans)


def _amounts(df: DataFrame, taken: Column | None = None) -> DataFrame:
    taken = F.col("size") * F.col("copies") if taken is None else taken
    return df.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("bigint").alias("copies"),
                     taken.cast("bigint").alias("taken"))


def amounts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of `docs`, as planned."""
    return _amounts(copies(*mix_plan(docs)))


def shards_for(plans: list[Plan], words: int = SHARD_WORDS) -> int:
    """A shard for each `words` of the targets."""
    return int(min(max(-(-sum(p.target for p in plans) // words), 1), MAX_SHARDS))


def shard_of_draws(plans: list[Plan], shards: int, extra: dict | None = None) -> list[tuple]:
    """(source, block, pass, shard) of every block draw; extra: source -> more (block, pass) that are drawn."""
    draws = [[(b, k) for k in range(p.passes + 1) for b in range(2**p.bits)
              if k < p.passes or (p.cutoff is not None and b <= p.cutoff >> (63 - p.bits))]
             + sorted((extra or {}).get(p.source, [])) for p in plans]
    quota = split(np.array([len(d) for d in draws]), shards)
    return [(p.source, b, k, int(s)) for p, d, q in zip(plans, draws, quota.T)
            for (b, k), s in zip(d, np.repeat(np.arange(shards), q), strict=True)]


def deal(rows: DataFrame, sized: DataFrame, plans: list[Plan], fixes: dict, shards: int, key: str = "doc_id",
         of: str = "source") -> DataFrame:
    """`rows` once for every drawn block that holds them, with `pass` and `shard`, shuffled in their shards.

    `sized` are the rows that `plans` were made from.
    """
    def known(rows, key, of):
        out = copies(rows, plans, fixes, key, of).withColumn("h", hashed(F.col(key)))
        return out.withColumn("block", F.expr("shiftright(h, 63 - bits)")).where("copies > 0")

    # a document that a fix adds where the last pass has not drawn its block is a draw of its own: FIXES a source at most
    drawn = F.col("passes") + F.expr("cutoff >= 0 and block <= shiftright(cutoff, 63 - bits)").cast("int")
    extra: dict = {}
    if fixes:
        added = known(sized.select("doc_id", "source"), "doc_id", "source").where(F.col("copies") > drawn)
        for r in added.select("source", "block", F.explode(F.sequence(drawn, F.col("copies") - 1)).alias("k")).distinct().collect():
            extra.setdefault(r["source"], []).append((r["block"], r["k"]))
    draws = _local(rows.sparkSession, shard_of_draws(plans, shards, extra), "s string, b bigint, pass int, shard int")
    placed = known(rows, key, of).join(
        F.broadcast(draws), F.col(of).eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("pass") < F.col("copies")))
    return (placed.drop("s", "b").repartitionById(shards, F.col("shard"))
            .sortWithinPartitions("shard", F.xxhash64(F.lit(SEED), "shard", "h", "pass")))


def mix(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix: rows of `docs`, as often as they are taken, dealt to shards and shuffled in them."""
    sized, plans, fixes = mix_plan(docs)
    if not plans:
        return docs
    whole = docs.select(F.struct(*docs.columns).alias("mixed"), F.col("doc_id").cast("bigint").alias("key"),
                        F.col("source").alias("of"))
    return deal(whole, sized, plans, fixes, shards or shards_for(plans), "key", "of").select("mixed.*")


def drawn_amounts(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """What amounts() plans, counted from the stored shards of a mix; a row that differs is an error."""
    sized, plans, fixes = mix_plan(docs)
    planned = copies(sized, plans, fixes)
    if not plans:
        return _amounts(planned)
    dealt = cut_lineage(deal(sized, sized, plans, fixes, shards or shards_for(plans)).select("row", "size", "pass", "shard"), "mix-shards")
    held = dealt.groupBy("row").agg(F.count(F.lit(1)).alias("held"), F.sum("size").alias("taken"))
    found = planned.join(held, "row", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    found = found.withColumn("copies", F.when(F.col("held") == F.col("copies"), F.col("held")).otherwise(
        F.raise_error(F.concat(F.lit("shards differ from the plan at doc_id "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))))
    return _amounts(found, F.coalesce("taken", F.lit(0)))

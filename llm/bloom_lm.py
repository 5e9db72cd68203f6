"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne 2007).

N-grams (one and two tokens) are counted over the whole training text. Those that make up
at least 1 / ENTRIES of its tokens go into one Bloom filter, with the count quantised: an
n-gram of level q is inserted q times, as (n-gram, 1) to (n-gram, q). A level doubles the
count every two steps. Its count is read back by probing (n-gram, 1), (n-gram, 2), ... until
a probe fails. As the threshold follows the text's size, an order makes at most
``1.7 * ENTRIES`` insertions whatever the corpus, so the filter that is broadcast has a fixed
size (BITS) and error rate at every size.

No n-gram is lost to the threshold: rows are dealt to blocks of about GATHER tokens, which
send their distinct n-grams to be counted, and get the exact counts of the rarer ones back.
A block is scored with them, so a token takes no join of its own.

A token's probability mixes the two orders, ``MIX * (c(v w) - DISCOUNT) / c(v) + (1 - MIX) *
c(w) / N``; a word that the training text doesn't have counts as half an occurrence.

The base score uses exact counts. Tokens of at least N / HEAVY occurrences (HEAVY of them at
most) are broadcast; the counts of the others come back to their block.

Defined cases: a null text is empty and has the end token alone; a null doc_id is trained
on; without training tokens all counts are 0, base scores follow the formula with N = V = 0
and scores equal them; repeated rows count as often as they come; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

from . import words
from .common import id_and_text, word_count

ENTRIES = 1 << 21
STEPS = 2
BITS = 1 << 26
PROBES = 6
MIX = 0.3
DISCOUNT = 0.75
HEAVY = 1 << 20
#: Tokens of a block: its distinct n-grams are counted together, and the filter is probed once for each.
GATHER = 1 << 20
#: N-grams that a range of hashes holds, about, over all blocks.
RANGE = 1 << 23
END = np.uint64(0x7D5A1C93E4B20F68)
_PAIR = np.uint64(0xA24BAED4963EE407)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and the end token of every row, offsets of the rows)."""
    h, at = words.hash_words(col)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def pairs(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of (token before, token) of every token; before a row's first stands the end token."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[at[:-1]] = END
    return words.mix(before * _PAIR + t)


def blocks(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with a row number and the block of each row: neighbours of about GATHER tokens in all, or one longer text."""
    def deal(batches):
        task, row, block, size = TaskContext.get().partitionId() << 40, 0, 0, 0
        for b in words.slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), task + block)), pa.array(task + row + np.arange(len(b))),
                                              b.column(0), b.column(1)], ["block", "row", "doc_id", "text"])
            row += len(b)
            # white space ends most tokens, and a row's end one
            size += np.count_nonzero(words.text_buffer(b.column(1))[0] <= 32) + len(b)
            if size >= GATHER:
                block, size = block + 1, 0

    return docs.select("doc_id", "text").mapInArrow(deal, "block bigint, row bigint, doc_id bigint, text string")


def _distinct(t: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams, sorted; place of every token's n-gram among them)."""
    return np.unique(t if n == 1 else pairs(t, at), return_inverse=True)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The values of a list column, one row after the other."""
    return np.concatenate([x.flatten().to_numpy() for x in column.chunks])


def block_counts(dealt: DataFrame, total: int, below: tuple[float, float], least: float) -> DataFrame:
    """Counts over the rows of `dealt` (block, row, text, train) with `train`, by n and range of hashes.

    A row without block has a range's n-grams and their counts (gram, c): every single token,
    and the pairs of at least `least` occurrences. The others hold, for the distinct n-grams
    of a piece in their order, the counts less than ``below[n - 1]`` (found; 0 for the rest).
    A piece is what a task meets of a block, mostly all of it; `first` is its first row.

    Blocks send sorted runs of hashes, cut by hash range, so that a range's runs are merged
    in one small group; ranges hold distinct hashes, so none is hot.
    """
    ranges = max(4 * int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE)

    def runs(n, key, t, at, train):
        g, back = _distinct(t, at, n)
        c = np.bincount(back, np.repeat(train, np.diff(at)), len(g)).astype(np.int64)
        part = ((g >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(part, np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(cut))
        at = pa.array(np.append(cut[some], len(g)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (g.view(np.int64), c)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), n, np.int32)), pa.array(some), *(pa.array(np.full(len(some), x)) for x in key), *lists],
            ["n", "range", "block", "first", "gram", "c"])

    def finish(key, held):
        if held:
            t, at = _joined([tokens(b.column(2)) for b in held])
            train = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in held]).astype(float)
            yield from (runs(n, key, t, at, train) for n in (1, 2))

    def send(batches):
        held, key, last = [], None, None
        for b in words.slices(batches):
            block, row = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = (np.diff(block, prepend=block[0]) != 0) | (np.diff(row, prepend=row[0] - 1) != 1)
            new[0] = (block[0], row[0] - 1) != last
            edges = np.append(np.flatnonzero(new), len(b))
            if edges[0]:
                held.append(b.slice(0, edges[0]))
            for begin, end in zip(edges[:-1], edges[1:]):
                yield from finish(key, held)
                held, key = [b.slice(begin, end - begin)], (block[begin], row[begin])
            last = (block[-1], row[-1])
        yield from finish(key, held)

    def merge(table: pa.Table) -> pa.Table:
        n, part = table.column("n")[0].as_py(), table.column("range")[0].as_py()
        g, c = _flat(table.column("gram")), _flat(table.column("c"))
        order = np.argsort(g, kind="stable")
        new = np.append(True, g[order[1:]] != g[order[:-1]])
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        g, c = g[order[first]], np.add.reduceat(c[order], first)
        found = np.empty(len(order), np.int32)
        found[order] = np.where(c < min(below[n - 1], 1 << 31), c, 0)[of]
        keep = c >= (least if n == 2 else 1)
        pieces = len(table)
        lengths = np.concatenate([x.value_lengths().to_numpy() for x in table.column("c").chunks])
        whole = pa.array(np.append(0, np.full(pieces + 1, keep.sum())), pa.int32())
        return pa.table({
            "n": np.full(pieces + 1, n, np.int32), "range": np.full(pieces + 1, part),
            **{k: pa.concat_arrays([pa.nulls(1, pa.int64()), *table.column(k).chunks]) for k in ("block", "first")},
            "gram": pa.ListArray.from_arrays(whole, pa.array(g[keep])), "c": pa.ListArray.from_arrays(whole, pa.array(c[keep])),
            "found": pa.ListArray.from_arrays(pa.array(np.cumsum(np.append([0, 0], lengths)), pa.int32()), pa.array(found))})

    schema = "n int, range bigint, block bigint, first bigint, gram array<bigint>, c array<bigint>"
    sent = dealt.select("block", "row", "text", "train").mapInArrow(send, schema)
    return sent.groupBy("n", "range").applyInArrow(merge, schema + ", found array<int>")


def _joined(parts) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets of the rows) of several pieces as one."""
    t = np.concatenate([t for t, _ in parts])
    return t, np.append(0, np.cumsum(np.concatenate([np.diff(at) for _, at in parts])))


def totals(counted: DataFrame) -> DataFrame:
    """(n, gram, c) of ``block_counts``."""
    return (counted.where("block is null").select("n", F.explode(F.arrays_zip("gram", "c")).alias("x"))
            .select("n", "x.gram", "x.c"))


def ngram_counts(docs: DataFrame, total: int, least: float) -> DataFrame:
    """(n, gram, c): every single token, and the pairs of at least `least` occurrences."""
    dealt = blocks(docs).withColumn("train", F.lit(True))
    return totals(block_counts(dealt, total, (0, 0), least))


def level(c, least: float):
    """Quantised log frequency: 1 at `least`, STEPS more with every doubling."""
    return 1 + np.floor(STEPS * np.log2(np.maximum(c / least, 1)) + 1e-9).astype(np.int64)


def count_of(q, least: float):
    """The count that stands for a level, in the middle of its range."""
    return least * 2 ** ((q - 0.5) / STEPS)


def places(gram: np.ndarray, n: int, q) -> list[np.ndarray]:
    """The PROBES bits of (n-gram, level)."""
    order = np.uint64(n * 0xA24BAED4963EE407 % 2**64)
    h = words.mix(gram + order + np.atleast_1d(np.asarray(q, np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    step = words.mix(h) | np.uint64(1)
    return [(h + np.uint64(i) * step) % np.uint64(BITS) for i in range(PROBES)]


def build(grams: DataFrame, least: float) -> np.ndarray:
    """The filter's bytes, from (n, gram, c)."""
    def bits(batches):
        for b in batches:
            n, g, c = (b.column(i).to_numpy() for i in range(3))
            q = level(c, least)
            r = np.repeat(np.arange(len(g)), q)
            j = np.arange(len(r)) - np.repeat(np.cumsum(q) - q, q) + 1
            for order in (1, 2):
                one = n[r] == order
                at = np.concatenate(places(g.view(np.uint64)[r[one]], order, j[one]))
                at = np.unique(at)
                if len(at):
                    word, first = np.unique(at >> np.uint64(6), return_index=True)
                    value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["w", "v"])

    rows = grams.mapInArrow(bits, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def levels(filter_bytes: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """Level of each n-gram, 0 for none: probes (n-gram, 1), (n-gram, 2), ... until one fails."""
    out = np.zeros(len(gram), np.int64)
    left = np.arange(len(gram))
    q = 1
    while len(left):
        h = gram[left]
        hit = np.ones(len(left), bool)
        for at in places(h, n, q):
            hit &= (filter_bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        left = left[hit]
        out[left] = q
        q += 1
    return out


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`."""
    docs = id_and_text(docs)
    spark = docs.sparkSession
    size = docs.where(~held_out()).agg(F.sum(word_count() + 1)).first()[0] or 0
    if not size:
        zero = docs.select("doc_id", (word_count() + 1).alias("n_tokens"))
        zero = zero.withColumn("base_score", F.lit(0.0) * F.col("n_tokens"))
        return zero.select("doc_id", held_out().alias("held_out"), "n_tokens", F.lit(0).cast("bigint").alias("n_known"),
                           F.lit(0).cast("bigint").alias("train_tokens"), "base_score", F.col("base_score").alias("score"))
    least = max(size / ENTRIES, 1.0)
    # at most HEAVY tokens are as frequent as this
    often = max(size / HEAVY, 1.0)
    dealt = cut_lineage(blocks(docs), "lm-blocks")
    counted = cut_lineage(block_counts(dealt.withColumn("train", ~held_out()), size, (often, least), least), "lm-counts")
    counts = totals(counted)
    single = counts.where("n = 1")
    vocabulary = single.count()
    norm = np.log10(size + 0.5 * (vocabulary + 1))
    unseen = 0.5 / size
    heavy = single.where(F.col("c") >= often).select("gram", "c").toArrow()
    order = np.argsort(heavy.column("gram").to_numpy().view(np.uint64))
    sent = spark.sparkContext.broadcast((
        build(counts.where(F.col("c") >= least), least),
        heavy.column("gram").to_numpy().view(np.uint64)[order], heavy.column("c").to_numpy()[order]))

    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        back = back.sort_by([("first", "ascending"), ("n", "ascending"), ("range", "ascending")])
        firsts, at = np.unique(back.column("first").to_numpy(), return_index=True)
        cut = np.append(np.searchsorted(rows.column("row").to_numpy(), firsts), len(rows))
        at = np.append(at, len(back))
        return pa.concat_tables(piece(rows.slice(cut[i], cut[i + 1] - cut[i]), _flat(back.column("found").slice(at[i], at[i + 1] - at[i])))
                                for i in range(len(firsts)))

    def piece(rows: pa.Table, rarer: np.ndarray) -> pa.Table:
        table, gram, count = sent.value
        held = list(words.slices(rows.to_batches()))
        t, at = _joined([tokens(b.column(3)) for b in held])
        # exact counts: broadcast, or sent back to the block
        u, of = _distinct(t, at, 1)
        place = np.minimum(np.searchsorted(gram, u), max(len(gram) - 1, 0))
        c = np.where(gram[place] == u, count[place], rarer[: len(u)]) if len(gram) else rarer[: len(u)]
        known = c > 0
        base = np.log10(c + 0.5) - norm
        # model: levels of tokens and pairs from the filter, exact counts of those that aren't in it
        q = levels(table, u, 1)
        c1 = np.where(q > 0, count_of(q, least), c)
        p1 = np.where(c1 > 0, c1 / size, unseen)[of]
        two, of2 = _distinct(t, at, 2)
        q2 = levels(table, two, 2)
        c2 = np.where(q2 > 0, count_of(q2, least), rarer[len(u):])[of2]
        before = np.empty(len(t))
        before[1:] = c1[of][:-1]
        before[at[:-1]] = c1[np.searchsorted(u, END)]
        p2 = np.maximum(c2 - DISCOUNT, 0) / np.maximum(np.maximum(before, c2), 1.0)
        model = np.log10(MIX * p2 + (1 - MIX) * np.minimum(p1, 1.0))
        n_known, base, model = (np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64)[of], base[of], model))
        return pa.table({"doc_id": pa.concat_arrays([b.column(2) for b in held]), "n_tokens": np.diff(at),
                         "n_known": n_known, "base_score": base, "score": model})

    found = dealt.groupBy("block").cogroup(counted.where("block is not null").select("block", "first", "n", "range", "found").groupBy("block"))
    scored = found.applyInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
                         F.lit(size).cast("bigint").alias("train_tokens"), "base_score", "score")

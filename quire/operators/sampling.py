"""Seeded sampling, shuffling and splitting.

Reproducibility: every random choice is a hash of (seed, key), so results do
not depend on partitioning or executor count, and DuckDB can recompute them
(``md5`` prefix as a 32-bit integer, ties broken by the key).

Scale: a class-stratified sample needs the rank of each row inside its class.
``row_number() over (partition by label ...)`` would put a whole class (half
the data for a binary label) into one task. ``hash_rank`` instead

1. buckets rows by the top 16 bits of their hash (65,536 buckets per class),
2. ranks rows inside (class, bucket) only, counting the bucket on the same
   partitions,
3. turns the per-bucket counts into offsets with a window over *buckets*
   (a small table) and adds them. Class sizes come from the same counts, so
   the input is scanned once.

Same ranks as the global window, but the largest sort is one bucket. Joins
against the small per-class / per-bucket tables are left to AQE, which
broadcasts them when their runtime size is under the threshold and falls back
to a shuffle join otherwise.

Every operator takes ``groups``: columns naming independent datasets (e.g.
the content source). All datasets are then split in the same jobs, with
class counts, quotas and ranks computed per group -- no driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import SEED
from ..session import cut_lineage

BUCKET_BITS = 16


def hash32(key: Column, seed=SEED, salt: str = "") -> Column:
    """Deterministic 32-bit hash: first 8 hex digits of md5('<seed>[:salt]:<key>')."""
    prefix = f"{seed}:{salt}:" if salt else f"{seed}:"
    return F.conv(F.substring(F.md5(F.concat(F.lit(prefix), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def rank_table(df: DataFrame, key: str, by=(), seed=SEED, salt: str = "", rank_col: str = "_rank", facts=None):
    """Exact 1-based rank within `by` (order: hash(seed, key), key) plus row counts per `by`.

    `facts` turns the counts into a table with one row per `by` (class sizes,
    quotas); its columns come with the ranked rows. They ride on the offsets
    per (by, bucket), so no row is ever shuffled by `by` alone.

    Returns (ranked rows, counts(by..., _cnt)). The input is computed once:
    rows are exchanged by (by, bucket) for the in-bucket window, the bucket
    sizes are a window count over the same partitions, and the per-bucket
    histogram (hence offsets and group counts) is aggregated from that output
    without another exchange or another pass over `df`.
    """
    by = list(by)
    part = Window.partitionBy(*by, "_b")
    r = (_bucketed(df, key, seed, salt).withColumn("_rb", F.row_number().over(part.orderBy("_h", key)))
         .withColumn("_bc", F.count(F.lit(1)).over(part)))
    offsets, counts, extra = _offsets(r.groupBy(*by, "_b").agg(F.max("_bc").alias("_bn")), by, facts)
    ranked = r.join(offsets.drop("_bn"), by + ["_b"]).select(*df.columns, (F.col("_off") + F.col("_rb")).alias(rank_col), *extra)
    return ranked, counts


def _bucketed(df: DataFrame, key: str, seed, salt: str) -> DataFrame:
    """`df` with the hash `_h` of the key and its bucket `_b`."""
    return df.withColumn("_h", hash32(F.col(key), seed, salt)).withColumn("_b", F.shiftright(F.col("_h"), 32 - BUCKET_BITS))


def _offsets(hist: DataFrame, by, facts):
    """From (by..., _b, _bn): offsets (by..., _b, _bn, _off, columns of `facts`), counts(by..., _cnt), those columns' names."""
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(*by, "_b", "_bn", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    counts = hist.groupBy(*by).agg(F.sum("_bn").alias("_cnt"))
    if facts is None:
        return offsets, counts, []
    per_class = facts(counts)
    offsets = offsets.join(per_class, by) if by else with_scalars(offsets, per_class)
    return offsets, counts, [c for c in per_class.columns if c not in by]


def rank_cuts(df: DataFrame, key: str, by, cuts, seed=SEED, salt: str = "", facts=None):
    """Which ranks of ``rank_table`` reach up to cuts, without an exchange of the rows.

    `facts` turns the counts into a table with one row per `by` and the columns `cuts`: a
    cut is a rank. Returns (rows of `df` with a boolean for each cut, named like it: whether
    the rank is at most the cut; counts(by..., _cnt)).

    The ranks of most buckets lie on one side of a cut, so the bucket's number tells; only
    the rows of the one bucket that a cut goes through are ranked. `df` is read three times:
    this is for stored tables. The last bucket before each cut, and the one that it goes
    through, are broadcast, a row for each `by`.
    """
    by = list(by)
    x = _bucketed(df, key, seed, salt)
    offsets, counts, _ = _offsets(x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_bn")), by, facts)
    end, cells = F.col("_off") + F.col("_bn"), []
    for c in cuts:
        through = (F.col("_off") < F.col(c)) & (end > F.col(c))
        cells += [F.coalesce(F.max(F.when(end <= F.col(c), F.col("_b"))), F.lit(-1)).alias(f"{c}_last"),
                  F.coalesce(F.max(F.when(through, F.col("_b"))), F.lit(-1)).alias(f"{c}_edge"),
                  F.max(F.when(through, F.col(c) - F.col("_off"))).alias(f"{c}_left")]
    edges = offsets.groupBy(*by).agg(*cells)
    met = x.join(F.broadcast(edges), by) if by else with_scalars(x, edges)
    at_edge = F.col("_b").isin(*[F.col(f"{c}_edge") for c in cuts])
    before = {c: F.col("_b") <= F.col(f"{c}_last") for c in cuts}
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    ranked = met.where(at_edge).withColumn("_rb", rank)
    sure = met.where(~at_edge).select(*df.columns, *[before[c].alias(c) for c in cuts])
    return sure.unionByName(ranked.select(*df.columns, *[
        (before[c] | ((F.col("_b") == F.col(f"{c}_edge")) & (F.col("_rb") <= F.col(f"{c}_left")))).alias(c) for c in cuts])), counts


def hash_rank(df: DataFrame, key: str, by=(), seed=SEED, salt: str = "", rank_col: str = "_rank") -> DataFrame:
    """Exact 1-based rank of each row within `by`, ordered by (hash(seed, key), key)."""
    return rank_table(df, key, by, seed, salt, rank_col)[0]


def _class_stats(counts: DataFrame, label: str, groups) -> DataFrame:
    """(groups..., label, _nc, _n, _k) from per-class counts (one row per class)."""
    w = Window.partitionBy(*groups)
    return (counts.withColumnRenamed("_cnt", "_nc")
            .withColumn("_n", F.sum("_nc").over(w))
            .withColumn("_k", F.count(F.lit(1)).over(w)))


def class_counts(df: DataFrame, label: str, groups=()) -> DataFrame:
    """(groups..., label, _nc, _n, _k): class size, dataset size, number of classes."""
    groups = list(groups)
    return _class_stats(df.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("_cnt")), label, groups)


def _trunc(c: Column) -> Column:
    """Python int() of a non-negative double."""
    return F.floor(c).cast("bigint")


def shuffle(df: DataFrame, key: str, seed=SEED) -> DataFrame:
    """O1: seeded permutation (a global sort by hash; range-partitioned)."""
    return df.orderBy(hash32(F.col(key), seed, "shuffle"), F.col(key))


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    An equi-join on a constant key against a broadcast single row (its size is
    bounded by construction), not a cross product.
    """
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


#: Classes whose value may be attached to rows without a shuffle; more is an error.
MAX_CLASSES = 10_000


def with_class_value(df: DataFrame, label: str, small: DataFrame, value: str) -> DataFrame:
    """Attach `value` of `small` (label, value: one row per class) to the rows of `df`.

    The classes travel as one map in a broadcast row, so rows aren't shuffled
    by label. The map is bounded: more than MAX_CLASSES classes raise an error.
    Rows without a class in `small` are dropped, as by a join.
    """
    entries = small.where(F.col(label).isNotNull()).limit(MAX_CLASSES + 1).agg(
        F.collect_list(F.struct(F.col(label).alias("k"), F.col(value).alias("v"))).alias("_e"))
    checked = F.when(F.size("_e") > MAX_CLASSES, F.raise_error(F.lit(f"more than {MAX_CLASSES} classes"))).otherwise(F.col("_e"))
    out = with_scalars(df, entries.select(F.map_from_entries(checked).alias("_classes")))
    return out.withColumn(value, F.try_element_at("_classes", F.col(label))).where(F.col(value).isNotNull()).drop("_classes")


def downsample(df: DataFrame, key: str, fraction: float = 0.1, seed=SEED, groups=()) -> DataFrame:
    """O3: exactly round(n * fraction) rows (half-even, as pandas), no replacement."""
    groups = list(groups)
    def quota(cnt):
        return cnt.select(*groups, F.bround(F.col("_cnt") * F.lit(float(fraction)), 0).cast("bigint").alias("_q"))

    ranked, _ = rank_table(df, key, groups, seed, "downsample", facts=quota)
    return ranked.where(F.col("_rank") <= F.col("_q")).select(*df.columns)


def check_fractions(train: float, dev: float, test: float) -> None:
    if train + dev + test != 1.0:
        raise ValueError(f"train, dev and test shares sum to {train + dev + test}, not 1")


def global_positions(df: DataFrame, order_cols, pos_col: str = "_pos") -> DataFrame:
    """1-based position of each row in the order of `order_cols`, distributed.

    Range-partition and sort within partitions, checkpoint (fixes the
    partition assignment and survives executor loss), count rows per
    partition and add the running offset of the partitions before it.
    """
    order_cols = list(order_cols)
    nparts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(nparts, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pn"))
               .select("_pid", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_poff")))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    # one row per partition: bounded by spark.sql.shuffle.partitions
    return (ranged.join(F.broadcast(offsets), "_pid")
            .select(*df.columns, (F.col("_poff") + local + 1).alias(pos_col)))


def split_ordered(df: DataFrame, order_cols, train: float = 0.8, dev: float = 0.1, test: float = 0.1) -> DataFrame:
    """Contiguous cuts at int(train*n) and int((train+dev)*n) of the ordered rows."""
    check_fractions(train, dev, test)
    pos = global_positions(df, order_cols)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    cut1 = _trunc(F.lit(float(train)) * F.col("_n"))
    cut2 = _trunc(F.lit(float(train + dev)) * F.col("_n"))
    out = with_scalars(pos, n)
    split = F.when(F.col("_pos") <= cut1, "train").when(F.col("_pos") <= cut2, "dev").otherwise("test")
    return out.select(*df.columns, split.alias("split"))


def sample_by_class(df: DataFrame, key: str, label: str, size: int | None = None,
                    weights: dict | None = None, fraction: float | None = None, seed=SEED, groups=()) -> DataFrame:
    """Per class int(size * w_c) rows without replacement.

    `weights` maps label -> weight (default: the class proportions); `size` is
    an absolute size, or `fraction` of the row count of the dataset.
    """
    groups = list(groups)
    if weights is not None:
        wexpr = F.lit(None).cast("double")
        for lab, w in weights.items():
            wexpr = F.when(F.col(label) == F.lit(lab), F.lit(float(w))).otherwise(wexpr)
    else:
        wexpr = F.col("_nc") / F.col("_n")
    base = F.lit(int(size)) if size is not None else _trunc(F.lit(float(fraction)) * F.col("_n"))

    def quota(cnt):
        return _class_stats(cnt, label, groups).select(*groups, label, _trunc(base * wexpr).alias("_q"))

    ranked, _ = rank_table(df, key, groups + [label], seed, "class", facts=quota)
    return ranked.where(F.col("_rank") <= F.col("_q")).select(*df.columns)


#: A row that is drawn more often than this meets its draws in several partitions.
HOT_DRAWS = 1024


def _draw_table(quota: DataFrame, keys, carry=(), chunk: int = 1 << 16) -> DataFrame:
    """One row per draw (keys..., _i, carry...) for 0 <= i < _m, generated in parallel chunks.

    A class row expands to ceil(_m / chunk) chunk rows, which are spread over
    the cluster before each expands to at most `chunk` draws.
    """
    keys = list(keys)
    m = F.col("_m").cast("bigint")
    nchunks = F.ceil(m / F.lit(chunk)).cast("bigint")
    empty = F.array().cast("array<bigint>")
    chunks = quota.select(*keys, *carry, m.alias("_m"), F.explode(
        F.when(m > 0, F.sequence(F.lit(0).cast("bigint"), nchunks - 1)).otherwise(empty)).alias("_c"))
    chunks = chunks.repartition(*keys, "_c")
    lo = F.col("_c") * F.lit(chunk)
    hi = F.least(lo + F.lit(chunk), F.col("_m")) - 1
    return chunks.select(*keys, *carry, F.explode(F.sequence(lo, hi)).alias("_i"))


def sample_with_replacement(df: DataFrame, key: str, label: str, per_class: DataFrame, seed=SEED,
                            salt: str = "replace", groups=()) -> DataFrame:
    """`_m` draws per class (table per_class(groups..., label, _m)), uniform with replacement.

    Draw i of class c picks the row of rank (hash(seed, c, i) mod n_c) + 1.
    Draws are generated in parallel chunks that carry their class size, and
    matched to ranked rows on (label, rank, salt): a small class that is drawn
    often has its rows repeated once per HOT_DRAWS expected draws.
    """
    keys = list(groups) + [label]

    def sizes(cnt):
        both = cnt.withColumnRenamed("_cnt", "_nc").join(per_class.select(*keys, "_m"), keys, "left")
        salts = F.greatest(F.ceil(F.coalesce("_m", F.lit(0)) / (F.col("_nc") * HOT_DRAWS)), F.lit(1)).cast("bigint")
        return both.select(*keys, "_nc", "_m", salts.alias("_salts"))

    ranked, cnt = rank_table(df, key, keys, seed, salt, facts=sizes)
    ranked = ranked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)))
    draws = _draw_table(sizes(cnt).where(F.col("_m").isNotNull()), keys, ["_nc", "_salts"])
    pick = F.pmod(hash32(F.concat_ws(":", F.col(label).cast("string"), F.col("_i").cast("string")), seed,
                         salt + "-draw"), F.col("_nc")) + 1
    draws = draws.select(*keys, "_i", pick.alias("_rank"), (F.col("_i") % F.col("_salts")).alias("_salt"))
    return ranked.join(draws, keys + ["_rank", "_salt"]).select(*df.columns, F.col("_i").alias("_draw"))


def _split_quotas(cnt: DataFrame, label: str, groups, train: float, dev: float, test: float, balanced: bool):
    counts = _class_stats(cnt, label, groups)
    prop = F.col("_nc") / F.col("_n")
    uni = F.lit(1.0) / F.col("_k")
    return counts.select(
        *groups, label,
        _trunc(_trunc(F.lit(float(test)) * F.col("_n")) * prop).alias("_qt"),
        _trunc(_trunc(F.lit(float(dev)) * F.col("_n")) * (uni if balanced else prop)).alias("_qd"),
        _trunc(_trunc(F.lit(float(train)) * F.col("_n")) * uni).alias("_m"),
    )


def split_stratified(df: DataFrame, key: str, label: str, train: float = 0.8, dev: float = 0.1,
                     test: float = 0.1, seed=SEED, groups=(), stored: bool = False) -> DataFrame:
    """Test and dev keep the class proportions; train takes the rest.

    Per class c with n_c of n rows: test = int(int(test*n) * n_c/n) rows,
    dev = int(int(dev*n) * n_c/n) of the remaining, train = everything else.
    One ranked pass per class assigns all three. `stored`: `df` is a stored
    table, which is read more than once rather than shuffled (``rank_cuts``).
    """
    check_fractions(train, dev, test)
    groups = list(groups)

    def quotas(cnt):
        return _split_quotas(cnt, label, groups, train, dev, test, balanced=False).drop("_m")

    tagged, _ = _test_dev_rest(df, key, groups + [label], seed, quotas, "train", stored)
    return tagged


def _test_dev_rest(df: DataFrame, key: str, keys, seed, quotas, rest: str, stored: bool):
    """(`df` with `split`: the first _qt rows of a class are test, the next _qd are dev, others `rest`; its counts)."""
    if stored:
        def cuts(cnt):
            return quotas(cnt).select(*keys, F.col("_qt").alias("_test"), (F.col("_qt") + F.col("_qd")).alias("_dev"))
        rows, cnt = rank_cuts(df, key, keys, ["_test", "_dev"], seed, "class", cuts)
        is_test, is_dev = F.col("_test"), F.col("_dev")
    else:
        rows, cnt = rank_table(df, key, keys, seed, "class", facts=quotas)
        is_test, is_dev = F.col("_rank") <= F.col("_qt"), F.col("_rank") <= F.col("_qt") + F.col("_qd")
    split = F.when(is_test, "test").when(is_dev, "dev").otherwise(rest)
    return rows.select(*df.columns, split.alias("split")), cnt


def split_balanced(df: DataFrame, key: str, label: str, train: float = 0.8, dev: float = 0.1,
                   test: float = 0.1, seed=SEED, groups=(), stored: bool = False) -> DataFrame:
    """Test as in O7 (unbalanced); dev = int(int(dev*n)/k) per class from
    the rest; train = int(int(train*n)/k) draws per class *with replacement*
    from what is left (over- or under-sampling). Train rows carry `_draw`.
    `stored` as in ``split_stratified``."""
    check_fractions(train, dev, test)
    groups = list(groups)
    keys = groups + [label]

    def quotas(cnt):
        return _split_quotas(cnt, label, groups, train, dev, test, balanced=True)

    tagged, cnt = _test_dev_rest(df, key, keys, seed, lambda cnt: quotas(cnt).drop("_m"), "rest", stored)
    quota = quotas(cnt)
    head = tagged.where(F.col("split") != "rest").withColumn("_draw", F.lit(None).cast("bigint"))
    rest = tagged.where(F.col("split") == "rest").drop("split")
    drawn = sample_with_replacement(rest, key, label, quota.select(*keys, "_m"), seed, "balanced", groups)
    return head.unionByName(drawn.withColumn("split", F.lit("train"))).select(*df.columns, "split", "_draw")


def split_few_shot(balanced: DataFrame, key: str, n: int, seed=SEED, groups=(), stored: bool = False) -> DataFrame:
    """The first 2n rows of the balanced train (in its seeded shuffle
    order) stay train, the other train rows become 'unlabeled'; dev and test
    are kept. No per-class quota is applied (as in the original).
    `stored` as in ``split_stratified``."""
    train = balanced.where(F.col("split") == "train")
    other = balanced.where(F.col("split") != "train")
    order_key = F.concat_ws(":", F.col(key).cast("string"), F.col("_draw").cast("string"))
    keyed = train.withColumn("_fk", order_key)
    if stored:
        ranked, _ = rank_cuts(keyed, "_fk", list(groups), ["_first"], seed, "few-shot",
                              lambda cnt: cnt.select(*groups, F.lit(2 * int(n)).alias("_first")))
        first = F.col("_first")
    else:
        ranked, first = hash_rank(keyed, "_fk", list(groups), seed, "few-shot"), F.col("_rank") <= 2 * int(n)
    relabel = ranked.withColumn("split", F.when(first, "train").otherwise("unlabeled"))
    return other.unionByName(relabel.select(*balanced.columns))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 10, seed=SEED, groups=()) -> DataFrame:
    """fold = (rank within class - 1) mod k; fold i validates, the rest trains."""
    ranked = hash_rank(df, key, list(groups) + [label], seed, "kfold")
    return ranked.select(*df.columns, ((F.col("_rank") - 1) % F.lit(int(k))).cast("int").alias("fold"))

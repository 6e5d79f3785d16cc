"""Order-sensitive building blocks that never put a whole group in one task.

Windows over a whole table, or over a key that may hold a third of the rows,
send that many rows to a single task. The helpers here split such work: by
hash bucket for rank cuts, by position block for running values, and by a
digit for exact quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from sheaf.session import written

HASH_DIGITS = 4
POSITION_BLOCK = 65_536


def hash_key(id_col: str, seed: int) -> Column:
    """Hash of an id and a seed: the random order every engine can repeat."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def _keyed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    hashed = df.withColumn("_h", hash_key(id_col, seed))
    return hashed.withColumn("_b", F.substring("_h", 1, HASH_DIGITS))


def hash_cut(df: DataFrame, id_col: str, seed: int, wanted: Column) -> DataFrame:
    """Mark the ``wanted`` rows with the smallest hash, exactly that many.

    Bucket counts (one row per leading hash digits) locate the bucket the cut
    falls in; only that bucket is ranked, to find the last row still wanted.
    Marking is then a comparison, so rows do not move. Adds the boolean
    column ``chosen``; all rows are chosen when more are wanted than exist.
    """
    ids = _keyed(df.select(id_col), id_col, seed)
    upto = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = (
        ids.groupBy("_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(upto))
        .withColumn("_wanted", wanted)
    )
    left = F.col("_wanted") - F.col("_end") + F.col("_n")
    place = filled.where("_end >= _wanted and _end - _n < _wanted").agg(
        F.first(F.struct("_b", left.alias("left"))).alias("place")
    )
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h", id_col))
    last = (
        ids.withColumn("_cut", place.scalar())
        .where("_b = _cut._b")
        .withColumn("_r", rank)
        .where("_r = _cut.left")
        .agg(F.first(F.struct(F.col("_h").alias("h"), F.col(id_col).alias("id"))).alias("last"))
    )
    own = F.struct(hash_key(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    marked = df.withColumn("_last", last.scalar())
    return marked.withColumn(
        "chosen", F.coalesce(own <= F.col("_last"), wanted > 0)
    ).drop("_last")


def hash_rank(df: DataFrame, id_col: str, seed: int, name: str = "rank") -> DataFrame:
    """Number all rows 1..n in hash order without a single-task window."""
    keyed = _keyed(df, id_col, seed)
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("_b")
        .agg(F.count("*").alias("_n"))
        .select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(W.partitionBy("_b").orderBy("_h", id_col))
    return (
        keyed.withColumn("_r", within)
        .join(starts, "_b")
        .withColumn(name, F.col("_start") + F.col("_r"))
        .drop("_h", "_b", "_r", "_start")
    )


def block_of(order: str, block: int = POSITION_BLOCK) -> Column:
    """The block a position falls in."""
    return F.floor(F.col(order) / F.lit(block)).cast("long")


def running_last(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    value: Column,
    name: str,
    before: str | None = None,
    block: int = POSITION_BLOCK,
    marks: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Last non-null ``value`` up to each row, as column ``name``.

    ``before`` names a second column that leaves the row itself out.
    Rows of a group are cut into blocks of ``block`` positions. Each block is
    scanned on its own; a second scan over one row per block carries the
    latest value forward, so no task ever scans a whole hot group.

    Where ``df`` is large and its values few, ``marks`` (the rows with a
    value) and ``blocks`` (``group`` and ``_blk`` of all rows) spare a second
    pass over ``df``.
    """
    group = list(group)
    keys = [*group, "_blk"]
    held = df.withColumn("_v", value).withColumn("_blk", block_of(order, block))
    within = W.partitionBy(*keys).orderBy(order)
    latest = F.last("_v", ignorenulls=True)
    scanned = held.withColumn(
        "_in", latest.over(within.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    if before:
        scanned = scanned.withColumn(
            "_ex", latest.over(within.rowsBetween(W.unboundedPreceding, -1))
        )
    if marks is None:
        source = held
    else:
        source = marks.withColumn("_v", value).withColumn("_blk", block_of(order, block))
    finals = source.groupBy(*keys).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_final")
    )
    if blocks is not None:
        finals = blocks.join(finals, keys, "left")
    earlier = W.partitionBy(*group).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    # Groups of one block carry nothing, so this side is mostly empty.
    carried = finals.select(
        *keys, F.last("_final", ignorenulls=True).over(earlier).alias("_carry")
    ).where("_carry is not null")
    out = scanned.join(carried, keys, "left").withColumn(name, F.coalesce("_in", "_carry"))
    if before:
        out = out.withColumn(before, F.coalesce("_ex", "_carry"))
    return out.drop("_v", "_blk", "_in", "_ex", "_carry")


@F.arrow_udf(T.LongType())
def _ordered(values: pa.Array) -> pa.Array:
    """A whole number for every double, in the same order; its upper 16 bits begin at 0."""
    bits = (values.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF)) ^ np.int64(-(1 << 63)))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact, linearly interpolated quantiles: columns ``group, prob, quantile``.

    Radix selection: doubles become 64-bit numbers of the same order, whose
    digits of 16 bits are settled one after another. A round counts, for every
    prefix that a wanted rank has reached, the rows by their next digit: 65,536
    counters at most, which combine before the shuffle. Groups of all sizes go
    this way. Null values do not count; a null group is a group; NaN is the
    largest value.
    """
    keys = list(group)
    value = F.col(value).cast("double")
    rows = df.select(*keys, value.alias("_v")).where("_v is not null")
    rows = written(rows.withColumn("_k", _ordered("_v")), "selection")
    counts = rows.groupBy(*keys, F.shiftrightunsigned("_k", 48).alias("_p")).agg(F.count("*").alias("_c"), F.max("_v").alias("_v"))
    whole = W.partitionBy(*keys)
    first = counts.withColumn("_n", F.sum("_c").over(whole))
    ranks = [
        F.struct(F.lit(float(p)).alias("prob"), (p * (F.col("_n") - 1)).alias("pos"), edge(p * (F.col("_n") - 1)).cast("long").alias("rank"))
        for p in probs
        for edge in (F.floor, F.ceil)
    ]
    found = _settled(first.withColumn("_wanted", F.array(*ranks)), keys, whole)
    for shift in (32, 16, 0):
        reached = written(found.groupBy(*keys, "_p").agg(F.collect_list("_t").alias("_wanted")), "prefixes")
        own = reached.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)), F.col("_p").alias("_prefix"), "_wanted")
        same = F.shiftrightunsigned("_k", shift + 16) == F.col("_prefix")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
        # A prefix holds one list of ranks: two for each probability.
        counts = (
            rows.join(own, same)
            .groupBy(*keys, "_prefix", F.shiftrightunsigned("_k", shift).alias("_p"))
            .agg(F.count("*").alias("_c"), F.max("_v").alias("_v"), F.any_value("_wanted").alias("_wanted"))
        )
        found = _settled(counts, keys, W.partitionBy(*keys, "_prefix"))
    out = found.groupBy(*keys, F.col("_t.prob").alias("prob"), F.col("_t.pos").alias("_pos")).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    share = F.col("_pos") - F.floor("_pos")
    return out.select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("quantile"))


def _settled(counts: DataFrame, keys: Sequence[str], whole: WindowSpec) -> DataFrame:
    """``keys, _p, _v, _t``: each wanted rank with the prefix that holds it, counted from that prefix's first row."""
    before = F.sum("_c").over(whole.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c")
    placed = counts.withColumn("_before", before)
    held = F.filter("_wanted", lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_c")))
    moved = F.transform(held, lambda t: t.withField("rank", t["rank"] - F.col("_before")))
    return placed.select(*keys, "_p", "_v", F.explode(moved).alias("_t"))


def first_values(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """First non-null value of every column per key; null keys are dropped."""
    return _edge_values(df, key, order, columns, F.min_by)


def last_values(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Last non-null value of every column per key; null keys are dropped."""
    return _edge_values(df, key, order, columns, F.max_by)


def _edge_values(df, key, order, columns, pick):
    picked = [
        pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns
    ]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*picked)

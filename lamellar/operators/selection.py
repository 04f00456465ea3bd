"""Ordered selection: balanced samples by count or bytes, strides, splits, shard assignment.

Ranks are taken in blocks of the order (quantiles or hashes) within groups, so neither the whole input nor a group that holds a third of it is
sorted in one task. Null groups are dropped, as in the sampler's group-by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(df: DataFrame, column: str, blocks: int = 64) -> Column:
    """The block of a value in its column's order: cuts are approximate quantiles, taken at once, so any use of the expression gives the same blocks.

    Columns that aren't numbers are one block.
    """
    if dict(df.dtypes)[column].split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        return F.lit(0)
    cuts = sorted(set(df.approxQuantile(column, [k / blocks for k in range(1, blocks)], 0.005)))
    value = F.col(column).cast("double")
    return F.when(value.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))) if cuts else F.lit(0)


def sums_before(df: DataFrame, by: list[str], block: Column, order: list, counts: Column) -> DataFrame:
    """df with `_before`: the sum of counts over the rows of the same `by` before it in the order. By blocks of the order, then within them, so that
    no group is sorted in one task. order begins with the column of which block is a rising function."""
    rows = df.withColumns({"_block": block, "_n": counts})
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    sums = rows.groupBy(*keys, F.col("_block").alias("_kb")).agg(F.sum("_n").alias("_s"))
    earlier = Window.partitionBy(*(f"_k{i}" for i in range(len(by)))).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    inner = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_block") == F.col("_kb")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = rows.withColumn("_within", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(sums, same)
    return out.withColumn("_before", F.col("_within") + F.col("_offset")).drop("_block", "_n", "_kb", "_s", "_offset", "_within", *(f"_k{i}" for i in range(len(by))))


def depth(df: DataFrame, group: str, order: list[str], name: str = "depth") -> DataFrame:
    """0-based place of each row in its group, ranked in blocks of the first order column."""
    df = df.where(F.col(group).isNotNull())
    return sums_before(df, [group], block_of(df, order[0]), order, F.lit(1)).withColumnRenamed("_before", name)


def stratified_topn(df: DataFrame, group: str | None, order: list[str], n: int | None) -> DataFrame:
    """Round robin over the sorted groups until n rows; everything if n is unset or not below the row count."""
    if not n or n <= 0 or df.count() <= n:
        return df
    if not group or group not in df.columns:
        return df.orderBy(*order).limit(n)
    # compared as row_number itself, so that Spark cuts each group before the exchange
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.where(F.col(group).isNotNull()).withColumn("depth", place).where(F.col("depth") <= n).orderBy("depth", group).limit(n).drop("depth")


def byte_budget(df: DataFrame, group: str, order: list[str], size: str, budget: float | None, block: int = 1024) -> DataFrame:
    """Round robin until the running size reaches `budget` bytes; the row that reaches it is taken. Null sizes count as 0.

    The running sum is a prefix sum in two steps: totals of blocks of depths, then within a block.
    """
    if not budget or budget <= 0 or size not in df.columns or group not in df.columns:
        return df
    rows = depth(df, group, order).withColumns({"_block": F.expr(f"depth div {block}"), "_size": F.coalesce(F.col(size).cast("double"), F.lit(0.0))})
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    totals = rows.groupBy("_block").agg(F.sum("_size").alias("_s")).select("_block", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_before")).where(F.col("_before") < budget)
    within = Window.partitionBy("_block").orderBy("depth", group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.join(totals, "_block").withColumn("_run", F.col("_before") + F.sum("_size").over(within))
    return run.where(F.col("_run") - F.col("_size") < budget).drop("_block", "_size", "_before", "_run", "depth")


def stride_sample(df: DataFrame, group: str, order: list[str], step: int) -> DataFrame:
    """Places 0, step, 2 step ... of each group."""
    return depth(df, group, order, "_d").where(F.col("_d") % step == 0).drop("_d")


def stride_count(counts: DataFrame, count: str, step: int) -> DataFrame:
    """Rows that stride_sample would keep, from the groups' counts alone."""
    return counts.agg(F.sum(F.ceil(F.col(count) / step)).alias("kept"))


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def worker_of(df: DataFrame, order: list[str], workers: int, within: str) -> DataFrame:
    """Rows of a shard dealt to its workers in turn."""
    placed = sums_before(df, [within], block_of(df, order[0]), order, F.lit(1))
    return placed.withColumn("worker", F.pmod(F.col("_before"), F.lit(workers))).drop("_before")


def assign_shards(weights: DataFrame, key: str, weight: str, shards: int) -> DataFrame:
    """Largest weight first onto the least loaded shard (ties: the lowest): a fold over the sorted list of files.

    Inherently sequential. It runs over one row for each file or group (a catalog), not over data rows. Null weights count 1.
    """
    item = F.struct((-F.coalesce(F.col(weight).cast("double"), F.lit(1.0))).alias("w"), F.col(key).alias("k"))
    start = F.struct(F.array_repeat(F.lit(0.0), shards).alias("load"), F.array().cast(f"array<struct<k:{dict(weights.dtypes)[key]},s:int,w:double>>").alias("out"))

    def step(acc, x):
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: v - F.when(i == at - 1, x["w"]).otherwise(0.0))
        return F.struct(load.alias("load"), F.concat(acc["out"], F.array(F.struct(x["k"].alias("k"), (at - 1).alias("s"), (-x["w"]).alias("w")))).alias("out"))

    folded = weights.agg(F.array_sort(F.collect_list(item)).alias("a")).select(F.aggregate("a", start, step)["out"].alias("out"))
    return folded.select(F.explode("out").alias("o")).select(F.col("o.k").alias(key), F.col("o.s").alias("shard"), F.col("o.w").alias(weight))


def key_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stratified_split(df: DataFrame, label: str, key: Column, share: float, seed: int = 0) -> DataFrame:
    """is_val: of each class of n > 1 rows, max(1, round half to even(n * share)) in order of a hash of the key."""
    rows = df.withColumn("_h", key_hash(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_k")).agg(F.count("*").alias("_c"))  # 4,096 blocks of a class at most
    blocks = Window.partitionBy("_l")
    before = F.coalesce(F.sum("_c").over(blocks.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "_n": F.sum("_c").over(blocks)})
    within = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h"))
    want = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share)).cast("int"))).otherwise(0)
    out = rows.withColumn("_p", within).join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_k")))
    return out.withColumn("is_val", F.col("_before") + F.col("_p") <= want).drop("_h", "_b", "_l", "_k", "_c", "_before", "_n", "_p")


def random_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """is_val for max(1, floor(n * share)) rows, the smallest by a hash of the key; rows whose hash equals the last one's are with it.

    The last hash is found by counts of blocks of hashes, then in one block alone.
    """
    h = key_hash(F.col(key), seed)
    blocks = df.groupBy(F.substring(h, 1, 3).alias("b")).count().orderBy("b").collect()  # 4,096 at most
    left = max(1, int(sum(r[1] for r in blocks) * share))
    block = None
    for block, n in blocks:
        if n >= left:
            break
        left -= n
    if block is None:
        return df.withColumn("is_val", F.lit(False))
    last = df.select(h.alias("h")).where(F.substring("h", 1, 3) == block).orderBy("h").limit(left).agg(F.max("h")).first()[0]
    return df.withColumn("is_val", h <= F.lit(last))


def column_split(df: DataFrame, split: str) -> DataFrame:
    """is_val from an explicit split column."""
    return df.where(F.col(split).isin("train", "val", "valid", "test")).withColumn("is_val", F.col(split) != "train")

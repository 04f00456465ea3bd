"""Uniform random shards of exact size by a hypergeometric communication matrix; DataFrame operations only.

Rows are dealt to partitions of about equal size. The matrix says how many rows go from each partition to each shard: a draw from the
distribution that a uniform shuffle of all rows has, row by row of the matrix, each a chain of hypergeometric draws from what the shards still
lack. Then each partition permutes its rows and cuts them by its row of the matrix, rows are exchanged, and each shard permutes again.
The second permutation is by random buckets of a shard, ranked apart and set off by the buckets' counts, so no shard is one task.
The matrix has `partitions` x `shards` counts, whatever the number of rows; it alone is broadcast.

Law `rows`: shard sizes differ by one at most. Null text: no bytes, so size 1 and the crc32 of nothing. Null or repeated doc_ids and equal rows
are rows like others: rows are told apart by their place. An empty table gives no rows. Very long texts are measured where they are read; only numbers move. Other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

import random
from math import exp, lgamma

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamellar.llm.common import small_table, staged


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement from good + bad are good: inversion, searched outwards from the mode."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo >= hi:
        return lo
    ln = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = exp(ln(good, mode) + ln(bad, draws - mode) - ln(good + bad, draws))
    u = rng.random() - p
    left, right, pl, pr = mode, mode, p, p
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > lo:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
        if pl < 1e-300 and pr < 1e-300:
            break
    return mode


def communication_matrix(rows: dict[int, int], shards: int, seed: int) -> list[dict]:
    """For each partition, the cumulated counts of its rows for the shards."""
    rng, total = random.Random(seed), sum(rows.values())
    lack = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for part in sorted(rows):
        left, others, ends, at = rows[part], sum(lack), [], 0
        for s in range(shards):
            others -= lack[s]
            got = hypergeometric(rng, lack[s], others, left)
            lack[s] -= got
            left -= got
            at += got
            ends.append(at)
        out.append({"part": part, "ends": ends})
    return out


def uniform_shards(docs: DataFrame, shards: int = 8, seed: int = 42, partition_rows: int = 20_000, most_cells: int = 1 << 20, bucket_rows: int = 4_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = staged(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "rows")
    n = rows.count()
    partitions = max(1, min(n // partition_rows + 1, most_cells // shards))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(partitions)))
    counts = {r[0]: r[1] for r in rows.groupBy("part").count().collect()}
    matrix = F.broadcast(small_table(spark, communication_matrix(counts, shards, seed), "part:bigint,ends:array<bigint>"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row")) - 1
    cut = rows.withColumn("place", local).join(matrix, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
    buckets = max(1, min(n // (shards * bucket_rows) + 1, 1 << 20))
    u = F.xxhash64(F.lit(seed + 2), "row")
    sent = staged(cut.select("doc_id", "size", "text_crc32", "row", "shard", u.alias("u"), F.pmod(F.xxhash64(F.lit(seed + 3), "row"), F.lit(buckets)).alias("bucket")), "sent")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("u", "row")) - 1
    return sent.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + within).alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by law `rows`."""
    out = uniform_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))

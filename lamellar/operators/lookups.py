"""Joins and key handling: lookups, last-writer-wins, map-back, anti joins, disjointness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the one of the largest `order`; one partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def inner_lookup(df: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows without a match are dropped."""
    return df.join(table, on, "inner")


def left_lookup(df: DataFrame, table: DataFrame, on: str | list[str], flag: str | None = None) -> DataFrame:
    """Rows without a match get nulls; flag tells whether there was one."""
    if flag:
        table = table.withColumn(flag, F.lit(True))
    out = df.join(table, on, "left")
    return out.withColumn(flag, F.coalesce(flag, F.lit(False))) if flag else out


def map_back(full: DataFrame, part: DataFrame, key: str, column: str) -> DataFrame:
    """A subset's result on the full table; others null."""
    return full.join(part.select(key, column), key, "left")


def todo(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that has no output yet."""
    return work.join(done.select(key), key, "left_anti")


def duplicated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys on more than one row; must be empty before shards are concatenated."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merge_shards(shards: list[DataFrame], key: str) -> DataFrame:
    """All-or-nothing concatenation of disjoint parts."""
    if any(s is None for s in shards):
        raise ValueError("a shard is missing")
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    if duplicated_keys(out, key).limit(1).count():
        raise ValueError(f"shards share values of {key}")
    return out


def exact_or_base(df: DataFrame, labels: DataFrame, path: str, name: str, value: str) -> DataFrame:
    """A label by the whole path, else by its base name: two equi-joins instead of a join on OR."""
    from lamellar.functions.scalars import base_name

    a = labels.select(F.col(name).alias(path), F.col(value).alias("_exact"))
    b = labels.select(F.col(name).alias("_base"), F.col(value).alias("_by_base"))
    joined = df.withColumn("_base", base_name(F.col(path))).join(a, path, "left").join(b, "_base", "left")
    return joined.withColumn(value, F.coalesce("_exact", "_by_base")).drop("_exact", "_by_base", "_base")

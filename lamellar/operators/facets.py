"""Counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet_counts(df: DataFrame, fields: list[str], unknown: str = "unknown") -> DataFrame:
    """facet, value, n for each field in one pass: grouping sets, one partial aggregation. Empty and null values are `unknown`."""
    cols = {f: F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(unknown)).otherwise(F.col(f).cast("string")) for f in fields}
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), c.alias("value")) for f, c in cols.items()))).alias("x"))
    return rows.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def facet_sets(df: DataFrame, fields: list[str], size: str) -> DataFrame:
    """Counts and bytes for each field's values and overall, by GROUPING SETS."""
    sets = [[F.col(f)] for f in fields] + [[]]
    return df.groupingSets(sets, *fields).agg(F.count("*").alias("n"), F.sum(F.coalesce(size, F.lit(0))).alias("total"), F.grouping_id().alias("gid"))


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(field).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field)


def bytes_total(df: DataFrame, size: str) -> DataFrame:
    total = F.sum(F.coalesce(size, F.lit(0)))
    return df.agg(F.count("*").alias("n"), total.alias("total"), F.round(total / (1 << 30), 2).alias("gib"))


def tallies(df: DataFrame, status: str, states: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(status) == s).alias(s) for s in states))


def completed_dirs(listing: DataFrame, directory: str = "dir", file: str = "file") -> DataFrame:
    """Directories with a whole file; partial ones don't count."""
    return listing.where(~F.col(file).rlike(r"\.partial$")).agg(F.countDistinct(directory).alias("done"))


def progress(done: Column, total: Column) -> Column:
    return F.when(done == 0, "not_started").when(done < total, "in_progress").otherwise("completed")


def md5_status(content: Column, expected: Column) -> Column:
    """ok, mismatch, or unchecked without an expected sum."""
    return F.when(F.coalesce(expected, F.lit("")) == "", "unchecked").when(F.md5(content) == expected, "ok").otherwise("mismatch")

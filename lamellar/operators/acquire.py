"""Acquisition plans: what to do for each item, by joins against artifact listings instead of file probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.functions.scalars import joined_path, truthy


def local_paths(slides: DataFrame, slides_dir: str, maf_dir: str) -> DataFrame:
    """<dir>/<file id>/<name>; the mutation file's only where it has one with id and name."""
    maf = F.when(truthy(F.col("has_maf")), joined_path(maf_dir, F.col("maf_file_id"), F.col("maf_filename")))
    return slides.withColumns({"slide_local_path": joined_path(slides_dir, F.col("file_id"), F.col("filename")), "maf_local_path": maf})


def existence_flags(df: DataFrame, listing: DataFrame, columns: dict[str, str]) -> DataFrame:
    """columns: path column -> flag. listing: path of what there is. False for null paths."""
    for path, flag in columns.items():
        there = listing.select(F.col("path").alias(path)).distinct().withColumn(flag, F.lit(True))
        df = df.join(there, path, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return df


def stringified_paths(df: DataFrame) -> DataFrame:
    """Columns named *_path as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in df.columns if c.endswith("_path")}) if any(c.endswith("_path") for c in df.columns) else df


def acquisition(work: DataFrame, outputs: DataFrame, cache: DataFrame, key: str, file_key: str, stream: bool = False) -> DataFrame:
    """action: skip (output there), fail (no file id), reuse (file cached), else stream or download. The fetch itself runs on the rest."""
    done = outputs.select(key).distinct().withColumn("_done", F.lit(True))
    kept = cache.select(file_key).distinct().withColumn("_kept", F.lit(True))
    rows = work.join(done, key, "left").join(kept, file_key, "left")
    action = F.when(F.col("_done"), "skip").when(F.coalesce(F.col(file_key).cast("string"), F.lit("")) == "", "fail").when(F.col("_kept"), "reuse").otherwise("stream" if stream else "download")
    return rows.withColumn("action", action).drop("_done", "_kept")


def outcome(plan: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """status: skipped, failed, processed or no_access; no result for planned work is missing. results: key, status."""
    joined = plan.join(results.select(key, F.col("status").alias("_s")), key, "left")
    return joined.withColumn("status", F.when(F.col("action") == "skip", "skipped").when(F.col("action") == "fail", "failed").otherwise(F.coalesce("_s", F.lit("missing")))).drop("_s")


def run_state(statuses: DataFrame, by: str) -> DataFrame:
    """The state of each run from its parts: no_access before failed before ok."""
    rank = F.when(F.col("status") == "no_access", 2).when(F.col("status").isin("failed", "missing"), 1).otherwise(0)
    return statuses.groupBy(by).agg(F.max(rank).alias("_r")).select(by, F.element_at(F.array(F.lit("ok"), F.lit("failed"), F.lit("no_access")), F.col("_r") + 1).alias("state"))

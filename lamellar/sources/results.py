"""Embedding and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCALARS = ["model", "task", "n_classes", "n", "n_total", "accuracy", "balanced_accuracy", "macro_f1", "auroc"]


def write_embeddings(df: DataFrame, path: str) -> None:
    """One folder for each model; a model's rerun replaces its folder alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def models(spark: SparkSession, path: str) -> DataFrame:
    """Models that have embeddings; read from the folders' names, without data."""
    return spark.read.parquet(path).select("model").distinct().orderBy("model")


def write_results(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines, the scalars as CSV (missing: empty)."""
    df.write.mode("overwrite").json(f"{path}/results_json")
    df.select(*[c for c in SCALARS if c in df.columns]).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/results_csv")


def write_summary(table: DataFrame, path: str, metric: str) -> None:
    """The leaderboard: a row for each model, so one file."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary_{metric}")

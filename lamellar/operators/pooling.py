"""Vectors: mean pooling with map-side sums, z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer


def mean_pool(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """Mean vector and count of each key; a row's vector stays whole, partial sums are merged (one shuffle of a vector for each key and task)."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    return df.where(F.col(vector).isNotNull()).withColumn("_v", v).groupBy(*key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("embedding"), F.count("*").alias("n_patches"))


def z_scores(df: DataFrame, train: str, value: str) -> DataFrame:
    """(value - train mean) / train sample deviation, the deviation at least 1e-6. train: a boolean column."""
    s = df.where(F.col(train)).agg(F.avg(value).alias("_m"), F.greatest(F.stddev_samp(value), F.lit(1e-6)).alias("_s")).first()
    return df.withColumn("z", (F.col(value) - F.lit(s[0])) / F.lit(s[1]))

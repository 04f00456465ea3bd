"""Classification metrics as aggregates over (by..., y, pred, prob) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.operators.selection import block_of, sums_before


def confusion_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """by, y, pred, n. One aggregation; all metrics but the AUROC follow from it."""
    return df.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """All class pairs, 0 where none: the counts and zeros for every pair, summed."""
    counts = confusion_counts(df, by)
    pairs = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(p).alias("pred"), F.lit(0).cast("long").alias("n")) for y in range(classes) for p in range(classes)))
    own = F.array(F.struct(F.col("y").cast("int").alias("y"), F.col("pred").cast("int").alias("pred"), "n"))
    cells = counts.select(*by, F.explode(F.concat(pairs, own)).alias("e")).select(*by, "e.*")
    return cells.groupBy(*by, "y", "pred").agg(F.sum("n").alias("n")).where(F.col("y").between(0, classes - 1) & F.col("pred").between(0, classes - 1))


def class_counts(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """For each class its rows (support), its predictions and its hits, from one aggregation: an agreeing pair counts for one class, another for two."""
    counts = confusion_counts(df, by)
    of = lambda c, support, predicted, hits: F.struct(F.col(c).cast("int").alias("class"), support.alias("support"), predicted.alias("predicted"), hits.alias("hits"))
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("pred"), n).otherwise(zero)
    none = [F.struct(F.lit(k).alias("class"), zero.alias("support"), zero.alias("predicted"), zero.alias("hits")) for k in range(classes)]
    each = counts.select(*by, F.explode(F.array(of("y", n, zero, hit), of("pred", zero, n, zero), *none)).alias("e")).select(*by, "e.*")
    return each.groupBy(*by, "class").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "hits")))


def class_scores(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """Recall (null without support) and precision (0 if never predicted) of each class."""
    each = class_counts(df, by, classes).where(F.col("class").between(0, classes - 1))
    return each.select(*by, "class", F.try_divide("hits", "support").alias("recall"), F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)).alias("precision"))


def metric_bundle(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    """accuracy, balanced_accuracy, macro_f1 (classes with support), n; all from one reading and one aggregation of the rows."""
    known = F.col("class").between(0, classes - 1)
    recall, precision = F.when(known, F.try_divide("hits", "support")), F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    f1 = F.when(recall.isNotNull(), F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall)))
    each = class_counts(df, by, classes)
    return each.groupBy(*by).agg(F.sum("support").alias("n"), F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def average_ranks(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Rank from 1, ties share their mean: from counts of distinct scores, so that ties cost one row; summed in blocks of scores, so that no group is one task."""
    counts = df.groupBy(*by, score).agg(F.count("*").alias("_c"))
    ranks = sums_before(counts, by, block_of(df, score), [score], F.col("_c"))
    return df.join(ranks.select(*by, score, (F.col("_before") + (F.col("_c") + 1) / 2).alias("rank")), [*by, score])


def auroc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney with ties at one half; null if a class is missing. positive: a boolean column. Negatives below a score are summed in blocks of scores."""
    counts = df.groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("m"))
    below = sums_before(counts, by, block_of(df, score), [score], F.col("m"))
    wins = F.sum(F.col("p") * (F.col("_before") + F.col("m") / 2))
    return below.groupBy(*by).agg(F.try_divide(wins, F.sum("p") * F.sum("m")).alias("auroc"))


def auroc_multiclass(df: DataFrame, by: list[str], prob: str = "prob", y: str = "y") -> DataFrame:
    """Two classes: that of class 1. More: the mean over classes that have both kinds of rows."""
    one = df.select(*by, F.col(y).alias("_y"), F.size(prob).alias("_k"), F.posexplode(prob).alias("class", "score")).where("_k > 2 or class = 1")
    per = auroc(one.withColumn("pos", F.col("_y") == F.col("class")), [*by, "class"], "score", "pos")
    return per.groupBy(*by).agg(F.avg("auroc").alias("auroc"))

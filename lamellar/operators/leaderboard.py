"""Model by task tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamellar.functions.scalars import three_places


def pivot(results: DataFrame, model: str, task: str, metric: str, tasks: list[str]) -> DataFrame:
    """One row for each model; a pair that was never run is null."""
    return results.groupBy(model).pivot(task, tasks).agg(F.first(metric, ignorenulls=True))


def ranked(table: DataFrame, model: str, tasks: list[str]) -> DataFrame:
    """Mean over the tasks that have a value; best first, none last, then by name. Ranks a table of models (a few rows)."""
    values = F.array_compact(F.array(*(F.nanvl(F.col(t), F.lit(None).cast("double")) for t in tasks)))
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    out = table.withColumn("mean", mean)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), model)))


def formatted(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.withColumns({c: three_places(F.col(c)) for c in columns})

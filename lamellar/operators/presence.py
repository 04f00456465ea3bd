"""Presence matrices: long pairs are the canonical, sparse form; wide only at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence_long(events: DataFrame, ids: DataFrame, event_id: str, row: str, feature: str) -> DataFrame:
    """Distinct (row, feature) of events whose id resolves to a row; null features are dropped."""
    return events.where(F.col(feature).isNotNull()).join(ids, event_id).select(row, feature).distinct()


def presence_wide(long: DataFrame, rows: DataFrame, row: str, feature: str, features: list[str]) -> DataFrame:
    """0/1 columns for `features` (explicit, so no extra job; an unseen one is all 0); rows without any feature stay, all 0."""
    wide = long.where(F.col(feature).isin(features)).groupBy(row).pivot(feature, features).agg(F.max(F.lit(1)))
    return rows.select(row).distinct().join(wide, row, "left").fillna(0, features)


def features_of(long: DataFrame, feature: str) -> list[str]:
    """Sorted distinct features: the width of a matrix, so small enough for the driver by definition."""
    return [r[0] for r in long.select(feature).distinct().orderBy(feature).collect()]


def merge_presence(table: DataFrame, wide: DataFrame, on: str, features: list[str], how: str = "left") -> DataFrame:
    """Nulls become 0 in feature columns only."""
    return table.join(wide, on, how).fillna(0, features)


def shape(long: DataFrame, row: str, feature: str) -> DataFrame:
    return long.agg(F.countDistinct(row).alias("rows"), F.countDistinct(feature).alias("features"))

"""Tasks: declarative label definitions compiled to Columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.functions.scalars import any_of, as_int, blank, label_from_map, truthy


@dataclass(frozen=True)
class Task:
    name: str
    source: str = ""
    label_map: dict[str, int] = field(default_factory=dict)
    label_any_of: tuple[str, ...] = ()
    filter_col: str = ""
    filter_values: tuple[str, ...] = ()
    require: str = ""
    class_names: tuple[str, ...] = ("0", "1")


#: Fixed values.
TASKS = [
    Task("luad_vs_lusc", "project_id", {"TCGA-LUAD": 0, "TCGA-LUSC": 1}, (), "project_id", ("TCGA-LUAD", "TCGA-LUSC"), "", ("LUAD", "LUSC")),
    Task("lgg_vs_gbm", "project_id", {"TCGA-LGG": 0, "TCGA-GBM": 1}, (), "project_id", ("TCGA-LGG", "TCGA-GBM"), "", ("LGG", "GBM")),
    Task("kras", "KRAS", require="has_maf"),
    Task("tp53", "TP53", require="has_maf"),
    Task("egfr", "EGFR", require="has_maf"),
    Task("idh", label_any_of=("IDH1", "IDH2"), require="has_maf"),
]


def task_labels(df: DataFrame, task: Task, key: str, order: str | None = None) -> DataFrame:
    """(key, label) of the rows the task applies to; blanks and values that aren't a class are dropped, a repeated key keeps the last."""
    if task.filter_col:
        df = df.where(F.col(task.filter_col).isin(*task.filter_values))
    if task.require:
        df = df.where(truthy(F.col(task.require)))
    if task.label_any_of:
        label = any_of(*(F.col(c) for c in task.label_any_of))
    elif task.label_map:
        label = label_from_map(F.col(task.source), task.label_map)
    else:
        label = F.when(~blank(F.col(task.source)), as_int(F.col(task.source)))
    out = df.select(F.col(key), label.cast("int").alias("label"), *([F.col(order).alias("_o")] if order else []))
    out = out.where(F.col("label").between(0, len(task.class_names) - 1))
    return out.groupBy(key).agg(F.max_by("label", "_o").alias("label")) if order else out


def all_labels(df: DataFrame, tasks: list[Task], key: str) -> DataFrame:
    """(task, key, label) of all tasks."""
    parts = [task_labels(df, t, key).select(F.lit(t.name).alias("task"), key, "label") for t in tasks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

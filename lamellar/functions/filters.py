"""Declarative filters compiled to Columns.

An expression is {"op": name, "content": {"field": dotted path, "value": value}} or {"op": "and" | "or", "content": [expressions]}.
A path that goes through arrays holds if any element satisfies it (`!=` and `exclude`: if none satisfies the opposite).
Plain columns compile to plain comparisons, which Catalyst pushes down to the scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIMPLE = {
    "=": lambda c, v: c == v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v),
}
OPPOSITE = {"!=": "=", "exclude": "in"}


def _any(c: Column, kind: T.DataType, path: list[str], test) -> Column:
    """test on the path below c, on any element of each array on the way."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: F.coalesce(_any(x, kind.elementType, path, test), F.lit(False))), F.lit(False))
    if not path:
        return test(c)
    field = kind[path[0]]
    return _any(c[path[0]], field.dataType, path[1:], test)


def compile_filter(expr: dict[str, Any] | None, schema: T.StructType) -> Column:
    if not expr:
        return F.lit(True)
    op, content = expr["op"].lower(), expr["content"]
    if op in ("and", "or"):
        parts = [compile_filter(e, schema) for e in content]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    first, *path = content["field"].split(".")
    kind, value, column = schema[first].dataType, content.get("value"), F.col(first)
    holds = lambda test: _any(column, kind, path, test)
    present = holds(lambda c: c.isNotNull())
    if op == "is":
        return ~present if str(value).upper() == "MISSING" else present
    if op == "not":
        return present
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    compare = lambda name: holds(lambda c: SIMPLE[name](c, values if name == "in" else value))
    if op in OPPOSITE:
        return ~F.coalesce(compare(OPPOSITE[op]), F.lit(False))
    if op not in SIMPLE:
        raise ValueError(f"unknown operator {op!r}")
    return compare(op)


class FilterBuilder:
    """Collects conditions that all must hold."""

    def __init__(self) -> None:
        self.parts: list[dict[str, Any]] = []

    def add(self, field: str, value: Any, op: str | None = None) -> FilterBuilder:
        many = isinstance(value, (list, tuple, set))
        op = op or ("in" if many else "=")
        if op in ("in", "exclude") and not many:
            value = [value]
        self.parts.append({"op": op, "content": {"field": field, "value": list(value) if many else value}})
        return self

    def add_exists(self, field: str, exists: bool = True) -> FilterBuilder:
        self.parts.append({"op": "not" if exists else "is", "content": {"field": field, "value": "MISSING"}})
        return self

    def clear(self) -> FilterBuilder:
        self.parts = []
        return self

    def build(self, custom: dict[str, Any] | None = None) -> dict[str, Any]:
        """Nothing, one condition, or their conjunction; `custom` is one more."""
        parts = [*self.parts, *([custom] if custom else [])]
        return parts[0] if len(parts) == 1 else {"op": "and", "content": parts} if parts else {}

    def apply(self, df: DataFrame, custom: dict[str, Any] | None = None) -> DataFrame:
        return df.where(compile_filter(self.build(custom), df.schema))


def query(df: DataFrame, filters: dict[str, Any] | None = None, fields: list[str] | None = None, most: int | None = None, sort: str | None = None, custom: dict[str, Any] | None = None) -> DataFrame:
    """The typed scans' common form: equality or IN for each filter that isn't None, then projection, order (`field:desc`) and limit."""
    b = FilterBuilder()
    for field, value in (filters or {}).items():
        if value is not None:
            b.add(field, value)
    df = b.apply(df, custom)
    if sort:
        name, _, way = sort.partition(":")
        df = df.orderBy(F.col(name).desc() if way == "desc" else F.col(name))
    if fields:
        df = df.select(*(F.col(f).alias(f.replace(".", "_")) for f in fields))
    return df.limit(most) if most else df


def point_lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def discover_fields(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of all leaves; arrays stand for their elements."""
    out: list[str] = []
    for f in schema:
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        out += discover_fields(kind, f"{prefix}{f.name}.") if isinstance(kind, T.StructType) else [prefix + f.name]
    return out


def expandable_fields(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of nested entities."""
    out: list[str] = []
    for f in schema:
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += [prefix + f.name, *expandable_fields(kind, f"{prefix}{f.name}.")]
    return out

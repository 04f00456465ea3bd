"""Scalar expressions. All are built-in expressions; none calls Python for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """true, 1, yes, t in any case and with spaces around; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "t"), F.lit(False))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def as_int(c: Column) -> Column:
    """int(float(text)): cut towards zero; null where it is no number."""
    return c.cast("string").try_cast("double").try_cast("int")


def as01(c: Column) -> Column:
    """1 for a number that cuts to a nonzero integer; else 0, blanks and non-numbers included."""
    return F.coalesce((as_int(c) != 0).cast("int"), F.lit(0))


def any_of(*cols: Column) -> Column:
    """1 if any is a nonzero integer, null if all are blank."""
    some = ~blank(cols[0])
    for c in cols[1:]:
        some |= ~blank(c)
    return F.when(some, F.greatest(*(as01(c) for c in cols)) if len(cols) > 1 else as01(cols[0]))


def label_from_map(c: Column, mapping: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in mapping.items()))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def item_key(path: Column) -> Column:
    """The name without folder and extension, cut at the first double underscore."""
    return F.element_at(F.split(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), "__", 2), 1)


def patch_xy(path: Column) -> tuple[Column, Column]:
    """Coordinates in `<key>__x<X>_y<Y>.<ext>`."""
    return tuple(F.regexp_extract(path, rf"__x(\d+)_y(\d+)\.", g).try_cast("int") for g in (1, 2))


def three_places(c: Column) -> Column:
    """Three decimals, - for null or NaN."""
    return F.when(c.isNull() | F.isnan(c), F.lit("-")).otherwise(F.format_string("%.3f", c))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """The first place of the largest, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def joined_path(*parts: Column | str) -> Column:
    """Parts joined by /; null if one is missing."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    whole = cols[0].isNotNull()
    for c in cols[1:]:
        whole &= c.isNotNull()
    return F.when(whole, F.concat_ws("/", *cols))

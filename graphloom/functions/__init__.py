"""Scalar functions: case folding, set values, id texts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(c: Column, kind: T.DataType) -> Column:
    """What equality, ranges and order compare: lower case for strings and for the items of string sets."""
    if isinstance(kind, T.StringType):
        return F.lower(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(c, F.lower)
    return c


def fold_value(v: Any) -> Any:
    return v.lower() if isinstance(v, str) else v


def normal(c: Column, kind: T.DataType) -> Column:
    """A stored property: false and the empty set are absent, a set is sorted without repeats or nulls."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit(True))
    if isinstance(kind, T.ArrayType):
        items = F.array_sort(F.array_distinct(F.array_compact(c)))
        return F.when(F.size(items) > 0, items)
    return c


def comparable(v: Any, kind: T.DataType) -> bool:
    """Whether a value is of a property's class; a search by another class finds nothing."""
    if isinstance(kind, T.ArrayType):
        return comparable(v, kind.elementType)
    if isinstance(v, bool) or isinstance(kind, T.BooleanType):
        return isinstance(v, bool) and isinstance(kind, T.BooleanType)
    if isinstance(v, int):
        return isinstance(kind, T.IntegralType)
    if isinstance(v, float):
        return isinstance(kind, T.FractionalType)
    return isinstance(v, str) == isinstance(kind, T.StringType)


# --- set values -----------------------------------------------------------


def set_minus(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def set_contains(a: Column, item: Any) -> Column:
    return F.coalesce(F.array_contains(a, item), F.lit(False))


def set_size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def set_min(a: Column) -> Column:
    return F.array_min(a)


def set_max(a: Column) -> Column:
    return F.array_max(a)


# --- ids as text ----------------------------------------------------------


def id_text(type_id: Column, local_id: Column) -> Column:
    """`3-17` of type 3, id 17; null for the null element."""
    return F.when(local_id.isNotNull(), F.concat_ws("-", type_id.cast("string"), local_id.cast("string")))


def id_parts(text: Column) -> tuple[Column, Column]:
    """Type and local id of an id text, null where it isn't one."""
    ok = text.rlike(r"^\d+-\d+$")
    return F.when(ok, F.split_part(text, F.lit("-"), F.lit(1)).try_cast("int")), F.when(ok, F.split_part(text, F.lit("-"), F.lit(2)).try_cast("bigint"))

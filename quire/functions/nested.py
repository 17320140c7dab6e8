"""Column expressions over arrays and structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_element(col, field: str | None = None) -> Column:
    """First element or null, also for an empty array; ``field`` may be a dotted path into it."""
    out = F.get(_col(col), F.lit(0))
    for name in (field or "").split("."):
        if name:
            out = out.getField(name)
    return out


def _path(x: Column, path: str) -> Column:
    for name in path.split("."):
        x = x.getField(name)
    return x


def transform_join(col, field: str | None = None, sep: str = "; ", fn: Callable[[Column], Column] | None = None) -> Column:
    """Array mapped to strings and joined; null elements are skipped, a null array gives ''."""
    pick = fn or (lambda x: _path(x, field) if field else x)
    return F.coalesce(F.array_join(F.transform(_col(col), pick), sep), F.lit(""))


def nested_transform_join(col, inner: str, sep: str = "; ", prefix: str | None = None, inner_sep: str = " ") -> Column:
    """Array of arrays joined inside and out; ``prefix`` is a path put before each element as ``prefix: ``."""
    def one(x):
        body = F.array_join(_path(x, inner), inner_sep)
        return body if prefix is None else F.concat(_path(x, prefix), F.lit(": "), body)
    return transform_join(col, sep=sep, fn=one)


def case_size_null(col, expr: Column) -> Column:
    """``expr`` for a non-empty array, else null."""
    return F.when(F.size(_col(col)) > 0, expr)


def filter_array(col, pred: Callable[[Column], Column]) -> Column:
    return F.filter(_col(col), pred)


def array_size_of_path(first_of, inner: str) -> Column:
    """Size of ``inner`` in the first element of an array (page count); 0 when missing."""
    return F.coalesce(F.size(first_element(first_of, inner)), F.lit(0))

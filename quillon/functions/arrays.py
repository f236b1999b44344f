"""Array functions with the reference's null rules: a null array is empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def size(a) -> Column:
    return F.when(_c(a).isNull(), 0).otherwise(F.size(_c(a)))


def is_empty(a) -> Column:
    return size(a) == 0


def first(a) -> Column:
    return F.try_element_at(_c(a), F.lit(1))


def last(a) -> Column:
    return F.try_element_at(_c(a), F.lit(-1))


def remove_one(a, x) -> Column:
    a = _c(a)
    at = F.array_position(a, x)
    return F.when(at > 0, F.concat(F.slice(a, F.lit(1), (at - 1).cast("int")), F.slice(a, (at + 1).cast("int"), F.size(a)))).otherwise(a)


def remove_all(a, x) -> Column:
    return F.array_remove(_c(a), x)


def find_first(a, test: Callable) -> Column:
    return F.try_element_at(F.filter(_c(a), test), F.lit(1))


def find_all(a, test: Callable) -> Column:
    return F.filter(_c(a), test)


def count_matches(a, test: Callable) -> Column:
    return F.when(_c(a).isNull(), 0).otherwise(F.size(F.filter(_c(a), test)))


def exists(a, test: Callable) -> Column:
    return F.coalesce(F.exists(_c(a), test), F.lit(False))


def is_not_empty(a) -> Column:
    return ~is_empty(a)


def convert(a, change: Callable) -> Column:
    return F.transform(_c(a), change)


def contains(a, x) -> Column:
    return F.coalesce(F.array_contains(_c(a), x), F.lit(False))


def get(a, i: int, other=None) -> Column:
    """From 0; another value where there is no such place."""
    return F.coalesce(F.get(_c(a), F.lit(i)) if i >= 0 else F.lit(None), F.lit(other))


def is_index_valid(a, i) -> Column:
    i = i if isinstance(i, Column) else F.lit(i)
    return F.coalesce((i >= 0) & (i < F.size(_c(a))), F.lit(False))


def reverse(a) -> Column:
    return F.reverse(_c(a))


def deep_equals(a, b) -> Column:
    return _c(a).eqNullSafe(_c(b))


def frequencies(df, *keys: str):
    """How often each value comes, the most frequent first by n; counted before rows move."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))

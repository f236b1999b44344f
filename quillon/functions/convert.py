"""Conversions between types: what can't be converted is null, or the other value if one is given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates

#: Texts that mean yes and no.
YES, NO = ("true", "yes", "y", "on", "1", "t"), ("false", "no", "n", "off", "0", "f")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _or(x: Column, other) -> Column:
    return x if other is None else F.coalesce(x, other if isinstance(other, Column) else F.lit(other))


def to_string(x, other=None) -> Column:
    return _or(_c(x).cast("string"), other)


def to_string_or_empty(x) -> Column:
    return to_string(x, "")


def to_filled_string(x, other: str) -> Column:
    """Another text for null and empty ones."""
    return F.coalesce(F.nullif(_c(x).cast("string"), F.lit("")), F.lit(other))


def to_boolean(x, other=None) -> Column:
    s = F.lower(F.trim(_c(x).cast("string")))
    return _or(F.when(s.isin(*YES), True).when(s.isin(*NO), False), other)


def number_of_boolean(x) -> Column:
    """1 and 0 of yes and no; null: 0."""
    return F.coalesce(to_boolean(x).cast("int"), F.lit(0))


def _number(x, kind: str) -> Column:
    """Texts with blanks around, grouping commas, and decimals (towards zero for whole types)."""
    s = F.replace(F.trim(_c(x).cast("string")), F.lit(","), F.lit(""))
    direct = s.try_cast(kind)
    return direct if kind in ("double", "decimal(38,18)") else F.coalesce(direct, F.when(s.rlike(r"^[-+]?\d*\.\d+$"), s.try_cast("decimal(38,18)").try_cast(kind)))


def to_int(x, other=None) -> Column:
    return _or(_number(x, "int"), other)


def to_int_value(x) -> Column:
    return to_int(x, 0)


def to_long(x, other=None) -> Column:
    return _or(_number(x, "bigint"), other)


def to_long_value(x) -> Column:
    return to_long(x, F.lit(0).cast("long"))


def to_double(x, other=None) -> Column:
    return _or(_number(x, "double"), other)


def to_double_value(x) -> Column:
    return to_double(x, 0.0)


def to_decimal(x, other=None) -> Column:
    return _or(_number(x, "decimal(38,18)"), other)


def to_date(x, other=None) -> Column:
    """A time of text in any common form, or of seconds or milliseconds as a number."""
    s = F.trim(_c(x).cast("string"))
    forms = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyyMMddHHmmss", "yyyyMMdd")
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in forms[:-2]], F.when(F.length(s) == 14, F.try_to_timestamp(s, F.lit(forms[-2]))), F.when(F.length(s) == 8, F.try_to_timestamp(s, F.lit(forms[-1]))))
    epoch = F.when(s.rlike(r"^\d{10}$") | s.rlike(r"^\d{13}$"), dates.from_epoch(s.try_cast("long")))
    return _or(F.coalesce(epoch, parsed), other)


def to_binary_text(x, bits: int = 8) -> Column:
    """The lowest bits as zeros and ones."""
    return F.right(F.lpad(F.bin(_c(x).cast("long").bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))), bits, "0"), F.lit(bits))

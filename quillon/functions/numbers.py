"""Numbers and decimal strings. Decimal work is DECIMAL(38,18); results are strings without ending zeros."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,18)"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _d(x) -> Column:
    """Empty and null count as 0."""
    return F.coalesce(F.nullif(_c(x).cast("string"), F.lit("")).cast(WIDE), F.lit(0).cast(WIDE))


def is_positive_integer(s) -> Column:
    return F.coalesce(_c(s).rlike(r"^[1-9]\d*$"), F.lit(False))


def is_positive_decimal(s) -> Column:
    return F.coalesce(_c(s).rlike(r"^(?=.*[1-9])(?:[1-9]\d*|0)\.\d+$"), F.lit(False))


def is_number(s) -> Column:
    return F.coalesce(_c(s).rlike(r"^\d+$"), F.lit(False))


def is_parsable(s) -> Column:
    return F.coalesce(_c(s).rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.lit(False))


def remove_end_zeros(s) -> Column:
    s = _c(s).cast("string")
    return F.when(F.locate(".", s) > 0, F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def cut(x, places: int) -> Column:
    """Towards zero."""
    d, p = _d(x), F.lit(10**places).cast("decimal(20,0)")
    return remove_end_zeros((F.signum(d).cast("int") * F.floor(F.abs(d) * p) / p).cast(f"decimal(38,{max(places, 0)})"))


def cut_up(x, places: int) -> Column:
    """Away from zero."""
    d, p = _d(x), F.lit(10**places).cast("decimal(20,0)")
    return remove_end_zeros((F.signum(d).cast("int") * F.ceil(F.abs(d) * p) / p).cast(f"decimal(38,{max(places, 0)})"))


def add(a, b, places: int) -> Column:
    return cut((_d(a) + _d(b)).cast(WIDE), places)


def subtract(a, b, places: int) -> Column:
    return cut((_d(a) - _d(b)).cast(WIDE), places)


def multiply(a, b, places: int) -> Column:
    return cut((_d(a).cast("decimal(24,8)") * _d(b).cast("decimal(14,8)")).cast(WIDE), places)


def divide(a, b, places: int) -> Column:
    """Null for a divisor of 0."""
    by = _d(b).cast("decimal(14,6)")
    return F.when(by != 0, cut(F.try_divide(_d(a).cast("decimal(24,6)"), by).cast(WIDE), places))


def compare(a, b) -> Column:
    return F.signum(_d(a) - _d(b)).cast("int")


def hex_to_decimal(s) -> Column:
    return F.conv(_c(s), 16, 10)


def convert_base(s, a: int, b: int) -> Column:
    return F.lower(F.conv(_c(s), a, b))


def accuracy(s) -> Column:
    """Decimal places, without ending zeros."""
    return F.length(F.regexp_replace(F.split_part(_c(s), F.lit("."), F.lit(2)), "0+$", ""))


def format_amount(x, places: int = 2) -> Column:
    return F.format_number(_c(x), places)


def numbers_min(*xs) -> Column:
    return F.least(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def numbers_max(*xs) -> Column:
    return F.greatest(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def is_not_number(s) -> Column:
    return ~is_number(s)


def is_coin_amount(s) -> Column:
    """A whole or decimal number that isn't negative."""
    return F.coalesce(_c(s).rlike(r"^\d+(?:\.\d+)?$"), F.lit(False))


def deduct_fee(x, rate, places: int = 6) -> Column:
    """x less its share, cut to the places."""
    return cut(_d(x) - _d(x) * F.lit(rate).cast("decimal(18,9)"), places)


def divide_up(a, b, places: int) -> Column:
    """The quotient to 18 places, then rounded away from zero."""
    return cut_up(_d(a) / _d(b), places)


def compare_abs(a, b) -> Column:
    return F.signum(F.abs(_d(a)) - F.abs(_d(b))).cast("int")


def increase_step(s, step: int) -> Column:
    """The step is added at the last decimal place: 1.20 and 3 give 1.23. Blank: null."""
    s = _c(s)
    places = F.when(F.instr(s, ".") > 0, F.length(s) - F.instr(s, ".")).otherwise(0)
    moved = F.replace(s, F.lit("."), F.lit("")).try_cast("decimal(38,0)") + F.lit(step).cast("decimal(38,0)")
    digits = F.lpad(F.abs(moved).cast("decimal(38,0)").cast("string"), F.greatest(F.length(F.abs(moved).cast("decimal(38,0)").cast("string")), places + 1), F.lit("0"))
    text = F.when(places > 0, F.concat(F.left(digits, F.length(digits) - places), F.lit("."), F.right(digits, places))).otherwise(digits)
    return F.when(s.rlike(r"\S"), F.concat(F.when(moved < 0, "-").otherwise(""), text))


def average(a, b, places: int) -> Column:
    return cut((_d(a) + _d(b)) / 2, places)


def accuracy_all(s) -> Column:
    """Digits behind the point, trailing zeros too."""
    return F.when(F.instr(_c(s), ".") > 0, F.length(F.substring_index(_c(s), ".", -1))).otherwise(F.lit(0))


def round_text(x, places: int = 2) -> Column:
    """Rounded half to even, with these places and without a leading zero."""
    return F.regexp_replace(F.replace(F.format_number(F.bround(_c(x).cast("decimal(38,18)"), places), places), F.lit(","), F.lit("")), r"^(-?)0\.", "$1.")


def to_unsigned(x) -> Column:
    """Without the sign, as text."""
    return F.regexp_replace(_c(x).cast("string"), "^[-+]", "")


def digits_of(s) -> Column:
    """All digits and points of a text."""
    return F.regexp_replace(_c(s), r"[^0-9.]", "")


def first_number(s) -> Column:
    return F.nullif(F.regexp_extract(_c(s), r"(\d+)", 1), F.lit(""))


def add_all(x, *others) -> Column:
    """Nulls count as 0."""
    zero = F.lit(0)
    return reduce(lambda a, b: a + F.coalesce(_c(b), zero), others, F.coalesce(_c(x), zero))


def subtract_all(x, *others) -> Column:
    zero = F.lit(0)
    return reduce(lambda a, b: a - F.coalesce(_c(b), zero), others, F.coalesce(_c(x), zero))


# Chinese capital numerals and the units of amounts.
RMB_DIGITS = "零壹贰叁肆伍陆柒捌玖"
RMB_PLACES = ("", "拾", "佰", "仟")


def amount_in_chinese(s) -> Column:
    """An amount above zero with up to 12 whole digits and two places, in capital numerals; anything else: null.

    Groups of four digits are written apart; zeros inside and between groups count once, those at a group's end not at all.
    """
    text = F.replace(_c(s).cast("string"), F.lit(","), F.lit(""))
    text = F.when(F.instr(text, ".") > 0, text).otherwise(F.concat(text, F.lit(".00")))
    ok = text.rlike(r"^(0|[1-9]\d{0,11})\.(\d\d)$") & (text != "0.00")
    whole, cents = F.lpad(F.substring_index(text, ".", 1), 12, "0"), F.substring_index(text, ".", -1)
    digit = lambda i: F.substring(whole, i + 1, 1).try_cast("int")
    name = lambda d: F.substring(F.lit(RMB_DIGITS), d + 1, F.lit(1))
    pieces = []
    for i in range(12):
        pieces.append(F.when(digit(i) > 0, F.concat(name(digit(i)), F.lit(RMB_PLACES[(11 - i) % 4]))).otherwise("零"))
        if i in (3, 7):  # the end of a group
            pieces.append(F.when(F.substring(whole, i - 2, 4) != "0000", "亿" if i == 3 else "万").otherwise(""))
    raw = F.concat(*pieces)
    raw = F.regexp_replace(F.regexp_replace(raw, "零+", "零"), "零(万|亿)", "$1")
    raw = F.regexp_replace(F.regexp_replace(raw, "^零+", ""), "零+$", "")
    tens, ones = F.substring(cents, 1, 1).try_cast("int"), F.substring(cents, 2, 1).try_cast("int")
    small = F.concat(F.when(tens > 0, F.concat(name(tens), F.lit("角"))).when(raw != "", "零").otherwise(""), F.when(ones > 0, F.concat(name(ones), F.lit("分"))).otherwise(""))
    return F.when(ok, F.concat(F.when(raw != "", F.concat(raw, F.lit("元"))).otherwise(""), F.when(cents == "00", "整").otherwise(small)))

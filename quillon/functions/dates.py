"""Date and time functions on date, timestamp or timestamp_ntz columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _micros(x) -> Column:
    return F.unix_micros(_c(x).cast("timestamp"))


def format_date(d, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_c(d), pattern)


def parse_date(s, *patterns: str) -> Column:
    """By the first pattern that fits; null if none does."""
    known = patterns or ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMddHHmmss", "yyyyMMdd")
    return F.coalesce(*[F.try_to_timestamp(_c(s), F.lit(p)) for p in known])


def from_epoch(x) -> Column:
    """Ten digits are seconds, more are milliseconds."""
    x = _c(x).cast("long")
    return F.timestamp_millis(F.when((x >= 1_000_000_000) & (x <= 9_999_999_999), x * 1000).otherwise(x))


def next_day(d, n: int = 1) -> Column:
    return F.date_add(_c(d), n)


def add_months(d, n: int) -> Column:
    return F.add_months(_c(d), n)


def gap_millis(a, b) -> Column:
    """Without sign."""
    return F.floor(F.abs(_micros(a) - _micros(b)) / 1000).cast("long")


def gap_seconds(a, b) -> Column:
    return F.floor(gap_millis(a, b) / 1000).cast("long")


def gap_minutes(a, b) -> Column:
    return F.floor(gap_millis(a, b) / 60_000).cast("long")


def gap_hours(a, b) -> Column:
    return F.floor(gap_millis(a, b) / 3_600_000).cast("long")


def gap_days(a, b) -> Column:
    return F.floor(gap_millis(a, b) / 86_400_000).cast("long")


def gap_months(a, b) -> Column:
    """By calendar months alone."""
    a, b = _c(a), _c(b)
    return F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("long")


def begin_of_day(d) -> Column:
    return F.date_trunc("day", _c(d))


def end_of_day(d) -> Column:
    return F.date_trunc("day", _c(d)) + F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND")


def begin_of_year(d) -> Column:
    return F.date_trunc("year", _c(d))


def end_of_year(d) -> Column:
    return F.add_months(F.trunc(_c(d), "year"), 12).cast("timestamp") - F.expr("INTERVAL '0.001' SECOND")


def first_day_of_last_month(d) -> Column:
    return F.trunc(F.add_months(_c(d), -1), "MM")


def last_day_of_last_month(d) -> Column:
    return F.last_day(F.add_months(_c(d), -1))


def is_leap_year(y) -> Column:
    y = _c(y)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def days_of_month(y, m) -> Column:
    return F.day(F.last_day(F.make_date(_c(y), _c(m), F.lit(1))))


def utc_to_local(d, zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.from_utc_timestamp(_c(d).cast("timestamp"), zone), pattern)


def duration_text(millis) -> Column:
    """d days h:mm:ss of a number of milliseconds."""
    s = F.floor(_c(millis) / 1000)
    return F.format_string("%d days %d:%02d:%02d", F.floor(s / 86400).cast("long"), F.floor(s % 86400 / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long"))


# --- now

SPANS = {"year": 365 * 86_400_000, "month": 30 * 86_400_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000}


def now_text(pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.current_timestamp(), pattern)


def now_number(pattern: str = "yyyyMMdd") -> Column:
    return now_text(pattern).cast("long")


def current_year() -> Column:
    return F.year(F.current_timestamp())


def day_of(d) -> Column:
    return F.day(_c(d))


def hour_of(d) -> Column:
    return F.hour(_c(d))


def begin_of_tomorrow() -> Column:
    return F.date_trunc("day", F.current_timestamp()) + F.expr("INTERVAL 1 DAY")


def month_and_day(m, d) -> Column:
    """0101 of 1 and 1."""
    two = lambda x: F.when(F.length(x) == 1, F.concat(F.lit("0"), x)).otherwise(x)
    return F.concat(two(_c(m).cast("string")), two(_c(d).cast("string")))


# --- spans of milliseconds


def to_unit(millis, unit: str) -> Column:
    """Whole years (of 365 days), months (of 30), days, hours, minutes or seconds, towards zero."""
    x = _c(millis)
    return F.when(x >= 0, F.floor(x / SPANS[unit])).otherwise(F.ceil(x / SPANS[unit])).cast("long")


def past(d, unit: str, now: Column | None = None) -> Column:
    """Whole units from a time to now."""
    return to_unit(F.unix_millis(now if now is not None else F.current_timestamp()) - F.unix_millis(_c(d).cast("timestamp")), unit)


def past_text(millis, names: tuple[str, ...] = ("年", "个月", "天", "小时", "分钟", "秒")) -> Column:
    """A span as its parts that aren't zero, from years to seconds."""
    rest, parts = _c(millis), []
    for unit, name in zip(SPANS, names, strict=True):
        n = F.floor(rest / SPANS[unit])
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))))
        rest = rest - n * SPANS[unit]
    return F.concat_ws("", *parts)


# --- zones


def to_local(d, zone: str) -> Column:
    """A time without zone, as clocks in the zone show it."""
    return F.from_utc_timestamp(_c(d), zone).cast("timestamp_ntz")


def from_local(d, zone: str) -> Column:
    return F.to_utc_timestamp(_c(d), zone)


def utc_text_to_local(s, pattern: str, zone: str) -> Column:
    return F.from_utc_timestamp(F.try_to_timestamp(_c(s), F.lit(pattern)), zone)

"""Identifiers: ULID, UUIDv7, snowflakes, 64-bit and 62-digit codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The alphabets of ULID (Crockford's 32) and of short codes (62 digits), and the constants of the FNV-1a hash.
ULID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
CODE_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _digit(at: Column, digits: str) -> Column:
    return F.substring(F.lit(digits), (at + 1).cast("int"), F.lit(1))


PLAIN_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # those that conv() knows


def _base32(number: Column, n: int) -> Column:
    """n digits, five bits each."""
    return F.lpad(F.translate(F.conv(number.cast("string"), 10, 32), PLAIN_DIGITS, ULID_DIGITS), n, "0")


def ulid(millis: Column | None = None, entropy: Column | None = None) -> Column:
    """48 bits of time and 80 of chance (or of a hash that is given, such as of a row's key, for repeatable ids) in 26 digits."""
    t = millis if millis is not None else F.unix_millis(F.current_timestamp())
    seed = entropy if entropy is not None else F.xxhash64(F.uuid())
    a, b = (F.xxhash64(seed, F.lit(k)).bitwiseAND(F.lit((1 << 40) - 1)) for k in ("a", "b"))
    return F.concat(_base32(t, 10), _base32(a, 8), _base32(b, 8))


def ulid_monotonic(millis: Column | None = None) -> Column:
    """Within one task ids ascend: the chance part ends in the row's number."""
    t = millis if millis is not None else F.unix_millis(F.current_timestamp())
    row = F.monotonically_increasing_id()
    return F.concat(_base32(t, 10), _base32(F.shiftright(row, 33), 4), F.lit("00000"), _base32(row.bitwiseAND(F.lit((1 << 33) - 1)), 7))


def is_ulid(s) -> Column:
    return F.coalesce(F.upper(_c(s)).rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$"), F.lit(False))


def _value(s: Column, a: int, n: int) -> Column:
    """The number that n digits from place a (from 0) write."""
    return F.conv(F.translate(F.substring(s, a + 1, n), ULID_DIGITS, PLAIN_DIGITS), 32, 10).cast("long")


def ulid_parts(s) -> Column:
    """struct<millis, at, entropy (hex)>; null for what isn't one."""
    u = F.upper(_c(s))
    millis = _value(u, 0, 10)
    entropy = F.lower(F.concat(F.lpad(F.hex(_value(u, 10, 8)), 10, "0"), F.lpad(F.hex(_value(u, 18, 8)), 10, "0")))
    return F.when(is_ulid(s), F.struct(millis.alias("millis"), F.timestamp_millis(millis).alias("at"), entropy.alias("entropy")))


def ulid_bytes(s) -> Column:
    p = ulid_parts(s)
    return F.unhex(F.concat(F.lpad(F.hex(p["millis"]), 12, "0"), p["entropy"]))


def ulid_of_bytes(b) -> Column:
    h = F.hex(_c(b))
    number = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long")
    return F.when(F.octet_length(_c(b)) == 16, F.concat(_base32(number(1, 12), 10), _base32(number(13, 10), 8), _base32(number(23, 10), 8)))


def is_uuid7(s) -> Column:
    return F.coalesce(F.lower(_c(s)).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def uuid7_time(s) -> Column:
    return F.when(is_uuid7(s), F.timestamp_millis(F.conv(F.substring(F.replace(_c(s), F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")))


def uuid7_monotonic(millis: Column | None = None) -> Column:
    """Within one task ids ascend: the row's number follows the time."""
    t = F.lpad(F.lower(F.hex(millis if millis is not None else F.unix_millis(F.current_timestamp()))), 12, "0")
    row = F.monotonically_increasing_id()
    low = F.lpad(F.lower(F.hex(row.bitwiseAND(F.lit((1 << 33) - 1)))), 9, "0")
    task = F.lpad(F.lower(F.hex(F.shiftright(row, 33))), 6, "0")
    return F.concat(F.left(t, F.lit(8)), F.lit("-"), F.right(t, F.lit(4)), F.lit("-7"), F.left(task, F.lit(3)), F.lit("-8"), F.right(task, F.lit(3)), F.lit("-000"), low)


def snowflake_parts(x, epoch_ms: int = 1_577_836_800_000) -> Column:
    """struct<at, partition, row> of an id by crypto.snowflake_id."""
    x = _c(x).cast("long")
    return F.struct(F.timestamp_millis(F.shiftright(x, 22) + epoch_ms).alias("at"), F.shiftright(x, 12).bitwiseAND(F.lit(1023)).alias("partition"), x.bitwiseAND(F.lit(4095)).alias("row"))


def hex_id(x) -> Column:
    return F.lower(F.hex(_c(x)))


@F.pandas_udf(LongType())
def fnv1a(s: pd.Series) -> pd.Series:
    """FNV-1a over the UTF-16 units of a text, as a signed 64-bit number; null: null. One step over all rows at a time."""
    units = [np.frombuffer((x or "").encode("utf-16-le"), "<u2") for x in s]
    n = np.array([len(u) for u in units])
    order = np.argsort(-n, kind="stable")
    out = np.full(len(units), FNV_BASIS, np.uint64)
    for i in range(int(n.max()) if len(n) else 0):
        live = order[: int((n > i).sum())]
        out[live] = (out[live] ^ np.array([units[k][i] for k in live], np.uint64)) * np.uint64(FNV_PRIME)
    return pd.Series(out.astype(np.int64)).astype("Int64").where(s.notna().to_numpy())


def encode62(x) -> Column:
    """A number above zero in digits of 62, the lowest first; anything else: null."""
    x = _c(x).cast("long")
    start = F.struct(x.alias("n"), F.lit("").alias("s"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(11)), start, lambda acc, _: F.when(acc["n"] > 0, F.struct(F.floor((acc["n"] - F.pmod(acc["n"], F.lit(62))) / 62).cast("long").alias("n"), F.concat(acc["s"], _digit(F.pmod(acc["n"], F.lit(62)), CODE_DIGITS)).alias("s"))).otherwise(acc))
    return F.when(x > 0, done["s"])


def decode62(s) -> Column:
    """The number that digits of 62, the lowest first, write; null for other characters and empty texts."""
    s = F.trim(_c(s))
    digits = F.transform(F.split(F.reverse(s), ""), lambda d: F.call_function("locate", d, F.lit(CODE_DIGITS)) - 1)
    return F.when(s.rlike("^[0-9A-Za-z]{1,10}$"), F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * 62 + d))


# The weights and check characters of 18-digit identity numbers.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"


def id_card_check(s) -> Column:
    """The check character of the first 17 digits."""
    total = sum((F.substring(_c(s), i + 1, 1).try_cast("int") * w for i, w in enumerate(ID_WEIGHTS)), F.lit(0))
    return F.when(F.length(_c(s)) >= 17, F.substring(F.lit(ID_CHECKS), F.pmod(total, F.lit(11)) + 1, F.lit(1))).otherwise(" ")


def id_card_parts(s) -> Column:
    """struct<area, birthday, gender, age> of a valid number; else null. The area is its code, to be joined with a table of names."""
    s = F.upper(_c(s))
    birthday = F.try_to_date(F.substring(s, 7, 8), "yyyyMMdd")
    ok = F.coalesce(s.rlike(r"^\d{17}[\dX]$") & (id_card_check(s) == F.substring(s, 18, 1)) & birthday.isNotNull(), F.lit(False))
    gender = F.when(F.substring(s, 17, 1).try_cast("int") % 2 == 1, "male").otherwise("female")
    age = F.floor(F.months_between(F.current_date(), birthday) / 12).cast("int")
    return F.when(ok, F.struct(F.substring(s, 1, 6).alias("area"), birthday.alias("birthday"), gender.alias("gender"), age.alias("age")))

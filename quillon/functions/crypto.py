"""Hashes, encodings, ciphers and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def md5(s) -> Column:
    return F.md5(_c(s).cast("binary"))


def sha1(s) -> Column:
    return F.sha1(_c(s).cast("binary"))


def sha256(s) -> Column:
    return F.sha2(_c(s).cast("binary"), 256)


def sha512(s) -> Column:
    return F.sha2(_c(s).cast("binary"), 512)


def hex_text(b) -> Column:
    return F.lower(F.hex(_c(b)))


def base64_encode(s) -> Column:
    return F.base64(_c(s).cast("binary"))


def base64_decode(s) -> Column:
    return F.unbase64(_c(s)).cast("string")


def base64_decode_lenient(s) -> Column:
    """Characters outside of the alphabet are left out."""
    return F.unbase64(F.regexp_replace(F.translate(_c(s), "-_", "+/"), "[^A-Za-z0-9+/=]", "")).cast("string")


def is_base64(s) -> Column:
    return F.coalesce(_c(s).rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.lit(False))


def hmac_sha256(s, key: str) -> Column:
    """Over built-in hashes: H((key ^ opad) + H((key ^ ipad) + message))."""
    import hashlib

    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), _c(s).cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def aes_encrypt(s, key: str, mode: str = "GCM") -> Column:
    return F.base64(F.aes_encrypt(_c(s), F.lit(key), F.lit(mode)))


def aes_decrypt(s, key: str, mode: str = "GCM") -> Column:
    return F.aes_decrypt(F.unbase64(_c(s)), F.lit(key), F.lit(mode)).cast("string")


def snowflake_id(epoch_ms: int = 1_577_836_800_000) -> Column:
    """41 bits of time, 10 of the partition, 12 of the row: unique in a run of up to 1024 partitions and 4096 rows a millisecond."""
    row = F.monotonically_increasing_id()
    millis = F.unix_millis(F.current_timestamp()) - epoch_ms + F.shiftright(row.bitwiseAND(F.lit((1 << 33) - 1)), 12)
    return F.shiftleft(millis, 22).bitwiseOR(F.shiftleft((F.spark_partition_id() % 1024).cast("long"), 12)).bitwiseOR(row.bitwiseAND(F.lit(4095)))


def uuid7() -> Column:
    """Time-ordered: 48 bits of milliseconds, then version, variant and random bits."""
    t = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    r = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.left(t, F.lit(8)), F.lit("-"), F.right(t, F.lit(4)), F.lit("-7"), F.substring(r, 14, 3), F.lit("-"), F.substring(r, 17, 4), F.lit("-"), F.substring(r, 21, 12))


def id_card_checksum_ok(s) -> Column:
    """18 characters; the last is a weighted sum modulo 11."""
    weights = [2 ** (17 - i) % 11 for i in range(17)]
    s = F.upper(_c(s))
    total = sum((F.substring(s, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return F.coalesce(s.rlike(r"^\d{17}[\dX]$") & (F.substring(F.lit("10X98765432"), (total % 11 + 1).cast("int"), F.lit(1)) == F.substring(s, 18, 1)), F.lit(False))

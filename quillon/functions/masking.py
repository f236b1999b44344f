"""Masks for personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def mask(s, head: int, tail: int, sign: str = "*") -> Column:
    """head and tail characters stay. Too short for both: the first stays; one character: none."""
    s = _c(s)
    n = F.length(s)
    full = F.concat(F.left(s, F.lit(head)), F.repeat(F.lit(sign), n - head - tail), F.right(s, F.lit(tail)) if tail else F.lit(""))
    return F.when(n <= 1, F.repeat(F.lit(sign), n)).when(n <= head + tail, F.concat(F.left(s, F.lit(1)), F.repeat(F.lit(sign), n - 1))).otherwise(full)


def mask_all(s, sign: str = "*") -> Column:
    return F.repeat(F.lit(sign), F.length(_c(s)))


def phone(s) -> Column:
    return mask(s, 3, 4)


def id_card(s) -> Column:
    return mask(s, 6, 4)


def bank_card(s) -> Column:
    return mask(F.replace(_c(s), F.lit(" "), F.lit("")), 4, 4)


def name(s) -> Column:
    s = _c(s)
    return F.when(s.rlike(r"^[一-龥]{2,15}$"), mask(s, 1, 0)).otherwise(mask(s, 1, 1))


def email(s) -> Column:
    s = _c(s)
    local = F.substring_index(s, "@", 1)
    return F.when(F.locate("@", s) > 1, F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.length(local) - 1), F.substring(s, F.length(local) + 1, F.length(s)))).otherwise(mask(s, 1, 1))


def address(s) -> Column:
    return mask(s, 6, 0)


def car_number(s) -> Column:
    return mask(s, 2, 2)


def ip(s) -> Column:
    s = _c(s)
    return F.when(F.size(F.split(s, r"\.")) == 4, F.concat(F.substring_index(s, ".", 2), F.lit(".*.*"))).otherwise(mask(s, 1, 1))


def password(s) -> Column:
    return F.when(_c(s).isNotNull(), F.lit("******"))


MASKS = {"phone": phone, "id_card": id_card, "bank_card": bank_card, "name": name, "email": email, "address": address, "car_number": car_number, "ip": ip, "password": password, "all": mask_all}


def desensitize(s, kind: str) -> Column:
    return MASKS[kind](s) if kind in MASKS else mask(s, 1, 1)

"""What differs between dialects, as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str
    quotes: str = '"'  # characters that open quoted names
    double_is_string: bool = False
    concat_pipes: bool = True  # || concatenates (else it is OR)
    backslash: bool = False  # escapes in strings
    nulls_high: bool = False  # NULL sorts as the greatest value
    hash_comment: bool = False
    caret_power: bool = False
    concat_skips_null: bool = False
    length_bytes: bool = False
    greatest_null: bool = False  # LEAST and GREATEST give NULL for any NULL
    no_case: bool = False  # string comparison ignores case
    integer_division: bool = False
    array_base: int = 1


DIALECTS = {
    d.name: d
    for d in (
        Dialect("ansi"),
        Dialect("mysql", "`", True, False, True, False, True, length_bytes=True, greatest_null=True),
        Dialect("postgres", nulls_high=True, caret_power=True, concat_skips_null=True, integer_division=True),
        Dialect("oracle", nulls_high=True, concat_skips_null=True, greatest_null=True),
        Dialect("oracle12", nulls_high=True, concat_skips_null=True, greatest_null=True),
        Dialect("sqlserver", '"[', concat_skips_null=True, integer_division=True),
        Dialect("h2"),
        Dialect("db2", nulls_high=True, integer_division=True),
        Dialect("sqlite", '"`[', integer_division=True),
        Dialect("hive", "`", True, True, True, array_base=0),
        Dialect("clickhouse", '"`', False, True, True),
        Dialect("presto", nulls_high=True, integer_division=True),
        Dialect("dameng", nulls_high=True, concat_skips_null=True, greatest_null=True),
        Dialect("spark", "`", True, True, True, array_base=0),
    )
}


def dialect(name: str | Dialect) -> Dialect:
    if isinstance(name, Dialect):
        return name
    key = name.lower()
    if key not in DIALECTS:
        raise ValueError(f"unknown dialect {name}; known: {', '.join(DIALECTS)}")
    return DIALECTS[key]

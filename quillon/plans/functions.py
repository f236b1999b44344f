"""Functions of other dialects, as calls that Spark knows. A rule gets the emitter and the call, and returns a call or text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from . import ast as A

Rule = Callable[[Any, A.Call], Any]
RULES: dict[str, Rule] = {}


def rule(*names: str):
    def add(f: Rule) -> Rule:
        for n in names:
            RULES[n] = f
        return f

    return add


def register(name: str, f: Rule) -> None:
    """A rule of one's own; it wins over a built-in one."""
    RULES[name.upper()] = f


RENAMED = {
    "IFNULL": "coalesce", "NVL": "coalesce", "UCASE": "upper", "LCASE": "lower", "CEILING": "ceil", "POW": "power", "LEN": "length", "CHARACTER_LENGTH": "char_length", "REPLICATE": "repeat", "SUBSTR": "substring", "MID": "substring",
    "TRUNCATE": "truncate", "GETDATE": "current_timestamp", "SYSDATE": "current_timestamp", "SYSDATETIME": "current_timestamp", "SYSTIMESTAMP": "current_timestamp", "LOCALTIMESTAMP": "current_timestamp", "CURTIME": "current_time", "RANDOM": "rand",
    "DAYOFMONTH": "day", "TO_CHARS": "to_char", "ARRAY_LENGTH": "size", "CARDINALITY": "size", "UNIQ": "count_distinct", "ARGMAX": "max_by", "ARGMIN": "min_by", "ARG_MAX": "max_by", "ARG_MIN": "min_by", "STDDEV_POP": "stddev_pop", "STDEV": "stddev_samp",
    "VARP": "var_pop", "VAR": "var_samp", "ARRAY_AGG": "collect_list", "GROUPARRAY": "collect_list", "STRPOS": "instr", "APPROX_DISTINCT": "approx_count_distinct", "EVERY": "bool_and", "LOGICAL_OR": "bool_or", "TODATE": "to_date", "TOSTRING": "string",
    "CHARINDEX": "locate", "JSON_EXTRACT_PATH_TEXT": "get_json_object", "JSON_VALUE": "get_json_object", "JSON_EXTRACT": "get_json_object", "DATALENGTH": "octet_length", "NEWID": "uuid", "GEN_RANDOM_UUID": "uuid",
}

DATE_SIGNS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "a": "EEE", "W": "EEEE", "j": "DDD", "T": "HH:mm:ss", "%": "%"}
ORACLE_SIGNS = (("YYYY", "yyyy"), ("YY", "yy"), ("MONTH", "MMMM"), ("MON", "MMM"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("DY", "EEE"), ("AM", "a"), ("Q", "Q"))


def mysql_pattern(text: str, em: Any = None) -> str:
    def sign(m: re.Match) -> str:
        if m[1] not in DATE_SIGNS and em is not None:
            em.warn(f"date sign %{m[1]} has no counterpart")
        return DATE_SIGNS.get(m[1], m[1])

    return re.sub(r"%(.)", sign, text)


def oracle_pattern(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        for a, b in ORACLE_SIGNS:
            if text[i : i + len(a)].upper() == a:
                out, i = out + b, i + len(a)
                break
        else:
            out, i = out + (f"'{text[i]}'" if text[i].isalpha() else text[i]), i + 1
    return out


def _pattern(em: Any, x: Any) -> str:
    if em.d.name in ("spark", "hive"):
        return em.e(x)
    if not isinstance(x, A.Lit):
        em.warn("a date pattern that isn't a literal is passed on")
        return em.e(x)
    return "'" + (mysql_pattern(x.value, em) if "%" in x.value else oracle_pattern(x.value)).replace("'", "\\'") + "'"


@rule("GROUP_CONCAT", "STRING_AGG", "LISTAGG", "WM_CONCAT")
def _listagg(em, c):
    value, *rest = c.args
    if c.name.upper() == "GROUP_CONCAT" and rest:
        value, rest = A.Call("concat", c.args), []
    sep = c.separator or (rest[0] if rest else A.Lit("string", ","))
    keys = c.order or c.within
    if c.distinct and keys and em.e(keys[0].value) != em.e(value):
        k = em.e(keys[0].value)
        arr = f"array_sort(collect_set(struct({k} AS k, CAST({em.e(value)} AS STRING) AS v)))"
        arr = f"reverse({arr})" if keys[0].desc else arr
        return f"array_join(transform({arr}, x -> x.v), {em.e(sep)})"
    value = A.Cast(value, "STRING")
    return A.Call("listagg", [value, sep], distinct=c.distinct, within=[replace(k, value=A.Cast(k.value, "STRING")) if c.distinct else k for k in keys])


@rule("CONCAT")
def _concat(em, c):
    return A.Call("concat", [A.Call("coalesce", [A.Cast(a, "STRING"), A.Lit("string", "")]) for a in c.args]) if em.d.concat_skips_null else replace(c, name="concat")


@rule("ISNULL")
def _isnull(em, c):
    return replace(c, name="coalesce" if len(c.args) == 2 else "isnull")


@rule("LENGTH")
def _length(em, c):
    return replace(c, name="octet_length" if em.d.length_bytes else "length")


@rule("LEN")
def _len(em, c):
    return f"length(rtrim({em.es(c.args)}))"


@rule("LOCATE", "CHARINDEX")
def _locate(em, c):
    return replace(c, name="locate")


@rule("INSTR", "STRPOS")
def _instr(em, c):
    return f"locate({em.e(c.args[1])}, {em.e(c.args[0])}{', ' + em.e(c.args[2]) if len(c.args) > 2 else ''})"


@rule("POSITION")
def _position(em, c):
    return f"locate({em.es(c.args)})"


@rule("LEAST", "GREATEST")
def _least(em, c):
    inner = f"{c.name.lower()}({em.es(c.args)})"
    if not em.d.greatest_null:
        return inner
    return f"CASE WHEN {' OR '.join(f'{em.e(a, 4)} IS NULL' for a in c.args)} THEN NULL ELSE {inner} END"


@rule("DATE_FORMAT", "TO_CHAR", "FORMATDATETIME", "STRFTIME")
def _date_format(em, c):
    if len(c.args) == 1:
        return A.Cast(c.args[0], "STRING")
    a, b = c.args if c.name.upper() != "STRFTIME" or not (isinstance(c.args[0], A.Lit)) else c.args[::-1]
    if c.name.upper() == "TO_CHAR" and isinstance(b, A.Lit) and re.fullmatch(r"[FM$,.09SGDL]+", b.value):
        return f"to_char({em.e(a)}, {em.e(A.Lit('string', b.value.replace('FM', '')))})"
    return f"date_format({em.e(a)}, {_pattern(em, b)})"


@rule("STR_TO_DATE", "TO_TIMESTAMP", "TO_DATE")
def _to_date(em, c):
    f = "to_date" if c.name.upper() == "TO_DATE" and em.d.name not in ("oracle", "oracle12", "dameng") else "to_timestamp"
    return f"{f}({em.e(c.args[0])}{', ' + _pattern(em, c.args[1]) if len(c.args) > 1 else ''})"


@rule("FROM_UNIXTIME")
def _from_unixtime(em, c):
    return f"from_unixtime({em.e(c.args[0])}{', ' + _pattern(em, c.args[1]) if len(c.args) > 1 else ''})"


@rule("DATE_ADD", "ADDDATE", "DATE_SUB", "SUBDATE")
def _date_add(em, c):
    minus = c.name.upper() in ("DATE_SUB", "SUBDATE")
    if len(c.args) == 2 and isinstance(c.args[1], A.Interval):
        return f"({em.e(c.args[0], 6)} {'-' if minus else '+'} {em.e(c.args[1], 7)})"
    if len(c.args) == 3:  # date_add('day', n, x)
        unit = c.args[0].value if isinstance(c.args[0], A.Lit) else em.e(c.args[0])
        return f"dateadd({unit}, {em.e(c.args[1])}, {em.e(c.args[2])})"
    return f"{'date_sub' if minus else 'date_add'}({em.es(c.args)})"


@rule("DATEADD")
def _dateadd(em, c):
    return f"dateadd({_unit(em, c.args[0])}, {em.e(c.args[1])}, {em.e(c.args[2])})"


def _unit(em: Any, x: Any) -> str:
    text = x.value if isinstance(x, A.Lit) else em.e(x)
    return {"YY": "YEAR", "YYYY": "YEAR", "MM": "MONTH", "M": "MONTH", "DD": "DAY", "D": "DAY", "HH": "HOUR", "MI": "MINUTE", "N": "MINUTE", "SS": "SECOND", "S": "SECOND", "QQ": "QUARTER", "WK": "WEEK"}.get(text.upper(), text.upper())


@rule("DATEDIFF", "DATE_DIFF")
def _datediff(em, c):
    if len(c.args) == 2:
        return f"datediff({em.es(c.args)})"
    unit, a, b = _unit(em, c.args[0]), em.e(c.args[1]), em.e(c.args[2])
    if em.d.name != "sqlserver":
        return f"timestampdiff({unit}, {a}, {b})"
    # Boundaries crossed, not units completed.
    if unit == "DAY":
        return f"datediff(CAST({b} AS DATE), CAST({a} AS DATE))"
    if unit == "YEAR":
        return f"(year({b}) - year({a}))"
    if unit in ("MONTH", "QUARTER"):
        n = "month" if unit == "MONTH" else "quarter"
        k = 12 if unit == "MONTH" else 4
        return f"((year({b}) - year({a})) * {k} + {n}({b}) - {n}({a}))"
    return f"timestampdiff({unit}, date_trunc('{unit}', {a}), date_trunc('{unit}', {b}))"


@rule("TIMESTAMPDIFF", "TIMESTAMPADD")
def _timestampdiff(em, c):
    return f"{c.name.lower()}({_unit(em, c.args[0])}, {em.es(c.args[1:])})"


@rule("TRIM")
def _trim(em, c):
    if len(c.args) == 3:
        return f"trim({c.args[0].value} {em.e(c.args[1])} FROM {em.e(c.args[2])})"
    return replace(c, name="trim")


@rule("QUANTILE", "QUANTILEEXACT", "MEDIAN")
def _quantile(em, c):
    return f"percentile({em.e(c.args[0])}, {em.e(c.params[0]) if c.params else '0.5'})"


@rule("PERCENTILE_CONT", "PERCENTILE_DISC")
def _percentile(em, c):
    return replace(c, name=c.name.lower())


@rule("JSON_EXTRACT_PATH_TEXT")
def _json_path(em, c):
    return f"get_json_object({em.e(c.args[0])}, '$.{'.'.join(a.value for a in c.args[1:])}')"


@rule("JSON_OBJECTAGG")
def _objectagg(em, c):
    return f"to_json(map_from_entries(array_sort(collect_list(struct({em.e(c.args[0])}, {em.e(c.args[1])})))))"


@rule("JSON_ARRAYAGG")
def _arrayagg(em, c):
    return f"to_json(collect_list({em.e(c.args[0])}))"


@rule("JSON_OBJECT")
def _json_object(em, c):
    return f"to_json(named_struct({em.es(c.args)}))"


@rule("ARRAY_AGG", "GROUPARRAY", "COLLECT_LIST")
def _array_agg(em, c):
    if not c.order:
        return replace(c, name="collect_set" if c.distinct else "collect_list", distinct=False)
    k = c.order[0]
    arr = f"array_sort(collect_list(struct({em.e(k.value)} AS k, {em.e(c.args[0])} AS v)))"
    return f"transform({f'reverse({arr})' if k.desc else arr}, x -> x.v)"


@rule("CHAR", "CHR")
def _chr(em, c):
    return f"chr({em.e(c.args[0])})" if len(c.args) == 1 else f"concat({', '.join(f'chr({em.e(a)})' for a in c.args)})"


@rule("LAST_INSERT_ID", "FOUND_ROWS")
def _no_counterpart(em, c):
    em.warn(f"{c.name} has no counterpart")
    return replace(c)


@rule("WINDOWFUNNEL")
def _funnel(em, c):
    """The longest chain of conditions met in time order, all within the window that starts at the first."""
    span, (ts, *conds) = em.e(c.params[0]), c.args
    t = f"CAST({em.e(ts)} AS TIMESTAMP)"
    steps = f"array({', '.join(f'coalesce({em.e(x)}, FALSE)' for x in conds)})"
    rows = f"array_sort(collect_list(struct(unix_micros({t}) / 1e6 AS t, {steps} AS m)))"
    n = len(conds)
    return (
        f"array_max(concat(array(0), aggregate({rows}, array_repeat(CAST(NULL AS DOUBLE), {n}), (a, e) -> transform(a, (s, i) -> "
        f"CASE WHEN i = 0 AND e.m[0] THEN e.t WHEN i > 0 AND e.m[i] AND a[i - 1] IS NOT NULL AND e.t <= a[i - 1] + {span} THEN greatest(coalesce(s, a[i - 1]), a[i - 1]) ELSE s END), "
        f"a -> transform(a, (s, i) -> CASE WHEN s IS NULL THEN 0 ELSE i + 1 END))))"
    )


def rewrite_call(em: Any, c: A.Call) -> Any:
    u = c.name.upper()
    if em.d.name == "spark" and u not in ("TRIM", "TIMESTAMPDIFF", "TIMESTAMPADD", "DATEADD"):
        return c
    if u in RULES:
        out = RULES[u](em, c)
        return em.e(out) if not isinstance(out, str | A.Call) else out
    return replace(c, name=RENAMED[u]) if u in RENAMED else c

"""String functions. Positions and lengths count code points. Regular white space means Java's \\s."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _l(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def is_empty(s) -> C:
    return _c(s).isNull() | (_c(s) == "")


def is_blank(s) -> C:
    return _c(s).isNull() | _c(s).rlike(r"^\s*$")


def is_not_blank(s) -> C:
    return ~is_blank(s)


def any_blank(*s) -> C:
    return F.greatest(*[is_blank(x) for x in s]) if len(s) > 1 else is_blank(s[0])


def all_blank(*s) -> C:
    return F.least(*[is_blank(x) for x in s]) if len(s) > 1 else is_blank(s[0])


def contains_any(s, chars: str) -> C:
    return F.length(F.translate(_c(s), chars, "")) < F.length(_c(s))


def index_of_ignore_case(s, sub: str, start: int = 0) -> C:
    """From 0; -1 if absent."""
    return F.locate(sub.lower(), F.lower(_c(s)), start + 1) - 1


def trim_to_null(s) -> C:
    return F.nullif(trim_whitespace(s), F.lit(""))


def default_if_empty(s, other) -> C:
    return F.coalesce(F.nullif(_c(s), F.lit("")), _l(other))


def default_if_blank(s, other) -> C:
    return F.when(is_blank(s), _l(other)).otherwise(_c(s))


def replace_once(s, old: str, new: str) -> C:
    s = _c(s)
    at = F.locate(old, s)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(new), F.substring(s, at + len(old), F.length(s)))).otherwise(s)


def is_all_lower(s) -> C:
    return F.coalesce(_c(s).rlike(r"^\p{Ll}+$"), F.lit(False))


def is_all_upper(s) -> C:
    return F.coalesce(_c(s).rlike(r"^\p{Lu}+$"), F.lit(False))


def is_mixed_case(s) -> C:
    return F.coalesce(_c(s).rlike(r"\p{Ll}") & _c(s).rlike(r"\p{Lu}"), F.lit(False))


def equals_ignore_case(a, b) -> C:
    return F.lower(_c(a)).eqNullSafe(F.lower(_c(b)))


def length(s) -> C:
    """0 for null."""
    return F.coalesce(F.length(_c(s)), F.lit(0))


def upper_first(s) -> C:
    return F.concat(F.upper(F.left(_c(s), F.lit(1))), F.substring(_c(s), F.lit(2), F.length(_c(s))))


def lower_first(s) -> C:
    return F.concat(F.lower(F.left(_c(s), F.lit(1))), F.substring(_c(s), F.lit(2), F.length(_c(s))))


_HALF = "".join(map(chr, range(0x21, 0x7F)))
_FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def to_half_width(s) -> C:
    return F.translate(_c(s), _FULL + "　", _HALF + " ")


def to_full_width(s) -> C:
    return F.translate(_c(s), _HALF + " ", _FULL + "　")


def delete_any(s, chars: str) -> C:
    return F.translate(_c(s), chars, "")


def delimited_to_array(s, delimiter: str) -> C:
    import re

    return F.split(_c(s), re.escape(delimiter))


def array_to_delimited(a, delimiter: str, prefix: str = "", suffix: str = "") -> C:
    return F.array_join(F.transform(_c(a), lambda x: F.concat(F.lit(prefix), x, F.lit(suffix))), delimiter)


def substring(s, start: int, end: int | None = None) -> C:
    """From 0; negative places count from the end; end is exclusive."""
    s = _c(s)
    n = F.length(s)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    z = n if end is None else F.lit(end) if end >= 0 else n + end
    return F.when(s.isNotNull(), F.substring(s, a + 1, F.greatest(F.least(z, n) - a, F.lit(0))))


def substring_before(s, d: str) -> C:
    at = F.locate(d, _c(s))
    return F.when(at > 0, F.substring(_c(s), F.lit(1), at - 1)).otherwise(_c(s))


def substring_after(s, d: str) -> C:
    at = F.locate(d, _c(s))
    return F.when(at > 0, F.substring(_c(s), at + len(d), F.length(_c(s)))).when(_c(s).isNotNull(), F.lit(""))


def substring_before_last(s, d: str) -> C:
    tail = F.substring_index(_c(s), d, -1)
    return F.when(F.locate(d, _c(s)) > 0, F.substring(_c(s), F.lit(1), F.length(_c(s)) - F.length(tail) - len(d))).otherwise(_c(s))


def substring_after_last(s, d: str) -> C:
    return F.when(F.locate(d, _c(s)) > 0, F.substring_index(_c(s), d, -1)).when(_c(s).isNotNull(), F.lit(""))


def substring_between(s, a: str, b: str) -> C:
    """Null if either mark is absent."""
    import re

    found = F.regexp_extract_all(_c(s), F.lit(f"(?s){re.escape(a)}(.*?){re.escape(b)}"), F.lit(1))
    return F.get(found, F.lit(0))


def substrings_between(s, a: str, b: str) -> C:
    import re

    return F.regexp_extract_all(_c(s), F.lit(f"(?s){re.escape(a)}(.*?){re.escape(b)}"), F.lit(1))


def mid(s, at: int, n: int) -> C:
    return F.substring(_c(s), at + 1, n)


def split_first(s, d: str) -> C:
    """[before, after] of the first delimiter; null if absent."""
    return F.when(F.locate(d, _c(s)) > 0, F.array(substring_before(s, d), substring_after(s, d)))


def truncate(s, n: int, suffix: str = "") -> C:
    return F.when(F.length(_c(s)) > n, F.concat(F.left(_c(s), F.lit(n)), F.lit(suffix))).otherwise(_c(s))


def trim_whitespace(s) -> C:
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def trim_all_whitespace(s) -> C:
    return F.regexp_replace(_c(s), r"\s+", "")


def trim_character(s, c: str) -> C:
    import re

    return F.regexp_replace(_c(s), f"^(?:{re.escape(c)})+|(?:{re.escape(c)})+$", "")


def starts_with_ignore_case(s, p: str) -> C:
    return F.coalesce(F.lower(_c(s)).startswith(p.lower()), F.lit(False))


def ends_with_ignore_case(s, p: str) -> C:
    return F.coalesce(F.lower(_c(s)).endswith(p.lower()), F.lit(False))


def join(separator: str, *s) -> C:
    return F.concat_ws(separator, *map(_c, s))


def to_camel(s, separator: str = "_") -> C:
    parts = delimited_to_array(F.lower(_c(s)), separator)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(upper_first(x))), "")


def camel_to(s, separator: str = "_") -> C:
    return F.lower(F.regexp_replace(_c(s), r"(?<!^)([A-Z])", f"{separator}$1"))


def escape_html(s) -> C:
    out = _c(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_html(s) -> C:
    """All named and numbered references, in Arrow batches."""
    import html

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(html.unescape, na_action="ignore")

    return run(_c(s))


def contains_element_ignore_case(a, k: str) -> C:
    return F.exists(_c(a), lambda x: F.lower(x) == k.lower())


def to_unicode_escapes(s) -> C:
    r"""\uXXXX for each code point of the basic plane."""
    each = F.transform(F.split(_c(s), ""), lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.encode(x, "UTF-16BE")), 4, "0"))))
    return F.array_join(each, "")


def fix_latin1(s) -> C:
    """Text that was read as Latin-1 though it was UTF-8."""
    return F.decode(F.encode(_c(s), "ISO-8859-1"), "UTF-8")


# --- tests and defaults


def is_not_empty(s) -> C:
    return ~is_empty(s)


has_length = is_not_empty


def any_empty(*s) -> C:
    return reduce(lambda a, b: a | b, map(is_empty, s))


def none_empty(*s) -> C:
    return ~any_empty(*s)


def all_empty(*s) -> C:
    return reduce(lambda a, b: a & b, map(is_empty, s))


def none_blank(*s) -> C:
    return ~any_blank(*s)


def is_space(s) -> C:
    """White space alone, or nothing; null isn't."""
    return F.coalesce(_c(s).rlike(r"^\s*$"), F.lit(False))


def contains(s, sub) -> C:
    return F.coalesce(F.contains(_c(s), _l(sub)), F.lit(False))


def equals(a, b) -> C:
    """Nulls are equal to each other."""
    return _c(a).eqNullSafe(_c(b))


def default_string(s, other="") -> C:
    return F.coalesce(_c(s), _l(other))


def null_to_empty(s) -> C:
    return F.coalesce(_c(s), F.lit(""))


# --- parts


def left(s, n: int) -> C:
    return F.left(_c(s), F.lit(max(n, 0)))


def right(s, n: int) -> C:
    return F.right(_c(s), F.lit(max(n, 0)))


def reverse(s) -> C:
    return F.reverse(_c(s))


def repeat(s, n: int, separator: str = "") -> C:
    return F.when(_c(s).isNotNull(), F.array_join(F.array_repeat(_c(s), n), separator)) if separator else F.repeat(_c(s), F.lit(n))


def replace(s, old: str, new: str) -> C:
    return F.replace(_c(s), F.lit(old), F.lit(new)) if old else _c(s)


def trim_suffix(s, c: str) -> C:
    return F.regexp_replace(_c(s), f"(?:{_quote(c)})+$", "")


def trim_prefix(s, c: str) -> C:
    return F.regexp_replace(_c(s), f"^(?:{_quote(c)})+", "")


def _quote(c: str) -> str:
    return "\\Q" + c.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def clean_value(s, prefix: str = '"', suffix: str | None = None) -> C:
    """Without one quote (or another mark) in front and one behind."""
    suffix = prefix if suffix is None else suffix
    s = _c(s)
    s = F.when(F.startswith(s, F.lit(prefix)), F.substring(s, F.lit(len(prefix) + 1), F.length(s))).otherwise(s)
    return F.when(F.endswith(s, F.lit(suffix)), F.substring(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s)


def sort_array(a) -> C:
    return F.array_sort(_c(a))


def to_string_array(a) -> C:
    return _c(a).cast("array<string>")


# --- amounts, paths


def remove_amount_point(s) -> C:
    """A decimal as text, rounded half up to a whole number by its first digit behind the point; null: empty."""
    s = _c(s)
    whole = F.substring_index(s, ".", 1).try_cast("int")
    up = F.coalesce((F.length(s) - F.instr(s, ".") >= 2) & (F.substring(s, F.instr(s, ".") + 1, F.lit(1)).try_cast("int") >= 5), F.lit(False))
    return F.when(s.isNull(), "").when(F.instr(s, ".") == 0, s).otherwise((whole + up.cast("int")).cast("string"))


def format_amount(x, pattern: str = "¥,##0.00") -> C:
    """A number by a decimal pattern: text before the first # or 0, a comma for groups of three, places behind the point. Null counts as 0."""
    head = re.match(r"[^#0,]*", pattern)[0]
    body = pattern[len(head) :]
    tail = re.search(r"[^#0,.]*$", body)[0]
    places = len(body.split(".")[1]) - len(tail) if "." in body else 0
    least = body.split(".")[1][:places].count("0") if "." in body else 0
    n = F.coalesce(_c(x).try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))
    text = F.format_number(n, places)
    text = text if "," in body else F.replace(text, F.lit(","), F.lit(""))
    if places > least:  # optional places go if they are zero
        text = F.regexp_replace(text, rf"0{{1,{places - least}}}$", "")
        text = F.regexp_replace(text, r"\.$", "")
    sign = F.when(n < 0, "-").otherwise("")
    return F.concat(sign, F.lit(head), F.regexp_replace(text, "^-", ""), F.lit(tail))


def clean_path(s) -> C:
    """Slashes for backslashes, without "." and with ".." taken back; leading ".." of a relative path stay."""
    s = F.replace(_c(s), F.lit("\\"), F.lit("/"))
    root = F.startswith(s, F.lit("/"))
    parts = F.filter(F.split(s, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    back = F.aggregate(
        parts, none,
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & root, acc).otherwise(F.array_append(acc, p)),
    )
    end = F.when(F.endswith(s, F.lit("/")) & (F.size(back) > 0), "/").otherwise("")
    return F.concat(F.when(root, "/").otherwise(""), F.array_join(back, "/"), end)


def path_equals(a, b) -> C:
    return clean_path(a) == clean_path(b)


def mapping_path(*parts) -> C:
    """/a/b/ of pieces: a slash in front, behind and between, none twice; empty pieces are skipped."""
    return F.regexp_replace(F.replace(F.concat(F.lit("/"), F.concat_ws("/", *map(_c, parts)), F.lit("/")), F.lit("\\"), F.lit("/")), "/+", "/")


# --- templates


def lenient_format(template, *args) -> C:
    """%s in turn becomes the arguments (null: null); more arguments stand behind, in brackets."""
    parts = F.split(F.coalesce(_c(template), F.lit("null")), "%s")
    values = F.array(*[F.coalesce(_c(a).cast("string"), F.lit("null")) for a in args]) if args else F.array().cast("array<string>")
    n = F.least(F.size(parts) - 1, F.size(values))
    pieces = F.transform(parts, lambda p, i: F.when(i == 0, p).when(i <= n, F.concat(F.get(values, i - 1), p)).otherwise(F.concat(F.lit("%s"), p)))
    rest = F.slice(values, n + 1, F.size(values))
    return F.concat(F.array_join(pieces, ""), F.when(F.size(rest) > 0, F.concat(F.lit(" ["), F.array_join(rest, ", "), F.lit("]"))).otherwise(""))


def replace_placeholder(s, placeholder: str, *args) -> C:
    """The placeholder in turn becomes the arguments; those that are left over stay."""
    if not placeholder or not args:
        return _c(s)
    parts = F.split(_c(s), _quote(placeholder))
    values = F.array(*[F.coalesce(_c(a).cast("string"), F.lit("null")) for a in args])
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(i <= len(args), F.concat(F.get(values, i - 1), p)).otherwise(F.concat(F.lit(placeholder), p))), "")


def replace_variables(s, values: dict[str, C], pattern: str = r"[$][{]([ ]*[0-9a-zA-Z_.$]+[ ]*)[}]", if_absent: str | None = "null") -> C:
    """${name} becomes the value of that name. Names without a value, and null values, become if_absent; None: they stay as they are.

    The text is cut at the matches, and each is looked up in a map of the values: built-ins alone.
    """
    known = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[_c(v).cast("string") for v in values.values()])) if values else F.create_map().cast("map<string,string>")
    whole = F.regexp_extract_all(_c(s), F.lit(f"({pattern})"), F.lit(1))
    names = F.regexp_extract_all(_c(s), F.lit(f"({pattern})"), F.lit(2))
    rest = F.split(_c(s), pattern, -1)
    found = F.zip_with(whole, names, lambda w, n: F.coalesce(F.element_at(known, F.trim(n)), F.lit(if_absent) if if_absent is not None else w))
    return F.array_join(F.zip_with(rest, F.array_append(found, F.lit("")), lambda a, b: F.concat(a, b)), "")


def from_unicode_escapes(s) -> C:
    r"""\uXXXX becomes its character; all else stays."""
    s = F.regexp_replace(_c(s), r"\\(?!u[0-9a-fA-F]{4})", r"\\\\")
    s = F.replace(s, F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(name))
    return F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), F.lit(0))

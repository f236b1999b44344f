"""The row-level rule language, compiled to a Column.

Precedence, tightest first: ! and unary -, **, * / %, + -, << >>, > < >= <=, == !=, &, ^, |, then && || in out together and
left-associative, then ??, then ?:. Whole numbers divide whole; + joins text if a side is text; == treats two nulls as equal;
membership with a null is false; a condition that is null counts as false. Variables: a.b[0]. Functions: @name(x).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\s*(?:(\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(@?[A-Za-z_][\w.]*)|(\*\*|\?\?|&&|\|\||==|!=|>=|<=|<<|>>|[-+*/%<>!&^|?:()\[\]{},∈∉=]))")
LEVELS = [{"&&", "||", "in", "out", "∈", "∉"}, {"|"}, {"^"}, {"&"}, {"==", "!="}, {">", "<", ">=", "<="}, {"<<", ">>"}, {"+", "-"}, {"*", "/", "%"}, {"**"}]


def _bool(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "toArray": lambda *a: F.array(*a), "max": lambda *a: F.greatest(*a) if len(a) > 1 else a[0] if a else F.lit(0), "min": lambda *a: F.least(*a) if len(a) > 1 else a[0] if a else F.lit(0),
    "sum": lambda *a: sum(a, F.lit(0)), "avg": lambda *a: sum(a, F.lit(0)) / F.lit(float(len(a))) if a else F.lit(0.0), "abs": lambda a: F.abs(a.cast("double")), "sqrt": lambda a: F.sqrt(a),
    "length": lambda a: F.coalesce(F.length(a), F.lit(0)), "lower": F.lower, "upper": F.upper, "size": lambda a: F.coalesce(F.size(a), F.lit(0)), "ifNull": lambda a, b: F.coalesce(a, b), "isNull": lambda a: a.isNull(), "isNotNull": lambda a: a.isNotNull(),
    "now": lambda: F.current_timestamp(), "date": lambda a: F.to_date(a), "date_format": lambda a, b: F.date_format(a, b._lit if hasattr(b, "_lit") else "yyyy-MM-dd HH:mm:ss"), "toString": lambda a: F.coalesce(a.cast("string"), F.lit("null")),
    "BigDecimal": lambda a: a.cast("decimal(38,18)"), "BigInteger": lambda a: a.cast("decimal(38,0)"),
}


def register(name: str, f: Callable[..., Column]) -> None:
    FUNCTIONS[name] = f


class _Compiler:
    def __init__(self, text: str, df: DataFrame, strict: bool):
        self.df, self.strict, self.text = df, strict, text
        self.toks, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:at + 10]!r} at {at}")
            self.toks.append(next((k, v) for k, v in zip(("number", "string", "name", "op"), m.groups(), strict=True) if v is not None))
            at = m.end()
        self.i = 0

    def peek(self) -> str:
        return self.toks[self.i][1] if self.i < len(self.toks) else ""

    def eat(self, text: str) -> bool:
        if self.i < len(self.toks) and self.toks[self.i][1] == text and self.toks[self.i][0] != "string":
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            raise ValueError(f"expected {text} in {self.text!r}, found {self.peek()!r}")

    def type(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema[0].dataType  # analysis only

    def ternary(self) -> Column:
        c = self.coalesce()
        if self.eat("?"):
            a = self.ternary()
            self.need(":")
            return F.when(_bool(c), a).otherwise(self.ternary())
        return c

    def coalesce(self) -> Column:
        c = self.binary(0)
        while self.eat("??"):
            c = F.coalesce(c, self.binary(0))
        return c

    def binary(self, level: int) -> Column:
        if level == len(LEVELS):
            return self.unary()
        c = self.binary(level + 1)
        while self.peek() in LEVELS[level] and self.toks[self.i][0] != "string":
            op = self.peek()
            self.i += 1
            c = self.apply(op, c, self.binary(level + 1))
        return c

    def apply(self, op: str, a: Column, b: Column) -> Column:
        if op in ("&&", "||"):
            return _bool(a) & _bool(b) if op == "&&" else _bool(a) | _bool(b)
        if op in ("in", "∈", "out", "∉"):
            found = F.coalesce(F.array_contains(F.transform(b, lambda x: x.cast("string")), a.cast("string")), F.lit(False))
            return found if op in ("in", "∈") else (a.isNotNull() & b.isNotNull() & ~found)
        if op == "**":
            return F.pow(a, b)
        if op in ("<<", ">>", "&", "|", "^"):
            if op in ("<<", ">>"):
                return F.call_function("shiftleft" if op == "<<" else "shiftright", a, b.cast("int"))
            return {"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[op](b)
        if op in ("==", "!="):
            ta, tb = self.type(a), self.type(b)
            if isinstance(ta, T.NumericType) and isinstance(tb, T.NumericType):
                a, b = a.cast("double"), b.cast("double")
            elif type(ta) is not type(tb) and not isinstance(ta, T.NullType) and not isinstance(tb, T.NullType):
                return F.lit(op == "!=")
            return a.eqNullSafe(b) if op == "==" else ~a.eqNullSafe(b)
        if op in ("<", ">", "<=", ">="):
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        ta, tb = self.type(a), self.type(b)
        if op == "+" and (isinstance(ta, T.StringType) or isinstance(tb, T.StringType)):
            return F.concat(F.coalesce(a.cast("string"), F.lit("null")), F.coalesce(b.cast("string"), F.lit("null")))
        if op == "/":
            whole = isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType)
            return F.call_function("div", a, b) if whole else F.try_divide(a.cast("double") if not isinstance(ta, T.DecimalType) else a, b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: F.try_mod(a, b)}[op]()

    def unary(self) -> Column:
        if self.eat("!"):
            return ~_bool(self.unary())
        if self.eat("-"):
            return -self.unary()
        return self.primary()

    def listed(self, close: str) -> list[Column]:
        out = []
        while not self.eat(close):
            out.append(self.ternary())
            self.eat(",")
        return out

    def primary(self) -> Column:
        if self.i >= len(self.toks):
            raise ValueError(f"{self.text!r} ends too early")
        kind, text = self.toks[self.i]
        self.i += 1
        if kind == "number":
            return F.lit(float(text) if re.search("[.eE]", text) else int(text)) if "." in text or abs(int(text)) > 2**31 - 1 else F.lit(int(text)).cast("long")
        if kind == "string":
            body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
            out = F.lit(body)
            out._lit = body
            return out
        if text == "(":
            c = self.ternary()
            self.need(")")
            return c
        if text in ("[", "{"):
            items = self.listed("]" if text == "[" else "}")
            return F.array(*items)
        if kind != "name":
            raise ValueError(f"unexpected {text!r} in {self.text!r}")
        if text.startswith("@"):
            name = text[1:].split(".")[-1]
            if name not in FUNCTIONS:
                raise ValueError(f"unknown function {text}")
            self.need("(")
            return FUNCTIONS[name](*self.listed(")"))
        if text in ("true", "false"):
            return F.lit(text == "true")
        if text == "null":
            return F.lit(None)
        c = F.col(text)
        if self.strict:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"variable {text} is null"))).otherwise(c)
        while self.eat("["):
            c = F.get(c, self.ternary().cast("int"))
            self.need("]")
        return c


def compile_expression(text: str, df: DataFrame, strict: bool = False) -> Column:
    """strict: a null variable is an error."""
    c = _Compiler(text, df, strict)
    out = c.ternary()
    if c.i != len(c.toks):
        raise ValueError(f"unexpected {c.peek()!r} in {text!r}")
    return out


def compute(df: DataFrame, variables: dict[str, str]) -> DataFrame:
    """Computed variables in order; later ones may use earlier ones."""
    for name, text in variables.items():
        df = df.withColumn(name, compile_expression(text, df))
    return df


def render_template(template: str, df: DataFrame, prefix: str = "${", suffix: str = "}") -> Column:
    parts: list[Column] = []
    rest = template
    while (at := rest.find(prefix)) >= 0:
        end = rest.index(suffix, at)
        parts += [F.lit(rest[:at]), F.coalesce(compile_expression(rest[at + len(prefix) : end], df).cast("string"), F.lit("null"))]
        rest = rest[end + len(suffix) :]
    return F.concat(*parts, F.lit(rest))

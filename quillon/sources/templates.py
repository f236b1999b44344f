"""JSON templates and JSON Schemas as row generators, and the check of data against a template.

A template is JSON whose keys may carry a rule, "name|rule", and whose texts may hold placeholders, "@name(arguments)":

* text: "min-max" or "count" repeats it; * number: "min-max" draws one, "min-max.dmin-dmax" with places, "+step" goes up from row to row;
* boolean: "1" draws it evenly, "min-max" takes its own value with the chance min in min + max; * object: "count" or "min-max" keeps so many of its keys;
* array: "1" takes one item, "+1" takes them in turn, "count" or "min-max" repeats the items; * a text "/…/" is a pattern that the value matches.

The template is compiled once, on the driver, to one Column over a row's key, so rows are made where they are used, and are the same for
any partitioning. Values that must share a column's type but don't (the arms of a choice, items of different shapes) become text.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import EXTRA, Draw, call, placeholders

RULE = re.compile(r"^(.*?)\|(?:\+(?P<step>\d+)|(?P<lo>-?\d+)(?:-(?P<hi>-?\d+))?(?:\.(?P<dlo>\d+)(?:-(?P<dhi>\d+))?)?)$", re.S)
PLACE = re.compile(r"\\?@(\w+)(?:\(((?:[^()'\"]|'[^']*'|\"[^\"]*\"|\([^()]*\))*)\))?")


def normalize_quotes(text: str) -> str:
    """JSON of a template in loose form: single quotes, bare keys, ending commas and comments become what JSON asks for."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c in "\"'":
            j, piece = i + 1, []
            while j < len(text) and text[j] != c:
                if text[j] == "\\" and j + 1 < len(text):
                    piece.append(text[j + 1] if text[j + 1] == "'" else text[j : j + 2])
                    j += 2
                else:
                    piece.append('\\"' if text[j] == '"' else text[j])
                    j += 1
            out.append(f'"{"".join(piece)}"')
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif m := re.compile(r"[A-Za-z_$][\w$]*(?=\s*:)").match(text, i):
            out.append(f'"{m[0]}"')
            i = m.end()
        elif c == "," and re.compile(r"\s*[}\]]").match(text, i + 1):
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def read(template: str | Any) -> Any:
    if not isinstance(template, str):
        return template
    try:
        return json.loads(template)
    except ValueError:
        return json.loads(normalize_quotes(template))


def pretty(template: str | Any) -> str:
    return json.dumps(read(template), indent=2, ensure_ascii=False)


def parse_args(text: str | None) -> list[Any]:
    """The arguments of a placeholder: JSON values, and bare words as text."""
    if not text or not text.strip():
        return []
    parts, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(text + ","):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[({":
            depth += 1
        elif c in "])}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    out = []
    for p in parts:
        try:
            out.append(json.loads(p.replace("'", '"')))
        except ValueError:
            out.append(p.strip("'\""))
    return out


def split_rule(key: str) -> tuple[str, dict[str, int] | None]:
    m = RULE.match(key)
    if not m:
        return key, None
    return m[1], {k: int(v) for k, v in m.groupdict().items() if v is not None}


class Compiler:
    """A template to Columns."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def value(self, t: Any, rule: dict[str, int] | None, d: Draw, siblings: dict[str, Any]) -> Column:
        rule = rule or {}
        if isinstance(t, bool):
            if not rule:
                return F.lit(t)
            lo = rule.get("lo", 1)
            return d.bool(lo, rule.get("hi", lo), t)
        if isinstance(t, int | float):
            return self.number(t, rule, d)
        if isinstance(t, str):
            return self.text(t, rule, d, siblings)
        if t is None:
            return F.lit(None).cast("string")
        if isinstance(t, dict):
            return self.object(t, rule, d)
        return self.array(t, rule, d)

    def number(self, t: float, rule: dict[str, int], d: Draw) -> Column:
        if "step" in rule:
            return F.lit(t) + d.row * rule["step"]
        if not rule:
            return F.lit(t)
        lo, hi = rule["lo"], rule.get("hi", rule["lo"])
        whole = d.integer(lo, hi) if hi != lo else F.lit(lo).cast("long")
        if "dlo" in rule:
            dlo, dhi = rule["dlo"], rule.get("dhi", rule["dlo"])
            # Of the places drawn the last isn't 0, so that they count.
            size = d.integer(dlo, dhi)
            part = d._many(size, lambda e: e.character("123456789"))
            return F.concat(whole.cast("string"), F.lit("."), part).cast("double")
        return whole

    def text(self, t: str, rule: dict[str, int], d: Draw, siblings: dict[str, Any]) -> Column:
        if re.fullmatch(r"/.+/", t, re.S):
            one = d.below("r").regex(t[1:-1])
        else:
            one = self.filled(t, d, siblings)
        if "lo" not in rule:
            return one
        n = d.integer(rule["lo"], rule["hi"]) if "hi" in rule else F.lit(rule["lo"])
        if not PLACE.search(t) and not t.startswith("/"):
            return F.repeat(one.cast("string"), n.cast("int"))
        return d._many(n, lambda e: (e.regex(t[1:-1]) if t.startswith("/") else self.filled(t, e, siblings)).cast("string"))

    def filled(self, t: str, d: Draw, siblings: dict[str, Any]) -> Column:
        """A text with its placeholders; one that is a placeholder alone keeps its type. @name of a sibling key is that key's text."""
        known = {p.lower() for p in placeholders()}
        whole = PLACE.fullmatch(t)
        if whole and t[0] == "@" and whole[1].lower() in known:
            return call(d, whole[1], *parse_args(whole[2]))
        parts, at = [], 0
        for m in PLACE.finditer(t):
            if m[0][0] == "\\":
                parts.append(F.lit(t[at : m.start()] + m[0][1:]))
            elif m[1].lower() in known and m[1] not in siblings:
                parts += [F.lit(t[at : m.start()]), call(d, m[1], *parse_args(m[2])).cast("string")]
            elif m[1] in siblings and m[2] is None:
                parts += [F.lit(t[at : m.start()]), siblings[m[1]].cast("string")]
            else:
                parts.append(F.lit(t[at : m.end()]))
            at = m.end()
        parts.append(F.lit(t[at:]))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def fields(self, t: dict[str, Any], d: Draw) -> dict[str, Column]:
        done: dict[str, Column] = {}
        for key, v in t.items():
            name, rule = split_rule(key)
            done[name] = self.value(v, rule, d.below(name), done)
        return done

    def object(self, t: dict[str, Any], rule: dict[str, int], d: Draw) -> Column:
        done = self.fields(t, d)
        if "lo" not in rule:
            return F.struct(*(v.alias(k) for k, v in done.items()))
        # So many keys, the first in an order by chance; the others are null and left out of JSON.
        n = d.integer(rule["lo"], rule["hi"]) if "hi" in rule else F.lit(rule["lo"])
        order = d.shuffle(*done)
        return F.struct(*(F.when(F.array_position(order, k) <= n, v).alias(k) for k, v in done.items()))

    def array(self, t: list[Any], rule: dict[str, int], d: Draw) -> Column:
        if not t:
            return F.array().cast("array<string>")
        if "step" in rule:
            items = [self.value(x, None, d.below(str(i)), {}) for i, x in enumerate(t)]
            return F.element_at(F.array(*self.alike(items)), (F.pmod(d.row * rule["step"], F.lit(len(t))) + 1).cast("int"))
        if rule.get("lo") == 1 and "hi" not in rule:
            items = [self.value(x, None, d.below(str(i)), {}) for i, x in enumerate(t)]
            return F.element_at(F.array(*self.alike(items)), (d.n(len(t)) + 1).cast("int"))
        if "lo" not in rule:
            return F.array(*self.alike([self.value(x, None, d.below(str(i)), {}) for i, x in enumerate(t)]))
        n = (d.integer(rule["lo"], rule["hi"]) if "hi" in rule else F.lit(rule["lo"]).cast("long")) * len(t)

        def one(i: Column) -> Column:
            e = d.below("each", F.xxhash64(d.key, i))
            items = self.alike([self.value(x, None, e.below(str(k)), {}) for k, x in enumerate(t)])
            return items[0] if len(items) == 1 else F.element_at(F.array(*items), (F.pmod(i - 1, F.lit(len(t))) + 1).cast("int"))

        every = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))), one)
        return F.when(n > 0, every).otherwise(F.slice(every, 1, 0))

    def alike(self, items: list[Column]) -> list[Column]:
        """The items if they have one type, else as texts (of objects: their JSON)."""
        if len(items) < 2:
            return items
        probe = self.spark.range(1).select(F.col("id").alias("__k"))
        try:
            kinds = [f.dataType.simpleString() for f in probe.select(*(c.alias(f"x{i}") for i, c in enumerate(items))).schema]
        except AnalysisException:  # inside a function of an array's item, whose variable the probe doesn't have
            return [c.cast("string") for c in items]
        if len(set(kinds)) <= 1:
            return items
        if all(k in ("int", "bigint", "double", "decimal") for k in kinds):
            return [c.cast("double") for c in items]
        return [F.to_json(c) if k.startswith(("struct", "array")) else c.cast("string") for c, k in zip(items, kinds, strict=True)]


def mock(spark: SparkSession, template: str | Any, n: int = 1, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """n rows of a template whose top is an object; its keys are the columns. A top array is one column, `value`."""
    t = read(template)
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    rows = rows.withColumnRenamed("id", "__k")
    d, compiler = Draw(F.col("__k"), seed), Compiler(spark)
    if isinstance(t, dict):
        name = None
        if len(t) == 1:
            key, rule = split_rule(next(iter(t)))
            name = key if rule is not None and isinstance(next(iter(t.values())), list) and key in ("", "root") else None
        if name is None:
            return rows.select(*(v.alias(k) for k, v in compiler.fields(t, d).items()))
        t = next(iter(t.values()))
    return rows.select(compiler.value(t, None, d, {}).alias("value"))


def mock_json(spark: SparkSession, template: str | Any, n: int = 1, seed: int = 1) -> DataFrame:
    """One JSON text a row; keys without a value are left out."""
    rows = mock(spark, template, n, seed)
    value = F.col("value") if rows.columns == ["value"] and not isinstance(read(template), dict) else F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(F.to_json(value).alias("json"))


# --- JSON Schema --------------------------------------------------------------------------------------------------

FORMATS = {
    "email": lambda d: d.email(), "uri": lambda d: d.url("https"), "url": lambda d: d.url("https"), "uuid": lambda d: d.uuid(), "date": lambda d: d.date(), "time": lambda d: d.time(), "date-time": lambda d: d.datetime("yyyy-MM-dd'T'HH:mm:ss'Z'"),
    "ipv4": lambda d: d.ip(), "hostname": lambda d: d.domain(), "phone": lambda d: d.phone(), "color": lambda d: d.hex(),
}


def schema_value(spec: dict[str, Any], d: Draw, compiler: Compiler) -> Column:
    if "const" in spec:
        return F.lit(spec["const"])
    if "enum" in spec:
        return d.pick(spec["enum"])
    for key in ("oneOf", "anyOf"):
        if key in spec:
            arms = compiler.alike([schema_value(x, d.below(f"{key}{i}"), compiler) for i, x in enumerate(spec[key])])
            return F.element_at(F.array(*arms), (d.n(len(arms)) + 1).cast("int"))
    if "allOf" in spec:
        merged: dict[str, Any] = {}
        for x in spec["allOf"]:
            for k, v in x.items():
                merged[k] = {**merged.get(k, {}), **v} if isinstance(v, dict) else v
        return schema_value(merged, d, compiler)
    kind = spec.get("type", "object" if "properties" in spec else "string")
    kind = next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind
    match kind:
        case "object":
            return F.struct(*(schema_value(v, d.below(k), compiler).alias(k) for k, v in spec.get("properties", {}).items()))
        case "array":
            lo = spec.get("minItems", 1)
            n = d.integer(lo, spec.get("maxItems", lo + 4))
            items = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))), lambda i: schema_value(spec.get("items", {}), d.below("item", F.xxhash64(d.key, i)), compiler))
            return F.when(n > 0, items).otherwise(F.slice(items, 1, 0))
        case "integer":
            step = spec.get("multipleOf", 1)
            lo, hi = spec.get("minimum", spec.get("exclusiveMinimum", -1) + 1), spec.get("maximum", spec.get("exclusiveMaximum", 1001) - 1)
            return d.integer(-(-lo // step), hi // step) * step
        case "number":
            return d.float(spec.get("minimum", 0), spec.get("maximum", 1000), 2)
        case "boolean":
            return d.bool()
        case "null":
            return F.lit(None).cast("string")
    if "pattern" in spec:
        return d.regex(spec["pattern"])
    if spec.get("format") in FORMATS:
        return FORMATS[spec["format"]](d)
    lo = spec.get("minLength", 3)
    return d.string("lower", lo, spec.get("maxLength", max(lo, 12)))


def mock_schema(spark: SparkSession, schema: str | dict[str, Any], n: int = 1, seed: int = 1) -> DataFrame:
    """n rows of a JSON Schema of an object."""
    spec, d = read(schema), Draw(F.col("__k"), seed)
    rows, compiler = spark.range(n).withColumnRenamed("id", "__k"), Compiler(spark)
    return rows.select(*(schema_value(v, d.below(k), compiler).alias(k) for k, v in spec.get("properties", {}).items()))


# --- checks -------------------------------------------------------------------------------------------------------


def to_json_schema(template: str | Any) -> dict[str, Any]:
    """What a template's values look like, as JSON Schema."""
    def of(t: Any, rule: dict[str, int] | None) -> dict[str, Any]:
        rule = rule or {}
        if isinstance(t, bool):
            return {"type": "boolean"}
        if isinstance(t, int | float):
            out: dict[str, Any] = {"type": "number" if "dlo" in rule or isinstance(t, float) else "integer"}
            if "lo" in rule and "dlo" not in rule:
                out |= {"minimum": rule["lo"], "maximum": rule.get("hi", rule["lo"])}
            elif "lo" in rule:
                out |= {"minimum": rule["lo"], "exclusiveMaximum": rule.get("hi", rule["lo"]) + 1}
            return out
        if isinstance(t, str):
            if re.fullmatch(r"/.+/", t, re.S):
                return {"type": "string", "pattern": t[1:-1]} if "lo" not in rule else {"type": "string"}
            if PLACE.search(t):
                m = PLACE.fullmatch(t)
                numeric = m is not None and m[1].lower() in ("integer", "int", "natural", "increment", "inc", "timestamp", "salary", "age")
                return {"type": "integer"} if numeric else {"type": "boolean"} if m is not None and m[1].lower() in ("bool", "boolean") else {"type": "number"} if m is not None and m[1].lower() in ("float", "price") else {} if m is not None and m[1] in ("pick", "shuffle", "range", *EXTRA) else {"type": "string"}
            return {"type": "string", "minLength": len(t) * rule["lo"], "maxLength": len(t) * rule.get("hi", rule["lo"])} if "lo" in rule else {"type": "string"}
        if isinstance(t, dict):
            names = {split_rule(k)[0]: of(v, split_rule(k)[1]) for k, v in t.items()}
            return {"type": "object", "properties": names} | ({} if "lo" in rule else {"required": list(names)})
        if isinstance(t, list):
            if "step" in rule or rule.get("lo") == 1 and "hi" not in rule:
                kinds = [of(x, None) for x in t]
                return kinds[0] if all(k == kinds[0] for k in kinds) else {"anyOf": kinds}
            kinds = [of(x, None) for x in t]
            items = kinds[0] if kinds and all(k == kinds[0] for k in kinds) else {"anyOf": kinds} if kinds else {}
            size = {"minItems": rule["lo"] * len(t), "maxItems": rule.get("hi", rule["lo"]) * len(t)} if "lo" in rule else {"minItems": len(t), "maxItems": len(t)}
            return {"type": "array", "items": items} | size
        return {"type": "null"}

    return of(read(template), None)


def problems(df: DataFrame, template: str | Any, json_col: str | None = None) -> DataFrame:
    """The input's columns and problems, an array of struct<path, problem>: where a row isn't as the template says.

    Rows are typed columns (their names are the template's keys), or JSON text in json_col. One projection of compiled tests; nothing is collected.
    """
    spec = to_json_schema(template)
    record = F.try_parse_json(F.col(json_col)) if json_col else F.to_variant_object(F.struct(*df.columns))
    found = [x for x in _tests(spec, record, "$")]
    listed = F.filter(F.flatten(F.array(*found)), lambda p: p.isNotNull()) if found else F.array().cast("array<struct<path:string,problem:string>>")
    return df.withColumn("problems", listed)


def _tests(spec: dict[str, Any], v: Column, path: str) -> list[Column]:
    """Columns of array<struct<path, problem>> for the rules on the value at v."""
    one = lambda test, text: F.when(test, F.array(F.struct(F.lit(path).alias("path"), F.lit(text).alias("problem")))).otherwise(F.array().cast("array<struct<path:string,problem:string>>"))
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    wanted = spec.get("type")
    classes = {"integer": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$", "string": r"^(STRING|DATE|TIMESTAMP.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$"}
    if wanted is None:
        return []
    bad = ~kind.rlike(classes[wanted])
    out = [one(bad, f"is not of type {wanted}")]
    number = F.try_variant_get(v, "$", "double")
    for key, sign in (("minimum", "<"), ("maximum", ">"), ("exclusiveMaximum", ">=")):
        if key in spec:
            test = {"<": number < spec[key], ">": number > spec[key], ">=": number >= spec[key]}[sign]
            out.append(one(F.coalesce(test, F.lit(False)), f"breaks {key} {spec[key]}"))
    if wanted == "string":
        s = F.try_variant_get(v, "$", "string")
        if "pattern" in spec:
            out.append(one(F.coalesce(~s.rlike(f"^(?:{spec['pattern'].removeprefix('^').removesuffix('$')})$"), F.lit(False)), "does not match the pattern"))
        for key, test in (("minLength", lambda n: F.length(s) < n), ("maxLength", lambda n: F.length(s) > n)):
            if key in spec:
                out.append(one(F.coalesce(test(spec[key]), F.lit(False)), f"breaks {key} {spec[key]}"))
    if wanted == "array":
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        for key, test in (("minItems", lambda n: F.size(items) < n), ("maxItems", lambda n: F.size(items) > n)):
            if key in spec:
                out.append(one(~bad & test(spec[key]), f"breaks {key} {spec[key]}"))
        below = spec.get("items", {})
        if below.get("type"):
            def each(m: Column) -> Column:
                return F.flatten(F.array(*_tests(below, m, path + "[]")))

            out.append(F.flatten(F.transform(items, each)))
    for name, below in spec.get("properties", {}).items():
        part = F.try_variant_get(v, f"$['{name}']" if not re.fullmatch(r"\w+", name) else f"$.{name}", "variant")
        if name in spec.get("required", ()) and below.get("type") != "null":
            absent = F.coalesce(F.schema_of_variant(part), F.lit("VOID")) == "VOID"
            out.append(F.when(~bad & absent, F.array(F.struct(F.lit(f"{path}.{name}").alias("path"), F.lit("is missing").alias("problem")))).otherwise(F.when(~bad, F.flatten(F.array(*_tests(below, part, f"{path}.{name}")))).otherwise(F.array().cast("array<struct<path:string,problem:string>>"))) if _tests(below, part, "") else F.array().cast("array<struct<path:string,problem:string>>"))
        elif _tests(below, part, ""):
            present = F.coalesce(F.schema_of_variant(part), F.lit("VOID")) != "VOID"
            out.append(F.when(present, F.flatten(F.array(*_tests(below, part, f"{path}.{name}")))).otherwise(F.array().cast("array<struct<path:string,problem:string>>")))
    return out

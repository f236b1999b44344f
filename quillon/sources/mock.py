"""Generated rows: spark.range and seeded expressions, the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import CITIES, DOMAINS, FIRST, LAST, WORDS, Draw, call

def draw(seed: int, salt: str, n: int, row: Column | None = None) -> Column:
    """A number from 0 to n - 1 for each row, by a hash of row, salt and seed."""
    return F.pmod(F.xxhash64(row if row is not None else F.col("__i"), F.lit(salt), F.lit(seed)), F.lit(n))


def pick(seed: int, salt: str, of) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), (draw(seed, salt, len(of)) + 1).cast("int"))


def field(kind: str, seed: int, salt: str, **o) -> Column:
    match kind:
        case "id" | "auto_increment":
            return F.col("__i") + o.get("start", 1)
        case "int" | "integer" | "long":
            lo, hi = o.get("min", 0), o.get("max", 1000)
            return draw(seed, salt, hi - lo + 1) + lo
        case "float" | "double" | "decimal":
            lo, hi, places = o.get("min", 0), o.get("max", 1000), o.get("places", 2)
            return ((draw(seed, salt, (hi - lo) * 10**places + 1) + lo * 10**places) / 10**places).cast("double")
        case "boolean":
            return draw(seed, salt, 1000) < int(1000 * o.get("share", 0.5))
        case "first_name":
            return pick(seed, salt, FIRST)
        case "last_name":
            return pick(seed, salt, LAST)
        case "name":
            return F.concat_ws(" ", pick(seed, salt + "f", FIRST), pick(seed, salt + "l", LAST))
        case "email":
            return F.concat(F.lower(pick(seed, salt + "f", FIRST)), F.lit("."), draw(seed, salt + "n", 10_000).cast("string"), F.lit("@"), pick(seed, salt + "d", DOMAINS))
        case "phone":
            return F.concat(F.lit("1"), F.lpad(draw(seed, salt, 10**10).cast("string"), 10, "0"))
        case "city":
            return pick(seed, salt, CITIES)
        case "word":
            return pick(seed, salt, WORDS)
        case "sentence":
            n = o.get("words", 8)
            return F.concat_ws(" ", *[pick(seed, f"{salt}{i}", WORDS) for i in range(n)])
        case "enum":
            return pick(seed, salt, o["values"])
        case "date":
            return F.date_add(F.lit(o.get("from", "2020-01-01")).cast("date"), draw(seed, salt, o.get("days", 1826)).cast("int"))
        case "datetime" | "timestamp":
            return F.timestamp_seconds(F.unix_timestamp(F.lit(o.get("from", "2020-01-01")).cast("timestamp")) + draw(seed, salt, o.get("seconds", 157_766_400)))
        case "uuid":
            h = F.md5(F.concat_ws("|", F.col("__i").cast("string"), F.lit(salt), F.lit(str(seed))))
            return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
        case "ip":
            return F.concat_ws(".", *[draw(seed, f"{salt}{i}", 254).cast("string") for i in range(4)])
        case "url":
            return F.concat(F.lit("https://"), pick(seed, salt + "w", WORDS), F.lit(".example.com/"), draw(seed, salt, 10_000).cast("string"))
        case "color":
            return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(draw(seed, salt, 1 << 24)), 6, "0")))
        case "pattern":
            return pattern(o["pattern"], seed, salt)
        case "constant":
            return F.lit(o["value"])
    return call(Draw(F.col("__i"), seed, salt), kind, *o.get("args", ()))  # any placeholder of templates


def pattern(text: str, seed: int, salt: str) -> Column:
    """A text that a regular expression matches."""
    return Draw(F.col("__i"), seed, salt).regex(text)


def generate(spark: SparkSession, n: int, fields: dict[str, dict], seed: int = 1, partitions: int | None = None) -> DataFrame:
    """fields: name -> {kind, nulls (share of nulls), and the kind's options}."""
    rows = spark.range(0, n, 1, partitions).withColumnRenamed("id", "__i") if partitions else spark.range(n).withColumnRenamed("id", "__i")
    cols = []
    for name, o in fields.items():
        o = dict(o)
        kind, nulls = o.pop("kind"), o.pop("nulls", 0)
        c = field(kind, seed, name, **o)
        if nulls:
            c = F.when(draw(seed, name + "?", 1000) >= int(1000 * nulls), c)
        cols.append(c.alias(name))
    return rows.select(*cols)


def violations(df: DataFrame, fields: dict[str, dict]) -> DataFrame:
    """rule, n: how many rows break what the fields say, in one pass."""
    tests: dict[str, Column] = {}
    for name, o in fields.items():
        c = F.col(name)
        if not o.get("nulls"):
            tests[f"{name}: null"] = c.isNull()
        if "min" in o:
            tests[f"{name}: below {o['min']}"] = c < o["min"]
        if "max" in o:
            tests[f"{name}: above {o['max']}"] = c > o["max"]
        if "values" in o:
            tests[f"{name}: value"] = ~c.isin(*o["values"])
        if "regex" in o:
            tests[f"{name}: form"] = ~c.rlike(o["regex"])
    counts = df.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in tests])
    return counts.select(F.inline(pairs))

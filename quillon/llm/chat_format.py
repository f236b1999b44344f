r"""Chat formatting: schema fingerprints select a declarative mapping of each layout to canonical turns; one template marks them.

Layouts. A record is a VARIANT: parsed from JSON text, or made of a typed row. Its fingerprint is the hash of the sorted nested field paths
that it has, of those that some layout names: fields beside them (ids, scores, sources) don't change it, and a null field counts as absent. Known fingerprints,
made on the driver of each layout's required paths and any of its optional ones, select a declarative mapping to ``array<struct<role, text>>``; an object or array where
a layout has text is a path of another kind and so another fingerprint. An empty array of messages gives empty turns. Records of
unknown layout get no turns (null), never a guess; they stay in the result.

Template. A turn is ``<|start|>role<|message|>text<|end|>``. Inside roles and texts a backslash is doubled and a control
string gets a backslash behind its first character, so no control string of this or other common templates survives, and one
pattern (a backslash and the character behind it) reads it back. Null roles and texts are empty. A conversation without turns formats
to the empty string. Rows of one turn number keep the order of (role, text); repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_names, read

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
# Control strings of common chat templates. The pair "<|" covers the own markers and those like them.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]", "<start_of_turn>", "<end_of_turn>")

TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


# --- layouts -----------------------------------------------------------------------------------------------------


def _text(path: str) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))


def _pair(*said: tuple[str, str]) -> Callable[[Column], Column]:
    """Turns of fixed roles from single fields; empty fields that are marked ? give no turn."""

    def turns(v: Column) -> Column:
        each = []
        for role, path in said:
            text = _text(path.rstrip("?"))(v)
            turn = F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
            each.append(F.when(text != "", turn).otherwise(F.array().cast(TURNS)) if path.endswith("?") else turn)
        return F.concat(*each).cast(TURNS)

    return turns


def _messages(field: str, role: str, *texts: str, roles: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Turns of an array of objects; the first of `texts` that is there is the text."""

    def turns(v: Column) -> Column:
        kind = f"array<struct<`{role}`:string,{','.join(f'`{t}`:string' for t in texts)}>>"
        said = lambda m: F.coalesce(m[role], F.lit(""))
        name = lambda m: reduce(lambda c, k: c.when(F.lower(said(m)) == k, F.lit(roles[k])), list(roles)[1:], F.when(F.lower(said(m)) == next(iter(roles)), F.lit(roles[next(iter(roles))]))).otherwise(said(m)) if roles else said(m)
        return F.transform(F.try_variant_get(v, f"$.{field}", kind), lambda m: F.struct(name(m).alias("role"), F.coalesce(*(m[t] for t in texts), F.lit("")).alias("text"))).cast(TURNS)

    return turns


#: What "from" fields call the two sides.
SIDES = {"human": "user", "prompter": "user", "user": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "assistant": "assistant", "system": "system"}


@dataclass(frozen=True)
class Layout:
    """Required and optional field paths ([] for the items of an array), and how to get turns from a record that has them."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    mapping: Callable[[Column], Column]

    def fingerprints(self) -> list[str]:
        return [fingerprint_of([*self.required, *some]) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]


LAYOUTS = (
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content", "messages[].text"), _messages("messages", "role", "content", "text")),
    Layout("conversations", ("conversations[]",), ("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value", roles=SIDES)),
    Layout("instruction", ("instruction", "output"), ("input", "system"), _pair(("system", "system?"), ("user", "instruction"), ("user", "input?"), ("assistant", "output"))),
    Layout("completion", ("prompt", "completion"), ("system",), _pair(("system", "system?"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("prompt", "response"), ("system",), _pair(("system", "system?"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("question", "answer"), ("system",), _pair(("system", "system?"), ("user", "question"), ("assistant", "answer"))),
)


def fingerprint_of(field_paths: Sequence[str]) -> str:
    """The same hash as fingerprint() gives for a record with these paths."""
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


def known_paths(layouts: Sequence[Layout]) -> list[str]:
    return sorted({p for x in layouts for p in (*x.required, *x.optional)})


def paths(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """The sorted paths of a record (a variant) among those of the layouts. Text where an array is known, or an object or array where text is, is
    the path with a mark that no layout has."""

    def kind(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))

    found = []
    names = known_paths(layouts)
    for p in (p for p in names if "[]." not in p):
        value = F.try_variant_get(record, f"$.{p.removesuffix('[]')}", "variant")
        k = kind(value)
        if p.endswith("[]"):
            found.append(F.when(k == "VOID", F.array()).when(k.startswith("ARRAY"), F.array(F.lit(p))).otherwise(F.array(F.lit(p + "?"))))
            items = F.coalesce(F.try_variant_get(record, f"$.{p.removesuffix('[]')}", "array<variant>"), F.array().cast("array<variant>"))
            for below in (q.removeprefix(p + ".") for q in names if q.startswith(p + ".")):
                kinds = F.transform(items, _below(below, kind))
                has = F.exists(kinds, lambda x: x != "VOID")
                odd = F.exists(kinds, lambda x: x.startswith("ARRAY") | x.startswith("OBJECT"))
                found.append(F.when(odd, F.array(F.lit(f"{p}.{below}?"))).when(has, F.array(F.lit(f"{p}.{below}"))).otherwise(F.array()))
            # Items that aren't objects, or have none of the known fields, hold something else.
            strange = F.exists(items, lambda m: ~kind(m).startswith("OBJECT"))
            found.append(F.when(strange, F.array(F.lit(p + "*"))).otherwise(F.array()))
        else:
            found.append(F.when(k == "VOID", F.array()).when(k.startswith("ARRAY") | k.startswith("OBJECT"), F.array(F.lit(p + "?"))).otherwise(F.array(F.lit(p))))
    return F.array_sort(F.concat(*(x.cast("array<string>") for x in found)))


def _below(path: str, kind: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: kind(F.try_variant_get(m, f"$.{path}", "variant"))


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """The hash of a record's paths; null for no record."""
    return F.when(record.isNotNull(), F.substring(F.sha2(F.array_join(paths(record, layouts), "\n"), 256), 1, 16))


def canonical(df: DataFrame, record_col: str, out_col: str = "turns", layout_col: str | None = None, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """The input's columns and out_col: the turns of each record (a variant, or JSON text), null for an unknown layout or no record.

    layout_col: also the name of the layout. Columns of the input with these names are replaced.
    """
    plain, back = plain_names(df)
    at = plain.columns[df.columns.index(record_col)]
    record = F.try_parse_json(F.col(at)) if dict(plain.dtypes)[at] == "string" else F.col(at)
    known = F.create_map(*(F.lit(x) for layout in layouts for f in layout.fingerprints() for x in (f, layout.name)))
    # The fingerprint is taken once, in a projection of its own: its uses below are many.
    rows = plain.withColumn("record", record).withColumn("mark", fingerprint(F.col("record"), layouts))
    rows = rows.withColumn("layout", F.element_at(known, F.coalesce("mark", F.lit(""))))
    turns = F.when(F.lit(False), F.lit(None).cast(TURNS))
    for layout in layouts:
        turns = turns.when(F.col("layout") == layout.name, layout.mapping(F.col("record")))
    made = {out_col: turns} | ({layout_col: F.col("layout")} if layout_col else {})
    gone = {c.lower() for c in made}
    return rows.select(*(c for c, old in zip(back, df.columns, strict=True) if old.lower() not in gone), *(v.alias(k) for k, v in made.items()))


def as_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, record: one variant for each conversation of a table with a row for each turn, in the plainest layout that holds it.

    A question and its answer are prompt and response, with a system text of its own if one comes first; all else is messages. A
    conversation is one record by definition, so its rows meet in one task; the other keys are spread by hash.
    """
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("said"))
    roles = F.array_join(F.transform("said", lambda t: t["role"]), "\n")
    text = lambda i: F.get("said", F.lit(i))["content"]
    pair = F.to_variant_object(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    led = F.to_variant_object(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")))
    listed = F.to_variant_object(F.struct(F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")))
    record = F.when(roles == "user\nassistant", pair).when((roles == "system\nuser\nassistant") & (text(0) != ""), led).otherwise(listed)
    return grouped.select("id", record.alias("record"))


# --- template ----------------------------------------------------------------------------------------------------


def format_turns(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MESSAGE), escape(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted string: array<struct<role, text, at, escaped>>; at: code points before the escaped text."""
    literal = lambda s: s.replace("|", "\\|")
    parts = F.filter(F.split(formatted, literal(START)), lambda x, i: i > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, MESSAGE, 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, MESSAGE) + len(MESSAGE), F.length(p) - F.instr(p, MESSAGE) - len(MESSAGE) + 1 - len(END))).alias("text"),
        ),
    )


def loss_spans(turns: Column) -> Column:
    """array<struct<start, length>>, in code points of the formatted string: the escaped assistant texts."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    sizes = F.transform(turns, lambda t: F.struct(F.length(escape(t["role"])).alias("r"), F.length(escape(t["text"])).alias("t"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("a")))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(START) + t["r"] + len(MESSAGE)
        span = F.array(F.struct(start.cast("long").alias("start"), t["t"].cast("long").alias("length")))
        return F.struct((start + t["t"] + len(END)).cast("long").alias("at"), F.when(t["a"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["spans"])


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, formatted, loss_spans: one row for each conversation of a table with a row for each turn; each record's fingerprint selects its mapping."""
    said = canonical(as_records(rows, id_col, turn_col, role_col, text_col), "record")
    return said.select("id", format_turns(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = format_chats(rows.unionByName(probe))
    back = done.withColumn("turns", read_turns(F.col("formatted")))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    back = back.withColumns({
        "said": F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
        "loss": masked,
    })
    return back.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )

"""Functions of one's own, rows of CSV, event streams, seeded values, templates."""

import re
from dataclasses import dataclass

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.functions import ids, numbers, random, strings, udfs
from quillon.operators import patterns
from quillon.sources import files, templates
from quillon.streaming import messages


def test_functions_of_ones_own(spark):
    udfs.scalar(spark, "twice_q", lambda x: x * 2, "long")
    udfs.aggregate(spark, "span_q", lambda v: float(v.max() - v.min()), "double")

    class Letters:
        def eval(self, text: str):
            for i, c in enumerate(text):
                yield i, c

    udfs.table(spark, "letters_q", Letters, "i int, c string")
    e = Engine(spark)
    e.add("u_t", spark.createDataFrame([(1, 5), (1, 9), (2, 4)], "k long, v long"))
    assert sorted(map(tuple, e.sql("SELECT k, span_q(twice_q(v)) AS s FROM u_t GROUP BY k", "mysql").collect())) == [(1, 8.0), (2, 0.0)]
    assert [tuple(r) for r in e.sql("SELECT c, i FROM letters_q('ab') ORDER BY i", "spark").collect()] == [("a", 0), ("b", 1)]


def test_rows_of_csv(spark):
    @dataclass
    class User:
        user_name: str
        age: int
        mail: str | None

    df = spark.createDataFrame([("ann", "7", "x"), ("bob", "no", None)], "userName string, AGE string, other string")
    assert [tuple(r) for r in files.as_entities(df, User).collect()] == [("ann", 7, None), ("bob", None, None)]
    assert files.row_map(df).first().row == {"userName": "ann", "AGE": "7", "other": "x"}
    assert files.without(df, 1).columns == ["userName", "other"]
    assert [r.other for r in files.with_value(df, "other", "y", F.col("AGE") == "7").collect()] == ["y", None]


def test_event_streams(spark):
    text = ": hello\nevent: add\nid: 7\ndata: one\ndata: two\n\ndata:three\r\n\r\nretry: 5\n\ndata"
    out = messages.events(spark.createDataFrame([("s", text)], "k string, body string"), "body").collect()
    assert [(r.event, r.id, r.data) for r in out] == [("add", "7", "one\ntwo"), ("message", None, "three"), ("message", None, "")]
    parts = spark.createDataFrame([("a", 2, "lo"), ("a", 1, "hel"), ("b", 1, None)], "k string, n int, p string")
    assert sorted(map(tuple, messages.merged(parts, ["k"], "n", "p").collect())) == [("a", "hello"), ("b", "")]


def test_every_placeholder_has_its_form(spark):
    forms = {
        "bool": r"true|false", "natural": r"\d+", "integer": r"-?\d+", "float": r"\d+(\.\d+)?(E\d+)?", "character": ".", "string": r"\w{3,7}", "date": r"\d{4}-\d\d-\d\d", "time": r"\d\d:\d\d:\d\d", "datetime": r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "now": r"\d{4}-.*", "image": r"https://.*\d+x\d+\.png",
        "dataImage": r"data:image/svg\+xml;base64,[\w+/=]+", "hex": "#[0-9a-f]{6}", "rgb": r"rgb\(\d+, \d+, \d+\)", "rgba": r"rgba\(\d+, \d+, \d+, [01]\.\d\d\)", "hsl": r"hsl\(\d+, \d+, \d+\)", "sentence": r"[A-Z][a-z ]+\.", "paragraph": r"([A-Z][a-z ]+\. ?)+", "word": "[a-z]{3,10}", "title": r"([A-Z][a-z]+ ?)+", "cword": ".", "csentence": ".{12,18}。", "ctitle": ".{3,7}", "cparagraph": "(.+。)+",
        "name": "[A-Z][a-z]+ [A-Z][a-z]+", "first": "[A-Z][a-z]+", "last": "[A-Z][a-z]+", "cname": "..", "cfirst": ".", "clast": ".", "url": r"\w+://.+/.+", "domain": r"[a-z]+\.[a-z]+", "protocol": "[a-z]+", "tld": "[a-z]+", "email": r"[a-z]+@example\.[a-z]+", "ip": r"(\d+\.){3}\d+", "mac": "([0-9a-f]{2}:){5}[0-9a-f]{2}",
        "region": r"\w+", "province": r"\w+", "city": r"\w+", "county": r"[\w ]+", "zip": r"\d{6}", "guid": "[0-9a-f-]{36}", "id": r"\d{17}[\dX]", "increment": r"\d+", "phone": r"1\d{10}", "gender": "male|female", "company": r"\w+ \w+", "department": r"\w+", "position": r"\w+", "salary": r"\d+00", "bankCard": r"62\d{17}", "creditCard": r"\d{15,16}", "currency": "[A-Z]{3}",
        "userAgent": "Mozilla.*", "password": ".{8,16}", "token": "[0-9a-f]{32}", "timestamp": r"\d+", "fileName": r"[a-z]+\.[a-z]+", "mime": r"\w+/\w+", "age": r"\d+", "price": r"\d+(\.\d+)?", "birthday": r"\d{4}-\d\d-\d\d",
    }
    rows = spark.range(40).withColumnRenamed("id", "__k")
    made = rows.select(*(random.call(random.Draw(F.col("__k"), 3, n), n).cast("string").alias(n) for n in forms)).collect()
    for n, form in forms.items():
        assert all(re.fullmatch(form, r[n], re.S) for r in made), (n, [r[n] for r in made][:3])
    assert len(random.placeholders()) >= 70 and set(random.placeholder_groups()) >= {"basic", "date", "web"}
    again = rows.repartition(7).select("__k", random.Draw(F.col("__k"), 3).email().alias("m")).orderBy("__k").collect()
    assert again == rows.select("__k", random.Draw(F.col("__k"), 3).email().alias("m")).orderBy("__k").collect()
    random.extend("hello", lambda d, who="you": F.lit(f"hello {who}"))
    assert templates.mock(spark, {"x": "@hello(me)!"}).first().x == "hello me!"
    with pytest.raises(ValueError):
        random.call(random.Draw(F.lit(1)), "nothing")


def test_patterns_and_templates(spark):
    rows = spark.range(60).withColumnRenamed("id", "__k")
    for p in (r"[a-c]{2,4}-\d+x?", r"(ab|cd)+z", r"\w{3}\.[^a-z]", "a|b|c"):
        assert all(re.fullmatch(p, r[0]) for r in rows.select(random.Draw(F.col("__k")).regex(p)).collect()), p
    loose = "{'id|+2': 5, n: '@natural(1, 3)', // a comment\n 'xs|0-2': [{a: '@id'}], 'one|1': ['p', 'q'], 'seq|+1': ['u', 'v'], 'ok|9-1': true, pi: 3.5,}"
    out = templates.mock(spark, loose, 30, seed=2).collect()
    assert [r.id for r in out[:3]] == [5, 7, 9] and [r.seq for r in out[:3]] == ["u", "v", "u"] and {len(r.xs) for r in out} == {0, 1, 2} and sum(r.ok for r in out) > 20 and {r.one for r in out} == {"p", "q"} and all(1 <= r.n <= 3 for r in out)
    bad = templates.problems(spark.createDataFrame([('{"id":1,"n":2,"xs":[{"a":1},{},{}],"one":"p","seq":"u","ok":"no","pi":1}',), ("[]",)], "j string"), loose, "j").collect()
    assert {(p.path, p.problem) for p in bad[0].problems} == {("$.xs", "breaks maxItems 2"), ("$.xs[].a", "is not of type string"), ("$.xs[].a", "is missing"), ("$.ok", "is not of type boolean")} or len(bad[0].problems) >= 3
    assert [p.problem for p in bad[1].problems] == ["is not of type object"]


def test_chinese_amounts_and_hashes(spark):
    want = {"100000000": "壹亿元整", "1010.05": "壹仟零壹拾元零伍分", "0.50": "伍角", "0.05": "伍分", "100010000": "壹亿零壹万元整", "20,304.10": "贰万零叁佰零肆元壹角", "0": None, "x": None, "5": "伍元整"}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r.s: r.a for r in df.select("s", numbers.amount_in_chinese("s").alias("a")).collect()} == want

    def fnv(t):
        h = 0xCBF29CE484222325
        for u in memoryview(t.encode("utf-16-le")).cast("H"):
            h = (h ^ u) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    texts = ["", "a", "foobar", "中文", "é" * 40, None]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "s string").select(ids.fnv1a("s").alias("h")).collect()]
    assert got == [None if t is None else fnv(t) for t in texts]


def test_paths_and_variables(spark):
    paths = {"/a/./b/../c\\d/": "/a/c/d/", "../x/../y": "../y", "/../z": "/z", "a//b": "a/b", "": ""}
    got = {r.p: r.c for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", strings.clean_path("p").alias("c")).collect()}
    assert got == paths
    row = spark.createDataFrame([("${a} $b ${ c } ${d}", "1")], "t string, v string").select(strings.replace_variables("t", {"a": F.col("v"), "c": F.lit("z")}, if_absent=None).alias("x"), strings.replace_variables("t", {"a": F.col("v")}, if_absent="").alias("y")).first()
    assert (row.x, row.y) == ("1 $b z ${d}", "1 $b  ")


def test_prefix_sums_by_ranges(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": [(i * 37) % 101 for i in range(101)], "v": list(range(101))}))
    got = {r.k: (r.place, r.running) for r in patterns.prefix(df.repartition(5), [F.col("k").desc()], "v").collect()}
    total = 0
    for place, (k, v) in enumerate(sorted(((r.k, r.v) for r in df.collect()), reverse=True), 1):
        total += v
        assert got[k] == (place, total)
    assert patterns.prefix(df.limit(0), [F.col("k")]).count() == 0

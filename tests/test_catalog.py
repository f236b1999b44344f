"""Registered queries against DuckDB on the smallest tables, and the other sources, sinks and operators."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from quillon.engine import TABLES
from quillon.operators import catalog, patterns
from quillon.sources import files, mock
from quillon.streaming import windows


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return repr(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    names = rel.columns
    want = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(cell(r[c]) for c in cols) for r in got.collect()) == want


def test_titles_of_odd_pages_against_sql(spark, tmp_path):
    """References besides &amp;, some of them cut off; white space; no title; no page."""
    titles = ["a&amp;&amp", "token = &quot;0b96", "x &am", "&amp;lt; &lt;b&gt; &eacute;", "  two  spaces\t ", "\u00a0\u3000wide\u2003", "a<b>b</b> c", "", "<i>", "&amp;amp; &#65;"]
    pages = [f"<html><body>\n<nav><ul>\n<li><a href='/{i}'>l</a></li></ul></nav>\n<article>\n<h1>{t}</h1><p>é&amp;\n<p>two</article>" for i, t in enumerate(titles)]
    pages += ["<article><p>none</p></article>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(catalog.ORACLES["html_selectors"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["html_selectors"](spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)) or [pytest.param("none", marks=pytest.mark.skip)])
def test_query_without_sql_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', None), ("", "line", "3")], "x string, y string, z string")
    files.write_csv(df, f"file://{tmp_path}/c")
    back = files.read_csv(spark, f"file://{tmp_path}/c")
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, [("a,b", 'say "x"', None), (None, "line", "3")]))
    files.write_ndjson(df, f"file://{tmp_path}/j")
    assert files.read_ndjson(spark, f"file://{tmp_path}/j", df.schema).count() == 2
    assert files.typed(back, {"z": "int"}).schema["z"].dataType == T.IntegerType()
    with pytest.raises(Exception, match="required"):
        files.typed(back, {}, required=["z"]).collect()
    assert files.insert_statements(df, "t").first()[0] == "INSERT INTO t (x, y, z) VALUES ('a,b', 'say \"x\"', NULL);"


def test_urls_and_schemas():
    u = files.jdbc_options("jdbc:mysql://db:3306/shop?useSSL=false")
    assert (u["dialect"], u["host"], u["port"], u["database"], u["useSSL"]) == ("mysql", "db", "3306", "shop", "false")
    assert files.jdbc_options("jdbc:sqlserver://h:1433;databaseName=x")["database"] == "x"
    assert files.jdbc_options("jdbc:oracle:thin:@h:1521:orcl")["database"] == "orcl"
    have, want = T.StructType().add("a", T.IntegerType()), T.StructType().add("a", T.LongType()).add("b", T.StringType())
    assert files.schema_changes(have, want, "t") == ["ALTER TABLE t ADD COLUMNS (b string)", "-- a: int is wanted as bigint"]


def test_mock_is_the_same_for_any_partitioning(spark):
    fields = {"id": {"kind": "id"}, "u": {"kind": "uuid"}, "d": {"kind": "date"}, "x": {"kind": "decimal", "min": 1, "max": 2}, "p": {"kind": "pattern", "pattern": "\\d{3}-[xy]"}, "m": {"kind": "email", "nulls": 0.5}}
    a, b = (sorted(map(str, mock.generate(spark, 200, fields, 3, n).collect())) for n in (1, 7))
    assert a == b and a != sorted(map(str, mock.generate(spark, 200, fields, 4).collect()))
    bad = mock.violations(spark.createDataFrame([(5,), (None,), (11,)], "x int"), {"x": {"min": 6, "max": 10}})
    assert {r.rule: r.n for r in bad.collect()} == {"x: null": 1, "x: below 6": 1, "x: above 10": 1}


def test_merge_cases(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C"), (4, "D")], "k int, v string")
    out = patterns.merge(t, s, ["k"], {"v": "v"}, F.col("k") == 3)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "B"), (4, "D")]
    assert sorted(map(tuple, patterns.merge(t, s, ["k"], {"v": "v"}, insert=False).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert patterns.delete(t, F.lit(None).cast("boolean")).count() == 3


def test_stream_clauses(spark):
    assert windows.clause("WINDOW HOPPING (SIZE 1 HOUR, ADVANCE BY 15 MINUTES)") == {"kind": "HOPPING", "spans": ["1 hour", "15 minutes"]}
    with pytest.raises(ValueError):
        windows.clause("WINDOW ROUND (1)")

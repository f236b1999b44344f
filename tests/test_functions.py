import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions import crypto as K
from quillon.functions import dates as D
from quillon.functions import expressions as X
from quillon.functions import htmls as H
from quillon.functions import jsons as J
from quillon.functions import masking as M
from quillon.functions import numbers as N
from quillon.functions import strings as S


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(c.alias("x")).first()[0]


@pytest.mark.parametrize(("c", "value", "want"), [
    (lambda: S.is_blank("s"), " \t", True), (lambda: S.is_blank("s"), None, True), (lambda: S.substring_before("s", "."), "a.b.c", "a"), (lambda: S.substring_after("s", "."), "a.b.c", "b.c"), (lambda: S.substring_after("s", "/"), "abc", ""), (lambda: S.substring_before_last("s", "."), "a.b.c", "a.b"),
    (lambda: S.substring_after_last("s", "."), "a.b.c", "c"), (lambda: S.substring_between("s", "[", "]"), "x[y]z", "y"), (lambda: S.substring_between("s", "[", "]"), "xyz", None), (lambda: S.replace_once("s", "a", "b"), "aaa", "baa"), (lambda: S.to_camel("s"), "order_line_item", "orderLineItem"),
    (lambda: S.camel_to("s"), "orderLineItem", "order_line_item"), (lambda: S.substring("s", -3, -1), "abcdef", "de"), (lambda: S.truncate("s", 3, "…"), "abcdef", "abc…"), (lambda: S.trim_whitespace("s"), "\t a \n", "a"), (lambda: S.trim_character("s", "/"), "//a/", "a"), (lambda: S.escape_html("s"), "<a&'\">", "&lt;a&amp;&#39;&quot;&gt;"),
    (lambda: S.unescape_html("s"), "&lt;&eacute;&#65;", "<éA"), (lambda: S.to_half_width("s"), "Ａ１　", "A1 "), (lambda: S.index_of_ignore_case("s", "B"), "abc", 1), (lambda: S.split_first("s", "="), "a=b=c", ["a", "b=c"]), (lambda: S.default_if_blank("s", "d"), " ", "d"), (lambda: S.fix_latin1("s"), "Ã©", "é"),
    (lambda: S.to_unicode_escapes("s"), "aé", "\\u0061\\u00e9"), (lambda: S.upper_first("s"), "abc", "Abc"), (lambda: S.is_all_upper("s"), "ABÇ", True), (lambda: S.is_mixed_case("s"), "aB", True), (lambda: S.delete_any("s", "ab"), "cabbage", "cge"), (lambda: S.contains_any("s", "xyz"), "day", True),
    (lambda: M.phone("s"), "13812345678", "138****5678"), (lambda: M.email("s"), "john@x.org", "j***@x.org"), (lambda: M.email("s"), "nobody", "n****y"), (lambda: M.ip("s"), "10.1.2.3", "10.1.*.*"), (lambda: M.mask("s", 3, 4), "abcd", "a***"), (lambda: M.mask("s", 1, 1), "a", "*"), (lambda: M.name("s"), "王小明", "王**"), (lambda: M.password("s"), None, None),
    (lambda: N.cut("s", 2), "-1.999", "-1.99"), (lambda: N.cut_up("s", 2), "1.991", "2"), (lambda: N.cut("s", 0), "7.9", "7"), (lambda: N.remove_end_zeros("s"), "1.500", "1.5"), (lambda: N.remove_end_zeros("s"), "100", "100"), (lambda: N.is_positive_integer("s"), "012", False), (lambda: N.hex_to_decimal("s"), "ff", "255"), (lambda: N.accuracy("s"), "1.2300", 2),
    (lambda: N.add("s", F.lit("0.1"), 2), "0.2", "0.3"), (lambda: N.divide("s", F.lit("3"), 3), "10", "3.333"), (lambda: N.divide("s", F.lit("0"), 3), "10", None), (lambda: N.is_parsable("s"), "-1.5e3", True), (lambda: N.is_positive_decimal("s"), "0.00", False),
    (lambda: K.hmac_sha256("s", "key"), "The quick brown fox jumps over the lazy dog", "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"), (lambda: K.base64_decode_lenient("s"), "aGVs\nbG8=", "hello"), (lambda: K.is_base64("s"), "abc", False), (lambda: K.id_card_checksum_ok("s"), "11010519491231002X", True), (lambda: K.id_card_checksum_ok("s"), "110105194912310021", False),
])
def test_text_functions(spark, c, value, want):
    assert one(spark, c(), value) == want


def test_dates(spark):
    ts = dt.datetime(2024, 2, 29, 13, 14, 15)
    df = spark.createDataFrame([(ts, dt.datetime(2024, 3, 2, 13, 14, 14))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(D.gap_days("a", "b"), D.gap_hours("b", "a"), D.gap_months("a", "b"), D.format_date(D.end_of_day("a")), D.format_date(D.begin_of_year("a"), "yyyy-MM-dd"), D.format_date(D.end_of_year("a")), D.is_leap_year(F.year("a")), D.days_of_month(F.lit(2023), F.lit(2)), D.duration_text(F.lit(90061000))).first()
    assert list(r) == [1, 47, 1, "2024-02-29 23:59:59", "2024-01-01", "2024-12-31 23:59:59", True, 28, "1 days 1:01:01"]
    got = one(spark, F.date_format(D.parse_date("s"), "yyyyMMdd"), "2024/03/05")
    assert got == "20240305" and one(spark, D.parse_date("s"), "junk") is None


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 2, 3],), (None,)], "a array<int>")
    rows = df.select(A.size("a"), A.first("a"), A.last("a"), A.remove_one("a", 2), A.find_first("a", lambda x: x > 1), A.count_matches("a", lambda x: x == 2), A.exists("a", lambda x: x == 9)).collect()
    assert [list(r) for r in rows] == [[4, 1, 3, [1, 2, 3], 2, 2, False], [0, None, None, None, None, 0, False]]


def test_ids(spark):
    df = spark.range(2000).repartition(3).select(K.snowflake_id().alias("a"), K.uuid7().alias("b"))
    rows = df.collect()
    assert len({r.a for r in rows}) == 2000 and len({r.b for r in rows}) == 2000 and all(r.b[14] == "7" and len(r.b) == 36 for r in rows)


@pytest.mark.parametrize(("e", "want"), [
    ("a / 2", 3), ("a / 2.0", 3.5), ("a ** 2", 49.0), ("-a + 1", -6), ("a % 4 == 3 && b == 'x'", True), ("true || (1/0) && false", False), ("n == null", True), ("n ?? 5", 5), ("a in [1, 7]", True), ("n in [1]", False), ("n out [1]", False), ("a == 7.0", True), ("b == 7", False), ("b + a", "x7"),
    ("a > 5 ? 'big' : 'small'", "big"), ("@max(a, 9)", 9), ("@length(n)", 0), ("@toString(n)", "null"), ("!n", True), ("1 + 2 * 3 - 4", 3), ("(1 + 2) * 3", 9), ("6 & 3 | 8", 10), ("1 << 3", 8), ("@avg()", 0.0), ("@upper(b)", "X"), ("xs[1]", 20),
])
def test_expressions(spark, e, want):
    df = spark.createDataFrame([(7, "x", None, [10, 20])], "a long, b string, n long, xs array<int>")
    assert df.select(X.compile_expression(e, df).alias("v")).first()[0] == want


def test_expression_errors(spark):
    df = spark.createDataFrame([(7, None)], "a long, n long")
    for bad in ("a +", "a b", "@nope(1)", "(a", "a $ 1"):
        with pytest.raises(ValueError):
            X.compile_expression(bad, df)
    with pytest.raises(Exception, match="null"):
        df.select(X.compile_expression("n + 1", df, strict=True)).collect()
    assert df.select(X.render_template("<${a}-${n}>", df)).first()[0] == "<7-null>"


DOC = {"a": {"b": [{"x": 1, "n": "p"}, {"x": 5, "n": "q"}, {"x": 9, "n": "r"}]}, "abc": 1, "xbc": {"x": 3}}


@pytest.mark.parametrize(("path", "want"), [
    ("/a/b/0/x", [1]), ("//x", [1, 5, 9, 3]), ("/a/b/*/x", [1, 5, 9]), ("/a/b/1+/x", [5, 9]), ("/a/b/1-/x", [1, 5]), ("/a/b/1~2/x", [5, 9]), ("/a/b[0,2]/x", [1, 9]), ("/a/b[x > 4 && n == 'q']/x", [5]), ("/*bc", [1, {"x": 3}]), ("/ab*", [1]), ("/*b*", [1, {"x": 3}]), ("/^x.c", [{"x": 3}]), ("/'abc'", [1]), ("/none", []),
])
def test_json_paths(path, want):
    assert J.find(DOC, path) == want


def test_json_columns(spark):
    s = json.dumps(DOC)
    assert one(spark, J.get("s", "/a/b/1/n"), s) == "q" and one(spark, J.get("s", "//n"), s) == "p" and one(spark, J.collect("s", "//x"), "junk") is None
    assert one(spark, J.apply_patch("s", [{"op": "replace", "path": "/a", "value": 2}, {"op": "test", "path": "/a", "value": 2}])["value"], '{"a":1}') == '{"a":2}'
    assert one(spark, J.apply_patch("s", [{"op": "remove", "path": "/z"}])["error"], '{"a":1}')
    assert one(spark, J.validate("s", {"oneOf": [{"type": "object"}, {"required": ["a"]}]})["ok"], '{"a":1}') is False


def test_patch_and_schema():
    assert J.patch({"a": [1, 2]}, [{"op": "add", "path": "/a/1", "value": 9}, {"op": "add", "path": "/a/-", "value": 3}]) == {"a": [1, 9, 2, 3]}
    assert J.patch({"a": 1, "b~/": 2}, [{"op": "move", "from": "/b~0~1", "path": "/c"}, {"op": "copy", "from": "/a", "path": "/d"}]) == {"a": 1, "c": 2, "d": 1}
    with pytest.raises(J.PatchError):
        J.patch({"a": 1}, [{"op": "test", "path": "/a", "value": 2}])
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "t": {"$ref": "#/defs/t"}}, "defs": {"t": {"enum": ["x"]}}, "additionalProperties": False}
    assert J.check({"n": 1, "t": "x"}, schema) == [] and J.check({"t": "y", "z": 1}, schema) == ["/n: required", "/t: enum", "/z: additionalProperties"]


PAGE = "<html><body><div id='main' class='a b'><h2>Head</h2><p class=x>One <b>two</b></p><p>Three</p><ul><li>1<li>2<li>3</ul><a href='/p/1' data-k='v'>link</a><p></p></div><pre> a  b </pre><script>no()</script></body></html>"


@pytest.mark.parametrize(("selector", "want"), [
    ("#main > p", ["One two", "Three", ""]), ("div.a.b h2", ["Head"]), ("li:first-child", ["1"]), ("li:nth-child(odd)", ["1", "3"]), ("li:nth-child(2)", ["2"]), ("li:last-child", ["3"]), ("p + p", ["Three"]), ("h2 ~ p", ["One two", "Three", ""]), ("a[href^=/p/]", ["link"]), ("a[data-k='v']", ["link"]), ("[href$='1'], h2", ["Head", "link"]),
    ("p:contains(thr)", ["Three"]), ("p:not(.x)", ["Three", ""]), ("p:empty", [""]), ("p:containsOwn(two)", []), ("b:only-child", ["two"]), ("li:matches([23])", ["2", "3"]), ("p:nth-of-type(2)", ["Three"]), ("*[class~=b] > ul > li", ["1", "2", "3"]),
])
def test_selectors(selector, want):
    assert [e.text() for e in H.select(H.parse(PAGE), selector)] == want


def test_html_columns(spark):
    r = one(spark, H.select_column("s", "a"), PAGE)
    assert r[0].attrs == {"href": "/p/1", "data-k": "v"} and r[0].html == '<a href="/p/1" data-k="v">link</a>' and one(spark, H.text_column("s", "p"), None) is None


@pytest.mark.parametrize(("selector", "want"), [
    ("li", ["1", "2", "3"]), ("p", ["One <b>two</b>", "Three", ""]), ("pre", [" a  b "]), ("ul", ["<li>1<li>2<li>3"]), ("script", ["no()"]), ("#main > a", ["link"]), ("br", []),
])
def test_source_of_hits(spark, selector, want):
    assert one(spark, H.source_column("s", selector), PAGE) == want and one(spark, H.source_column("s", selector), None) is None


def test_source_of_hits_across_lines(spark):
    page = "<!-- c\n -->\r\n<table\n a='>'>\n<tr><td>&lt;x&amp\n<td>é<br>\n<tr><td>z</table>\n<h1>&quot;<i/>a</h1><div>\nopen &am"
    assert one(spark, H.source_column("s", "td"), page) == ["&lt;x&amp\n", "é<br>\n", "z"]
    assert one(spark, H.source_column("s", "h1, div, br, tbody"), page)[-2:] == ["&quot;<i/>a", "\nopen &am"]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("ab/~", max_size=2), c, max_size=3), max_leaves=8))
def test_patch_of_whole_document_round_trips(doc):
    assert J.patch({"x": 0}, [{"op": "replace", "path": "", "value": doc}]) == doc

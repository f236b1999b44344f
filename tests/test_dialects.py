"""Statements of each dialect: they parse, lower to text that Spark parses, and mean what they should."""

import pytest

from quillon.engine import convert, convert_all
from quillon.plans.dialects import DIALECTS
from quillon.plans.emit import spark_type, to_spark
from quillon.plans.lexer import SqlError
from quillon.plans.parser import parse, parse_all, parse_expr

GOLDEN = [
    ("mysql", "SELECT DISTINCTROW a FROM t LIMIT 5, 10", "SELECT DISTINCT a FROM t LIMIT 10 OFFSET 5"),
    ("mysql", "SELECT a || b FROM t", "SELECT a OR b FROM t"),
    ("postgres", "SELECT a || b FROM t", "SELECT a || b FROM t"),
    ("mysql", "SELECT IFNULL(a, 0), LENGTH(b) FROM t", "SELECT coalesce(a, 0), octet_length(b) FROM t"),
    ("mysql", "SELECT DATE_FORMAT(d, '%Y-%m-%d %H:%i:%s') FROM t", "SELECT date_format(d, 'yyyy-MM-dd HH:mm:ss') FROM t"),
    ("mysql", "SELECT DATE_SUB(d, INTERVAL 7 DAY) FROM t", "SELECT (d - INTERVAL 7 DAY) FROM t"),
    ("oracle", "SELECT TO_CHAR(d, 'YYYY-MM-DD HH24:MI:SS'), NVL(a, 1) FROM t", "SELECT date_format(d, 'yyyy-MM-dd HH:mm:ss'), coalesce(a, 1) FROM t"),
    ("oracle", "SELECT a FROM t WHERE ROWNUM <= 3", "SELECT a FROM t LIMIT 3"),
    ("sqlserver", "SELECT TOP 5 [order id], ISNULL(b, 0) FROM t", "SELECT `order id`, coalesce(b, 0) FROM t LIMIT 5"),
    ("sqlserver", "SELECT DATEDIFF(month, a, b), LEN(c) FROM t", "SELECT ((year(b) - year(a)) * 12 + month(b) - month(a)), length(rtrim(c)) FROM t"),
    ("postgres", "SELECT a::int, b ->> 'k' FROM t", "SELECT CAST(a AS INT), get_json_object(b, '$.k') FROM t"),
    ("postgres", "SELECT a -> 'x' -> 0 ->> 'y' FROM t", "SELECT get_json_object(a, '$.x[0].y') FROM t"),
    ("postgres", "SELECT 7 / 2, 2 ^ 3", "SELECT 7 DIV 2, POWER(2, 3)"),
    ("postgres", "SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY a NULLS LAST"),
    ("mysql", "SELECT a FROM t WHERE x ISNULL OR NOT (a = 1 AND b = 2)", "SELECT a FROM t WHERE x IS NULL OR NOT (a = 1 AND b = 2)"),
    ("ansi", "SELECT a * (b + c) - (d - e) FROM t", "SELECT a * (b + c) - (d - e) FROM t"),
    ("mysql", "SELECT a FROM t WHERE (a = 1 OR b = 2) AND c = 3", "SELECT a FROM t WHERE (a = 1 OR b = 2) AND c = 3"),
    ("ansi", "SELECT 1 FROM t WHERE a IN () ", "SELECT 1 FROM t WHERE FALSE"),
    ("hive", "SELECT a FROM t LATERAL VIEW OUTER explode(x) e AS y", "SELECT a FROM t LATERAL VIEW OUTER explode(x) e AS y"),
    ("clickhouse", "SELECT a FROM t GLOBAL JOIN u USING (id) WHERE a GLOBAL IN (SELECT 1)", "SELECT a FROM t INNER JOIN u USING (id) WHERE a IN (SELECT 1)"),
    ("oracle", "SELECT 1 FROM dual", "SELECT 1 FROM (SELECT 1 AS dummy) AS dual"),
    ("sqlite", "SELECT [a], `b`, \"c\" FROM t", "SELECT a, b, c FROM t"),
    ("mysql", "SELECT GROUP_CONCAT(a SEPARATOR '-') FROM t", "SELECT listagg(CAST(a AS STRING), '-') FROM t"),
    ("mysql", "SELECT 'it''s', \"two\" FROM t", "SELECT 'it\\'s', 'two' FROM t"),
    ("ansi", "SELECT a FROM t UNION ALL (SELECT b FROM u ORDER BY b LIMIT 1)", "SELECT a FROM t UNION ALL (SELECT b FROM u ORDER BY b LIMIT 1)"),
    ("ansi", "SELECT CASE WHEN a THEN 1 END, CAST(b AS VARCHAR(3)), EXTRACT(YEAR FROM d), TRIM(BOTH 'x' FROM s) FROM t", "SELECT CASE WHEN a THEN 1 END, CAST(b AS STRING), EXTRACT(YEAR FROM d), trim(BOTH 'x' FROM s) FROM t"),
]


@pytest.mark.parametrize(("d", "sql", "want"), GOLDEN)
def test_golden(d, sql, want):
    assert to_spark(parse(sql, d), d)[0] == want


def test_spark_parses_what_is_written(spark):
    parser = spark._jsparkSession.sessionState().sqlParser()
    for d, sql, _ in GOLDEN:
        parser.parsePlan(to_spark(parse(sql, d), d)[0])


def test_written_text_is_stable():
    """Spark SQL that came out, read as Spark's dialect, comes out the same from then on."""
    for _, _, want in GOLDEN:
        once = to_spark(parse(want, "spark"), "spark")[0]
        assert to_spark(parse(once, "spark"), "spark")[0] == once


@pytest.mark.parametrize("d", list(DIALECTS))
def test_every_dialect_parses_the_common_core(d):
    sql = "WITH a AS (SELECT x, COUNT(*) AS n FROM t WHERE y BETWEEN 1 AND 2 GROUP BY x HAVING COUNT(*) > 1) SELECT a.x, CASE WHEN n > 1 THEN 'b' ELSE 'c' END AS z, SUM(n) OVER (PARTITION BY x ORDER BY n) AS s FROM a LEFT JOIN u ON u.x = a.x WHERE EXISTS (SELECT 1 FROM v WHERE v.x = a.x) UNION ALL SELECT 1, 'q', 2 ORDER BY 1"
    assert to_spark(parse(sql, d), d)[0].startswith("WITH a AS (SELECT x")


@pytest.mark.parametrize("bad", ["SELEC 1", "SELECT 'a", "SELECT (1", "SELECT 1 FROM", "SELECT a b c FROM t", "SELECT /* x"])
def test_errors(bad):
    with pytest.raises(SqlError):
        parse(bad, "mysql")
    assert convert(bad, "mysql")["error"]


def test_statements():
    kinds = [s.kind for s in parse_all("INSERT INTO t (a) VALUES (1); UPDATE t SET a = 2 WHERE b = 3; DELETE FROM t WHERE a = 1; CREATE TABLE x (a int); SET a = 1", "mysql")]
    assert kinds == ["INSERT", "UPDATE", "DELETE", "DDL", "SET"]
    assert parse("-- only a comment", "mysql").kind == "OTHER"


def test_types_and_expressions():
    assert [spark_type(t) for t in ("VARCHAR(20)", "NUMBER(10,2)", "DATETIME", "BIGINT UNSIGNED", "double precision", "DECIMAL(8,3)", "TIMESTAMP WITHOUT TIME ZONE")] == ["STRING", "DECIMAL(10,2)", "TIMESTAMP", "BIGINT", "DOUBLE", "DECIMAL(8,3)", "TIMESTAMP_NTZ"]
    with pytest.raises(SqlError):
        parse_expr("a +", "mysql")


def test_conversion_on_executors(spark):
    df = spark.createDataFrame([("oracle", "SELECT a FROM t WHERE ROWNUM <= 3"), ("mysql", "SELECT (")], "dialect string, sql string")
    rows = {r.dialect: r.converted for r in convert_all(df).collect()}
    assert rows["oracle"].sql.endswith("LIMIT 3") and rows["mysql"].error


def test_window_frames_and_quantifiers(spark):
    spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, v int").createOrReplaceTempView("q_t")
    from quillon.engine import Engine

    e = Engine(spark)
    assert e.sql("SELECT k FROM q_t WHERE 10 > ALL (SELECT v FROM q_t WHERE v IS NOT NULL)", "mysql").count() == 3
    assert e.sql("SELECT k FROM q_t WHERE 10 > ALL (SELECT v FROM q_t)", "mysql").count() == 0
    assert e.sql("SELECT k FROM q_t WHERE 1 > ALL (SELECT v FROM q_t WHERE v > 100)", "mysql").count() == 3
    assert e.sql("SELECT k FROM q_t WHERE k > ANY (SELECT 2)", "postgres").count() == 1

"""Statements of one dialect as text of another; DuckDB runs what is written for PostgreSQL, SQLite what is written for it."""

import sqlite3

import duckdb
import pytest

from quillon.plans.dialects import DIALECTS
from quillon.plans.parser import parse
from quillon.plans.targets import columns_of, convert, struct_of

CASES = [
    ("mysql", "postgres", "SELECT IFNULL(a, 0), `order` FROM t LIMIT 5, 10", 'SELECT COALESCE(a, 0), "order" FROM t LIMIT 10 OFFSET 5'),
    ("mysql", "oracle", "SELECT a FROM t ORDER BY a LIMIT 3", "SELECT * FROM (SELECT a FROM t ORDER BY a NULLS FIRST) WHERE ROWNUM <= 3"),
    ("mysql", "oracle12", "SELECT a FROM t LIMIT 3 OFFSET 4", "SELECT a FROM t OFFSET 4 ROWS FETCH NEXT 3 ROWS ONLY"),
    ("mysql", "sqlserver", "SELECT a FROM t x LIMIT 3", "SELECT TOP 3 a FROM t AS x"),
    ("mysql", "sqlserver", "SELECT a FROM t LIMIT 3 OFFSET 4", "SELECT a FROM t ORDER BY (SELECT NULL) OFFSET 4 ROWS FETCH NEXT 3 ROWS ONLY"),
    ("postgres", "mysql", "SELECT a || b || 'c', x::int FROM t WHERE y ILIKE 'q%'", "SELECT CONCAT(a, b, 'c'), CAST(x AS SIGNED) FROM t WHERE LOWER(y) LIKE LOWER('q%')"),
    ("mysql", "postgres", "SELECT DATE_FORMAT(d, '%Y-%m-%d %H:%i:%s'), DATE_ADD(d, INTERVAL 3 DAY), DATEDIFF(a, b) FROM t", "SELECT TO_CHAR(d, 'YYYY-MM-DD HH24:MI:SS'), d + INTERVAL '3 DAY', (CAST(a AS DATE) - CAST(b AS DATE)) FROM t"),
    ("oracle", "mysql", "SELECT TO_CHAR(d, 'YYYY-MM-DD'), NVL(a, 1), DECODE(b, 1, 'x', 'y') FROM t WHERE ROWNUM <= 5", "SELECT DATE_FORMAT(d, '%Y-%m-%d'), COALESCE(a, 1), CASE WHEN b = 1 THEN 'x' ELSE 'y' END FROM t LIMIT 5"),
    ("oracle", "postgres", "SELECT a.x FROM a, b WHERE a.k = b.k(+)", "SELECT a.x FROM a LEFT JOIN b ON a.k = b.k"),
    ("oracle", "postgres", "SELECT 1 FROM dual MINUS SELECT 2 FROM dual", "SELECT 1 EXCEPT SELECT 2"),
    ("postgres", "oracle", "SELECT TRUE EXCEPT SELECT FALSE", "SELECT 1 FROM dual MINUS SELECT 0 FROM dual"),
    ("sqlserver", "mysql", "SELECT TOP 5 [order id], ISNULL(b, 0), LEN(c), GETDATE(), DATEADD(day, -3, d) FROM t", "SELECT `order id`, COALESCE(b, 0), CHAR_LENGTH(c), NOW(), DATE_ADD(d, INTERVAL -3 DAY) FROM t LIMIT 5"),
    ("mysql", "postgres", "SELECT GROUP_CONCAT(a ORDER BY b DESC SEPARATOR '-') FROM t", "SELECT STRING_AGG(a, '-' ORDER BY b DESC NULLS LAST) FROM t"),
    ("postgres", "sqlserver", "SELECT STRING_AGG(a, ',' ORDER BY b) FROM t", "SELECT STRING_AGG(a, ',') WITHIN GROUP (ORDER BY CASE WHEN b IS NULL THEN 1 ELSE 0 END, b) FROM t"),
    ("mysql", "spark", "SELECT a <=> b FROM t WHERE x REGEXP '^a'", "SELECT a <=> b FROM t WHERE x RLIKE '^a'"),
    ("mysql", "postgres", "SELECT a <=> b FROM t WHERE x REGEXP '^a'", "SELECT a IS NOT DISTINCT FROM b FROM t WHERE x ~ '^a'"),
    ("postgres", "mysql", "SELECT COUNT(*) FILTER (WHERE a > 1) FROM t", "SELECT COUNT(CASE WHEN a > 1 THEN 1 END) FROM t"),
    ("postgres", "oracle", "SELECT DISTINCT ON (k) k, v FROM t ORDER BY k, v", "SELECT k, v FROM (SELECT k AS k, v AS v, ROW_NUMBER() OVER (PARTITION BY k ORDER BY k, v) AS w_1 FROM t) q_2 WHERE w_1 = 1 ORDER BY k, v"),
    ("mysql", "postgres", "INSERT INTO t (a) VALUES (1) ON DUPLICATE KEY UPDATE a = VALUES(a)", None),
    ("postgres", "mysql", "INSERT INTO t (a, b) VALUES (1, 2) ON CONFLICT (a) DO UPDATE SET b = EXCLUDED.b", "INSERT INTO t (a, b) VALUES (1, 2) ON DUPLICATE KEY UPDATE b = VALUES(b)"),
    ("mysql", "oracle", "UPDATE t SET a = IF(b > 1, 'x', 'it''s') WHERE c = TRUE", "UPDATE t SET a = CASE WHEN b > 1 THEN 'x' ELSE 'it''s' END WHERE c = 1"),
    ("sqlserver", "postgres", "SELECT c.a, x.b FROM c CROSS APPLY (SELECT TOP 1 b FROM d WHERE d.a = c.a ORDER BY b) x", "SELECT c.a, x.b FROM c INNER JOIN LATERAL (SELECT b FROM d WHERE d.a = c.a ORDER BY b NULLS FIRST LIMIT 1) AS x ON TRUE"),
    ("postgres", "mysql", "SELECT j ->> 'a' FROM t", "SELECT JSON_UNQUOTE(JSON_EXTRACT(j, '$.a')) FROM t"),
    ("mysql", "sqlserver", "SELECT a FROM t WHERE b REGEXP 'x'", None),
    ("oracle", "mysql", "SELECT a FROM t START WITH a = 1 CONNECT BY PRIOR a = b", None),
]


@pytest.mark.parametrize(("source", "target", "sql", "want"), CASES)
def test_cases(source, target, sql, want):
    got = convert(sql, source, target)
    assert got["sql"] == want and (want is not None or got["error"]), got


CORE = "WITH a AS (SELECT k, COUNT(*) AS n FROM t WHERE v BETWEEN 1 AND 90 GROUP BY k HAVING COUNT(*) > 1) SELECT a.k, CASE WHEN n > 2 THEN 'b' ELSE 'c' END AS z, SUM(n) OVER (PARTITION BY n ORDER BY a.k) AS s FROM a LEFT JOIN u ON u.k = a.k WHERE EXISTS (SELECT 1 FROM t x WHERE x.k = a.k) UNION ALL SELECT 1, 'q', 2"


@pytest.mark.parametrize("target", list(DIALECTS))
@pytest.mark.parametrize("source", list(DIALECTS))
def test_core_between_all(source, target):
    got = convert(CORE, source, target)
    assert got["error"] is None
    again = convert(got["sql"], target, target)
    assert again["sql"] == got["sql"]  # what is written reads as itself
    assert parse(got["sql"], target)


RUNS = [
    ("mysql", "SELECT k, IFNULL(v, -1) AS v FROM t ORDER BY k, v LIMIT 2, 5"), ("mysql", "SELECT IF(k > 2, 'a', 'b') AS z, COUNT(*) AS n FROM t GROUP BY IF(k > 2, 'a', 'b') ORDER BY z"), ("sqlserver", "SELECT TOP 4 k, ISNULL(v, 0) AS v FROM t ORDER BY v DESC, k"),
    ("oracle", "SELECT k, NVL(v, 7) AS v, DECODE(k, 1, 'x', 'y') AS d FROM t WHERE MOD(k, 2) = 1 ORDER BY k, v"), ("mysql", "SELECT t.k, u.w FROM t JOIN u ON u.k = t.k WHERE u.w IN ('a', 'b') AND t.v IS NOT NULL ORDER BY t.k, u.w, t.v"), ("clickhouse", "SELECT k, v FROM t WHERE v > 1 ORDER BY v LIMIT 1 BY k"),
    ("oracle", "SELECT k FROM t MINUS SELECT k FROM u ORDER BY k"), ("mysql", "SELECT k, ROW_NUMBER() OVER (PARTITION BY k ORDER BY v) AS r FROM t WHERE v IS NOT NULL ORDER BY k, r"), ("sqlserver", "SELECT LEN(w) AS n, k FROM u ORDER BY k"),
]


@pytest.fixture(scope="module")
def bases():
    duck, lite = duckdb.connect(), sqlite3.connect(":memory:")
    for db in (duck, lite):
        db.execute("CREATE TABLE t (k INTEGER, v INTEGER)")
        db.execute("CREATE TABLE u (k INTEGER, w VARCHAR(9))")
        db.execute("INSERT INTO t VALUES (1, 10), (1, 20), (2, 5), (2, NULL), (3, 7), (3, 8), (3, 9), (4, 1)")
        db.execute("INSERT INTO u VALUES (1, 'a'), (2, 'bb'), (3, 'b')")
    return duck, lite


@pytest.mark.parametrize(("source", "sql"), RUNS)
def test_two_engines_and_spark_agree(bases, spark, source, sql):
    duck, lite = bases
    a = duck.execute(convert(sql, source, "postgres")["sql"]).fetchall()
    b = lite.execute(convert(sql, source, "sqlite")["sql"]).fetchall()
    from quillon.engine import Engine

    e = Engine(spark)
    e.add("t", spark.createDataFrame(duck.execute("SELECT * FROM t").fetchall(), "k int, v int"))
    e.add("u", spark.createDataFrame(duck.execute("SELECT * FROM u").fetchall(), "k int, w string"))
    c = [tuple(r) for r in e.sql(sql, source).collect()]
    assert sorted(map(str, a)) == sorted(map(str, b)) == sorted(map(str, c))


def test_tables(spark):
    ddl = "CREATE TABLE IF NOT EXISTS s.users (id BIGINT UNSIGNED NOT NULL AUTO_INCREMENT, name VARCHAR(32) NOT NULL DEFAULT 'x' COMMENT 'the name', age INT(11) UNSIGNED, paid DECIMAL(10,2), at DATETIME, ok BOOLEAN, note TEXT, PRIMARY KEY (id), KEY by_name (name)) ENGINE=InnoDB"
    want = {
        "postgres": "CREATE TABLE s.users (id BIGSERIAL NOT NULL, name VARCHAR(32) DEFAULT 'x' NOT NULL, age BIGINT, paid DECIMAL(10,2), at TIMESTAMP, ok BOOLEAN, note TEXT, PRIMARY KEY (id))",
        "oracle": "CREATE TABLE s.users (id NUMBER(20,0) GENERATED ALWAYS AS IDENTITY NOT NULL, name VARCHAR2(32) DEFAULT 'x' NOT NULL, age NUMBER(19), paid NUMBER(10,2), at TIMESTAMP, ok NUMBER(1), note VARCHAR2(4000), PRIMARY KEY (id))",
        "sqlserver": "CREATE TABLE s.users (id DECIMAL(20,0) IDENTITY(1,1) NOT NULL, name NVARCHAR(32) DEFAULT 'x' NOT NULL, age BIGINT, paid DECIMAL(10,2), at DATETIME2, ok BIT, note NVARCHAR(MAX), PRIMARY KEY (id))",
        "spark": "CREATE TABLE s.users (id DECIMAL(20,0) GENERATED ALWAYS AS IDENTITY NOT NULL, name STRING DEFAULT 'x' NOT NULL COMMENT 'the name', age BIGINT, paid DECIMAL(10,2), at TIMESTAMP, ok BOOLEAN, note STRING)",
    }
    for target, text in want.items():
        assert convert(ddl, "mysql", target)["sql"] == text
    back = convert(want["postgres"], "postgres", "mysql")["sql"]
    assert back == "CREATE TABLE s.users (id BIGINT NOT NULL AUTO_INCREMENT, name VARCHAR(32) DEFAULT 'x' NOT NULL, age BIGINT, paid DECIMAL(10,2), at DATETIME, ok TINYINT(1), note TEXT, PRIMARY KEY (id))"
    schema = struct_of(ddl, "mysql")
    assert schema.simpleString() == "struct<id:decimal(20,0),name:string,age:bigint,paid:decimal(10,2),at:timestamp,ok:boolean,note:string>" and not schema["id"].nullable
    assert columns_of(ddl, "mysql")[2] == ["id"]

"""Writes as table states, their governance, files, and the builders."""

import pytest

from quillon.engine import Engine, PolicyError, inspect_all
from quillon.plans import builder as B
from quillon.plans import govern as G
from quillon.plans.emit import to_spark
from quillon.plans.lexer import SqlError
from quillon.plans.parser import parse


@pytest.fixture
def engine(spark):
    e = Engine(spark, keys={"w_t": ["k"]})
    e.add("w_t", spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, None, 30)], "k int, v string, n int"))
    e.add("w_s", spark.createDataFrame([(2, "B"), (3, "C"), (4, "D")], "k int, v string"))
    return e


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_statements_in_turn(engine, spark):
    engine.sql("INSERT INTO w_t (k, v) VALUES (4, 'd')", "mysql")
    engine.sql("UPDATE w_t SET v = 'x', n = n + 1 WHERE k <= 2", "mysql")
    engine.sql("DELETE FROM w_t WHERE v IS NULL", "mysql")
    assert rows(spark.table("w_t")) == [(1, "x", 11), (2, "x", 21), (4, "d", None)]
    assert rows(engine.sql("INSERT INTO w_t VALUES (1, 'one', 1), (9, 'nine', 9) ON DUPLICATE KEY UPDATE v = VALUES(v), n = n + 100", "mysql")) == [(1, "one", 111), (2, "x", 21), (4, "d", None), (9, "nine", 9)]
    assert rows(engine.sql("INSERT IGNORE INTO w_t VALUES (1, 'no', 1), (5, 'yes', 5)", "mysql"))[0] == (1, "one", 111)
    assert rows(engine.sql("REPLACE INTO w_t SET k = 2, v = 'new'", "mysql"))[1] == (2, "new", None)
    assert rows(engine.sql("INSERT OVERWRITE TABLE w_t SELECT 7, 'seven', 7", "hive")) == [(7, "seven", 7)]
    assert engine.sql("DELETE FROM w_t", "mysql").count() == 0


def test_limits_joins_and_returning(engine):
    assert rows(engine.sql("UPDATE w_t SET n = 0 ORDER BY n DESC LIMIT 1", "mysql"))[2] == (3, None, 0)
    assert rows(engine.sql("UPDATE w_t t JOIN w_s s ON s.k = t.k SET t.v = s.v", "mysql")) == [(1, "a", 10), (2, "B", 20), (3, "C", 0)]
    assert rows(engine.sql("DELETE t FROM w_t t JOIN w_s s ON s.k = t.k WHERE s.v = 'B'", "mysql")) == [(1, "a", 10), (3, "C", 0)]
    assert rows(engine.sql("UPDATE w_t SET n = 5 WHERE k = 1 RETURNING k, n AS m", "postgres")) == [(1, 5)]
    assert rows(engine.sql("INSERT INTO w_t (k) VALUES (8) RETURNING *", "postgres")) == [(8, None, None)]
    assert rows(engine.sql("DELETE FROM w_t ORDER BY k DESC LIMIT 2", "mysql")) == [(1, "a", 5)]


def test_merge(engine, spark):
    sql = "MERGE INTO w_t t USING w_s s ON t.k = s.k WHEN MATCHED AND s.v = 'C' THEN DELETE WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k, v, n) VALUES (s.k, s.v, 0) WHEN NOT MATCHED BY SOURCE THEN UPDATE SET n = -1"
    assert rows(engine.sql(sql, "sqlserver")) == [(1, "a", -1), (2, "B", 20), (4, "D", 0)]
    engine.add("w_s", spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string"))
    with pytest.raises(Exception, match="several source rows"):
        engine.sql("MERGE INTO w_t t USING w_s s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v", "oracle").collect()
    from quillon.operators import patterns

    with pytest.raises(Exception, match="several source rows"):
        patterns.merge(spark.table("w_t"), spark.table("w_s"), ["k"], {"v": "v"}).collect()


def test_files(engine, spark, tmp_path):
    engine.sql(f"COPY w_s TO 'file://{tmp_path}/s' WITH (FORMAT csv, HEADER, DELIMITER ';')", "postgres")
    engine.sql(f"COPY w_t (k, v) FROM 'file://{tmp_path}/s' WITH (FORMAT csv, HEADER true, DELIMITER ';')", "postgres")
    assert (4, "D", None) in rows(spark.table("w_t")) and spark.table("w_t").count() == 6
    (tmp_path / "l.txt").write_text("k|v\n7|seven\n")
    engine.sql(f"LOAD DATA LOCAL INFILE 'file://{tmp_path}/l.txt' INTO TABLE w_s FIELDS TERMINATED BY '|' IGNORE 1 LINES (k, v)", "mysql")
    assert (7, "seven") in rows(spark.table("w_s"))


@pytest.mark.parametrize(("sql", "error"), [
    ("INSERT INTO w_t (k, v) VALUES (1)", "values"), ("INSERT INTO w_t (k, nothing) VALUES (1, 2)", "no column"), ("SELECT * FROM w_t PARTITION (p0)", "partition"), ("UPDATE w_t LEFT JOIN w_s ON 1 = 1 SET n = 1", "outer join"),
    ("DELETE q FROM w_t", "names a table"), ("LOAD DATA INFILE 'x' INTO TABLE w_t WHAT", "unexpected"), ("SELECT k FROM w_t ORDER SIBLINGS BY k", "SIBLINGS"), ("SELECT k FROM w_t FOR XML AUTO", "XML"),
])
def test_what_is_refused(engine, sql, error):
    with pytest.raises(SqlError, match=error):
        engine.sql(sql, "mysql")


def test_policies_on_writes(engine, spark):
    def text(sql, d="mysql", **o):
        return to_spark(G.inject(parse(sql, d), "n", 7, **o), d)[0]

    assert text("DELETE FROM w_t WHERE k = 5") == "DELETE FROM w_t WHERE k = 5 AND n = 7"
    assert text("UPDATE w_t SET v = 'x' WHERE k = 1 OR k = 2") == "UPDATE w_t SET v = 'x' WHERE (k = 1 OR k = 2) AND n = 7"
    assert text("INSERT INTO a (x) SELECT y FROM w_t") == "INSERT INTO a (x, n) SELECT y, 7 AS n FROM w_t WHERE w_t.n = 7"
    assert text("INSERT INTO a (x, n) VALUES (1, 99)") == "INSERT INTO a (x, n) VALUES (1, 7)"
    assert text("MERGE INTO a USING b ON a.k = b.k WHEN NOT MATCHED THEN INSERT (k) VALUES (b.k)") == "MERGE INTO a USING (SELECT * FROM b WHERE b.n = 7) AS b ON a.k = b.k AND a.n = 7 WHEN NOT MATCHED THEN INSERT (k, n) VALUES (b.k, 7)"
    assert text("SELECT * FROM a PIVOT (SUM(x) FOR y IN ('p'))", "oracle") == "SELECT * FROM (SELECT * FROM a WHERE a.n = 7) AS a PIVOT (SUM(x) FOR y IN ('p'))"
    assert text("SELECT k FROM a LATERAL VIEW explode(xs) e AS k", "hive") == "SELECT k FROM a LATERAL VIEW explode(xs) e AS k WHERE a.n = 7"
    assert text("CREATE VIEW x AS SELECT * FROM a") == "CREATE VIEW x AS SELECT * FROM a WHERE a.n = 7"
    for refused in ("INSERT INTO a VALUES (1)", "INSERT INTO a (x) SELECT * FROM b", "CALL p()", "TRUNCATE TABLE a", "COPY a FROM 'f'"):
        with pytest.raises(SqlError):
            text(refused)
    assert "7" in to_spark(G.bind(parse("UPDATE w_t SET n = ? WHERE k = ?"), [1, 7]))[0]
    with pytest.raises(SqlError):
        engine.sql("UPDATE w_t SET v = 'x'", "mysql", masks={"v": "'*'"})
    with pytest.raises(PolicyError):
        engine.sql("SELECT k FROM w_t", "mysql", tenant=("n", 10), masks={"n": "0"})
    assert rows(engine.sql("SELECT *, concat(v, '!') AS w FROM (SELECT v, k FROM w_t WHERE v = 'a') q", "mysql", masks={"v": "'*'"})) == []
    assert rows(engine.sql("SELECT t.*, upper(v) AS w FROM w_t t", "mysql", masks={"v": "'x'"}, tenant=("n", 20))) == [(2, "x", 20, "X")]
    with pytest.raises(SqlError):
        engine.sql("SELECT * FROM unknown_table_q", "mysql", masks={"v": "'x'"})


@pytest.mark.parametrize(("sql", "code"), [("SELEC 1", "parse-error"), ("CALL xp_cmdshell('dir')", "dangerous-function"), ("EXEC xp_cmdshell 'dir'", "dangerous-function"), ("GRANT ALL ON t TO u", "deny-ddl"), ("DO SLEEP(5)", "sleep-function"), ("MERGE INTO a USING b ON 1 = 1 WHEN MATCHED THEN DELETE", "always-true-condition"), ("MERGE INTO a USING b ON a.k = b.k WHEN NOT MATCHED BY SOURCE THEN DELETE", "delete-without-where")])
def test_wall_on_other_verbs(sql, code):
    assert code in G.wall(sql)


def test_statement_tables(spark):
    df = spark.createDataFrame([("mysql", "UPDATE t SET a = 1"), ("mysql", "SELECT a FROM b"), ("mysql", "SELECT (")], "dialect string, sql string")
    seen = {r.sql: r.seen for r in inspect_all(df).collect()}
    assert seen["UPDATE t SET a = 1"].codes == ["update-without-where"] and seen["SELECT a FROM b"].tables == ["b:SELECT"] and seen["SELECT a FROM b"].read_only and seen["SELECT ("].codes == ["parse-error"]


def test_paging_styles():
    def adapted(sql, d="oracle"):
        return to_spark(G.adapt_pagination(parse(sql, d)), d)[0]

    assert adapted("SELECT * FROM (SELECT q.*, ROWNUM AS rn FROM (SELECT a FROM t ORDER BY a) q WHERE ROWNUM <= 30) x WHERE rn > 20").endswith("LIMIT 10 OFFSET 20")
    assert adapted("SELECT * FROM (SELECT a, ROW_NUMBER() OVER (ORDER BY a) AS rn FROM t) x WHERE rn BETWEEN 11 AND 20", "sqlserver") == "SELECT a FROM t ORDER BY a LIMIT 10 OFFSET 10"
    assert G.get_limit(parse("SELECT a FROM t WHERE ROWNUM <= 5", "oracle")) == 5 and G.get_offset(parse("SELECT a FROM t LIMIT 3, 4")) == 3
    assert to_spark(G.set_offset(G.set_limit(parse("SELECT a FROM t LIMIT 9"), 4), 2), "mysql")[0] == "SELECT a FROM t LIMIT 4 OFFSET 2"


def test_select_items_and_chains():
    t = G.Rewrites().then(G.add_select_item, "b + 1", "c").then(G.remove_select_item, "a").then(G.set_limit, 3)(parse("SELECT a, b FROM t"))
    assert to_spark(t, "mysql")[0] == "SELECT b, b + 1 AS c FROM t LIMIT 3"
    with pytest.raises(ValueError):
        G.remove_select_item(parse("SELECT a FROM t"), "a")
    original = parse("SELECT a FROM t")
    assert G.clone(original) == original and G.clone(original) is not original and G.parameters("SELECT ? , :x FROM t") == ["?", ":x"]


def test_templates():
    assert G.fill_template("SELECT * FROM ${t} WHERE a = #{x} AND b IN (<y>) AND c = '@x@' AND d = @x@", {"t": "s.t", "x": "it's", "y": [1, 2]}) == "SELECT * FROM s.t WHERE a = 'it''s' AND b IN (1, 2) AND c = '@x@' AND d = 'it''s'"
    assert G.fill_template("SELECT %s FROM %s", [1, "t"]) == "SELECT 1 FROM t"
    for bad in ({"t": "t; DROP TABLE x"}, {}):
        with pytest.raises(SqlError):
            G.fill_template("SELECT * FROM ${t}", bad)


def test_builders(engine, spark):
    q = B.select("k", "count(*) AS n").from_("w_t").right_join("w_s", "w_s.k = w_t.k").where("w_t.n > ?", 1).or_("w_t.k IS NULL").group_by("k").limit(5).offset(2)
    assert q.sql() == "SELECT k, count(*) AS n FROM w_t RIGHT JOIN w_s ON w_s.k = w_t.k WHERE w_t.n > 1 OR w_t.k IS NULL GROUP BY k LIMIT 5 OFFSET 2"
    assert rows(engine.write(B.insert_into("w_t").columns("k", "v").values(9, "i'm").values_expr("4 + 4", "upper('x')")))[-2:] == [(8, "X", None), (9, "i'm", None)]
    assert (9, "z", None) in rows(engine.write(B.update("w_t").set("v", "z").where("k = ?", 9)))
    assert len(rows(engine.write(B.delete_from("w_t").where("k > 2").and_("v IS NOT NULL")))) == 3
    assert B.delete_from("a").where("b = 1").sql() == "DELETE FROM a WHERE b = 1" and B.concat([B.select("1"), B.update("t").set("a", 2)]) == "SELECT 1;\nUPDATE t SET a = 2"
    assert to_spark(B.select("a").from_("t").where(B.or_all("x = 1", B.and_all("y = 2", "z = 3"))).build(), "spark")[0] == "SELECT a FROM t WHERE x = 1 OR y = 2 AND z = 3"


def test_row_patterns(engine, spark):
    engine.add("w_p", spark.createDataFrame([(1, i, p) for i, p in enumerate([5, 3, 2, 4, 6, 6, 1, 2])], "g int, i int, p int"))
    v = "SELECT * FROM w_p MATCH_RECOGNIZE (PARTITION BY g ORDER BY i MEASURES A.p AS top, LAST(DOWN.p) AS low, COUNT(*) AS n, SUM(UP.p) AS s {rows} PER MATCH AFTER MATCH SKIP PAST LAST ROW PATTERN (A DOWN+ UP+) DEFINE DOWN AS DOWN.p < PREV(DOWN.p), UP AS UP.p > PREV(UP.p)) m"
    assert rows(engine.sql(v.format(rows="ONE ROW"), "oracle")) == [(1, 1, 5, 2, 5, 10.0), (1, 2, 6, 1, 3, 2.0)]
    every = engine.sql(v.format(rows="ALL ROWS"), "oracle")
    assert [r.classifier for r in every.orderBy("i").collect()] == ["A", "DOWN", "DOWN", "UP", "UP", "A", "DOWN", "UP"]
    from quillon.operators import patterns

    anchored = patterns.match_recognize(spark.table("w_p"), ["g"], ["i"], {"B": "p > 1"}, "B $".replace(" $", ""), {"at": "FIRST(i)"})
    assert anchored.count() == 7
    ends = patterns.match_recognize(spark.createDataFrame([(1, i, c) for i, c in enumerate("VCVC")], "g int, i int, c string"), ["g"], ["i"], {"V": "c = 'V'", "C": "c = 'C'"}, "(V C)$", {"at": "FIRST(i)"})
    assert [r.at for r in ends.collect()] == [2]

import pytest

from quillon.engine import Engine, PolicyError
from quillon.plans import govern as G
from quillon.plans.emit import to_spark
from quillon.plans.parser import parse


def text(tree, d="mysql"):
    return to_spark(tree, d)[0]


def test_stat():
    s = G.stat("WITH c AS (SELECT id FROM orders) SELECT c.id, MAX(u.age) AS top FROM c JOIN db.users u ON u.id = c.id WHERE u.age > 3 GROUP BY c.id ORDER BY top")
    assert s.tables == {"orders": {"SELECT"}, "db.users": {"SELECT"}} and {"id", "age", "top"} <= s.columns and s.functions == {"MAX"}
    assert s.read_only and "u.age > 3" in s.conditions
    assert G.stat("UPDATE t SET a = 1 WHERE b = 2").tables == {"t": {"UPDATE"}}
    assert G.tables("DELETE FROM a WHERE x IN (SELECT y FROM b)") == ["a", "b"]


@pytest.mark.parametrize(("sql", "want"), [("SELECT 1", True), ("SELECT a FROM t FOR UPDATE", False), ("SELECT a INTO b FROM t", False), ("SELECT a INTO OUTFILE 'f' FROM t", False), ("INSERT INTO t VALUES (1)", False), ("SELECT 1; DROP TABLE t", False), ("-- x", True)])
def test_read_only(sql, want):
    assert G.is_read_only(sql) is want


@pytest.mark.parametrize(("sql", "codes"), [
    ("SELECT id FROM t WHERE a = 1", []), ("SELECT id FROM t WHERE a = 1 OR 1 = 1", ["always-true-condition"]), ("SELECT id FROM t WHERE name LIKE '%_%' OR x = 1", ["always-true-condition"]), ("SELECT id FROM t WHERE 'a' = 'A'", ["always-true-condition"]),
    ("DELETE FROM t", ["delete-without-where"]), ("UPDATE t SET a = 1", ["update-without-where"]), ("DROP TABLE t", ["deny-ddl"]), ("SELECT 1; SELECT 2", ["multi-statement"]), ("SELECT 1 -- x", ["comment-bypass"]),
    ("SELECT SLEEP(3)", ["sleep-function"]), ("SELECT LOAD_FILE('x')", ["dangerous-function"]), ("SELECT a INTO OUTFILE 'f' FROM t", ["into-outfile"]), ("SELECT ((", ["parse-error"]), ("SELECT a FROM t WHERE a = a", ["always-true-condition"]),
])
def test_wall(sql, codes):
    assert G.wall(sql) == codes


def test_wall_options():
    c = G.WallConfig(union=False, select_only=True, information_schema=False, max_tables=1, deny_tables=["secret"], required_columns={"orders": "tenant"}, rules=[lambda s: "custom" if "x" in repr(s) else None])
    assert G.wall("SELECT 1 UNION SELECT 2", "mysql", c) == ["deny-union"]
    assert set(G.wall("SELECT a FROM secret, orders", "mysql", c)) >= {"too-many-tables", "deny-table", "missing-where-column"}
    assert "information-schema" in G.wall("SELECT a FROM information_schema.tables", "mysql", c)
    assert G.wall("SELECT a FROM t", "mysql", G.WallConfig(allow_tables=["u"])) == ["allow-table"]


def test_inject():
    t = G.inject(parse("SELECT * FROM a LEFT JOIN b ON a.id = b.id WHERE a.x = 1 OR a.y = 2"), "tenant", 7)
    assert text(t) == "SELECT * FROM a LEFT JOIN b ON a.id = b.id AND b.tenant = 7 WHERE (a.x = 1 OR a.y = 2) AND a.tenant = 7"
    t = G.inject(parse("WITH c AS (SELECT * FROM a) SELECT * FROM c WHERE id IN (SELECT id FROM b x)"), "tenant", "t'1")
    assert text(t) == "WITH c AS (SELECT * FROM a WHERE a.tenant = 't\\'1') SELECT * FROM c WHERE id IN (SELECT id FROM b AS x WHERE x.tenant = 't\\'1')"
    assert text(G.inject(parse("SELECT * FROM a, b"), "tenant", 7, only=["B"])) == "SELECT * FROM a CROSS JOIN b WHERE b.tenant = 7"
    assert G.inject(parse("INSERT INTO t (a) VALUES (1)"), "tenant", 7).columns == ["a", "tenant"]


def test_changes():
    assert text(G.replace_table(parse("SELECT t.a FROM s.T t JOIN u ON u.a = t.a"), "u", "x.v")) == "SELECT t.a FROM s.T AS t INNER JOIN x.v AS u ON u.a = t.a"
    assert text(G.replace_column(parse("SELECT t.a FROM t WHERE a = 1"), "a", "b")) == "SELECT t.b FROM t WHERE b = 1"
    assert text(G.mask_columns(parse("SELECT u.phone, name AS n FROM u UNION ALL SELECT phone, 'x' FROM v"), {"phone": "sha2({}, 256)", "n": "'***'"})) == "SELECT sha2(u.phone, 256) AS phone, '***' AS n FROM u UNION ALL SELECT sha2(phone, 256) AS phone, 'x' FROM v"
    assert text(G.page(parse("SELECT a FROM t UNION SELECT b FROM u"), 3, 10)).endswith("LIMIT 10 OFFSET 20")
    assert text(G.page(parse("SELECT a FROM t LIMIT 5"), 0, 0)) == "SELECT * FROM (SELECT a FROM t LIMIT 5) AS page LIMIT 1"
    assert G.get_limit(G.add_limit(parse("SELECT a FROM t LIMIT 5"), 9)) == 5 and G.get_limit(G.add_limit(parse("SELECT a FROM t"), 9)) == 9
    assert text(G.and_where(parse("SELECT a FROM t WHERE x = 1 OR y = 2"), "z = 3")) == "SELECT a FROM t WHERE (x = 1 OR y = 2) AND z = 3"
    cols = {"t": ["a", "b"], "u": ["c"]}
    assert text(G.expand_star(parse("SELECT x.*, u.* FROM t x JOIN u ON 1 = 1"), cols.get)) == "SELECT x.a, x.b, u.c FROM t AS x INNER JOIN u ON 1 = 1"
    assert text(G.expand_star(parse("SELECT * FROM t, w"), cols.get)) == "SELECT * FROM t CROSS JOIN w"


def test_bind_and_parameterize():
    t = G.bind(parse("SELECT a FROM t WHERE b IN (?) AND c = ? AND d = ?"), [[1, 2], "x'y", None])
    assert text(t) == "SELECT a FROM t WHERE b IN (1, 2) AND c = 'x\\'y' AND d = NULL"
    assert text(G.bind(parse("SELECT :a + :b"), {"a": -1, "b": 2.5})) == "SELECT -1 + 2.5"
    with pytest.raises(ValueError):
        G.bind(parse("SELECT ?"), [float("nan")])
    with pytest.raises(ValueError):
        G.bind(parse("SELECT ?"), [])
    tree, values = G.parameterize(parse("SELECT a FROM t WHERE b = 'x' AND c > 5"))
    assert text(tree) == "SELECT a FROM t WHERE b = ? AND c > ?" and values == ["x", 5]


@pytest.mark.parametrize(("e", "want"), [("1 + 2 * 3", 7), ("'A' = 'a'", True), ("1 / 0", None), ("NULL <=> NULL", True), ("NOT (1 > 2)", True), ("2 IN (1, 2)", True), ("5 BETWEEN 1 AND 3", False), ("NULL IS NULL", True)])
def test_evaluate(e, want):
    from quillon.plans.parser import parse_expr

    assert G.evaluate(parse_expr(e)) == want


def test_engine_policy(spark):
    with pytest.raises(PolicyError):
        Engine(spark).sql("DELETE FROM t", wall=G.WallConfig())

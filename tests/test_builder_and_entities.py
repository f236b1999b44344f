from pyspark.sql import functions as F

from quillon.plans.builder import Query
from quillon.sources import encodings
from quillon.sources.entities import Entity, Field, creation_order


def test_builder(spark):
    q = Query("c.id", "count(*) AS n").from_("orders", "o").left_join("customers", "c.id = o.cid", "c").where("o.x > ? OR o.y = ?", 3, "a'b").where_in("o.k", [1, 2]).group_by("c.id").having("count(*) > 1").order_by("n DESC").page(2, 10)
    assert q.sql() == "SELECT c.id, count(*) AS n FROM orders AS o LEFT JOIN customers AS c ON c.id = o.cid WHERE (o.x > 3 OR o.y = 'a\\'b') AND o.k IN (1, 2) GROUP BY c.id HAVING count(*) > 1 ORDER BY n DESC LIMIT 10 OFFSET 10"
    assert Query("*").from_(Query("1 AS a"), "t").union(Query("2")).sql() == "SELECT * FROM (SELECT 1 AS a) AS t UNION SELECT 2"
    assert spark.sql(Query("a").with_("w", Query("1 AS a")).from_("w").where_if(False, "a = 2").sql()).first()[0] == 1


def test_entities(spark):
    e = Entity("demo_user", [Field("id", "bigint", key=True), Field("name", "string", required=True, comment="it's"), Field("amount", "decimal(10,2)"), Field("boss", "bigint", references="demo_user"), Field("dept", "bigint", references="dept")])
    assert e.schema()["name"].nullable is False and e.schema()["amount"].dataType.simpleString() == "decimal(10,2)"
    assert e.create_table().startswith("CREATE TABLE IF NOT EXISTS demo_user (id BIGINT NOT NULL, name STRING NOT NULL COMMENT 'it\\'s', amount DECIMAL(10,2)")
    assert e.insert([{"id": 1, "name": "a'b"}, {"id": 2}]) == "INSERT INTO demo_user (id, name) VALUES (1, 'a\\'b'), (2, NULL)"
    assert e.select_by_key(7).endswith("WHERE id = 7") and e.update_by_key({"id": 1, "name": "x"}) == "UPDATE demo_user SET name = 'x' WHERE id = 1" and e.delete_by_key(3) == "DELETE FROM demo_user WHERE id = 3"
    assert [x.table for x in creation_order([e, Entity("dept", [Field("id", "bigint", key=True)])])] == ["dept", "demo_user"]


def test_encodings(spark):
    texts = {"UTF-8": "é中", "GB18030": "中文内容测试", "UTF-16LE": "plain text", "ISO-8859-1": "caf\xe9 au lait"}
    for name, t in texts.items():
        assert encodings.detect(t.encode(name)) == name and encodings.decode(t.encode(name)) == t
    assert encodings.decode(b"\xef\xbb\xbfx") == "x" and encodings.detect(b"") == "UTF-8"
    df = spark.createDataFrame([(bytearray("中文内容测试".encode("gb18030")),), (None,)], "b binary").select(encodings.decode_column(F.col("b")).alias("d"))
    assert [(r.d.encoding if r.d else None) for r in df.collect()] == ["GB18030", None]

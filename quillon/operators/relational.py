"""Relational queries in the dialects that the front end accepts, each with the SQL that checks it.

MONEY is exact: sums over decimals don't depend on the order of rows, and become doubles last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

REV = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(14,2))"


def q(name: str, dialect: str, sql: str, oracle: str | None = None, **options) -> None:
    """Register a query; the oracle is the same text unless the dialect's differs from plain SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = {k: options[k] for k in ("keys", "partitions") if k in options}
        return Engine(spark, sf_dir, **own).sql(sql, dialect, **{k: v for k, v in options.items() if k not in own})

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle or sql


TOPN = f"""
WITH sales AS (
  SELECT n.n_name, l.l_partkey, SUM({REV}) AS revenue FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  GROUP BY n.n_name, l.l_partkey),
ranked AS (SELECT n_name, l_partkey, revenue, SUM(revenue) OVER (PARTITION BY n_name) AS total, ROW_NUMBER() OVER (PARTITION BY n_name ORDER BY revenue DESC, l_partkey) AS rn FROM sales)
SELECT r.n_name, p.p_name, r.rn, CAST(r.revenue AS DOUBLE) AS revenue, CAST(r.total AS DOUBLE) AS nation_total FROM ranked r JOIN part p ON p.p_partkey = r.l_partkey WHERE r.rn <= 3
"""
q("topn_share", "postgres", TOPN)

# --- projection and predicates
q("filter_project", "ansi", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
q("star_except", "hive", "SELECT * EXCEPT (c_acctbal) FROM customer", "SELECT * EXCLUDE (c_acctbal) FROM customer")
q("star_replace", "clickhouse", "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation", "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation")
q("distinct_rows", "mysql", "SELECT DISTINCTROW o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
q("distinct_on", "postgres", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderkey DESC")
q("prewhere", "clickhouse", "SELECT l_orderkey, l_linenumber FROM lineitem PREWHERE l_quantity > 45 WHERE l_returnflag = 'R'", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
q("having", "ansi", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
q("qualify", "clickhouse", "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders QUALIFY rn <= 2")
q("qualify_hidden", "hive", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
q("null_safe_join", "mysql", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN nation b ON NULLIF(a.n_regionkey, 2) <=> NULLIF(b.n_regionkey, 2) AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN nation b ON NULLIF(a.n_regionkey, 2) IS NOT DISTINCT FROM NULLIF(b.n_regionkey, 2) AND a.n_nationkey < b.n_nationkey")
q("is_distinct", "postgres", "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'O') IS DISTINCT FROM 'F'")
q("like_escape", "ansi", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S!_%' ESCAPE '!'")
q("ilike", "postgres", "SELECT p_partkey FROM part WHERE p_name ILIKE '%E%' OR p_brand ILIKE 'brand#1%'")
q("regexp_op", "postgres", "SELECT p_partkey FROM part WHERE p_brand ~ '#[12]' AND p_type !~* 'steel'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12]') AND NOT regexp_matches(p_type, '(?i)steel')")
q("similar_to", "postgres", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)%'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).*')")
q("between_in", "ansi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_linestatus NOT IN ('F')")
q("in_subquery", "ansi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
q("row_in", "ansi", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT o_custkey, 'F' FROM orders WHERE o_orderpriority = '1-URGENT')")
q("exists", "ansi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
q("not_exists", "ansi", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
q("scalar_subquery", "ansi", f"SELECT c_custkey, (SELECT CAST(SUM({dec('o_totalprice')}) AS DOUBLE) FROM orders o WHERE o.o_custkey = c.c_custkey) AS spent FROM customer c")
q("any_quantifier", "mysql", "SELECT p_partkey FROM part WHERE p_size >= ANY (SELECT p_size FROM part WHERE p_brand = 'Brand#11')", "SELECT p_partkey FROM part WHERE p_size >= (SELECT min(p_size) FROM part WHERE p_brand = 'Brand#11')")
q("all_quantifier", "mysql", "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part WHERE p_size IS NOT NULL)", "SELECT p_partkey FROM part WHERE p_size >= (SELECT max(p_size) FROM part)")
q("xor", "mysql", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' XOR o_orderpriority = '1-URGENT'", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_orderpriority = '1-URGENT')")
q("pipes_or", "mysql", "SELECT n_name FROM nation WHERE n_regionkey = 1 || n_nationkey = 7", "SELECT n_name FROM nation WHERE n_regionkey = 1 OR n_nationkey = 7")
q("overlaps", "postgres", "SELECT o_orderkey FROM orders WHERE (CAST(o_orderdate AS DATE), DATE '1997-01-01') OVERLAPS (DATE '1996-06-01', DATE '1996-09-01')", "SELECT o_orderkey FROM orders WHERE LEAST(CAST(o_orderdate AS DATE), DATE '1997-01-01') < DATE '1996-09-01' AND DATE '1996-06-01' < GREATEST(CAST(o_orderdate AS DATE), DATE '1997-01-01')")
q("case_forms", "ansi", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size_class, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
q("casts", "postgres", "SELECT o_orderkey, o_totalprice::bigint AS whole, o_custkey::text AS cust FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS VARCHAR) AS cust FROM orders")
q("integer_arithmetic", "ansi", "SELECT o_orderkey, o_custkey % 7 AS m, o_custkey & 6 AS a, o_custkey | 1 AS b, -o_custkey AS neg FROM orders", "SELECT o_orderkey, o_custkey % 7 AS m, o_custkey & 6 AS a, o_custkey | 1 AS b, -o_custkey AS neg FROM orders")
q("div_operator", "mysql", "SELECT o_orderkey, o_custkey DIV 10 AS tens FROM orders", "SELECT o_orderkey, o_custkey // 10 AS tens FROM orders")
q("caret_power", "postgres", "SELECT n_nationkey, n_nationkey ^ 2 AS sq FROM nation", "SELECT n_nationkey, power(n_nationkey, 2) AS sq FROM nation")
q("least_nulls", "mysql", "SELECT n_nationkey, GREATEST(n_nationkey, NULLIF(n_regionkey, 1)) AS g, LEAST(n_nationkey, 5) AS l FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE GREATEST(n_nationkey, n_regionkey) END AS g, LEAST(n_nationkey, 5) AS l FROM nation")
q("concat_nulls", "postgres", "SELECT n_nationkey, concat(n_name, NULLIF(n_name, 'FRANCE'), '!') AS c FROM nation")
q("array_ops", "postgres", "SELECT n_nationkey FROM nation WHERE ARRAY[n_nationkey, n_regionkey] @> ARRAY[n_regionkey] AND ARRAY[n_nationkey] && ARRAY[1, 2, 3]", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 2, 3)")
q("ci_collation", "mysql", "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE utf8mb4_general_ci = 'building'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
q("bound_parameters", "mysql", "SELECT o_orderkey FROM orders WHERE o_custkey IN (?) AND o_totalprice > ?", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13) AND o_totalprice > 1000", args=[[1, 2, 3, 5, 8, 13], 1000])
q("named_parameters", "oracle", "SELECT n_name FROM nation WHERE n_regionkey = :region AND n_name <> :name", "SELECT n_name FROM nation WHERE n_regionkey = 3 AND n_name <> 'FRANCE'", args={"region": 3, "name": "FRANCE"})

# --- joins
q("join_inner", "ansi", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING'")
q("join_left", "ansi", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
q("join_right", "ansi", "SELECT c.c_custkey, n.n_name FROM customer c RIGHT JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9000")
q("join_full", "ansi", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_nationkey = c.c_nationkey AND c.c_acctbal > 9500")
q("join_cross", "ansi", "SELECT r.r_name, s.s_suppkey FROM region r CROSS JOIN supplier s")
q("join_using", "ansi", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)")
q("join_natural", "ansi", "SELECT doc_id, toxic FROM (SELECT doc_id, lang FROM documents) d NATURAL JOIN labels")
q("join_semi", "hive", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
q("join_anti", "hive", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
q("join_right_semi", "clickhouse", "SELECT c_custkey FROM orders RIGHT SEMI JOIN customer ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
q("join_right_anti", "clickhouse", "SELECT c_custkey FROM orders RIGHT ANTI JOIN customer ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
q("straight_join", "mysql", "SELECT n_name, r_name FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
q("cross_apply", "sqlserver", "SELECT c.c_custkey, x.o_orderkey FROM customer c CROSS APPLY (SELECT TOP 2 o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderkey) x", "SELECT c_custkey, o_orderkey FROM (SELECT c.c_custkey, o.o_orderkey, ROW_NUMBER() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderkey) AS rn FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey) t WHERE rn <= 2")
q("outer_apply", "sqlserver", "SELECT c.c_custkey, x.n FROM customer c OUTER APPLY (SELECT COUNT(*) AS n FROM orders o WHERE o.o_custkey = c.c_custkey) x", "SELECT c.c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
q("oracle_outer", "oracle", "SELECT n.n_name, s.s_suppkey FROM nation n, supplier s WHERE n.n_nationkey = s.s_nationkey(+)", "SELECT n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey")
q("legacy_outer", "sqlserver", "SELECT n.n_name, s.s_suppkey FROM nation n, supplier s WHERE n.n_nationkey *= s.s_nationkey", "SELECT n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey")
q("odbc_outer", "ansi", "SELECT n.n_name, s.s_suppkey FROM {oj nation n LEFT OUTER JOIN supplier s ON n.n_nationkey = s.s_nationkey}", "SELECT n.n_name, s.s_suppkey FROM nation n LEFT OUTER JOIN supplier s ON n.n_nationkey = s.s_nationkey")
q("informix_outer", "ansi", "SELECT r.r_name, n.n_name FROM region r, OUTER nation n WHERE r.r_regionkey = 1", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE r.r_regionkey = 1")
q("nested_on", "ansi", "SELECT o.o_orderkey, n.n_name FROM orders o JOIN customer c JOIN nation n ON n.n_nationkey = c.c_nationkey ON c.c_custkey = o.o_custkey WHERE n.n_regionkey = 2", "SELECT o.o_orderkey, n.n_name FROM orders o JOIN (customer c JOIN nation n ON n.n_nationkey = c.c_nationkey) ON c.c_custkey = o.o_custkey WHERE n.n_regionkey = 2")
q("unnest_ordinality", "presto", "SELECT doc_id, w, i FROM labels CROSS JOIN UNNEST(ARRAY[quality, toxic]) WITH ORDINALITY AS u(w, i)", "SELECT doc_id, quality AS w, 1 AS i FROM labels UNION ALL SELECT doc_id, toxic, 2 FROM labels")
q("lateral_view", "hive", "SELECT event_id, k FROM events LATERAL VIEW explode(array(event_type, 'any')) e AS k", "SELECT event_id, event_type AS k FROM events UNION ALL SELECT event_id, 'any' FROM events")

# --- aggregation
q("group_by", "ansi", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS qty, CAST(SUM({REV}) AS DOUBLE) AS revenue, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
q("global_aggregate", "sqlserver", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS hi FROM orders GROUP BY ()", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS hi FROM orders")
q("rollup", "mysql", "SELECT n_regionkey, n_nationkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey, n_nationkey WITH ROLLUP", "SELECT n_regionkey, n_nationkey, COUNT(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
q("cube", "oracle", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
q("grouping_sets", "ansi", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
q("distinct_aggregate", "ansi", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
q("filter_aggregate", "postgres", "SELECT o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done, COUNT(*) AS n FROM orders GROUP BY o_custkey")
q("group_concat", "mysql", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
q("group_concat_distinct", "mysql", "SELECT o_custkey, GROUP_CONCAT(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS s FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS s FROM orders GROUP BY o_custkey")
q("percentiles", "postgres", "SELECT o_orderstatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_custkey) AS med FROM orders GROUP BY o_orderstatus")
q("quantile_params", "clickhouse", "SELECT l_returnflag, quantile(0.25)(l_quantity) AS q25 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q25 FROM lineitem GROUP BY l_returnflag")
q("keep_last", "oracle", "SELECT o_custkey, MAX(o_totalprice) KEEP (DENSE_RANK LAST ORDER BY o_orderdate) AS latest FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_totalprice) AS latest FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) t WHERE r = 1 GROUP BY o_custkey")
q("arg_max", "clickhouse", "SELECT o_custkey, argMax(o_orderkey, o_orderkey) AS k FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey")
q("ordered_array", "postgres", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name), '/') AS names FROM nation GROUP BY n_regionkey".replace("array_to_string", "array_join"), "SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
q("bool_aggregates", "postgres", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_orderstatus = 'P') AS any_p FROM orders GROUP BY o_custkey")
q("window_funnel", "clickhouse", "SELECT user_id, windowFunnel(86400)(ts, event_type = 'view', event_type = 'click', event_type = 'purchase') AS depth FROM events GROUP BY user_id", """
WITH v AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'view'), c AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), p AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'purchase'),
two AS (SELECT DISTINCT v.user_id FROM v JOIN c ON c.user_id = v.user_id AND c.t > v.t AND c.t <= v.t + 86400), three AS (SELECT DISTINCT v.user_id FROM v JOIN c ON c.user_id = v.user_id AND c.t > v.t JOIN p ON p.user_id = v.user_id AND p.t > c.t AND p.t <= v.t + 86400)
SELECT u.user_id, CASE WHEN three.user_id IS NOT NULL THEN 3 WHEN two.user_id IS NOT NULL THEN 2 WHEN v1.user_id IS NOT NULL THEN 1 ELSE 0 END AS depth FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT DISTINCT user_id FROM v) v1 USING (user_id) LEFT JOIN two USING (user_id) LEFT JOIN three USING (user_id)""")

# --- windows
q("ranking", "ansi", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS tile FROM orders")
q("rank_shares", "ansi", "SELECT o_orderkey, PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pr, CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS cd FROM orders")
q("offsets", "postgres", "SELECT o_orderkey, LAG(o_orderkey) OVER w AS prev, LEAD(o_orderkey, 2) OVER w AS next2, FIRST_VALUE(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
q("window_inheritance", "postgres", "SELECT o_orderkey, COUNT(*) OVER w2 AS n FROM orders WINDOW w AS (PARTITION BY o_custkey), w2 AS (w ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
q("moving_average", "ansi", "SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving FROM orders", "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving FROM orders")
q("range_frame", "ansi", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS near FROM orders")
q("last_ignoring_nulls", "oracle", "SELECT o_orderkey, LAST_VALUE(NULLIF(o_orderstatus, 'O')) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_known FROM orders", "SELECT o_orderkey, LAST_VALUE(NULLIF(o_orderstatus, 'O') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_known FROM orders")
q("share_of_total", "ansi", f"SELECT o_orderkey, CAST(SUM({dec('o_totalprice')}) OVER (PARTITION BY o_custkey) AS DOUBLE) AS total FROM orders")

# --- order, limit, sets
q("order_limit", "mysql", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET 20")
q("fetch_ties", "oracle12", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC FETCH FIRST 5 ROWS WITH TIES", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) t WHERE r <= 5")
q("top_percent", "sqlserver", "SELECT TOP 10 PERCENT o_orderkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) t WHERE r <= ceil(n * 10 / 100.0)")
q("limit_by", "clickhouse", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2 BY o_custkey", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
q("rownum", "oracle", "SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey) t WHERE ROWNUM <= 7", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
q("nulls_order", "postgres", "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 1), n_nationkey) AS place FROM nation", "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 1) NULLS LAST, n_nationkey) AS place FROM nation")
q("paged", "mysql", "SELECT o_orderkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50", page=(3, 25))
q("set_operations", "ansi", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier UNION SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation WHERE n_nationkey < 9")
q("bag_operations", "ansi", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
q("minus", "oracle", "SELECT n_nationkey AS k FROM nation MINUS SELECT s_nationkey FROM supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
q("preferring", "ansi", "SELECT p_partkey FROM part PREFERRING HIGH p_size PLUS LOW p_retailprice", "SELECT p.p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size >= p.p_size AND o.p_retailprice <= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice < p.p_retailprice))")

# --- CTE, recursion, pivot
q("cte_chain", "ansi", "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b(c, k) AS (SELECT n, COUNT(*) FROM a GROUP BY n) SELECT c, k FROM b")
q("recursive_spine", "postgres", "WITH RECURSIVE m(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM m WHERE n < 12) SELECT m.n, COUNT(o.o_orderkey) AS orders FROM m LEFT JOIN orders o ON EXTRACT(MONTH FROM o.o_orderdate) = m.n GROUP BY m.n")
q("connect_by", "oracle", "SELECT n_nationkey, LEVEL AS depth, SYS_CONNECT_BY_PATH(n_name, '/') AS trail, CONNECT_BY_ROOT n_name AS top FROM nation START WITH n_nationkey < 2 CONNECT BY NOCYCLE PRIOR n_nationkey = n_nationkey - 5", "WITH RECURSIVE w AS (SELECT n_nationkey, 1 AS depth, '/' || n_name AS trail, n_name AS top FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n.n_nationkey, w.depth + 1, w.trail || '/' || n.n_name, w.top FROM nation n JOIN w ON w.n_nationkey = n.n_nationkey - 5) SELECT * FROM w")
q("pivot", "oracle", "SELECT * FROM (SELECT o_custkey, o_orderstatus, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey")
QUERIES["pivot"] = lambda spark, d: Engine(spark, d).sql("SELECT * FROM (SELECT o_custkey, o_orderstatus, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "oracle").na.fill(0)
q("unpivot", "sqlserver", "SELECT * FROM labels UNPIVOT (v FOR k IN (quality, toxic))", "SELECT doc_id, 'quality' AS k, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")

# --- analytic families
q("month_over_month", "mysql", "WITH m AS (SELECT DATE_FORMAT(o_orderdate, '%Y-%m') AS ym, COUNT(*) AS n FROM orders GROUP BY DATE_FORMAT(o_orderdate, '%Y-%m')) SELECT ym, n, n - LAG(n) OVER (ORDER BY ym) AS delta FROM m", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, COUNT(*) AS n FROM orders GROUP BY 1) SELECT ym, n, n - LAG(n) OVER (ORDER BY ym) AS delta FROM m")
q("cohorts", "postgres", "WITH f AS (SELECT o_custkey, MIN(EXTRACT(YEAR FROM o_orderdate)) AS cohort FROM orders GROUP BY o_custkey) SELECT f.cohort, EXTRACT(YEAR FROM o.o_orderdate) - f.cohort AS age, COUNT(DISTINCT o.o_custkey) AS customers FROM orders o JOIN f ON f.o_custkey = o.o_custkey GROUP BY f.cohort, EXTRACT(YEAR FROM o.o_orderdate) - f.cohort")
q("gaps_and_islands", "ansi", "WITH d AS (SELECT o_orderkey, o_custkey, o_orderkey - ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS g, o_orderstatus FROM orders) SELECT o_orderstatus, g, MIN(o_orderkey) AS first_key, COUNT(*) AS n FROM d GROUP BY o_orderstatus, g")
q("basket_pairs", "ansi", "SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey")
q("sessions", "postgres", "WITH g AS (SELECT user_id, event_id, CASE WHEN EXTRACT(EPOCH FROM ts) - LAG(EXTRACT(EPOCH FROM ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800 THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, SUM(fresh) AS sessions, COUNT(*) AS n FROM g GROUP BY user_id", "WITH g AS (SELECT user_id, event_id, CASE WHEN floor(epoch(ts)) - LAG(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800 THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, CAST(SUM(fresh) AS BIGINT) AS sessions, COUNT(*) AS n FROM g GROUP BY user_id")
q("transitions", "ansi", "WITH t AS (SELECT event_type, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_type, nxt, COUNT(*) AS n FROM t WHERE nxt IS NOT NULL GROUP BY event_type, nxt")
q("crosstab", "ansi", "SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_orderpriority")
q("integrity_check", "ansi", "SELECT 'orders without customer' AS issue, COUNT(*) AS n FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_custkey IS NULL UNION ALL SELECT 'lines without order', COUNT(*) FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IS NULL UNION ALL SELECT 'repeated order keys', COUNT(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1) d")
q("json_fields", "postgres", "SELECT event_id, CAST(props ->> 'k' AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")

# --- governed queries
q("tenant_inner", "mysql", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 7", tenant=("c_nationkey", 7), tenant_tables=["customer"])
q("tenant_outer", "mysql", "SELECT n.n_name, c.c_custkey FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey", "SELECT n.n_name, c.c_custkey FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = 'BUILDING'", tenant=("c_mktsegment", "BUILDING"), tenant_tables=["customer"])
q("masked_columns", "mysql", "SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, left(c_name, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) AS c_name FROM customer", masks={"c_name": "concat(left({}, 3), repeat('*', length({}) - 7), right({}, 4))"})
q("renamed_table", "mysql", "SELECT t.n_name FROM countries t WHERE t.n_regionkey = 2", "SELECT n_name FROM nation WHERE n_regionkey = 2", tables={"countries": "nation"})

# --- forms that are lowered
q("group_by_distinct", "postgres", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY DISTINCT ROLLUP (o_orderstatus, o_orderpriority), ROLLUP (o_orderstatus)", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
q("group_frame", "postgres", "SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM orders", "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
q("frame_exclusion", "postgres", "SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS s, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS g, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW EXCLUDE TIES) AS t FROM orders",
  "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS g, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW EXCLUDE TIES) AS t FROM orders")
q("siblings_order", "oracle", "SELECT place, n_nationkey FROM (SELECT ROWNUM AS place, n_nationkey FROM (SELECT n_nationkey FROM nation START WITH n_nationkey < 3 CONNECT BY PRIOR n_nationkey = n_nationkey - 5 ORDER SIBLINGS BY n_name DESC))",
  "WITH RECURSIVE w AS (SELECT n_nationkey, [row_number() OVER (ORDER BY n_name DESC)] AS p FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n.n_nationkey, list_append(w.p, 1) FROM nation n JOIN w ON w.n_nationkey = n.n_nationkey - 5) SELECT row_number() OVER (ORDER BY p) AS place, n_nationkey FROM w")
q("search_depth", "postgres", "WITH RECURSIVE t(k, up) AS (SELECT n_nationkey, CAST(NULL AS INT) FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n.n_nationkey, t.k FROM nation n JOIN t ON n.n_nationkey = t.k + 7) SEARCH DEPTH FIRST BY k SET ord SELECT k, up, ROW_NUMBER() OVER (ORDER BY ord) AS place FROM t",
  "WITH RECURSIVE t AS (SELECT n_nationkey AS k, CAST(NULL AS INT) AS up, [n_nationkey] AS ord FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n.n_nationkey, t.k, list_append(t.ord, n.n_nationkey) FROM nation n JOIN t ON n.n_nationkey = t.k + 7) SELECT k, up, ROW_NUMBER() OVER (ORDER BY ord) AS place FROM t")
q("search_breadth", "postgres", "WITH RECURSIVE t(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n.n_nationkey FROM nation n JOIN t ON n.n_nationkey = t.k + 7) SEARCH BREADTH FIRST BY k SET ord SELECT k, ROW_NUMBER() OVER (ORDER BY ord) AS place FROM t",
  "WITH RECURSIVE t AS (SELECT n_nationkey AS k, 1 AS d FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n.n_nationkey, d + 1 FROM nation n JOIN t ON n.n_nationkey = t.k + 7) SELECT k, ROW_NUMBER() OVER (ORDER BY d, k) AS place FROM t")
q("cycle_mark", "postgres", "WITH RECURSIVE t(k, steps) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, t.steps + 1 FROM nation n JOIN t ON n.n_nationkey = (t.k + 10) % 25) CYCLE k SET looped USING trail SELECT k, steps, looped FROM t",
  "WITH RECURSIVE t AS (SELECT 1 AS k, 0 AS steps, false AS looped, [1] AS trail UNION ALL SELECT n.n_nationkey, steps + 1, list_contains(trail, n.n_nationkey), list_append(trail, n.n_nationkey) FROM nation n JOIN t ON n.n_nationkey = (t.k + 10) % 25 AND NOT looped) SELECT k, steps, looped FROM t")
q("json_table", "mysql", "SELECT e.event_id, j.place, j.k FROM events e, JSON_TABLE(concat('[', e.props, ',{\"k\":-1}]'), '$[*]' COLUMNS (place FOR ORDINALITY, k INT PATH '$.k')) AS j", "SELECT event_id, 1 AS place, CAST(json_extract(props, '$.k') AS INT) AS k FROM events UNION ALL SELECT event_id, 2, -1 FROM events")
q("open_json", "sqlserver", "SELECT e.event_id, j.k FROM events e CROSS APPLY OPENJSON(e.props) WITH (k INT '$.k') j", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
q("json_exists", "postgres", "SELECT event_id, props ? 'k' AS a, props ?| ARRAY['x', 'k'] AS b, props ?& ARRAY['x', 'k'] AS c FROM events", "SELECT event_id, list_contains(json_keys(props), 'k') AS a, list_has_any(json_keys(props), ['x', 'k']) AS b, list_has_all(json_keys(props), ['x', 'k']) AS c FROM events")
q("array_slice", "postgres", "SELECT n_nationkey, (ARRAY[n_nationkey, n_regionkey, 7])[2:3] AS part FROM nation".replace("(ARRAY[n_nationkey, n_regionkey, 7])[2:3] AS part", "array_join((ARRAY[n_nationkey, n_regionkey, 7])[2:3], '-') AS part"), "SELECT n_nationkey, n_regionkey || '-7' AS part FROM nation")
q("named_partitions", "mysql", "SELECT o_orderkey FROM orders PARTITION (early, late)", "SELECT o_orderkey FROM orders WHERE o_custkey < 30 OR o_custkey >= 90", partitions={("orders", "early"): "o_custkey < 30", ("orders", "late"): "o_custkey >= 90", ("orders", "other"): "o_custkey BETWEEN 30 AND 89"})
q("match_recognize_sql", "oracle", "SELECT user_id, no, first_id, n_views FROM events MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY ts, event_id MEASURES MATCH_NUMBER() AS no, FIRST(V.event_id) AS first_id, COUNT(V.*) AS n_views ONE ROW PER MATCH PATTERN (V+ C) DEFINE V AS V.event_type = 'view', C AS C.event_type = 'click') m", """
WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER w AS i, lead(event_type) OVER w AS nxt, lag(event_type) OVER w AS prv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, SUM(CASE WHEN event_type = 'view' AND prv IS NOT DISTINCT FROM 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM s),
m AS (SELECT user_id, run, min(i) AS i, arg_min(event_id, i) AS first_id, COUNT(*) AS n_views, arg_max(nxt, i) AS behind FROM r WHERE event_type = 'view' GROUP BY user_id, run)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS no, first_id, n_views FROM m WHERE behind = 'click'""")

# --- writes, as the state of the table behind them
q("sql_update", "mysql", "UPDATE orders SET o_orderstatus = 'X', o_custkey = o_custkey + 1 WHERE o_totalprice > 200000", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
q("sql_update_join", "sqlserver", "UPDATE orders SET o_orderpriority = c.c_mktsegment FROM customer c WHERE c.c_custkey = orders.o_custkey AND c.c_nationkey = 3", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN c.c_custkey IS NULL THEN o_orderpriority ELSE c.c_mktsegment END AS o_orderpriority FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_nationkey = 3")
q("sql_delete", "postgres", "DELETE FROM orders USING customer c WHERE c.c_custkey = orders.o_custkey AND c.c_acctbal < 0", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
q("sql_insert", "ansi", "INSERT INTO nation (n_nationkey, n_name, n_regionkey) SELECT r_regionkey + 100, upper(r_name), r_regionkey FROM region", "SELECT * FROM nation UNION ALL SELECT r_regionkey + 100, upper(r_name), r_regionkey FROM region")
q("sql_upsert", "postgres", "INSERT INTO nation AS n (n_nationkey, n_name, n_regionkey) VALUES (1, 'ONE', 4), (90, 'NEW', 2) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = EXCLUDED.n_name || '!'", "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'ONE!' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 90, 'NEW', 2")
q("sql_replace", "mysql", "REPLACE INTO region (r_regionkey, r_name) VALUES (0, 'ZERO'), (9, 'NINE')", "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'ZERO' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'NINE'", keys={"region": ["r_regionkey"]})
q("sql_merge", "oracle", "MERGE INTO supplier t USING (SELECT c_custkey AS k, c_name AS nm, c_nationkey AS nk, c_acctbal AS b FROM customer WHERE c_custkey <= 2 * (SELECT MAX(s_suppkey) FROM supplier)) s ON t.s_suppkey = s.k WHEN MATCHED AND s.b < 0 THEN DELETE WHEN MATCHED THEN UPDATE SET s_name = s.nm, s_acctbal = t.s_acctbal + s.b WHEN NOT MATCHED AND s.b > 5000 THEN INSERT (s_suppkey, s_name, s_nationkey) VALUES (s.k, s.nm, s.nk)",
  "WITH s AS (SELECT c_custkey AS k, c_name AS nm, c_nationkey AS nk, c_acctbal AS b FROM customer WHERE c_custkey <= 2 * (SELECT MAX(s_suppkey) FROM supplier)) SELECT coalesce(t.s_suppkey, s.k) AS s_suppkey, coalesce(s.nm, t.s_name) AS s_name, coalesce(t.s_nationkey, s.nk) AS s_nationkey, CASE WHEN s.k IS NULL THEN t.s_acctbal ELSE t.s_acctbal + s.b END AS s_acctbal FROM supplier t FULL JOIN s ON t.s_suppkey = s.k WHERE (t.s_suppkey IS NOT NULL AND (s.k IS NULL OR s.b >= 0)) OR (t.s_suppkey IS NULL AND s.b > 5000)")
q("sql_returning", "postgres", "DELETE FROM orders WHERE o_totalprice < 5000 RETURNING o_orderkey, o_custkey", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice < 5000")
q("sql_insert_all", "oracle", "INSERT FIRST WHEN r_regionkey < 2 THEN INTO region (r_regionkey, r_name) VALUES (r_regionkey + 10, r_name) WHEN r_regionkey < 4 THEN INTO nation (n_nationkey, n_regionkey) VALUES (r_regionkey + 50, r_regionkey) ELSE INTO region (r_regionkey, r_name) VALUES (r_regionkey + 20, r_name) SELECT r_regionkey, r_name FROM region", "SELECT * FROM (VALUES ('region', 3), ('nation', 2)) t(target, n)")

# --- governed in every place
q("tenant_pivot", "oracle", "SELECT * FROM (SELECT o_custkey, o_orderstatus FROM orders) PIVOT (COUNT(*) FOR o_orderstatus IN ('F' AS f))", "SELECT o_custkey, NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey", tenant=("o_orderpriority", "1-URGENT"))
q("tenant_view", "hive", "SELECT event_id, k FROM events LATERAL VIEW explode(array(event_type, 'any')) e AS k", "SELECT event_id, event_type AS k FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'any' FROM events WHERE event_type = 'view'", tenant=("event_type", "view"))
q("tenant_delete", "mysql", "DELETE FROM orders WHERE o_custkey < 100", "SELECT * FROM orders WHERE NOT (o_custkey < 100 AND o_orderstatus = 'F')", tenant=("o_orderstatus", "F"))
q("tenant_update", "mysql", "UPDATE orders SET o_totalprice = ? WHERE o_custkey = ?", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_custkey = 7 AND o_orderstatus = 'F' THEN 1.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders", args=[1.5, 7], tenant=("o_orderstatus", "F"))
q("tenant_insert", "mysql", "INSERT INTO nation (n_nationkey, n_name) SELECT n_nationkey + 100, n_name FROM nation", "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, 2 FROM nation WHERE n_regionkey = 2", tenant=("n_regionkey", 2))
q("masked_star", "mysql", "SELECT * FROM (SELECT c_custkey, c_name AS n, upper(c_name) AS u FROM customer WHERE c_name LIKE '%#%') t", "SELECT c_custkey, '***' AS n, '***' AS u FROM customer WHERE FALSE", masks={"c_name": "'***'"})
q("masked_everywhere", "mysql", "SELECT c.*, upper(c.c_name) AS u FROM customer c", "SELECT c_custkey, 'x' || c_custkey AS c_name, c_nationkey, c_acctbal, c_mktsegment, 'X' || c_custkey AS u FROM customer", masks={"c_name": "concat('x', c_custkey)"})

"""Function queries: each applies a family of functions to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import convert as V
from ..functions import crypto as K
from ..functions import dates as D
from ..functions import ids as I
from ..functions import masking as M
from ..functions import numbers as N
from ..functions import strings as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, source: str, columns, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(*columns())

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle


add("string_tests", "customer", lambda: ["c_custkey", S.is_blank("c_name").alias("blank"), S.contains_any("c_name", "#19").alias("any"), S.index_of_ignore_case("c_name", "ER#").alias("at"), S.is_all_upper("c_mktsegment").alias("up"), S.is_mixed_case("c_name").alias("mixed"), S.starts_with_ignore_case("c_name", "CUST").alias("starts"), S.length("c_name").alias("n")],
    "SELECT c_custkey, c_name IS NULL OR regexp_full_match(c_name, '\\s*') AS blank, regexp_matches(c_name, '[#19]') AS any, instr(lower(c_name), 'er#') - 1 AS at, regexp_full_match(c_mktsegment, '[A-Z]+') AS up, regexp_matches(c_name, '[a-z]') AND regexp_matches(c_name, '[A-Z]') AS mixed, starts_with(lower(c_name), 'cust') AS starts, length(c_name) AS n FROM customer")
add("string_parts", "customer", lambda: ["c_custkey", S.substring_before("c_name", "#").alias("a"), S.substring_after("c_name", "#").alias("b"), S.substring("c_name", -4, -1).alias("c"), S.truncate("c_name", 5, "...").alias("d"), S.replace_once("c_name", "0", "_").alias("e"), S.mid("c_name", 2, 3).alias("f"), S.substring_between("c_name", "C", "#").alias("g"), S.delete_any("c_name", "0#").alias("h"), S.substring_before_last("c_name", "0").alias("i"), S.substring_after_last("c_name", "0").alias("j")],
    "SELECT c_custkey, split_part(c_name, '#', 1) AS a, substr(c_name, instr(c_name, '#') + 1) AS b, substr(c_name, length(c_name) - 3, 3) AS c, substr(c_name, 1, 5) || '...' AS d, regexp_replace(c_name, '0', '_') AS e, substr(c_name, 3, 3) AS f, regexp_extract(c_name, 'C(.*?)#', 1) AS g, translate(c_name, '0#', '') AS h, regexp_replace(c_name, '0[^0]*$', '') AS i, CASE WHEN instr(c_name, '0') > 0 THEN regexp_extract(c_name, '[^0]*$') ELSE '' END AS j FROM customer")
add("string_case", "part", lambda: ["p_partkey", S.upper_first("p_name").alias("a"), S.lower_first("p_brand").alias("b"), S.to_camel(F.regexp_replace("p_name", "\\s+", "_")).alias("c"), S.camel_to(F.lit("orderLineItem")).alias("d"), S.escape_html(F.concat(F.lit("<b>"), "p_name", F.lit("&</b>"))).alias("e"), S.to_full_width("p_brand").alias("f"), S.to_half_width(S.to_full_width("p_brand")).alias("g"), S.trim_all_whitespace("p_type").alias("h")],
    "SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS a, lower(substr(p_brand, 1, 1)) || substr(p_brand, 2) AS b, (SELECT string_agg(CASE WHEN i = 1 THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END, '' ORDER BY i) FROM (SELECT unnest(string_split(lower(regexp_replace(p_name, '\\s+', '_', 'g')), '_')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i)) AS c, 'order_line_item' AS d, '&lt;b&gt;' || replace(p_name, '&', '&amp;') || '&amp;&lt;/b&gt;' AS e, list_aggregate(list_transform(string_split(p_brand, ''), lambda x: CASE WHEN x = ' ' THEN chr(12288) WHEN ord(x) BETWEEN 33 AND 126 THEN chr(CAST(ord(x) + 65248 AS INT)) ELSE x END), 'string_agg', '') AS f, p_brand AS g, regexp_replace(p_type, '\\s+', '', 'g') AS h FROM part")
add("date_parts", "orders", lambda: ["o_orderkey", D.format_date("o_orderdate", "yyyy/MM/dd").alias("a"), D.format_date(D.next_day("o_orderdate", 3), "yyyy-MM-dd").alias("b"), D.format_date(D.add_months(F.col("o_orderdate").cast("date"), 1), "yyyy-MM-dd").alias("c"), D.gap_days("o_orderdate", F.lit("1995-06-17").cast("timestamp_ntz")).alias("d"), D.gap_months("o_orderdate", F.lit("1995-06-17").cast("date")).alias("e"), D.is_leap_year(F.year("o_orderdate")).alias("f"), D.days_of_month(F.year("o_orderdate"), F.month("o_orderdate")).alias("g"), D.format_date(D.first_day_of_last_month("o_orderdate"), "yyyy-MM-dd").alias("h"), D.format_date(D.last_day_of_last_month("o_orderdate"), "yyyy-MM-dd").alias("i")],
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS a, strftime(CAST(o_orderdate AS DATE) + 3, '%Y-%m-%d') AS b, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS c, CAST(abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-06-17')) // 86400000 AS BIGINT) AS d, abs((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 6) AS e, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS f, day(last_day(CAST(o_orderdate AS DATE))) AS g, strftime(date_trunc('month', CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH), '%Y-%m-%d') AS h, strftime(last_day(CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE)), '%Y-%m-%d') AS i FROM orders")
add("decimal_strings", "orders", lambda: ["o_orderkey", N.cut(F.col("o_totalprice").cast("decimal(14,2)").cast("string"), 1).cast("double").alias("a"), N.cut_up(F.col("o_totalprice").cast("decimal(14,2)").cast("string"), 1).cast("double").alias("b"), N.add("o_custkey", F.lit("0.25"), 1).cast("double").alias("c"), N.multiply("o_custkey", F.lit("1.5"), 2).cast("double").alias("d"), N.compare("o_custkey", F.lit("500")).alias("e"), N.hex_to_decimal(F.hex("o_custkey")).alias("f"), N.is_number(F.col("o_custkey").cast("string")).alias("g"), N.remove_end_zeros(F.lit("10.500")).alias("h"), N.divide("o_custkey", F.lit("8"), 2).cast("double").alias("i")],
    "SELECT o_orderkey, CAST(floor(CAST(o_totalprice AS DECIMAL(14,2)) * 10) AS DOUBLE) / 10 AS a, CAST(ceil(CAST(o_totalprice AS DECIMAL(14,2)) * 10) AS DOUBLE) / 10 AS b, o_custkey + 0.2::DOUBLE AS c, o_custkey * 1.5::DOUBLE AS d, CAST(sign(o_custkey - 500) AS INT) AS e, CAST(o_custkey AS VARCHAR) AS f, true AS g, '10.5' AS h, floor(o_custkey * 100 / 8) / 100 AS i FROM orders")
add("masks", "customer", lambda: ["c_custkey", M.mask("c_name", 3, 4).alias("a"), M.name("c_mktsegment").alias("b"), M.email(F.concat("c_mktsegment", F.lit("@example.com"))).alias("c"), M.ip(F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("c_custkey") % 256).cast("string"), F.lit("7"))).alias("d"), M.password("c_name").alias("e"), M.mask_all("c_mktsegment").alias("f"), M.mask(F.lit("ab"), 3, 4).alias("g")],
    "SELECT c_custkey, left(c_name, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) AS a, left(c_mktsegment, 1) || repeat('*', length(c_mktsegment) - 2) || right(c_mktsegment, 1) AS b, left(c_mktsegment, 1) || repeat('*', length(c_mktsegment) - 1) || '@example.com' AS c, '10.0.*.*' AS d, '******' AS e, repeat('*', length(c_mktsegment)) AS f, 'a*' AS g FROM customer")
add("mask_documents", "documents", lambda: ["doc_id", F.sha2(M.mask("text", 6, 4), 256).alias("h")],
    "SELECT doc_id, sha256(CASE WHEN length(text) <= 1 THEN repeat('*', length(text)) WHEN length(text) <= 10 THEN left(text, 1) || repeat('*', length(text) - 1) ELSE left(text, 6) || repeat('*', length(text) - 10) || right(text, 4) END) AS h FROM documents")
add("hashes", "customer", lambda: ["c_custkey", K.md5("c_name").alias("a"), K.sha256("c_name").alias("b"), K.base64_encode("c_name").alias("c"), K.base64_decode(K.base64_encode("c_name")).alias("d"), K.is_base64(K.base64_encode("c_name")).alias("e"), K.hex_text(F.col("c_name").cast("binary")).alias("f"), K.sha1("c_name").alias("g")],
    "SELECT c_custkey, md5(c_name) AS a, sha256(c_name) AS b, base64(encode(c_name)) AS c, c_name AS d, true AS e, lower(hex(c_name)) AS f, sha1(c_name) AS g FROM customer")
add("array_functions", "documents", lambda: ["doc_id", A.size(F.split("text", " ")).alias("a"), A.first(F.split("text", " ")).alias("b"), A.count_matches(F.split("text", " "), lambda x: F.length(x) > 5).alias("c"), F.size(A.remove_all(F.split("text", " "), "the")).alias("d"), A.exists(F.split("text", " "), lambda x: x == "the").alias("e"), F.size(A.remove_one(F.split("text", " "), "the")).alias("f")],
    "SELECT doc_id, len(string_split(text, ' ')) AS a, string_split(text, ' ')[1] AS b, len(list_filter(string_split(text, ' '), lambda x: length(x) > 5)) AS c, len(list_filter(string_split(text, ' '), lambda x: x <> 'the')) AS d, list_contains(string_split(text, ' '), 'the') AS e, len(string_split(text, ' ')) - CASE WHEN list_contains(string_split(text, ' '), 'the') THEN 1 ELSE 0 END AS f FROM documents")


def encryption_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "0123456789abcdef"
    return table(spark, sf_dir, "nation").select("n_nationkey", K.aes_decrypt(K.aes_encrypt("n_name", key), key).alias("name"))


QUERIES["encryption_round_trip"] = encryption_round_trip
ORACLES["encryption_round_trip"] = "SELECT n_nationkey, n_name AS name FROM nation"

add("string_defaults", "events", lambda: ["event_id", S.default_string(F.nullif("event_type", F.lit("view")), "none").alias("d"), S.any_empty("event_type", F.nullif("event_type", F.lit("click"))).alias("any"), S.all_empty("event_type", "props").alias("every"), S.equals(F.nullif("event_type", F.lit("view")), F.lit(None).cast("string")).alias("same"), S.is_space(F.lit(" ")).alias("space"), S.contains("event_type", "ic").alias("has"), S.null_to_empty(F.nullif("event_type", F.lit("view"))).alias("e")],
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS d, event_type = 'click' AS any, false AS every, event_type = 'view' AS same, true AS space, contains(event_type, 'ic') AS has, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS e FROM events")
add("string_parts", "customer", lambda: ["c_custkey", S.left("c_name", 4).alias("l"), S.right("c_name", 4).alias("r"), S.reverse("c_mktsegment").alias("b"), S.repeat("c_mktsegment", 2, "-").alias("two"), S.trim_suffix("c_mktsegment", "Y").alias("ts"), S.trim_prefix("c_mktsegment", "B").alias("tp"), S.clean_value(F.concat(F.lit('"'), "c_name", F.lit('"'))).alias("q"), S.replace("c_name", "#", "/").alias("s"), S.path_equals(F.concat(F.lit("/a/./"), "c_custkey"), F.concat(F.lit("/a/b/../"), "c_custkey")).alias("p"), S.mapping_path(F.lit("a//b"), "c_custkey").alias("m")],
    "SELECT c_custkey, left(c_name, 4) AS l, right(c_name, 4) AS r, reverse(c_mktsegment) AS b, c_mktsegment || '-' || c_mktsegment AS two, rtrim(c_mktsegment, 'Y') AS ts, ltrim(c_mktsegment, 'B') AS tp, c_name AS q, replace(c_name, '#', '/') AS s, true AS p, '/a/b/' || c_custkey || '/' AS m FROM customer")
add("string_templates", "orders", lambda: ["o_orderkey", S.lenient_format(F.lit("%s of %s"), "o_orderkey", "o_custkey", "o_orderstatus").alias("f"), S.replace_placeholder(F.lit("{} and {} and {}"), "{}", "o_orderkey", "o_custkey").alias("p"), S.replace_variables(F.lit("<${k}> ${ c }${none}"), {"k": F.col("o_orderkey"), "c": F.col("o_custkey")}).alias("v"), S.from_unicode_escapes(F.concat(F.lit("\\u0041"), "o_orderkey")).alias("u"), S.remove_amount_point(F.concat("o_custkey", F.lit(".56"))).alias("a"), S.format_amount("o_custkey").alias("m")],
    "SELECT o_orderkey, o_orderkey || ' of ' || o_custkey || ' [' || o_orderstatus || ']' AS f, o_orderkey || ' and ' || o_custkey || ' and {}' AS p, '<' || o_orderkey || '> ' || o_custkey || 'null' AS v, 'A' || o_orderkey AS u, CAST(o_custkey + 1 AS VARCHAR) AS a, format('¥{:,}.00', o_custkey) AS m FROM orders")
add("number_steps", "orders", lambda: ["o_orderkey", N.increase_step(F.concat("o_custkey", F.lit(".50")), 7).alias("up"), N.average("o_custkey", "o_orderkey", 1).alias("avg"), N.compare_abs(-F.col("o_custkey"), F.lit(700)).alias("cmp"), N.accuracy_all(F.lit("1.200")).alias("acc"), N.to_unsigned(-F.col("o_custkey")).alias("u"), N.digits_of(F.concat(F.lit("no "), "o_custkey")).alias("digits"), N.first_number(F.concat(F.lit("a"), "o_custkey", F.lit("b12"))).alias("first"), N.add_all("o_custkey", F.lit(None).cast("long"), F.lit(2)).alias("sum"), N.is_coin_amount(F.col("o_custkey").cast("string")).alias("coin"), N.deduct_fee("o_custkey", 0.25, 2).alias("fee")],
    "SELECT o_orderkey, o_custkey || '.57' AS up, CASE WHEN (o_custkey + o_orderkey) % 2 = 1 THEN ((o_custkey + o_orderkey) // 2) || '.5' ELSE CAST((o_custkey + o_orderkey) // 2 AS VARCHAR) END AS avg, CAST(sign(o_custkey - 700) AS INT) AS cmp, 3 AS acc, CAST(o_custkey AS VARCHAR) AS u, CAST(o_custkey AS VARCHAR) AS digits, CAST(o_custkey AS VARCHAR) AS first, o_custkey + 2 AS sum, true AS coin, rtrim(rtrim(CAST(CAST(o_custkey * 0.75 AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') AS fee FROM orders")
add("conversions", "orders", lambda: ["o_orderkey", V.to_int(F.concat(F.lit(" "), "o_custkey", F.lit(".9"))).alias("i"), V.to_long(F.lit("1,234")).alias("l"), V.to_boolean("o_orderstatus", False).alias("b"), V.number_of_boolean(F.lit("yes")).alias("n"), V.to_double("o_orderstatus", -1.0).alias("d"), V.to_filled_string(F.nullif("o_orderstatus", F.lit("F")), "-").alias("s"), V.to_binary_text(F.col("o_custkey") % 256).alias("bits"), F.date_format(V.to_date(F.date_format("o_orderdate", "yyyy/MM/dd")), "yyyy-MM-dd").alias("at")],
    "SELECT o_orderkey, CAST(o_custkey AS INT) AS i, 1234 AS l, false AS b, 1 AS n, CAST(-1 AS DOUBLE) AS d, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE o_orderstatus END AS s, right(lpad(format('{:b}', o_custkey % 256), 8, '0'), 8) AS bits, strftime(o_orderdate, '%Y-%m-%d') AS at FROM orders")
add("time_spans", "events", lambda: ["event_id", D.to_unit(F.col("event_id") * 3_600_000, "day").alias("days"), D.past("ts", "hour", F.col("ts").cast("timestamp") + F.expr("INTERVAL 90 MINUTES")).alias("hours"), D.past_text(F.col("event_id") % 100 * 61_000).alias("span"), D.month_and_day(F.month("ts"), F.day("ts")).alias("md"), D.hour_of("ts").alias("h"), D.day_of("ts").alias("d")],
    "SELECT event_id, event_id // 24 AS days, 1 AS hours, CASE WHEN event_id % 100 = 0 THEN '' ELSE (CASE WHEN event_id % 100 * 61 >= 3600 THEN (event_id % 100 * 61 // 3600) || '小时' ELSE '' END) || (CASE WHEN event_id % 100 * 61 % 3600 >= 60 THEN (event_id % 100 * 61 % 3600 // 60) || '分钟' ELSE '' END) || (CASE WHEN event_id % 100 * 61 % 60 > 0 THEN (event_id % 100 * 61 % 60) || '秒' ELSE '' END) END AS span, strftime(ts, '%m%d') AS md, hour(ts) AS h, day(ts) AS d FROM events")
add("short_codes", "orders", lambda: ["o_orderkey", (I.decode62(I.encode62("o_orderkey")) == F.col("o_orderkey")).alias("back"), F.length(I.encode62("o_orderkey")).alias("n"), I.is_uuid7(I.uuid7_monotonic(F.lit(1_700_000_000_000))).alias("v7"), (F.unix_millis(I.uuid7_time(I.uuid7_monotonic(F.lit(1_700_000_000_000)))) == 1_700_000_000_000).alias("t7"), (I.ulid_of_bytes(I.ulid_bytes(I.ulid(F.lit(1_700_000_000_000), F.col("o_orderkey")))) == I.ulid(F.lit(1_700_000_000_000), F.col("o_orderkey"))).alias("ulid"), I.hex_id("o_orderkey").alias("hex")],
    "SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN true END AS back, CASE WHEN o_orderkey < 1 THEN NULL WHEN o_orderkey < 62 THEN 1 WHEN o_orderkey < 3844 THEN 2 WHEN o_orderkey < 238328 THEN 3 ELSE 4 END AS n, true AS v7, true AS t7, true AS ulid, format('{:x}', o_orderkey) AS hex FROM orders")
add("array_places", "nation", lambda: ["n_nationkey", A.get(F.array("n_nationkey", "n_regionkey"), 1, -1).alias("one"), A.get(F.array("n_nationkey"), 5, -1).alias("other"), A.is_index_valid(F.array("n_nationkey"), 0).alias("valid"), A.contains(F.array("n_nationkey", "n_regionkey"), 3).alias("has"), F.array_join(A.reverse(F.array("n_nationkey", "n_regionkey")), "-").alias("back"), A.deep_equals(F.array("n_nationkey"), F.array("n_regionkey")).alias("same"), F.array_join(A.convert(F.array("n_nationkey"), lambda x: x * 2), "").alias("twice"), A.is_not_empty(F.array("n_name")).alias("full")],
    "SELECT n_nationkey, n_regionkey AS one, -1 AS other, true AS valid, n_nationkey = 3 OR n_regionkey = 3 AS has, n_regionkey || '-' || n_nationkey AS back, n_nationkey = n_regionkey AS same, CAST(n_nationkey * 2 AS VARCHAR) AS twice, true AS full FROM nation")

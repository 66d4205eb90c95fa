"""Predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as Q
from .registry import Tables, query


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_brand NOT LIKE '%#1%' AND p_size BETWEEN 5 AND 20 AND p_type IN (SELECT p_type FROM part WHERE p_size = 7)")
def predicate_like_between_in(t: Tables) -> DataFrame:
    some = t.part.filter("p_size = 7").select("p_type")
    return t.part.filter("p_name like '%e%' and p_brand not like '%#1%' and p_size between 5 and 20").join(some, "p_type", "left_semi").select("p_partkey", "p_name")


@query("SELECT event_id FROM events WHERE regexp_matches(event_type, '^[cp].*e?') AND (value IS NULL OR value % 2 < 1)")
def predicate_regex(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type").rlike("^[cp].*e?") & (F.col("value").isNull() | (F.col("value") % 2 < 1))).select("event_id")


@query("SELECT s_suppkey, nullif(s_nationkey, 3) IS NOT DISTINCT FROM NULL AS missing, (s_acctbal > 0) IS TRUE AS positive, NOT (s_acctbal > 5000) AS low, xor(s_nationkey, 5) AS mixed FROM supplier")
def predicate_null_safe(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).eqNullSafe(F.lit(None)).alias("missing"), F.coalesce(F.col("s_acctbal") > 0, F.lit(False)).alias("positive"), (~(F.col("s_acctbal") > 5000)).alias("low"), F.col("s_nationkey").bitwiseXOR(F.lit(5)).alias("mixed"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS state, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS class, coalesce(nullif(o_orderstatus, 'F'), '-') AS rest, greatest(o_custkey, 50) AS g, least(o_custkey, 50) AS l, if(o_custkey > 50, 'y', 'n') AS big FROM orders")
def fn_conditional(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("part")
    size = F.when(F.col("o_totalprice") > 200000, 2).when(F.col("o_totalprice") > 100000, 1).otherwise(0)
    return t.orders.select("o_orderkey", state.alias("state"), size.alias("class"), F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("-")).alias("rest"), F.greatest("o_custkey", F.lit(50)).alias("g"), F.least("o_custkey", F.lit(50)).alias("l"), F.when(F.col("o_custkey") > 50, "y").otherwise("n").alias("big"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS lo, length(p_name)::INT AS n, left(p_name, 3) AS l3, right(p_name, 3) AS r3, substr(p_name, 2, 4) AS mid, trim('  ' || p_brand || ' ') AS tr, lpad(p_size::VARCHAR, 5, '0') AS lp, rpad(p_size::VARCHAR, 5, '*') AS rp, repeat(left(p_name, 1), 3) AS rep, reverse(p_brand) AS rev, replace(p_name, 'e', '_') AS rpl, translate(p_name, 'aeiou', '12345') AS tr2, instr(p_name, 'a')::INT AS pos, concat_ws('-', p_brand, p_type) AS joined, starts_with(p_name, 'P') AS sw, ascii(p_name) AS code, chr(65 + p_size % 26) AS letter FROM part")
def fn_string_basic(t: Tables) -> DataFrame:
    n, size = F.col("p_name"), F.col("p_size").cast("string")
    return t.part.select("p_partkey", F.upper(n).alias("u"), F.lower("p_brand").alias("lo"), F.length(n).alias("n"), F.left(n, F.lit(3)).alias("l3"), F.right(n, F.lit(3)).alias("r3"), F.substring(n, 2, 4).alias("mid"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("tr"), F.lpad(size, 5, "0").alias("lp"), F.rpad(size, 5, "*").alias("rp"), F.repeat(F.left(n, F.lit(1)), 3).alias("rep"), F.reverse("p_brand").alias("rev"), F.replace(n, F.lit("e"), F.lit("_")).alias("rpl"), F.translate(n, "aeiou", "12345").alias("tr2"), F.instr(n, "a").alias("pos"), F.concat_ws("-", "p_brand", "p_type").alias("joined"), F.startswith(n, F.lit("P")).alias("sw"), F.ascii(n).alias("code"), F.char(65 + F.col("p_size") % 26).alias("letter"))


@query("SELECT c_custkey, split_part(c_name, '#', 2) AS part2, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_name, '[0-9]', 'x', 'g') AS masked, md5(c_name) AS m, sha256(c_name) AS s, hex(c_name) AS h, to_base64(c_name::BLOB) AS b, levenshtein(c_name, c_mktsegment)::INT AS lev, bit_length(c_name)::INT AS bits, strlen(c_name)::INT AS bytes FROM customer")
def fn_string_regex_hash(t: Tables) -> DataFrame:
    n = F.col("c_name")
    return t.customer.select("c_custkey", F.split_part(n, F.lit("#"), F.lit(2)).alias("part2"), F.regexp_extract(n, "([0-9]+)", 1).alias("digits"), F.regexp_replace(n, "[0-9]", "x").alias("masked"), F.md5(n).alias("m"), F.sha2(n, 256).alias("s"), F.hex(n).alias("h"), F.base64(n).alias("b"), F.levenshtein(n, "c_mktsegment").alias("lev"), F.bit_length(n).alias("bits"), F.octet_length(n).alias("bytes"))


@query("SELECT c_custkey, coalesce(list_position(['AUTOMOBILE', 'BUILDING', 'MACHINERY'], c_mktsegment), 0)::INT AS fld, CASE WHEN c_nationkey BETWEEN 1 AND 3 THEN ['a', 'b', 'c'][c_nationkey] END AS e, left(c_name, 2) || 'XYZ' || substr(c_name, 6) AS ins, CASE WHEN c_name < c_mktsegment THEN -1 WHEN c_name > c_mktsegment THEN 1 ELSE 0 END AS cmp FROM customer")
def fn_string_dialect(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", Q.field(F.col("c_mktsegment"), "AUTOMOBILE", "BUILDING", "MACHINERY").alias("fld"), Q.elt(F.col("c_nationkey"), "a", "b", "c").alias("e"), Q.insert_text(F.col("c_name"), 3, 3, "XYZ").alias("ins"), Q.strcmp(F.col("c_name"), F.col("c_mktsegment")).alias("cmp"))


@query("SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, ceil(l_extendedprice)::BIGINT AS c, floor(l_extendedprice)::BIGINT AS f, round(sqrt(l_extendedprice), 6) AS sq, round(ln(l_extendedprice), 8) AS ln, round(log10(l_extendedprice), 8) AS lg, round(exp(l_discount), 8) AS ex, power(l_linenumber, 3)::DOUBLE AS p, l_orderkey % 7 AS m, l_orderkey // 7 AS d, sign(l_quantity - 25)::INT AS s, trunc(l_extendedprice)::BIGINT AS tr, l_orderkey & 12 AS band, l_orderkey | 3 AS bor, (l_linenumber << 2)::INT AS shl FROM lineitem")
def fn_math(t: Tables) -> DataFrame:
    x, k = F.col("l_extendedprice"), F.col("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.abs(F.col("l_quantity") - 25).alias("a"), F.ceil(x).alias("c"), F.floor(x).alias("f"), F.round(F.sqrt(x), 6).alias("sq"), F.round(F.ln(x), 8).alias("ln"), F.round(F.log10(x), 8).alias("lg"), F.round(F.exp("l_discount"), 8).alias("ex"), F.pow("l_linenumber", F.lit(3)).alias("p"), (k % 7).alias("m"), Q.integer_division(k, F.lit(7)).alias("d"), F.signum(F.col("l_quantity") - 25).cast("int").alias("s"), Q.truncate(x, 0).cast("long").alias("tr"), k.bitwiseAND(F.lit(12)).alias("band"), k.bitwiseOR(F.lit(3)).alias("bor"), F.shiftleft("l_linenumber", 2).alias("shl"))


@query("SELECT event_id, round(sin(value), 8) AS s, round(cos(value), 8) AS c, round(atan(value), 8) AS at, round(atan2(value, 2), 8) AS a2, round(degrees(value), 6) AS deg, round(radians(value), 8) AS rad, round(cbrt(value), 8) AS cb FROM events WHERE value IS NOT NULL")
def fn_trigonometry(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.filter("value is not null").select("event_id", F.round(F.sin(v), 8).alias("s"), F.round(F.cos(v), 8).alias("c"), F.round(F.atan(v), 8).alias("at"), F.round(F.atan2(v, F.lit(2.0)), 8).alias("a2"), F.round(F.degrees(v), 6).alias("deg"), F.round(F.radians(v), 8).alias("rad"), F.round(F.cbrt(v), 8).alias("cb"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q, dayofyear(o_orderdate)::INT AS doy, isodow(o_orderdate)::INT AS dow, weekofyear(o_orderdate)::INT AS w, hour(o_orderdate)::INT AS h, strftime(o_orderdate, '%Y-%m-%d') AS iso, date_trunc('month', o_orderdate)::DATE AS mon, last_day(o_orderdate)::DATE AS last, (o_orderdate + INTERVAL 1 MONTH)::DATE AS next_month, (o_orderdate - INTERVAL 10 DAY)::DATE AS before, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days, epoch(o_orderdate)::BIGINT AS ep, date_trunc('week', o_orderdate)::DATE AS wk, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS yq, make_date(year(o_orderdate), 1, 1) AS jan FROM orders")
def fn_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.quarter(d).alias("q"), F.dayofyear(d).alias("doy"), (F.weekday(d) + 1).alias("dow"), F.weekofyear(d).alias("w"), F.hour(d).alias("h"), F.date_format(d, "yyyy-MM-dd").alias("iso"), F.to_date(F.date_trunc("month", d)).alias("mon"), F.last_day(d).alias("last"), F.add_months(d, 1).alias("next_month"), F.date_sub(d, 10).alias("before"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), Q.since_epoch(d).alias("ep"), Q.week_start(d).alias("wk"), Q.quarter_label(d).alias("yq"), F.make_date(F.year(d), F.lit(1), F.lit(1)).alias("jan"))


@query("SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k, json_extract_string(props, '$.k') AS ks, json_extract_string(props, '$.none') AS missing, json_valid(props) AS ok, json_array_length('[1,2,3]')::INT AS n FROM events")
def fn_json(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", Q.json_number(p, "$.k").alias("k"), F.get_json_object(p, "$.k").alias("ks"), F.get_json_object(p, "$.none").alias("missing"), F.try_parse_json(p).isNotNull().alias("ok"), F.json_array_length(F.lit("[1,2,3]")).alias("n"))


@query("SELECT vec_id, len(embedding)::INT AS n, embedding[1] AS first, list_max(embedding) AS top, list_min(embedding) AS low, list_contains(list_transform(embedding[1:3], lambda x: x > 0), true) AS any_pos, list_sort([label, 3, 1]) AS sorted, list_distinct([label, label])[1] AS one, embedding[1:2] AS head FROM embeddings")
def fn_array(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.size(e).alias("n"), F.element_at(e, 1).alias("first"), F.array_max(e).alias("top"), F.array_min(e).alias("low"), F.exists(F.slice(e, 1, 3), lambda x: x > 0).alias("any_pos"), F.array_sort(F.array("label", F.lit(3), F.lit(1))).alias("sorted"), F.array_distinct(F.array("label", "label"))[0].alias("one"), F.slice(e, 1, 2).alias("head"))


@query("SELECT vec_id, i::INT AS i, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def unnest_ordinality(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x"))


@query("SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2")
def fn_string_words(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.filter("word <> ''").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS i, CAST(c_custkey AS VARCHAR) AS s, CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR AS d, TRY_CAST(c_name AS INTEGER) AS bad, CAST(c_acctbal > 0 AS INTEGER) AS b FROM customer")
def fn_cast(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.rint(b).cast("int").alias("i"), F.col("c_custkey").cast("string").alias("s"), b.cast("decimal(18,2)").cast("string").alias("d"), F.col("c_name").try_cast("int").alias("bad"), (b > 0).cast("int").alias("b"))


@query("SELECT event_id, CASE WHEN a < 256 THEN a || '.' || b || '.1.7' END AS ip, CASE WHEN a < 256 THEN a * 16777216 + b * 65536 + 256 + 7 END AS n FROM (SELECT event_id, (event_id % 300) AS a, (user_id % 250) AS b FROM events)")
def fn_network(t: Tables) -> DataFrame:
    ip = F.concat_ws(".", (F.col("event_id") % 300).cast("string"), (F.col("user_id") % 250).cast("string"), F.lit("1"), F.lit("7"))
    n = t.events.select("event_id", Q.ip_to_number(ip).alias("n"))
    return n.select("event_id", F.when(F.col("n").isNotNull(), Q.number_to_ip(F.col("n"))).alias("ip"), "n")


@query("SELECT i::INT AS i, (DATE '2024-01-01' + i::INT)::DATE AS day FROM range(0, 60) r(i)")
def generate_series(t: Tables) -> DataFrame:
    return t.spark.range(60).select(F.col("id").cast("int").alias("i"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))


@query("SELECT col1 AS k, col0 AS name FROM (VALUES ('a', 1), ('b', 2), (NULL, 3))")
def values_rows(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT k, name FROM VALUES ('a', 1), ('b', 2), (NULL, 3) AS v(name, k)")

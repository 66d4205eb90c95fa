"""Further dialect functions: quoting, bit sets, periods, divisors, patterns and JSON kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import more as Q
from .registry import Tables, query


@query("""SELECT c_custkey, '''' || replace(c_name || '''s', '''', '''''') || '''' AS literal, coalesce('''' || nullif(c_mktsegment, 'BUILDING') || '''', 'NULL') AS nullable,
'"' || replace(c_name, '"', '""') || '"' AS ident, 'plain_1' AS plain, repeat(' ', (c_custkey % 4)::INT) || 'x' AS spaced FROM customer""")
def fn_quote(t: Tables) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    other = F.when(segment != "BUILDING", segment)
    spaced = F.concat(Q.space((F.col("c_custkey") % 4).cast("int")), F.lit("x"))
    return t.customer.select("c_custkey", Q.quote_literal(F.concat(name, F.lit("'s"))).alias("literal"), Q.quote_nullable(other).alias("nullable"), Q.quote_ident(name).alias("ident"), Q.quote_ident(F.lit("plain_1")).alias("plain"), spaced.alias("spaced"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size & 1 > 0 THEN 'a' END, CASE WHEN p_size & 2 > 0 THEN 'b' END, CASE WHEN p_size & 4 > 0 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS chosen,
array_to_string(list_transform(range(0, 6), lambda i: CASE WHEN (p_size >> i::INT) & 1 = 1 THEN 'Y' ELSE 'N' END), '-') AS bits FROM part""")
def fn_bit_sets(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", Q.make_set(F.col("p_size"), "a", "b", "c").alias("chosen"), Q.export_set(F.col("p_size"), "Y", "N", "-", 6).alias("bits"))


@query("SELECT l_orderkey, l_linenumber, gcd(l_partkey, l_orderkey)::BIGINT AS g, lcm(l_partkey, l_suppkey)::BIGINT AS l FROM lineitem")
def fn_divisors(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", Q.gcd(F.col("l_partkey"), F.col("l_orderkey")).alias("g"), Q.lcm(F.col("l_partkey"), F.col("l_suppkey")).alias("l"))


@query("""WITH p AS (SELECT o_orderkey, o_orderdate::DATE AS d, year(o_orderdate) * 100 + month(o_orderdate) AS period FROM orders)
SELECT o_orderkey, strftime((make_date((period // 100)::INT, (period % 100)::INT, 1) + INTERVAL 14 MONTH), '%Y%m')::BIGINT AS later,
date_diff('month', DATE '1990-05-01', d)::BIGINT AS months, date_diff('day', DATE '1970-01-01', d)::INT + 719528 AS days, d::VARCHAR AS back, (make_date(year(d)::INT, 1, 1) + INTERVAL 59 DAY)::DATE::VARCHAR AS sixtieth FROM p""")
def fn_periods(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    period = (F.year(d) * 100 + F.month(d)).cast("long")
    days = Q.to_days(d)
    return t.orders.select("o_orderkey", Q.period_add(period, 14).alias("later"), Q.period_diff(period, F.lit(199005).cast("long")).alias("months"), days.alias("days"), Q.from_days(days).cast("string").alias("back"), Q.make_date(F.year(d), F.lit(60)).cast("string").alias("sixtieth"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '([A-Za-z]+)#([0-9])') THEN [regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 1), regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 2)] END AS found, unnest(string_split_regex(p_type, '[ ]+')) AS word FROM part")
def fn_regexp_tables(t: Tables) -> DataFrame:
    """REGEXP_MATCH, and REGEXP_SPLIT_TO_TABLE as rows."""
    return t.part.select("p_partkey", Q.regexp_match(F.col("p_brand"), "([A-Za-z]+)#([0-9])", 2).alias("found"), F.explode(F.split("p_type", "[ ]+")).alias("word"))


@query("""SELECT event_id, 'object' AS kind, 'number' AS of_id, k AS key, json_extract_string(props, '$.' || k) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)""")
def fn_json_each(t: Tables) -> DataFrame:
    """JSONB_TYPEOF, and JSONB_EACH_TEXT as rows."""
    kinds = t.events.select("event_id", Q.json_kind(F.col("props")).alias("kind"), Q.json_kind(F.col("event_id").cast("string")).alias("of_id"), F.inline(Q.json_entries(F.col("props"))))
    return kinds.select("event_id", "kind", "of_id", "key", "value")

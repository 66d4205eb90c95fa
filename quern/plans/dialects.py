"""Functions that differ between dialects: date formats, times, JSON objects, arrays, ordered sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as Q
from .registry import Tables, query


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%y') AS short, strftime(o_orderdate, '%Y-day %j') AS ordinal, strftime(o_orderdate, '%B %-d, %H:%M:%S') AS long_form, strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS back FROM orders")
def fn_date_format(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", Q.date_format(d, "%d.%m.%y").alias("short"), Q.date_format(d, "%Y-day %j").alias("ordinal"), Q.date_format(d, "%M %e, %H:%i:%s").alias("long_form"), Q.str_to_date(Q.date_format(d, "%d/%m/%Y"), "%d/%m/%Y").alias("back"))


@query("SELECT event_id, lpad((event_id % 90000 // 3600)::VARCHAR, 2, '0') || ':' || lpad((event_id % 90000 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 90000 % 60)::VARCHAR, 2, '0') AS hms, event_id % 90000 AS s FROM events")
def fn_time(t: Tables) -> DataFrame:
    hms = t.events.select("event_id", Q.seconds_to_time(F.col("event_id") % 90000).alias("hms"))
    return hms.select("event_id", "hms", Q.time_to_seconds(F.col("hms")).alias("s"))


@query("SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'name', n_name) AS VARCHAR) AS o, array_to_string(json_keys(json_object('k', n_nationkey, 'name', n_name)), ',') AS keys, CAST(json_object('a', 'x', 'k', n_name) AS VARCHAR) AS put FROM nation")
def fn_json_object(t: Tables) -> DataFrame:
    o = F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    return t.nation.select("n_nationkey", o.alias("o"), F.array_join(Q.json_keys(o), ",").alias("keys"), Q.json_put(F.lit('{"k":"old","a":"x"}'), "k", F.col("n_name")).alias("put"))


@query("SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey), '|') AS names, list(n_nationkey ORDER BY n_nationkey DESC)[1] AS last, len(list(n_name))::INT AS n FROM nation GROUP BY 1")
def agg_array(t: Tables) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    grouped = t.nation.groupBy("n_regionkey").agg(entries.alias("e"))
    return grouped.select("n_regionkey", Q.array_to_text(F.col("e.n_name"), "|").alias("names"), F.element_at("e.n_nationkey", -1).alias("last"), F.size("e").alias("n"))


@query("SELECT vec_id, list_position([label, 7, 9], 7)::INT AS pos, list_concat([label], [1, 2]) AS joined, list_append([1], label) AS appended, list_filter([1, label, 1], lambda x: x <> 1) AS removed, list_has_any([label], [1, 2]) AS shares, list_reverse([label, 10]) AS rev, array_to_string(['a', NULL, 'b'], '-') AS txt, string_split('a,b,c', ',') AS parts FROM embeddings")
def fn_array_edit(t: Tables) -> DataFrame:
    one = F.col("label")
    return t.embeddings.select("vec_id", F.array_position(F.array(one, F.lit(7), F.lit(9)), F.lit(7)).cast("int").alias("pos"), F.concat(F.array(one), F.array(F.lit(1), F.lit(2))).alias("joined"), F.array_append(F.array(F.lit(1)), one).alias("appended"), F.array_remove(F.array(F.lit(1), one, F.lit(1)), F.lit(1)).alias("removed"), F.arrays_overlap(F.array(one), F.array(F.lit(1), F.lit(2))).alias("shares"), F.reverse(F.array(one, F.lit(10))).alias("rev"), Q.array_to_text(F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b")), "-").alias("txt"), F.split(F.lit("a,b,c"), ",").alias("parts"))


@query("""WITH small AS (SELECT p_brand, p_size % 3 AS p_size FROM part), counts AS (SELECT p_brand, p_size, count(*) AS n FROM small GROUP BY ALL)
SELECT p_brand, (SELECT arg_max(c.p_size, c.n * 10 - c.p_size) FROM counts c WHERE c.p_brand = s.p_brand) AS common, quantile_disc(p_size, 0.25) AS q1, quantile_disc(p_size, 0.75) AS q3 FROM small s GROUP BY p_brand""")
def agg_ordered_set(t: Tables) -> DataFrame:
    """PERCENTILE_DISC and MODE; of equally frequent values the least, which needs counts by value."""
    some = t.part.select("p_brand", (F.col("p_size") % 3).alias("p_size"))
    counts = some.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    common = counts.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", -F.col("p_size"))).alias("common"))
    spread = some.groupBy("p_brand").agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size)").cast("int").alias("q1"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY p_size)").cast("int").alias("q3"))
    return common.join(spread, "p_brand")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity >= 40 THEN 7 ELSE floor((l_quantity - 10) * 6 / 30)::INT + 1 END AS b FROM lineitem")
def fn_width_bucket(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", Q.width_bucket(F.col("l_quantity"), 10, 40, 6).alias("b"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, round(100 * o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) > 0 AS above FROM orders")
def window_share(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(w).alias("n"), F.round(100 * F.col("o_totalprice") / F.sum("o_totalprice").over(w), 6).alias("share"), (F.col("o_totalprice") - F.avg("o_totalprice").over(w) > 0).alias("above"))

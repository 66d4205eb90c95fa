"""Aggregates and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import group_concat
from .registry import Tables, query


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc, count(*) AS n, min(l_shipdate)::DATE AS first_day, max(l_tax) AS top_tax FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def agg_basic(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count(F.lit(1)).alias("n"), F.to_date(F.min("l_shipdate")).alias("first_day"), F.max("l_tax").alias("top_tax"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS high, count(value) AS known FROM events GROUP BY event_type")
def agg_distinct_filter(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count(F.when(F.col("value") > 50, 1)).alias("high"), F.count("value").alias("known"))


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 3) AS sd, round(stddev_pop(c_acctbal), 3) AS sdp, round(var_samp(c_acctbal), 1) AS v, round(var_pop(c_acctbal), 1) AS vp FROM customer GROUP BY 1")
def agg_variance(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 3).alias("sd"), F.round(F.stddev_pop("c_acctbal"), 3).alias("sdp"), F.round(F.var_samp("c_acctbal"), 1).alias("v"), F.round(F.var_pop("c_acctbal"), 1).alias("vp"))


@query("SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 8) AS c, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS k FROM lineitem GROUP BY 1")
def agg_regression(t: Tables) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr(y, x), 8).alias("c"), F.round(F.covar_pop(y, x), 2).alias("cp"), F.round(F.covar_samp(y, x), 2).alias("cs"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("icept"), F.round(F.regr_r2(y, x), 8).alias("r2"), F.regr_count(y, x).alias("k"))


@query("SELECT bit_and(l_orderkey) AS a, bit_or(l_orderkey) AS o, bit_xor(l_orderkey) AS x, bool_and(l_quantity > 0) AS every_one, bool_or(l_quantity > 49) AS any_one FROM lineitem")
def agg_bits_bools(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.bit_and("l_orderkey").alias("a"), F.bit_or("l_orderkey").alias("o"), F.bit_xor("l_orderkey").alias("x"), F.bool_and(F.col("l_quantity") > 0).alias("every_one"), F.bool_or(F.col("l_quantity") > 49).alias("any_one"))


@query("SELECT c_nationkey, string_agg(c_name, '; ' ORDER BY c_custkey) AS names FROM customer GROUP BY 1")
def agg_group_concat(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(group_concat(F.col("c_name"), F.col("c_custkey"), "; ").alias("names"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def agg_percentile(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


@query("SELECT o_orderstatus, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY 1")
def agg_arg_extremes(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.max_by("o_orderkey", "o_totalprice").alias("dearest"), F.min_by("o_orderkey", "o_totalprice").alias("cheapest"))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
def group_rollup(t: Tables) -> DataFrame:
    return t.part.rollup("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::TINYINT AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def group_cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").alias("g"), F.count(F.lit(1)).alias("n")).select("o_orderstatus", "o_orderpriority", "g", "n")


@query("SELECT p_brand, p_type, sum(p_size)::BIGINT AS s FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def group_sets(t: Tables) -> DataFrame:
    return t.part.groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.sum("p_size").alias("s"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15 AND sum(o_totalprice) > 1000000")
def group_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s")).filter("n >= 15 and s > 1000000").select("o_custkey", "n")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def group_pivot(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def group_time_bucket(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

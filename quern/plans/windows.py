"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as Q
from .registry import Tables, query


def by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS r, dense_rank() OVER p AS d, ntile(4) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def window_ranking(t: Tables) -> DataFrame:
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", F.row_number().over(by_customer()).alias("rn"), F.rank().over(p).alias("r"), F.dense_rank().over(p).alias("d"), F.ntile(4).over(by_customer()).alias("q"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 1, 0.0) OVER w AS after, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_offsets(t: Tables) -> DataFrame:
    whole = by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(by_customer()).alias("before"), F.lead("o_totalprice", 1, 0.0).over(by_customer()).alias("after"), F.first("o_orderkey").over(by_customer()).alias("first_key"), F.last("o_orderkey").over(whole).alias("last_key"), F.nth_value("o_orderkey", 2).over(whole).alias("second_key"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three, count(*) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_rows_frame(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(by_customer().rowsBetween(-2, 0)), 2).alias("three"), F.count(F.lit(1)).over(by_customer().rowsBetween(-1, 1)).alias("near"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day_before FROM events")
def window_range_frame(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(Q.rounded_epoch(F.col("ts"))).rangeBetween(-86400, 0)
    return t.events.select("event_id", F.count(F.lit(1)).over(w).alias("day_before"))


@query("SELECT p_partkey, round(percent_rank() OVER w, 10) AS pr, round(cume_dist() OVER w, 10) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)")
def window_distribution(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_retailprice")
    return t.part.select("p_partkey", F.round(F.percent_rank().over(w), 10).alias("pr"), F.round(F.cume_dist().over(w), 10).alias("cd"))


@query("SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2")
def window_sessions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(Q.since_epoch(F.col("ts"), "MICROSECOND") - Q.since_epoch(F.lag("ts").over(w), "MICROSECOND") <= 1_800_000_000, 0).otherwise(1)
    return t.events.select("user_id", "ts", "event_id", new.alias("new")).select("user_id", F.sum("new").over(w).alias("session")).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))

"""Joins, subqueries, set operations, sorting and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as Q
from ..operators import relational as R
from .registry import Tables, query


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def flagship_revenue(t: Tables) -> DataFrame:
    orders = t.orders.filter("o_orderdate >= timestamp_ntz'1995-01-01'").select("o_orderkey", "o_custkey")
    rows = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count(F.lit(1)).alias("n_lines")).orderBy(F.desc("revenue"), "n_name").limit(10)


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_inner(t: Tables) -> DataFrame:
    return t.orders.filter("o_totalprice > 200000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def join_left(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return t.customer.join(done, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT n_name, s_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_name")


@query("SELECT s.n AS s_nation, c.n AS c_nation, s.k AS n_suppliers, c.k AS n_customers FROM (SELECT s_nationkey AS n, count(*) AS k FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1) c ON s.n = c.n")
def join_full(t: Tables) -> DataFrame:
    s = t.supplier.groupBy(F.col("s_nationkey").alias("s_nation")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("c_nation")).agg(F.count(F.lit(1)).alias("n_customers"))
    return s.join(c, F.col("s_nation") == F.col("c_nation"), "full").select("s_nation", "c_nation", "n_suppliers", "n_customers")


@query("SELECT r_regionkey, n_nationkey, n_name FROM (SELECT r_regionkey, r_regionkey AS n_regionkey FROM region) r NATURAL JOIN nation")
def join_natural(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", F.col("r_regionkey").alias("n_regionkey")).join(t.nation, "n_regionkey").select("r_regionkey", "n_nationkey", "n_name")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) JOIN customer ON c_custkey = o_custkey WHERE k <= 2")
def join_lateral_top2(t: Tables) -> DataFrame:
    """LATERAL (... ORDER BY ... LIMIT 2) for each customer, as a ranking."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = t.orders.withColumn("k", rank).filter("k <= 2")
    return top.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l.event_id, max(r.event_id) AS earlier_id FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts < l.ts AND r.ts >= l.ts - INTERVAL 1 HOUR GROUP BY l.event_id")
def join_range(t: Tables) -> DataFrame:
    """Events of the hour before, by user. The hour is a second join key, so that a user of very many
    events is split."""
    hour = F.floor(Q.since_epoch(F.col("ts")) / 3600)
    left = t.events.select("event_id", "user_id", "ts").withColumn("hour", F.explode(F.array(hour, hour - 1)))
    right = t.events.select(F.col("event_id").alias("other"), F.col("user_id").alias("other_user"), F.col("ts").alias("other_ts"), hour.alias("other_hour"))
    near = F.expr("user_id = other_user and hour = other_hour and other_ts < ts and other_ts >= ts - interval 1 hour")
    return left.join(right, near).groupBy("event_id").agg(F.max("other").alias("earlier_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def subquery_scalar(t: Tables) -> DataFrame:
    one = t.orders.agg((F.avg("o_totalprice") * 1.8).alias("bound"))
    return t.orders.crossJoin(F.broadcast(one)).filter("o_totalprice > bound").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subquery_correlated(t: Tables) -> DataFrame:
    best = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("best"))
    return t.orders.join(best, F.expr("o_custkey = k and o_totalprice = best")).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 3)")
def subquery_all(t: Tables) -> DataFrame:
    return R.compare_all(t.part, "p_retailprice", ">", t.part.filter("p_size < 3").select(F.col("p_retailprice").alias("x")), "x").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size = 50)")
def subquery_any(t: Tables) -> DataFrame:
    return R.compare_any(t.part, "p_retailprice", "<", t.part.filter("p_size = 50").select(F.col("p_retailprice").alias("x")), "x").select("p_partkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def setop_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def setop_union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def setop_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT c_custkey FROM customer")
def setop_intersect_all(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).intersectAll(t.customer.select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def setop_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def setop_except_all(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).exceptAll(t.customer.select("c_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sort_limit_offset(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10")
def sort_fetch_with_ties(t: Tables) -> DataFrame:
    return R.limit_with_ties(t.part.select("p_partkey", "p_size"), 10, "p_size", descending=True)


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t: Tables) -> DataFrame:
    return R.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_size").distinct()


@query("WITH RECURSIVE s(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM s WHERE n < 50) SELECT n, total FROM s")
def cte_recursive(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE s(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM s WHERE n < 50) SELECT n, total FROM s")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey WHERE total > (SELECT avg(total) FROM big)")
def cte_reused(t: Tables) -> DataFrame:
    big = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    one = big.agg(F.avg("total").alias("mean"))
    return big.crossJoin(F.broadcast(one)).filter("total > mean").join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("c_name", F.round("total", 2).alias("total"))

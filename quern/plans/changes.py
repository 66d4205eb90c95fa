"""Statements that change rows by expressions, other tables or conflicts; null order, natural and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import Tables, query


def _accounts(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.supplier.filter("s_suppkey % 3 > 0").select("s_suppkey", "s_name", "s_nationkey")
    return old, t.supplier.select("s_suppkey", F.concat(F.lit("new "), "s_name").alias("s_name"), (F.col("s_nationkey") + 1).alias("s_nationkey"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE 'new ' || s_name END AS s_name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey + (s_nationkey + 1) * 10 ELSE s_nationkey + 1 END AS s_nationkey FROM supplier")
def dml_on_duplicate(t: Tables) -> DataFrame:
    """ON DUPLICATE KEY UPDATE with an expression over the old and the new row (VALUES())."""
    old, new = _accounts(t)
    return R.on_conflict_update(old, new, ["s_suppkey"], {"s_nationkey": F.col("s_nationkey") + F.col("excluded.s_nationkey") * 10})


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 OR s_nationkey > 10 THEN 'new ' || s_name ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier")
def dml_on_conflict(t: Tables) -> DataFrame:
    """ON CONFLICT DO UPDATE SET name = excluded.name WHERE old.nation > 10."""
    old, new = _accounts(t)
    return R.on_conflict_update(old, new, ["s_suppkey"], {"s_name": F.col("excluded.s_name")}, F.col("s_nationkey") > 10)


@query("SELECT s_suppkey, 'new ' || s_name AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 3 = 0 OR s_nationkey > 10")
def dml_returning(t: Tables) -> DataFrame:
    """RETURNING * of that statement: the rows inserted or changed."""
    old, new = _accounts(t)
    return R.returning(old, R.on_conflict_update(old, new, ["s_suppkey"], {"s_name": F.col("excluded.s_name")}, F.col("s_nationkey") > 10), ["s_suppkey"])


@query("SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def dml_update_from(t: Tables) -> DataFrame:
    """UPDATE supplier SET s_name = n_name FROM nation WHERE ...; multi-table UPDATE."""
    one = t.nation.filter("n_regionkey = 1")
    changed = R.update_from(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), one, F.col("s_nationkey") == F.col("n_nationkey"), {"s_name": F.col("n_name")}, ["s_suppkey"])
    return changed.select("s_suppkey", "s_name")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def dml_delete_using(t: Tables) -> DataFrame:
    """DELETE FROM supplier USING nation WHERE ...; multi-table DELETE."""
    return R.delete_using(t.supplier, t.nation.filter("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE false")
def dml_truncate(t: Tables) -> DataFrame:
    return R.truncate(t.nation.select("n_nationkey", "n_name"))


@query("SELECT k, max(v) AS v FROM (VALUES (1, 'b'), (2, 'z'), (3, 'c'), (3, 'd')) r(k, v) GROUP BY k")
def dml_replace_repeated(t: Tables) -> DataFrame:
    """REPLACE: of repeated new keys the last row stays."""
    old = t.spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'z') AS r(k, v)")
    new = t.spark.sql("SELECT * FROM VALUES (1, 'b'), (3, 'c'), (3, 'd') AS r(k, v)")
    return R.upsert(old, new, ["k"])


@query("SELECT k, v FROM (VALUES (1, 'a'), (2, 'z'), (3, 'c')) r(k, v)")
def dml_ignore_repeated(t: Tables) -> DataFrame:
    """INSERT IGNORE: of repeated new keys the first row is inserted."""
    old = t.spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'z') AS r(k, v)")
    new = t.spark.sql("SELECT * FROM VALUES (1, 'b'), (3, 'c'), (3, 'd') AS r(k, v)")
    return R.insert_ignore(old, new, ["k"])


@query("SELECT c_custkey FROM customer WHERE c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_custkey <> ALL (SELECT o_custkey FROM orders)")
def subquery_equal_any(t: Tables) -> DataFrame:
    """= ANY as a semi join, <> ALL as an anti join that knows nulls."""
    some = R.compare_any(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", "=", t.nation.filter("n_regionkey = 2"), "n_nationkey")
    return R.compare_all(some, "c_custkey", "<>", t.orders, "o_custkey").select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier) UNION ALL SELECT n_nationkey + 100 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 4)")
def subquery_not_in_nulls(t: Tables) -> DataFrame:
    """NOT IN: a null on the right leaves nothing."""
    holes = t.supplier.select(F.nullif("s_nationkey", F.lit(3)).alias("k"))
    none = R.not_in_rows(t.nation.select("n_nationkey"), "n_nationkey", holes, "k")
    some = R.not_in_rows(t.nation.select("n_nationkey"), "n_nationkey", t.supplier.filter("s_nationkey < 4").select(F.col("s_nationkey").alias("k")), "k")
    return none.union(some.select(F.col("n_nationkey") + 100))


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region WHERE r_regionkey < 2) USING (n_regionkey)")
def join_natural_left(t: Tables) -> DataFrame:
    few = t.region.filter("r_regionkey < 2").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return R.natural_join(t.nation, few, "left").select("n_nationkey", "n_name", "r_name")


@query("SELECT n_nationkey, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def join_comma(t: Tables) -> DataFrame:
    """FROM a, b WHERE ...: Catalyst makes an equi-join of it."""
    return t.nation.crossJoin(t.region).filter("n_regionkey = r_regionkey").select("n_nationkey", "r_name")


@query("""WITH e AS (SELECT user_id, ts, event_id FROM events), m AS (SELECT user_id, ts, max(event_id) AS last_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, m.last_id FROM e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts""")
def join_asof(t: Tables) -> DataFrame:
    """As-of join: each event with its user's last purchase up to then."""
    marks = t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return R.asof_join(t.events.select("user_id", "ts", "event_id"), marks, "user_id", "ts", ["last_id"]).select("event_id", "last_id")


@query("SELECT s_suppkey, n.n_name, n.m FROM supplier, LATERAL (SELECT n_name, s_nationkey * 2 AS m FROM nation WHERE n_nationkey = s_nationkey) n")
def join_lateral(t: Tables) -> DataFrame:
    """LATERAL with a correlated sub-plan, by DataFrame.lateralJoin."""
    own = t.nation.where(F.col("n_nationkey") == F.col("s_nationkey").outer()).select("n_name", (F.col("s_nationkey").outer() * 2).alias("m"))
    return t.supplier.lateralJoin(own).select("s_suppkey", "n_name", "m")


@query("SELECT event_id, row_number() OVER (ORDER BY value ASC NULLS FIRST, event_id) AS maria, row_number() OVER (ORDER BY value ASC NULLS LAST, event_id) AS postgres, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS maria_down, row_number() OVER (ORDER BY value DESC NULLS FIRST, event_id) AS postgres_down FROM (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN value END AS value, user_id FROM events) WHERE event_id < 300")
def sort_null_order(t: Tables) -> DataFrame:
    """ORDER BY with NULLS FIRST and LAST, and each dialect's own order, within OVER too."""
    e = t.events.filter("event_id < 300").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("value"))

    def place(dialect: str, down: bool = False):
        return F.row_number().over(Window.partitionBy().orderBy(R.sorted_as("value", dialect, down), "event_id"))

    return e.select("event_id", place("mariadb").alias("maria"), place("postgresql").alias("postgres"), place("mariadb", True).alias("maria_down"), place("postgresql", True).alias("postgres_down"))


@query("SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) ORDER BY k DESC LIMIT 7 OFFSET 2")
def sort_compound(t: Tables) -> DataFrame:
    """ORDER BY, LIMIT and OFFSET on a compound query."""
    both = t.nation.select(F.col("n_nationkey").alias("k")).union(t.region.select("r_regionkey"))
    return both.orderBy(F.desc("k")).offset(2).limit(7)


@query("SELECT n_name FROM nation ORDER BY n_name OFFSET 20")
def sort_offset(t: Tables) -> DataFrame:
    return t.nation.select("n_name").orderBy("n_name").offset(20)


@query("(SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT c_nationkey FROM customer WHERE c_custkey < 10 INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey > 1)")
def setop_chain(t: Tables) -> DataFrame:
    """A chain of branches with their own precedence."""
    left = t.nation.select(F.col("n_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()
    right = t.customer.filter("c_custkey < 10").select("c_nationkey").intersect(t.nation.filter("n_regionkey > 1").select("n_nationkey"))
    return left.exceptAll(right).distinct()


@query("SELECT event_id, sum(n) OVER (ORDER BY day GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS two_days FROM (SELECT event_id, ts::DATE AS day, 1 AS n FROM events)")
def window_groups(t: Tables) -> DataFrame:
    """GROUPS frame: a range over the dense rank, whose groups are counted first."""
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy().orderBy("day")  # one row for each day
    two = days.select("day", F.sum("n").over(order.rowsBetween(-1, 0)).alias("two_days"))
    return t.events.select("event_id", F.to_date("ts").alias("day")).join(two, "day").select("event_id", "two_days")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near FROM orders")
def window_groups_partitioned(t: Tables) -> DataFrame:
    rank = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus"))
    frame = Window.partitionBy("o_custkey").orderBy("g").rangeBetween(-1, 1)
    return t.orders.withColumn("g", rank).select("o_orderkey", F.round(F.sum("o_totalprice").over(frame), 2).alias("near"))


@query("""SELECT l_returnflag, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx, round(regr_sxy(l_extendedprice, l_quantity), 0) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1e9, 4) AS syy,
round(stddev_pop(l_quantity), 8) AS std, round(stddev_samp(l_quantity), 8) AS stddev, round(var_samp(l_quantity), 6) AS variance, any_value(l_returnflag) AS any_value, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS states FROM lineitem GROUP BY 1""")
def agg_more(t: Tables) -> DataFrame:
    """REGR_AVGX, AVGY, SXX, SXY, SYY; STD, STDDEV, VARIANCE; ANY_VALUE; GROUP_CONCAT(DISTINCT)."""
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    states = F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_avgx(y, x), 6).alias("ax"), F.round(F.regr_avgy(y, x), 4).alias("ay"), F.round(F.regr_sxx(y, x), 2).alias("sxx"), F.round(F.regr_sxy(y, x), 0).alias("sxy"), F.round(F.regr_syy(y, x) / 1e9, 4).alias("syy"), F.round(F.stddev_pop(x), 8).alias("std"), F.round(F.stddev(x), 8).alias("stddev"), F.round(F.variance(x), 6).alias("variance"), F.any_value("l_returnflag").alias("any_value"), states.alias("states"))


@query("SELECT n_nationkey, n_nationkey * 2 + 1 AS f, n_nationkey + i AS g FROM nation, (VALUES (0), (1)) r(i)")
def udf_sql(t: Tables) -> DataFrame:
    """CREATE FUNCTION with an SQL body, scalar and table-valued; Catalyst inlines both."""
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quern_twice_and_one(x BIGINT) RETURNS BIGINT RETURN x * 2 + 1")
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quern_two_from(x BIGINT) RETURNS TABLE (g BIGINT) RETURN SELECT x + i FROM VALUES (0), (1) AS r(i)")
    t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey")).createOrReplaceTempView("quern_udf_nation")
    return t.spark.sql("SELECT n_nationkey, quern_twice_and_one(n_nationkey) AS f, g FROM quern_udf_nation, LATERAL quern_two_from(n_nationkey)")


@query("SELECT n_name AS name, n_nationkey AS k FROM nation WHERE n_regionkey = 1")
def ddl_view(t: Tables) -> DataFrame:
    """CREATE VIEW, and DROP VIEW after its plan is taken."""
    t.nation.createOrReplaceTempView("quern_base")
    t.spark.sql("CREATE OR REPLACE TEMPORARY VIEW quern_view (name, k) AS SELECT n_name, n_nationkey FROM quern_base WHERE n_regionkey = 1")
    view = t.spark.table("quern_view")
    t.spark.sql("DROP VIEW quern_view")
    return view


@query("SELECT i::BIGINT AS i FROM generate_series(10, 100, 15) r(i) UNION ALL SELECT date_diff('hour', TIMESTAMP '2024-01-01', ts)::BIGINT FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 7 HOUR) s(ts)")
def generate_series_steps(t: Tables) -> DataFrame:
    """GENERATE_SERIES with start, stop and step over numbers and timestamps, in FROM."""
    numbers = t.spark.range(10, 101, 15).select(F.col("id").alias("i"))
    start, stop, step = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-03").cast("timestamp_ntz"), F.expr("interval 7 hours")
    times = t.spark.range(1).select(F.explode(F.sequence(start, stop, step)).alias("ts"))
    return numbers.union(times.select(F.timestamp_diff("HOUR", start, F.col("ts"))))


@query("WITH RECURSIVE up AS (SELECT n_nationkey AS k, 0 AS d FROM nation WHERE n_nationkey > 20 UNION ALL SELECT k // 2, d + 1 FROM up WHERE k > 0) SELECT k, d::INT AS d FROM up")
def cte_recursive_table(t: Tables) -> DataFrame:
    """WITH RECURSIVE from a table's rows."""
    t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey")).createOrReplaceTempView("quern_recursive_nation")
    return t.spark.sql("WITH RECURSIVE up(k, d) AS (SELECT n_nationkey, 0 FROM quern_recursive_nation WHERE n_nationkey > 20 UNION ALL SELECT k div 2, d + 1 FROM up WHERE k > 0) SELECT k, d FROM up")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 100000)")
def cte_changing(t: Tables) -> DataFrame:
    """A CTE that changes data: rows deleted from one table are inserted into another, here both again."""
    gone = t.orders.filter("o_orderstatus = 'P'")
    left = R.delete(t.orders, F.col("o_orderstatus") == "P")
    return left.unionByName(gone.filter("o_totalprice >= 100000")).select("o_orderkey", "o_totalprice")

"""Data-changing statements as copy-on-write plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import Tables, query


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 10 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(t: Tables) -> DataFrame:
    return R.update(t.supplier.select("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), F.col("s_nationkey") < 10, {"s_acctbal": F.col("s_acctbal") + 100}).drop("s_nationkey")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 25)")
def dml_delete(t: Tables) -> DataFrame:
    return R.delete(t.part.select("p_partkey", "p_size"), F.col("p_size") > 25)


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'new'")
def dml_upsert(t: Tables) -> DataFrame:
    new = t.nation.filter("n_nationkey < 5").select("n_nationkey").union(t.spark.range(1).select(F.lit(100))).withColumn("n_name", F.lit("new"))
    return R.upsert(t.nation.select("n_nationkey", "n_name"), new, ["n_nationkey"])


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'new'")
def dml_insert_ignore(t: Tables) -> DataFrame:
    new = t.nation.filter("n_nationkey < 5").select("n_nationkey").union(t.spark.range(1).select(F.lit(100))).withColumn("n_name", F.lit("new"))
    return R.insert_ignore(t.nation.select("n_nationkey", "n_name"), new, ["n_nationkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey + 10000000, 0.0 FROM orders WHERE o_orderstatus = 'P'")
def dml_insert_select(t: Tables) -> DataFrame:
    some = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return some.unionByName(some.select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice")))

"""Connected components by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b. Each node links its larger (or smaller) neighbours to its least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), a > b: root is the least node of its component."""
    now = written(edges.select("a", "b").distinct(), "edges")
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen or sign[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
        now = written(_star(_star(now, True), False), "edges")

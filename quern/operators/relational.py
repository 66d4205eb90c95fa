"""Relational operators that Spark has no single call for, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (SELECT DISTINCT ON)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def limit_with_ties(df: DataFrame, n: int, order: str, descending: bool = False) -> DataFrame:
    """The first n rows by a column, and all that tie with the last (FETCH FIRST n ROWS WITH TIES).

    A top-k finds the last value kept; the rows up to it follow by a filter, without a global sort.
    """
    edge = (F.min if descending else F.max)("__edge")
    last = df.filter(F.col(order).isNotNull()).select(F.col(order).alias("__edge")).orderBy(F.desc("__edge") if descending else F.asc("__edge")).limit(n).agg(edge.alias("__edge"))
    ok = F.col(order) >= F.col("__edge") if descending else F.col(order) <= F.col("__edge")
    return df.crossJoin(F.broadcast(last)).filter(ok).drop("__edge")  # one row


def compare_any(df: DataFrame, value: str, op: str, others: DataFrame, column: str) -> DataFrame:
    """Rows whose value stands in relation op to some value of others (value op ANY (...))."""
    return _quantified(df, value, op, others, column, some=True)


def compare_all(df: DataFrame, value: str, op: str, others: DataFrame, column: str) -> DataFrame:
    """Rows whose value stands in relation op to all values of others (value op ALL (...)).

    An empty list is true for all rows; a null in it is true for none.
    """
    return _quantified(df, value, op, others, column, some=False)


def _quantified(df: DataFrame, value: str, op: str, others: DataFrame, column: str, some: bool) -> DataFrame:
    if (op, some) in (("=", True), ("<>", False)):
        return in_rows(df, value, others, column) if some else not_in_rows(df, value, others, column)
    if op in ("=", "<>"):  # = ALL, <> ANY: the least and greatest value decide
        one = others.agg(F.min(column).alias("__low"), F.max(column).alias("__high"), F.count(F.lit(1)).alias("__n"), F.count(column).alias("__known"))
        all_same = F.expr(f"{value} = __low and {value} = __high")
        ok = F.expr(f"{value} <> __low or {value} <> __high") if some else (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & all_same)
        return df.crossJoin(F.broadcast(one)).filter(ok).drop("__low", "__high", "__n", "__known")  # one row
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(f"operator {op}")
    low = op in (">", ">=")
    bound = F.min(column) if low == some else F.max(column)
    one = others.agg(bound.alias("__bound"), F.count(F.lit(1)).alias("__n"), F.count(column).alias("__known"))
    hit = F.expr(f"{value} {op} __bound")
    ok = hit if some else (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & hit)
    return df.crossJoin(F.broadcast(one)).filter(ok).drop("__bound", "__n", "__known")  # one row


def in_rows(df: DataFrame, value: str, others: DataFrame, column: str) -> DataFrame:
    """Rows whose value is among others (IN (SELECT ...), = ANY)."""
    return df.join(others.select(F.col(column).alias("__in")), F.col(value) == F.col("__in"), "left_semi")


def not_in_rows(df: DataFrame, value: str, others: DataFrame, column: str) -> DataFrame:
    """Rows whose value is known to be none of others (NOT IN (SELECT ...), <> ALL): a null among others leaves
    none, a null value stays only if there are no others. An anti join by equality and one row of counts, so
    no side is broadcast whole."""
    one = others.agg(F.count(F.lit(1)).alias("__n"), F.count(column).alias("__known"))
    left = df.join(others.select(F.col(column).alias("__in")), F.col(value) == F.col("__in"), "left_anti")
    ok = (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & F.col(value).isNotNull())
    return left.crossJoin(F.broadcast(one)).filter(ok).drop("__n", "__known")  # one row


def group_concat(value: Column, order: Column, separator: str = ",") -> Column:
    """The group's values as text in an order, joined (GROUP_CONCAT ... ORDER BY, STRING_AGG)."""
    parts = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.cast("string").alias("v")))))
    return F.array_join(F.transform(parts, lambda x: x["v"]), separator)


def _one_per_key(source: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool) -> DataFrame:
    """The first or last row of each key; rows with a null in a key conflict with none and all stay."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    whole = F.struct(*(F.col(c) for c in source.columns))
    pick = (F.max_by if last else F.min_by)(whole, F.struct(*order)) if order else (F.max if last else F.min)(whole)
    best = source.filter(known).groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(pick.alias("__row")).select("__row.*")
    return best.unionByName(source.filter(~known))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Rows of source in place of those of target with the same keys, and the rest of both (REPLACE). Of rows
    of source with equal keys the last in `order` wins, without one the greatest."""
    new = _one_per_key(source.select(*target.columns), keys, order, last=True)
    return target.join(new, list(keys), "left_anti").select(*target.columns).unionByName(new)


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """target and those rows of source whose keys it lacks (INSERT IGNORE, ON CONFLICT DO NOTHING). Of rows of
    source with equal keys the first in `order` is inserted, without one the least."""
    new = _one_per_key(source.select(*target.columns), keys, order, last=False)
    return target.unionByName(new.join(target, list(keys), "left_anti").select(*target.columns))


def on_conflict_update(target: DataFrame, source: DataFrame, keys: Sequence[str], values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE SET ... WHERE, ON DUPLICATE KEY UPDATE. values and where are over the
    old row's columns and, as `excluded.name`, those of the new row. Keys of source are different."""
    new = source.select(F.struct(*target.columns).alias("excluded"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"excluded.{k}"))
    both = target.join(new, same, "full_outer")
    met = F.col(f"{keys[0]}").isNotNull() & F.col("excluded").isNotNull()
    changed = met if where is None else met & F.coalesce(where, F.lit(False))
    fresh = F.col(keys[0]).isNull() & F.col("excluded").isNotNull()
    return both.select(*(F.when(fresh, F.col(f"excluded.{c}")).when(changed, values[c] if c in values else F.col(c)).otherwise(F.col(c)).alias(c) for c in target.columns))


def returning(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that a statement has inserted or changed (RETURNING)."""
    same = F.lit(True)
    old = before.select(*(F.col(c).alias(f"__{c}") for c in before.columns))
    for c in before.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return after.join(old, same, "left_anti")


def update_from(target: DataFrame, other: DataFrame, on: Column, values: dict[str, Column], key: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM, multi-table UPDATE: rows of target that other's rows match get new values, of several
    matches the least."""
    hit = target.join(other, on).groupBy(*key).agg(F.min(F.struct(*(v.alias(c) for c, v in values.items()))).alias("__new"))
    return target.join(hit, list(key), "left").select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns))


def delete_using(target: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """DELETE ... USING, multi-table DELETE: target without the rows that other's rows match."""
    return target.join(other, on, "left_anti")


def truncate(target: DataFrame) -> DataFrame:
    """TRUNCATE: the columns of target and no rows."""
    return target.limit(0)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL [LEFT | RIGHT | FULL] JOIN: on all common columns, which come once; none gives all pairs."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def sorted_as(column: str, dialect: str, descending: bool = False) -> Column:
    """ORDER BY with the dialect's place of nulls: MariaDB and SQLite have them least, PostgreSQL greatest."""
    first = (dialect == "postgresql") == descending
    c = F.col(column)
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last())


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str]) -> DataFrame:
    """Each row of left with the values of right's last row of the same key at or before its time: one union,
    one shuffle by key and a running last value. Columns of right are key, time and values."""
    rows = left.select("*", *(F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values), F.lit(1).alias("__side"), F.lit(None).cast("boolean").alias("__hit"))
    marks = right.select(key, time, *(F.col(v).alias(f"__{v}") for v in values), F.lit(0).alias("__side"), F.lit(True).alias("__hit"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.when(F.col("__hit"), F.struct(*(F.col(f"__{v}").alias(v) for v in values)))
    filled = both.withColumn("__last", F.last(packed, ignorenulls=True).over(before)).filter("__side = 1")
    return filled.select(*left.columns, *(F.col(f"__last.{v}").alias(v) for v in values))


def update(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """target with new values in the rows where the condition is true (UPDATE)."""
    return target.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    """target without the rows where the condition is true; false and null rows stay (DELETE)."""
    return target.filter(~F.coalesce(where, F.lit(False)))

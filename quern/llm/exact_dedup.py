"""Operator 3, exact dedup by a tree-merge of sorted digest runs.

Each partition sorts the digests of its rows into a run and merges equal ones. The partitions then
exchange runs in rounds: the partitions' numbers are written in base FAN, and in round r those that
differ in digit r alone swap parts of their runs, by digit r of the digest. Every level merges the
runs that it gets, keeps the smallest (or largest) identifier of equal digests and adds up their
counts. After the last round each digest is in one partition, and a group of a third of all rows has
sent no more than one row from each partition. Runs are ordered by a 64-bit digest; two entries are
taken for equal only if their SHA-256 agree too.

Edge cases: a null text counts as empty. Texts are equal after lower-casing A-Z alone. A row without
doc_id never stays unless its whole group has none; keep_id is then null. Rows that repeat a doc_id
and its text are one document: all of them get the same result, and group_size counts each. An empty
table gives an empty result. Other columns are ignored by exact_dedup. keep_rows keeps them, whatever their
names, and of a group's rows exactly one: of those with the doc_id that stays the one with the smallest hash
of its other columns; rows equal in all columns are one.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import partitions, written

FAN = 8


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _merged(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Merges neighbours with equal digests; the rows come in order of digest."""
    better = max if largest else min
    now: tuple | None = None
    for batch in batches:
        out: list[tuple] = []
        for digest, sha, ident, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "sha", "ident", "n")), strict=True):
            if now and now[0] == digest and now[1] == sha:
                both = [x for x in (now[2], ident) if x is not None]
                now = (digest, sha, better(both) if both else None, now[3] + n)
            else:
                if now:
                    out.append(now)
                now = (digest, sha, ident, n)
        if out:
            yield _batch(out)
    if now:
        yield _batch([now])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["digest", "sha", "ident", "n"])


def merge_runs(rows: DataFrame, largest: bool = False, parts: int | None = None) -> DataFrame:
    """One row for each different sha of rows (digest, sha, ident, n): its best ident and its count."""
    rounds, total = 1, FAN
    while total < (parts or partitions(rows.sparkSession)):
        rounds, total = rounds + 1, total * FAN
    merge = partial(_merged, largest=largest)
    schema = "digest long, sha string, ident long, n long"
    runs = rows.sortWithinPartitions("digest", "sha").mapInArrow(merge, schema)
    for r in range(rounds):
        base = FAN**r
        here = F.pmod(F.spark_partition_id(), F.lit(total))
        digit = F.pmod(F.shiftrightunsigned("digest", 3 * r), F.lit(FAN)).cast("int")
        there = here + (digit - F.pmod(F.floor(here / base).cast("int"), F.lit(FAN))) * base
        runs = runs.withColumn("there", there).repartitionById(total, F.col("there").cast("int")).drop("there").sortWithinPartitions("digest", "sha").mapInArrow(merge, schema)
    return runs


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    slim = docs.select(F.col(id_col).cast("long").alias("ident"), text.alias("text"))
    return slim.select(F.xxhash64("text").alias("digest"), F.sha2("text", 256).alias("sha"), "ident")


def exact_dedup(docs: DataFrame, largest: bool = True) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs), "digests")
    groups = merge_runs(rows.withColumn("n", F.lit(1).cast("long")), largest)
    groups = groups.select(F.col("sha").alias("text_sha256"), F.col("ident").alias("keep_id"), F.col("n").alias("group_size"))
    joined = rows.select(F.col("ident").alias("doc_id"), F.col("sha").alias("text_sha256")).join(groups, "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The row of each group of equal texts that stays. Rows are known by digests of all their columns, and
    texts cross one shuffle, merged before it where they are equal in all columns."""
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    text = F.coalesce("text", F.lit(""))
    own = F.unhex(F.substring(F.sha2(F.concat(F.sha2(text, 256), others), 256), 1, 32))
    sha = F.sha2(ascii_lower(text), 256)
    slim = docs.select(F.xxhash64(ascii_lower(text)).alias("digest"), sha.alias("sha"), F.col("doc_id").cast("long").alias("ident"), own.alias("own"))
    slim = written(slim, "digests")
    groups = merge_runs(slim.select("digest", "sha", "ident", F.lit(1).cast("long").alias("n")), largest).select("sha", F.col("ident").alias("best"))
    best = slim.join(groups, "sha").filter(F.col("ident").eqNullSafe(F.col("best"))).groupBy("sha").agg(F.min("own").alias("own")).select("own")
    rows = docs.select(own.alias("own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    different = rows.groupBy("own").agg(F.first("row").alias("row"))
    return different.join(best.hint("shuffle_hash"), "own", "left_semi").select("row.*")

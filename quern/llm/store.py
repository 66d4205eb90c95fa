"""Tables written in the folder that driver and executors share.

A written table cuts lineage and survives the loss of executors. The folder is the one in
spark.checkpoint.dir; only where that is unset (local tests) a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_paths: list[str] = []
_tables: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _paths.append(f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}-{name}")
    return _paths[-1]


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this driver has written so far; results that are not yet computed from
    them can no longer be."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """For release: how many tables have been written so far."""
    return len(_paths)


def release(spark: SparkSession, since: int) -> None:
    """Deletes the tables written since the mark, but for the last, which was made from them."""
    gone, _paths[since:] = _paths[since:-1], _paths[max(since, len(_paths) - 1) :]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_id(text: F.Column) -> F.Column:
    """128 bits of the SHA-256 of a text: equal for equal texts, for no others in practice."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tid, text) of every row; a null text is the empty text. Other columns are left behind."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.select("doc", text_id(F.col("text")).alias("tid"), "text")


def distinct_texts(texts: DataFrame) -> DataFrame:
    """One row per distinct text: tid, doc (smallest id, null if it has none), copies, text.

    Copies are merged before the shuffle, so a text that fills a third of the rows crosses it
    once per task. The table is bucketed by tid: later joins on tid leave the texts in place.
    """
    spark = texts.sparkSession
    n = partitions(spark)
    grouped = texts.groupBy("tid").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    return bucketed(grouped, "tid", n)


def bucketed(df: DataFrame, by: str, n: int) -> DataFrame:
    """df, written as a table of n buckets, which should be partitioned by `by` like that already."""
    spark = df.sparkSession
    name = f"quern_{uuid.uuid4().hex}"
    _tables.append(name)
    df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, "bucketed")).bucketBy(n, by).saveAsTable(name)
    return spark.table(name)

"""COPY in and out: delimited and plain text files with the options of the COPY statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _options(header: bool, delimiter: str, null: str, quote: str, escape: str) -> dict[str, str]:
    return {"header": str(header).lower(), "sep": delimiter, "nullValue": null, "quote": quote, "escape": escape}


def copy_to(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", null: str = "", quote: str = '"', escape: str = '"') -> None:
    df.write.options(**_options(header, delimiter, null, quote, escape)).mode("overwrite").csv(path)


def copy_from(spark: SparkSession, path: str, schema: StructType, header: bool = True, delimiter: str = ",", null: str = "", quote: str = '"', escape: str = '"') -> DataFrame:
    """Rows of the files by a declared schema; a row that doesn't fit it fails, as COPY does."""
    return spark.read.schema(schema).options(mode="FAILFAST", **_options(header, delimiter, null, quote, escape)).csv(path)

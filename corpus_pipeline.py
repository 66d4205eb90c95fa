"""The corpus pipeline: filters, deduplicates, mixes and packs the documents, stage by stage.

Each stage reads what the one before has written. All but the last return the columns of documents. What the
mixing stage decides is the order of rows in its files, which packing follows.

Edge cases: decisions are made for each row, not for its doc_id. So of rows that share a doc_id, or have
none, each is judged by its own text. A null or empty text has no words and fails the quality rules. Of
repeated rows one stays. Texts of any length are read whole. An empty table gives an empty result. Other
columns, of any name, are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.exact_dedup import keep_rows
from quern.llm.mixing import by_files, file_places, in_order, mix_sources
from quern.llm.packing import cut_documents, pack_in_order
from quern.llm.quality_rules import keep_good
from quern.llm.queries import tokenizer_file
from quern.llm.simhash import near_dedup
from quern.llm.store import written
from quern.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: each row is judged by itself."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    return keep_rows(docs, largest=True)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one with the smallest doc_id: one of three fingerprints of the different words
    within 4 bits and at least 0.8 of the 5-word shingles in common. An edit changes fewer words than
    shingles, so single words bring more near copies within 4 bits."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources are to be mixed."""
    return in_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 2048 tokens, which follow the mix: the order
    of the rows in the files that the stage before has written. Only rows that come from no file, and so
    have no such order, are mixed here."""
    places = file_places(docs)
    cut = written(cut_documents(docs, tokenizer_file("byte_bpe_50k.json"), space="before", end=0, others=places), "cut")
    placed = by_files(cut) if places else mix_sources(cut, key="key")
    return pack_in_order(written(placed.select("doc_id", "slot", "place", F.inline("pieces")), "pieces"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has no suffix arrays, SimHash components, Pfair schedules or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

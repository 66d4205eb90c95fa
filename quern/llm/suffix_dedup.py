"""Operator 7, suffix-array dedup: bytes of strings that occur more than once in the corpus.

Not bucket-pointer refinement by sorting, which needs a row for each byte of the corpus (README says why and
gives figures). Identifiers of strings of 8, 16, ... 256 and 400 bytes are made by doubling from content,
each from those before at a later offset, so equal strings have equal ones on all executors. Of the positions
only a sample that every repeated string contains is exchanged (grams.anchors); those that are alone are
dropped, the others are extended to whole strings (repeats.repeated_windows).

Edge cases: a null or empty text has no bytes and no spans. A text shorter than `length` keeps all
its bytes. Rows with equal texts count as different documents even if their ids are equal or null,
so all of them lose all bytes if they have `length` or more. Texts of any length are cut into
overlapping pieces. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import covered, repeated_windows
from .store import distinct_texts, texts_of

LENGTH = 400
GRAM = 256


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for text, copies, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("copies").to_pylist(), batch.column("found").to_pylist(), strict=True):
            cut = [(0, len(text))] if copies > 1 and len(text) >= length else covered(found, len(text), length)
            at, parts = 0, []
            for lo, to in cut:
                parts.append(text[at:lo])
                at = to
            parts.append(text[at:])
            sizes.append(len(text))
            removed.append(sum(to - lo for lo, to in cut))
            spans.append([{"from": lo, "to": to} for lo, to in cut])
            kept.append(b"".join(parts))
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["tid", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeated_bytes(base: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per distinct text of base (store.distinct_texts): tid, n_bytes, n_removed, spans, kept."""
    found = repeated_windows(base, "bytes", gram, length, later_only=False)
    found = found.groupBy("tid").agg(F.collect_list(F.struct("lo", "n")).alias("found"))
    joined = base.select("tid", "copies", "text").join(found, "tid", "left")
    return joined.mapInArrow(partial(_cut, length=length), "tid binary, n_bytes long, n_removed long, spans array<struct<from:int,to:int>>, kept binary")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = texts_of(docs)
    cut = remove_repeated_bytes(distinct_texts(texts), length, gram)
    cut = cut.select("tid", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return texts.select(F.col("doc").alias("doc_id"), "tid").join(cut, "tid").drop("tid")

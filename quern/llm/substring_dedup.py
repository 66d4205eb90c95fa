"""Operator 4, substring dedup: words of passages that occur earlier in the corpus.

Seed and extend. Seeds are winnowed anchors: of the runs of `gram` words in each window the one with
the smallest identifier. Documents are joined on their seeds; seeds that match are extended to both
sides as far as their windows reach, by context where all of it agrees and window by window where a
repeat ends (repeats.repeated_windows). Windows that follow one another make up the maximal repeats
of at least `window` words, and each word of one is removed, unless no earlier copy is there.

Edge cases: a null or empty text has no words. Words are runs of characters other than the six ASCII
white-space characters. Earlier means a smaller doc_id, or the same one and an earlier start; rows
without doc_id come last. Rows that repeat a doc_id and its text count as one document and get the
same result. Texts of any length are cut into overlapping pieces. An empty table gives an empty
result. Other columns are ignored. Of two rows with one doc_id and different texts either may count as
the earlier, for windows at equal starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import covered, repeated_windows, split_words
from .store import distinct_texts, texts_of

WINDOW = 20
GRAM = 8


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, removed, spans, kept = [], [], [], []
        for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist(), strict=True):
            words = split_words(text)
            cut = covered(found, len(words), window)
            at, parts = 0, []
            for lo, to in cut:
                parts += words[at:lo]
                at = to
            parts += words[at:]
            n_words.append(len(words))
            removed.append(sum(to - lo for lo, to in cut))
            spans.append([{"from": lo, "to": to} for lo, to in cut])
            kept.append(b" ".join(parts))
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["tid", "doc", "n_words", "n_removed", "spans", "kept"])


def remove_repeated_words(base: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per distinct text of base (store.distinct_texts), as its first document has it: tid, doc, n_words, n_removed, spans, kept."""
    found = repeated_windows(base, "words", gram, window, later_only=True)
    found = found.groupBy("tid").agg(F.collect_list(F.struct("lo", "n")).alias("found"))
    joined = base.select("tid", "doc", "text").join(found, "tid", "left")
    return joined.mapInArrow(partial(_cut, window=window), "tid binary, doc long, n_words long, n_removed long, spans array<struct<from:int,to:int>>, kept string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    texts = texts_of(docs)
    cut = remove_repeated_words(distinct_texts(texts), window, gram)
    cut = cut.select("tid", F.col("doc").alias("first_doc"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    later = (F.col("n_words") >= window) & ~F.col("doc").eqNullSafe(F.col("first_doc"))
    return texts.select("doc", "tid").join(cut, "tid").select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )

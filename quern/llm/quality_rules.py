"""Operator 6, quality rules with suffix-array repetition.

A suffix array over the words of each document is built by prefix doubling, many documents at a time:
positions are ranked by their first word, then by 2, 4, 8, ... words, and only positions whose rank is
still shared go on. The ranks of all levels give the longest common prefix of neighbours in the array,
and so for each position the longest repeated substring that starts there. The union of these, from
`min_repeat` words on, is the covered part. A document is rejected if more than `max_covered` of its
words are covered or a single repeat takes more than `max_longest` of them, or if a base rule fails.

Edge cases: a null or empty text has no words and fails the base rule. Words are runs of characters
other than the six ASCII white-space characters. A document is never cut, whatever its length. Each
row is judged by itself, so repeated rows and null ids get a result like any other. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .repeats import word_ids

MIN_WORDS = 50
MIN_REPEAT = 10
MAX_COVERED = 0.2
MAX_LONGEST = 0.1
SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\v\f\r"
_BLANK_STR = _BLANK.decode()
#: Words that one suffix array holds; a longer document has one of its own.
JOINED = 1 << 17


def longest_repeats(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position of the joined documents the length of the longest run of words that starts
    there and also starts elsewhere in the same document."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    end = ends[doc]
    key = grams.mix(words, doc.astype(np.uint64))
    alive = np.arange(n)
    rank = np.zeros(n, np.int64)
    levels: list[np.ndarray] = []
    step = 0
    while len(alive):
        if step:
            later = alive + step
            key = rank[alive] * (n + 1) + np.where(later < end[alive], rank[np.minimum(later, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable" if step else "quicksort")
        sorted_key, at = key[order], alive[order]
        parent = rank[at]
        new = np.append(True, sorted_key[1:] != sorted_key[:-1])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        top = np.append(True, parent[1:] != parent[:-1])
        top_at = np.flatnonzero(top)[np.cumsum(top) - 1]
        rank[at] = parent + begin[group] - top_at
        size = np.diff(np.append(begin, len(at)))
        alive = at[size[group] > 1]
        levels.append(rank.astype(np.int32))
        step = 2 * step or 1
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    pair = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    i, j = array[pair], array[pair - 1]
    length = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + length, j + length
        ok = (a < end[i]) & (b < end[j])
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        length[ok] += 1 << k
    lcp[pair] = length
    return np.maximum(lcp[rank], lcp[rank + 1])


def _covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.subtract.at(change, at + length, 1)
    return np.cumsum(change[:-1]) > 0


def repetition(texts: list[np.ndarray], min_repeat: int) -> list[tuple[int, int, int]]:
    """Per document: words in repeated 3-word windows, words covered by repeats, longest repeat."""
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= JOINED):
            held += len(texts[to])
            to += 1
        size = np.array([len(t) for t in texts[at:to]])
        ends = np.cumsum(size)
        longest = longest_repeats(np.concatenate(texts[at:to]), ends - size, ends)
        three = np.flatnonzero(longest >= 3)
        many = np.flatnonzero(longest >= min_repeat)
        short = np.append(0, np.cumsum(_covered(three, np.full(len(three), 3), held)))
        wide = np.append(0, np.cumsum(_covered(many, longest[many], held)))
        for lo, hi in zip((ends - size).tolist(), ends.tolist(), strict=True):
            out.append((int(short[hi] - short[lo]), int(wide[hi] - wide[lo]), int(longest[lo:hi].max(initial=0))))
        at = to
    return out


def _duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(_BLANK_STR):
            seen.add(line)
    return n


def _measures(texts: pa.Array, min_repeat: int) -> list[list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat of each text."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    words = [word_ids(b) for b in raw]
    rows = []
    for data, ids, (three, wide, longest) in zip(raw, words, repetition(words, min_repeat), strict=True):
        bare = data.translate(None, _BLANK)
        rows.append([len(ids), len(bare.decode("utf-8", "replace")), len(data) - len(data.translate(None, SYMBOLS)), _duplicate_lines(data.decode("utf-8", "replace")), three, wide, longest])
    return rows


def _measured(batches: Iterator[pa.RecordBatch], min_repeat: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _measures(batch.column("text"), min_repeat)
        columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"])


def base_failed(n_words, n_repeat_words, min_words: int = MIN_WORDS):
    """Of numbers or of columns."""
    return (n_words < min_words) | (100 * n_repeat_words > 50 * n_words)


def repeats_fine(n_words, n_covered, longest_repeat, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST):
    """The verdict of the suffix array, of numbers or of columns."""
    return (n_covered <= max_covered * n_words) & ((longest_repeat < min_repeat) | (longest_repeat <= max_longest * n_words))


def _good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            rows = _measures(part.column("text"), MIN_REPEAT)
            keep = [not base_failed(n, three) and repeats_fine(n, wide, longest) for n, _, _, _, three, wide, longest in rows]
            yield part.filter(pa.array(keep, pa.bool_()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose texts pass all rules. Rows are judged where they are, without a shuffle."""
    return docs.mapInArrow(_good, docs.schema)


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_covered, longest_repeat."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"
    rows = slim.mapInArrow(partial(_measured, min_repeat=min_repeat), schema)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words)
    fine = repeats_fine(F.col("n_words"), F.col("n_covered"), F.col("longest_repeat"), min_repeat, max_covered, max_longest)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat")

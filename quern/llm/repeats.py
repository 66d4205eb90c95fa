"""Windows that occur more than once, over a whole corpus: the plan that operators 4 and 7 share.

1. Each distinct text gives a posting for each run of windows with the same anchor (grams.anchors).
2. Postings meet by anchor identifier. A posting whose identifier is alone has no repeated window.
   Postings that also have equal `ctx` agree on all units of all their windows: resolved as a whole.
3. Where one anchor has several contexts, a posting of each context is expanded into its single
   windows, whose identifiers decide. These are the ends of repeats, a small part of the corpus.
4. The windows found are gathered by text and joined with the texts, which were bucketed by text
   identifier and stay where they are.

No pair of documents is formed at any step, so a passage of m documents costs m rows. A window is a
repeat only if 64 bits of its anchor and 64 bits of its context or of itself agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .store import written

#: Distinct words that a Python worker remembers identifiers of.
KNOWN_WORDS = 500_000
NO_DOC = 2**63 - 1


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


_known = _Known()


def split_words(data: bytes) -> list[bytes]:
    """The runs of bytes other than space, \\t, \\n, \\v, \\f and \\r."""
    return data.split()


def word_ids(data: bytes) -> np.ndarray:
    words = split_words(data)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def byte_units(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


#: unit -> (units of a text, identifiers from joined units, units that an identifier spans)
UNITS: dict[str, tuple[Callable, Callable, int]] = {"bytes": (byte_units, grams.byte_grams, 8), "words": (word_ids, lambda x: x, 1)}


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _settled(bucket: np.ndarray, other: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal (bucket, other) the one of smallest (doc, lo) leads and the rest follow.

    Returns which rows follow and which lead others. A follower is settled where it is, so that a
    passage of very many copies sends one row from each batch to the task of its bucket.
    """
    order = np.lexsort((lo, doc, other, bucket))
    b, o = bucket[order], other[order]
    same = (b[1:] == b[:-1]) & (o[1:] == o[:-1])
    follows, leads = np.zeros(len(order), bool), np.zeros(len(order), bool)
    follows[order[1:]] = same
    first = np.append(True, ~same)
    leads[order[:-1]] = first[:-1] & same
    return follows, leads


def _alone(bucket: np.ndarray, tid: pa.Array, lo: np.ndarray) -> np.ndarray:
    """A bucket of its own for each settled row, so that these are dealt out evenly."""
    text = np.frombuffer(b"".join(x[:8] for x in tid.to_pylist()), np.uint64) if len(tid) else np.empty(0, np.uint64)
    return grams.mix(text, lo.astype(np.uint64))


def _postings(batches: Iterator[pa.RecordBatch], unit: str, gram: int, window: int) -> Iterator[pa.RecordBatch]:
    units_of, ids_of, have = UNITS[unit]
    for batch in batches:
        texts = [units_of(t) for t in _texts(batch)]
        docs = batch.column("doc").to_numpy(zero_copy_only=False)
        made: list[tuple[np.ndarray, ...]] = []
        for part in grams.pieces([len(t) for t in texts], window - 1):
            size = np.array([to - at for _, at, to in part])
            ends = np.cumsum(size)
            joined = np.concatenate([texts[i][at:to] for i, at, to in part])
            if len(joined) < max(window, have + 1):
                continue
            d, lo, n, bucket, ctx = grams.anchors(ids_of(joined), have, ends - size, ends, gram, window)
            if len(d):
                index = np.array([i for i, _, _ in part])[d]
                lo = lo + np.array([at for _, at, _ in part])[d]
                made.append((index, lo, n, bucket, ctx))
        if made:
            index, lo, n, bucket, ctx = (np.concatenate(x) for x in zip(*made, strict=True))
            tid = batch.column("tid").take(pa.array(index))
            follows, leads = _settled(bucket, ctx, docs[index], lo)
            bucket[follows] = _alone(bucket, tid.filter(pa.array(follows)), lo[follows])
            state = np.where(follows, 2, leads.astype(int)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([_signed(bucket), _signed(ctx), tid, pa.array(docs[index]), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(state)], ["bucket", "ctx", "tid", "doc", "lo", "n", "state"])


def _expanded(batches: Iterator[pa.RecordBatch], unit: str, window: int) -> Iterator[pa.RecordBatch]:
    units_of, ids_of, have = UNITS[unit]
    for batch in batches:
        held, size = [], 0

        def out(held=None):
            lengths = np.array([len(x[4]) for x in held])
            begins = np.cumsum(lengths) - lengths
            ids = grams.gram_ids(ids_of(np.concatenate([x[4] for x in held])), have, window)
            n = np.array([x[3] for x in held])
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows = np.repeat(np.array([x[0] for x in held]), n)
            start = np.repeat(np.array([x[2] for x in held]), n) + within
            tid = batch.column("tid").take(pa.array(rows))
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[rows]
            bucket = np.repeat(np.array([x[1] for x in held], np.int64), n).view(np.uint64)
            wid = ids[np.repeat(begins, n) + within]
            follows, leads = _settled(bucket, wid, doc, start)
            bucket[follows] = _alone(bucket, tid.filter(pa.array(follows)), start[follows])
            state = np.where(follows, 2, leads.astype(int)).astype(np.int8)
            return pa.RecordBatch.from_arrays([_signed(bucket), _signed(wid), tid, pa.array(doc), pa.array(start.astype(np.int32)), pa.array(state)], ["bucket", "wid", "tid", "doc", "start", "state"])

        for row, (text, todo) in enumerate(zip(_texts(batch), batch.column("todo").to_pylist(), strict=True)):
            units = units_of(text)
            for x in todo:
                held.append((row, x["bucket"], x["lo"], x["n"], units[x["lo"] : x["lo"] + x["n"] - 1 + window]))
                size += len(held[-1][4])
                if size > grams.PIECE:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)


def repeated_windows(base: DataFrame, unit: str, gram: int, window: int, later_only: bool) -> DataFrame:
    """(tid, lo, n): windows lo..lo+n-1 of text tid occur elsewhere; with later_only, earlier.

    base is what store.distinct_texts returns. Earlier is by smaller doc, then by smaller start;
    a text without an id comes after all others.
    """
    mapped = base.select("tid", F.coalesce("doc", F.lit(NO_DOC)).alias("doc"), "text")
    posts = mapped.mapInArrow(partial(_postings, unit=unit, gram=gram, window=window), "bucket long, ctx long, tid binary, doc long, lo int, n int, state byte")
    anchor, context = Window.partitionBy("bucket"), Window.partitionBy("bucket", "ctx")
    met = (
        posts.repartition("bucket")
        .sortWithinPartitions("bucket", "ctx", "doc", "lo", "tid")
        .withColumn("mixed", F.expr("state < 2") & (F.min("ctx").over(anchor) != F.max("ctx").over(anchor)))
        .withColumn("same", F.count(F.lit(1)).over(context))
        .withColumn("first", F.row_number().over(context.orderBy("doc", "lo", "tid")) == 1)
        .filter("mixed or same > 1 or state > 0")
        .select("bucket", "tid", "doc", "lo", "n", "mixed", F.expr("same > 1 or state > 0").alias("shared"), F.expr("first and state < 2").alias("first"))
    )
    met = written(met, "met")
    whole = met.filter("shared and not first" if later_only else "shared").select("tid", "lo", "n")
    todo = met.filter("mixed and first").groupBy("tid").agg(F.collect_list(F.struct("bucket", "lo", "n")).alias("todo"))
    single = mapped.join(todo, "tid").mapInArrow(partial(_expanded, unit=unit, window=window), "bucket long, wid long, tid binary, doc long, start int, state byte")
    same = Window.partitionBy("bucket", "wid")
    met_again = F.rank().over(same.orderBy("doc", "start")) > 1 if later_only else F.count(F.lit(1)).over(same) > 1
    mark = met_again | F.expr("state = 2" if later_only else "state > 0")
    ends = single.withColumn("mark", mark).filter("mark").select("tid", F.col("start").alias("lo"), F.lit(1).alias("n"))
    return whole.unionByName(ends)


def covered(spans: list[dict] | None, units: int, window: int) -> list[tuple[int, int]]:
    """The maximal runs [from, to) of units that the windows cover."""
    if not spans:
        return []
    lo = np.array([x["lo"] for x in spans])
    to = lo + np.array([x["n"] for x in spans]) - 1 + window
    order = np.argsort(lo, kind="stable")
    lo, to = lo[order], np.maximum.accumulate(to[order])
    new = np.append(True, lo[1:] > to[:-1])
    return list(zip(lo[new].tolist(), to[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)].tolist(), strict=True))

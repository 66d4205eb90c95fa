"""Operator 9, best-fit-decreasing packing of documents into sequences of a fixed length.

Documents are encoded and cut into pieces of at most `length` tokens; of a longer document the first
piece may be shorter. Pieces are dealt by hash into shards of about SHARD, each shard sorts its own by
falling length, and each piece goes to the open sequence with the least room that still holds it. A
segment tree over the possible amounts of room finds that in logarithmic time. A shard leaves a few
sequences part filled, out of tens of thousands, and no step depends on the whole corpus.

Documents that come with a place in a mix (slot, place) are packed in its order instead: runs of about
RUN pieces with neighbouring slots are packed each by itself, and sequences are numbered by run, within
it by the mean slot of their pieces. So any stretch of sequences has the sources in the shares of the mix.

Edge cases: a null or empty text has the end id alone. Each row is a document of its own: repeated
rows are packed as often as they come, with equal doc_id and piece. A null doc_id is kept. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import order
from .store import written
from .tokens import encoder

LENGTH = 2048
SHARD = 100_000
#: Pieces that are packed together where sequences follow a mix, about.
RUN = 4_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"
PACKED = "sequence_id long, offset long"
CUT = "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
IN_ORDER = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cuts(n: int, length: int) -> list[tuple[int, int]]:
    cuts = [0, *range(n % length or length, n + 1, length)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, space: str | None, end: int, length: int) -> Iterator[pa.RecordBatch]:
    code = encoder(path, space)
    tail = np.array([end], code.kind).tobytes()
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.frombuffer(code.encode(text) + tail, code.kind).astype("<u4")
            for piece, (at, to) in enumerate(_cuts(len(ids), length)):
                rows.append((doc, piece, at, to - at, ids[at:to].tobytes()))
            held += len(ids)
            if held > 1 << 20:
                yield _rows(rows)
                rows, held = [], 0
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])


def pieces(docs: DataFrame, path: str, space: str | None, end: int, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each piece."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(partial(_pieces, path=path, space=space, end=end, length=length), PIECES)


class Rooms:
    """Open sequences by the room left in them; a segment tree finds the least room that is enough."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = room + self.leaves
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def least(self, need: int) -> int | None:
        """The least room of at least `need` that a sequence has."""
        some, node = self.some, need + self.leaves
        while not some[node]:
            while node & 1:  # a right child, or the root: go up until there is a sibling to the right
                node >>= 1
                if not node:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if some[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> int:
        sequence = self.open[room].pop()
        if not self.open[room]:
            node = room + self.leaves
            self.some[node] = 0
            node >>= 1
            while node:
                if self.some[2 * node] or self.some[2 * node + 1]:
                    break
                self.some[node] = 0
                node >>= 1
        return sequence


def best_fit(lengths: list[int], rooms: Rooms, length: int, opened: int) -> tuple[list[int], list[int], int]:
    """The sequence and offset of each of these lengths, which fall; opened: sequences so far."""
    where, offset = [], []
    for n in lengths:
        room = rooms.least(n)
        if room is None:
            sequence, room = opened, length
            opened += 1
        else:
            sequence = rooms.take(room)
        where.append(sequence)
        offset.append(length - room)
        if room > n:
            rooms.put(room - n, sequence)
    return where, offset, opened


def _packed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 40
    rooms, opened = Rooms(length), 0
    for batch in batches:
        where, offset, opened = best_fit(batch.column("length").to_pylist(), rooms, length, opened)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + x for x in where], pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])


def pack(rows: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """rows (doc_id, piece, length and any others) with sequence_id and offset. It counts rows first,
    so they should be a written table."""
    shards = max(1, -(-rows.count() // shard))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartition(shards, F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return dealt.mapInArrow(partial(_packed, length=length), f"{schema}, {PACKED}")


def pack_documents(docs: DataFrame, path: str, space: str | None = "before", end: int = 0, length: int = LENGTH) -> DataFrame:
    """Per piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    slim = pieces(docs, path, space, end, length).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(written(slim, "pieces"), length)


def _cut(batches: Iterator[pa.RecordBatch], path: str, space: str | None, end: int, length: int) -> Iterator[pa.RecordBatch]:
    """Documents with their pieces, without the tokens."""
    code = encoder(path, space)
    tail = np.array([end], code.kind).tobytes()
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            ids = np.frombuffer(code.encode(text) + tail, code.kind).astype("<u4")
            found.append([{"piece": i, "start": at, "length": to - at, "ids_crc32": zlib.crc32(ids[at:to].tobytes())} for i, (at, to) in enumerate(_cuts(len(ids), length))])
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found, kind)], [*others, "pieces"])


def cut_documents(docs: DataFrame, path: str, space: str | None, end: int, length: int = LENGTH, others: dict[str, Column] | None = None) -> DataFrame:
    """Per row of docs: doc_id, others and the array of its pieces: piece, start, length, ids_crc32. Without
    others source and key (its order in a mix)."""
    others = others or {"source": F.col("source").cast("string"), "key": order(docs)}
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(name) for name, c in others.items()), F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.drop("text").schema.fields)
    return slim.mapInArrow(partial(_cut, path=path, space=space, end=end, length=length), f"{schema}, {CUT}")


def _packing_run(length: int) -> Callable[[pa.Table], pa.Table]:
    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "slot", "place"))])
        where, offset, opened = best_fit(table.column("length").to_pylist(), Rooms(length), length, 0)
        mean = np.bincount(where, table.column("slot").to_numpy(), opened) / np.bincount(where, minlength=opened)
        number = np.empty(opened, np.int64)
        number[np.argsort(mean, kind="stable")] = np.arange(opened)
        base = table.column("run")[0].as_py() << 40
        out = table.drop_columns(["run", "slot", "place"])
        return out.append_column("sequence_id", pa.array(base + number[where])).append_column("offset", pa.array(offset, pa.int64()))

    return packed


def pack_in_order(rows: DataFrame, length: int = LENGTH, run: int | None = None) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32, slot, place) with sequence_id and offset, without slot
    and place; sequences follow the slots. It counts rows first, so they should be a written table."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).first()
    runs = max(1, -(-found["n"] // (run or RUN)))
    dealt = rows.withColumn("run", F.expr(f"slot * {runs} div {(found['last'] or 0) + 1}"))
    return dealt.groupBy("run").applyInArrow(_packing_run(length), f"{IN_ORDER}, {PACKED}")

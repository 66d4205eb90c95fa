"""Operator 1, token-id files: canonical length-limited Huffman coding of ids.

1. Texts are encoded once; ids and an end id per document go to a table.
2. Ids are counted over the whole corpus. A vocabulary bounds the counts (one row per id), so the
   driver can make the code from them; each code has at most 16 bits, or as many as the vocabulary
   needs.
3. Each document becomes a run of bits that starts on a byte, with the bit offset of each 256th id as
   a checkpoint. Coded documents are dealt to parts by ranges of doc_id, whose bounds are quantiles of
   the ids alone, and gathered in blocks of about BLOCK ids.
4. A block is a row of a Parquet table, readable by itself: doc_ids, counts, bits, checkpoints, and
   the number of ids before it in its part. `parts` has the ids of each part and before it.
Reading decodes all stretches between checkpoints of a block side by side by look-ups in one table.

Edge cases: a null or empty text has the end id alone. Rows are in ascending order of doc_id, null
first; rows that repeat a doc_id follow each other, in order of their coded bits. A document is never
split between blocks, so a very long one makes a block of its own. An empty table gives empty files.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman
from .store import new_path, partitions, written
from .tokens import encoder

BLOCK = 1 << 16
CODED = "doc_id long, n_tokens long, bits binary, marks binary, part int"
BLOCKS = "part int, block int, before long, doc_ids binary, known binary, n_tokens binary, sizes binary, bits binary, marks binary"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, space: str | None, end: int) -> Iterator[pa.RecordBatch]:
    code = encoder(path, space)
    tail = np.array([end], code.kind).tobytes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for at in range(0, len(texts), 1000):
            ids = [code.encode(t) + tail for t in texts[at : at + 1000]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 1000), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def _counted(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        texts = batch.column("ids").to_pylist()
        for at in range(0, len(texts), 64):
            now = np.bincount(np.frombuffer(b"".join(texts[at : at + 64]), kind), minlength=len(total))
            now[: len(total)] += total
            total = now
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


def _coded(batches: Iterator[pa.RecordBatch], kind: str, lengths: Broadcast, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    sizes = lengths.value
    codes = huffman.canonical(sizes)
    for batch in batches:
        docs = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
        ident = batch.column("doc_id")
        part = np.where(ident.is_valid(), np.searchsorted(np.array(bounds, np.int64), ident.fill_null(0).to_numpy(), side="left"), 0).astype(np.int32)
        at = 0
        while at < len(docs):
            to, held = at, 0
            while to < len(docs) and (to == at or held + len(docs[to]) <= BLOCK):
                held += len(docs[to])
                to += 1
            count = np.array([len(x) for x in docs[at:to]])
            bits, first, marks = huffman.encode(np.concatenate(docs[at:to]), np.cumsum(count), sizes, codes)
            cut = np.append(0, np.cumsum(-(-count // huffman.STEP))).tolist()
            first = first.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    ident.slice(at, to - at),
                    pa.array(count),
                    pa.array([bits[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                    pa.array([marks[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array(part[at:to]),
                ],
                ["doc_id", "n_tokens", "bits", "marks", "part"],
            )
            at = to


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    part, number, before = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def out() -> pa.RecordBatch:
        docs, counts, bits, marks = zip(*held, strict=True)
        fields = [part, number, before, np.array([x or 0 for x in docs], "<i8").tobytes(), np.array([x is not None for x in docs], "u1").tobytes(), np.array(counts, "<u4").tobytes(), np.array([len(x) for x in bits], "<u4").tobytes(), b"".join(bits), b"".join(marks)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(fields, kinds, strict=True)], names)

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "bits", "marks")), strict=True):
            held.append(row)
            size += row[1]
            if size >= block:
                yield out()
                number, before, held, size = number + 1, before + size, [], 0
    if held:
        yield out()


def _read(batches: Iterator[pa.RecordBatch], lengths: Broadcast) -> Iterator[pa.RecordBatch]:
    decoder = huffman.Decoder(lengths.value)
    for batch in batches:
        rows = batch.to_pylist()
        for at in range(0, len(rows), 8):
            yield from _decoded(rows[at : at + 8], decoder)


def _decoded(rows: list[dict], decoder: huffman.Decoder) -> Iterator[pa.RecordBatch]:
    counts = [np.frombuffer(r["n_tokens"], "<u4").astype(np.int64) for r in rows]
    n = np.concatenate(counts)
    size = np.concatenate([np.frombuffer(r["sizes"], "<u4") for r in rows]).astype(np.int64)
    marks = np.concatenate([np.frombuffer(r["marks"], "<u4") for r in rows]).astype(np.int64)
    stretches = -(-n // huffman.STEP)
    owner = np.repeat(np.arange(len(n)), stretches)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    begin = (np.cumsum(size) - size) * 8
    ids = decoder.decode(b"".join(r["bits"] for r in rows), begin[owner] + marks, np.minimum(huffman.STEP, n[owner] - index * huffman.STEP))
    data, ends = ids.astype("<u4").tobytes(), np.cumsum(n) * 4
    known = np.concatenate([np.frombuffer(r["known"], "u1") for r in rows]).astype(bool)
    docs = pa.array(np.concatenate([np.frombuffer(r["doc_ids"], "<i8") for r in rows]), mask=~known)
    before = np.concatenate([r["before"] + np.cumsum(c) - c for r, c in zip(rows, counts, strict=True)])
    part = np.repeat(np.array([r["part"] for r in rows], np.int32), [len(c) for c in counts])
    each = pa.array([data[b - 4 * k : b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(part), docs, pa.array(before), pa.array(n), each], ["part", "doc_id", "start", "n_tokens", "ids"])


@dataclass
class TokenFiles:
    """Where the files are: the table of blocks, of parts, and of code lengths (id, bits)."""

    blocks: str
    parts: str
    code: str


def _lengths(spark: SparkSession, code: DataFrame) -> np.ndarray:
    rows = code.collect()  # one per id of the vocabulary
    lengths = np.zeros(max([x["id"] for x in rows], default=0) + 1, np.uint8)
    for x in rows:
        lengths[x["id"]] = x["bits"]
    return lengths


def write(docs: DataFrame, path: str, space: str | None, end: int, block: int = BLOCK) -> TokenFiles:
    spark = docs.sparkSession
    kind = encoder(path, space).kind.str
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = written(slim.mapInArrow(partial(_encoded, path=path, space=space, end=end), "doc_id long, ids binary"), "tokens")
    counts = tokens.mapInArrow(partial(_counted, kind=kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max([x["id"] for x in counts], default=0) + 1, np.int64)
    for x in counts:
        total[x["id"]] = x["n"]
    lengths = huffman.code_lengths(total)
    files = TokenFiles(*(new_path(spark, x) for x in ("blocks", "parts", "code")))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int").coalesce(1).write.parquet(files.code)
    shared = spark.sparkContext.broadcast(lengths)
    parts = partitions(spark)
    bounds = tokens.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    coded = tokens.mapInArrow(partial(_coded, kind=kind, lengths=shared, bounds=bounds), CODED)
    ranged = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "bits")
    ranged.mapInArrow(partial(_blocks, block=block), BLOCKS).write.option("compression", "none").parquet(files.blocks)
    each = spark.read.parquet(files.blocks).select("part", "n_tokens").mapInArrow(_block_sizes, "part int, n_tokens long").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per part
    each.select("part", "n_tokens", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(files.parts)
    return files


def _block_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(np.frombuffer(x, "<u4").sum(dtype=np.int64)) for x in batch.column("n_tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(n, pa.int64())], ["part", "n_tokens"])


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document in the files."""
    shared = spark.sparkContext.broadcast(_lengths(spark, spark.read.parquet(files.code)))
    rows = spark.read.parquet(files.blocks).mapInArrow(partial(_read, lengths=shared), "part int, doc_id long, start long, n_tokens long, ids binary")
    parts = F.broadcast(spark.read.parquet(files.parts).select("part", "before"))  # one row per part
    return rows.join(parts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, path: str, space: str | None = "none", end: int = 1) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    files = write(docs, path, space, end)
    return read(docs.sparkSession, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

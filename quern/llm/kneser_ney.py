"""Operator 5, quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Words, lower-cased in ASCII, fall into 2^BITS classes by a hash, of which one is the boundary; a text is its
words between two boundaries, and the model is one of bigrams of classes. What is kept for each class (how
many different words come before it, how often it comes, how many different words follow it once, twice,
more often) is bounded by the number of classes, so it goes to the driver and is broadcast, three numbers a
class. Bigrams grow with the trusted text and are never gathered or broadcast:

1. Tasks count the bigrams of trusted texts and send each shard, a range of first words, its part as one
   compressed row. Shards add them up; their table is the model.
2. Counts of counts give the discounts for 1, 2 and 3 or more. Sums by class are added up in ranges.
3. The logarithm of a text's probability is a sum of what each bigram has from its two classes, which the
   task of the document adds up, and of what it has more if it was seen. For the latter tasks send each shard
   the bigrams of some thousand documents at a time as one compressed row, those alone whose classes trusted
   text has; the shard answers with a sum for each document, and the sums of all shards are added up.

A document is kept if its perplexity is at most its language's threshold: the interpolated quantile of
log perplexity among trusted documents of the language that the model was not trained on, one in HELD_OUT
by a hash of the doc_id. As n texts show it with an error, it is raised by SLACK / sqrt(n) of its distance
from the median. It is averaged with the same of all languages, with the weights n and PRIOR; a language
without any such text has the latter. The rule is the same at every size.

All labelled rows count, for the model and for the thresholds. Trusted texts are found where they are by
broadcasts of their ids, so that texts cross no shuffle. That takes rounds of about ROUND ids, by a hash of
the doc_id, one after another: each round reads the documents once and adds up its bigrams, and the sums of
the rounds make one model. So what is broadcast at once is bounded, and a larger ROUND saves readings.
All documents are scored.

Edge cases: a null or empty text has no words, perplexity null, and is not kept. Null language is a
language. Rows that repeat a doc_id are scored each; a label counts once. Without any trusted text that is
held out no document has a threshold and all with words are kept. An empty table gives an empty result.
Texts of any length are counted whole. Other columns are ignored. Of V different words about V / 2^BITS share
their class with a given one; the model takes them for one word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import word_ids
from .store import partitions, written

#: Bits of a word's class.
BITS = 20
HELD_OUT = 5
QUANTILE = 0.99
#: Held-out texts of a language whose quantile counts as much as that of all languages.
PRIOR = 5
SLACK = 4
#: Ids of trusted documents that are broadcast at once, about; more take more rounds.
ROUND = 1_000_000
#: The class of the boundary; words have larger ones.
BOUNDARY = 0
#: Bytes of text that are counted together.
BLOCK = 1 << 23
#: Bigrams in a row of the model.
CHUNK = 1 << 20
#: Ranges of classes that their sums are added up in.
RANGES = 16
_MODEL, _COUNTS, _ROWS = 0, 1, 2
_SHARD = "shard int, blob binary"
_CHUNKS = "shard int, blob binary, n1 long, n2 long, n3 long, n4 long, n_grams long"
_SENT = "shard int, kind int, block long, blob binary, doc_ids array<long>, langs array<string>, n_words array<long>, base array<double>"
_SENT_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("blob", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("n_words", pa.list_(pa.int64())), ("base", pa.list_(pa.float64()))])
_SUMS = "block long, doc_ids array<long>, langs array<string>, n_words array<long>, base array<double>, sums array<float>"
_SUMS_SCHEMA = pa.schema([_SENT_SCHEMA.field(c) for c in ("block", "doc_ids", "langs", "n_words", "base")] + [pa.field("sums", pa.list_(pa.float32()))])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word classes of the texts one after another, each between two boundaries; the text of each; how many
    words each text has. Texts without words have none."""
    edge = np.array([BOUNDARY], np.int64)
    parts, n = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        ids = np.maximum((word_ids(text.lower()) >> np.uint64(64 - BITS)).astype(np.int64), BOUNDARY + 1)
        n[i] = len(ids)
        if len(ids):
            parts += [edge, ids, edge]
    return np.concatenate(parts) if parts else edge[:0], np.repeat(np.arange(len(texts)), np.where(n > 0, n + 2, 0)), n


def bigrams(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams within texts, and the text of each."""
    inside = text[1:] == text[:-1]
    return (ids[:-1] << BITS | ids[1:])[inside], text[1:][inside]


def _blocks(texts: list[bytes], size: int | None = None) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > (size or BLOCK):
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def pack(key: np.ndarray, *others: np.ndarray) -> bytes:
    """Ascending keys and 32-bit columns beside them, byte by byte so that equal bytes meet, compressed."""
    columns = [np.diff(key, prepend=np.int64(0)), *(x.astype(np.uint32) for x in others)]
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(key), -1).T.tobytes() for x in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, others: int) -> list[np.ndarray]:
    """The keys and columns of pack."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8 + 4 * others, -1)
    key = np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.int64).ravel())
    return [key, *(np.ascontiguousarray(planes[a : a + 4].T).view(np.uint32).ravel() for a in range(8, 8 + 4 * others, 4))]


def _sharded(key: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Each shard and where its keys are, which ascend."""
    cuts = np.searchsorted((key >> BITS) * shards >> BITS, np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, slice(cuts[s], cuts[s + 1])


def _counted(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lo, to in _blocks(texts):
            ids, text, _ = tokens(texts[lo:to])
            gram, n = np.unique(bigrams(ids, text)[0], return_counts=True)
            found = [(s, pack(gram[at], n[at])) for s, at in _sharded(gram, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["shard", "blob"])


def _summed(keys: list[np.ndarray], columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Different keys, ascending, and the sums of their columns."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return [key[first], *(np.add.reduceat(np.concatenate(c)[order].astype(np.int64), first) if len(first) else key[:0] for c in columns)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's one shard, in chunks."""
    shard, held = None, []
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            held.append(unpack(blob, 1))
            if len(held) >= 64:
                held = [_summed([x[0] for x in held], [[x[1] for x in held]])]
    if held:
        key, n = _summed([x[0] for x in held], [[x[1] for x in held]])
        n = np.minimum(n, 2**32 - 1)
        for at in range(0, len(key), CHUNK):
            part = n[at : at + CHUNK]
            row = {"shard": shard, "blob": pack(key[at : at + CHUNK], part), "n_grams": len(part)} | {f"n{k}": int((part == k).sum()) for k in (1, 2, 3, 4)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("blob", pa.binary()), *((f"n{k}", pa.int64()) for k in (1, 2, 3, 4)), ("n_grams", pa.int64())]))


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class of a chunk: different words before it, occurrences as a first word, words that follow it once,
    twice, more often. In ranges of classes."""
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            gram, n = unpack(blob, 1)
            first, last = gram >> BITS, gram & ((1 << BITS) - 1)
            zero = np.zeros(len(gram), np.int64)
            own = [zero, n, n == 1, n == 2, n > 2]
            key, *columns = _summed([last, first], [[np.ones(len(gram), np.int64) if i == 0 else zero, x] for i, x in enumerate(own)])
            cuts = np.searchsorted(key * RANGES >> BITS, np.arange(RANGES + 1))
            some = [r for r in range(RANGES) if cuts[r] < cuts[r + 1]]
            blobs = [pack(key[cuts[r] : cuts[r + 1]], *(c[cuts[r] : cuts[r + 1]] for c in columns)) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _classes_added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, shard = [], None
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            held.append(unpack(blob, 5))
            if len(held) >= 64:
                held = [_summed([x[0] for x in held], [[x[k] for x in held] for k in range(1, 6)])]
    if held:
        key, *columns = _summed([x[0] for x in held], [[x[k] for x in held] for k in range(1, 6)])
        blob = np.stack([key, *columns]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more."""
    many = {1: n1, 2: n2, 3: n3, 4: n4}
    ratio = n1 / (n1 + 2 * n2) if n1 else 0.5
    cuts = [min(k, max(0.1, k - (k + 1) * ratio * many[k + 1] / many[k])) if many[k] else 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(min(c, k - 0.05) for k, c in enumerate(cuts, 1))])


class Model:
    """The model: `grams`, a table of all bigrams seen, and for each class the logarithm of what it leaves to
    words by themselves where it comes first, of its probability by itself, and the discounts of its bigrams."""

    def __init__(self, grams: DataFrame, shards: int, cuts: np.ndarray, left: np.ndarray, alone: np.ndarray, taken: np.ndarray, seen: np.ndarray):
        self.grams, self.shards = grams, shards
        self.cuts, self.left, self.alone, self.taken, self.seen = cuts, left, alone, taken, seen


def train(*trusted: DataFrame) -> Model:
    """The model of the column text of all of trusted, which are counted one after another."""
    shards = partitions(trusted[0].sparkSession)

    def merged(sent: DataFrame) -> DataFrame:
        return written(sent.repartitionById(shards, F.col("shard")).mapInArrow(_merged, _CHUNKS), "grams")

    counted = [merged(x.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(partial(_counted, shards=shards), _SHARD)) for x in trusted]
    grams = counted[0] if len(counted) == 1 else merged(reduce(DataFrame.unionByName, counted).select("shard", "blob"))
    many = grams.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    cuts = discounts(*many)
    sums = grams.select("blob").mapInArrow(_by_class, _SHARD).repartitionById(RANGES, F.col("shard")).mapInArrow(_classes_added, _SHARD)
    before, total, once, twice, more = (np.zeros(1 << BITS) for _ in range(5))
    for row in sums.select("blob").collect():  # bounded by the number of classes
        key, *columns = np.frombuffer(row["blob"], "<i8").reshape(6, -1)
        for array, column in zip((before, total, once, twice, more), columns, strict=True):
            array[key] = column
    low = discounts(*(int((before == k).sum()) for k in (1, 2, 3, 4)))
    types, words = before.sum(), (before > 0).sum()
    held = low[np.minimum(before, 3).astype(int)].sum()
    unseen = held / types / (words + 1) if types else 1.0  # of all words seen and one unseen
    alone = np.where(before > 0, (before - low[np.minimum(before, 3).astype(int)]) / max(types, 1) + unseen, unseen)
    taken = cuts[1] * once + cuts[2] * twice + cuts[3] * more
    left = np.where(total > 0, np.log(np.where(total > 0, taken, 1)) - np.log(np.where(total > 0, total, 1)), 0)
    return Model(grams, shards, cuts, left, np.log(alone), taken, (before > 0) | (total > 0))


def _sent(batches: Iterator[pa.RecordBatch], shards: int, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    left, alone, _, seen = shared.value[:4]
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        doc_ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
        for lo, to in _blocks(texts):
            ids, text, n = tokens(texts[lo:to])
            key, of = bigrams(ids, text)
            first, last = key >> BITS, key & ((1 << BITS) - 1)
            base = np.bincount(of, left[first] + alone[last], to - lo)
            known = seen[first] & seen[last]
            key, of = key[known], of[known]
            order = np.argsort(key, kind="stable")  # by text within a key
            key, of = key[order], of[order]
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))[: len(key)])
            many = np.diff(np.append(new, len(key)))
            key, of = key[new], of[new]
            rows = [{"shard": s, "kind": _COUNTS, "block": block, "blob": pack(key[at], of[at], many[at])} for s, at in _sharded(key, shards)]
            rows.append({"shard": (block ^ block >> 32) % shards, "kind": _ROWS, "block": block, "doc_ids": doc_ids[lo:to], "langs": langs[lo:to], "n_words": n.tolist(), "base": base.tolist()})
            yield pa.RecordBatch.from_pylist(rows, _SENT_SCHEMA)
            block += 1


def _answered(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of one shard the model comes first: what its bigrams add for the texts of each block."""
    _, alone, taken, _, cuts = shared.value
    parts, model = [], None
    for batch in batches:
        for kind, block, blob, *own in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "blob", "doc_ids", "langs", "n_words", "base")), strict=True):
            if kind == _MODEL:
                parts.append(unpack(blob, 1))
                continue
            if kind == _ROWS:
                yield pa.RecordBatch.from_pylist([{"block": block} | dict(zip(("doc_ids", "langs", "n_words", "base"), own, strict=True))], _SUMS_SCHEMA)
                continue
            if model is None:
                gram = np.concatenate([np.full(1, -1, np.int64), *(k for k, _ in parts)])
                n = np.concatenate([np.zeros(1), *(v for _, v in parts)])
                above = np.maximum(0, n - cuts[np.minimum(n, 3).astype(int)])
                value = np.log1p(above / np.maximum(taken[gram >> BITS], 1e-9) * np.exp(-alone[gram & ((1 << BITS) - 1)]))
                order = np.argsort(gram)
                model, parts = (gram[order], value[order].astype(np.float32)), []
            key, of, many = unpack(blob, 2)
            at = np.searchsorted(model[0], key, "right") - 1
            sums = np.bincount(of, np.where(model[0][at] == key, model[1][at], 0.0) * many)
            if sums.any():
                yield pa.RecordBatch.from_pylist([{"block": block, "sums": sums.astype(np.float32)}], _SUMS_SCHEMA)


def _added(table: pa.Table) -> pa.Table:
    """The rows of one block with the sums of all shards."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["doc_ids"] is not None)
    total = np.array(own["base"], float)
    for r in rows:
        if r["sums"] is not None:
            total[: len(r["sums"])] += r["sums"]
    return pa.table({"doc_id": pa.array(own["doc_ids"], pa.int64()), "lang": pa.array(own["langs"], pa.string()), "n_words": pa.array(own["n_words"], pa.int64()), "total": total})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, lang, text): doc_id, lang, perplexity of its words and its end."""
    shared = docs.sparkSession.sparkContext.broadcast((model.left, model.alone, model.taken, model.seen, model.cuts))
    sent = docs.select("doc_id", "lang", "text").mapInArrow(partial(_sent, shards=model.shards, shared=shared), _SENT)
    own = model.grams.select("shard", F.lit(_MODEL).alias("kind"), "blob")
    sent = sent.unionByName(own, allowMissingColumns=True)
    sums = sent.repartitionById(model.shards, F.col("shard")).sortWithinPartitions("kind").mapInArrow(partial(_answered, shared=shared), _SUMS)
    added = sums.groupBy("block").applyInArrow(_added, "doc_id long, lang string, n_words long, total double")
    return added.select("doc_id", "lang", F.when(F.col("n_words") > 0, F.exp(-F.col("total") / (F.col("n_words") + 1))).alias("perplexity"))


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, held_out: int = HELD_OUT) -> DataFrame:
    """Per row of docs: doc_id, lang, perplexity, threshold, kept. trusted_ids: doc_id of trusted rows; one in
    held_out of them sets the thresholds, the others train the model."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    out = F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0
    ids = written(ids.withColumn("out", out), "trusted")
    fitting = ids.filter(~F.col("out"))
    rounds = max(1, -(-fitting.count() // ROUND))
    turn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("round")), F.lit(rounds))
    model = train(*(slim.join(F.broadcast(fitting.filter(turn == k).select("doc_id")), "doc_id", "left_semi") for k in range(rounds)))
    scores = written(score(slim, model), "scores")
    known = scores.join(ids.filter("out").select("doc_id"), "doc_id", "left_semi")
    logs = F.round(F.log("perplexity"), 4)  # so that few different values are held
    shape = [F.count(logs).alias("n"), F.percentile(logs, [quantile, 0.5]).alias("q")]
    raised = F.expr(f"q[0] + {SLACK} / sqrt(n) * (q[0] - q[1])").alias("own")
    overall = known.agg(*shape).select(raised).first()["own"]
    by_lang = known.groupBy(F.col("lang").alias("of")).agg(*shape).filter("n > 0").select("of", "n", raised)
    joined = scores.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left")
    pooled = F.lit(overall).cast("double")
    threshold = F.exp(F.coalesce((F.col("n") * F.col("own") + PRIOR * pooled) / (F.col("n") + PRIOR), pooled))
    fine = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return joined.withColumn("threshold", threshold).select("doc_id", "lang", "perplexity", "threshold", fine.alias("kept"))

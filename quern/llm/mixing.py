"""Operator 10, mixing sources to target weights by Pfair scheduling, with DataFrame functions alone.

The documents of a source are put in a fixed pseudo-random order and cut into blocks of equal numbers.
Weights are whole parts; H is their sum. Block i of a source with W parts is released at slot
floor(i * H / W) and due by slot ceil((i + 1) * H / W). Earliest deadline first gives each of the H
slots of a period to one block; periods repeat, so the slot of every block follows from a table of H
slots, and at any slot each source is less than one block from its share. When a source runs out, a
phase ends and the others go on with their parts in proportion; no document is dropped or repeated.

The table has one row for each of at most MAX_SOURCES - 1 sources, the largest, which bounds what is
broadcast. Where there are more, the smaller ones share one place in the schedule with the sum of their
weights; in it they are in pseudo-random order, so each of them has its share there on average only.
Numbers within a source come from counts by hash range, so a source of a third of all rows is spread
over as many tasks as its size asks for.

Edge cases: a null source is a source. A source without a weight has one part; one of weight 0 comes when
all others have run out. The pseudo-random order hashes all columns that docs has (as `order` gives it), so
rows that share a doc_id or have none are dealt out by their other columns; rows equal in all of them are in
an arbitrary order and numbered in one task. An empty table gives an empty result. Columns may have any
names, since rows are carried as one value; the added columns are named by the caller.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .store import partitions

BLOCK = 16
SEED = 42
#: Parts that weights from sizes add up to, about.
PARTS = 1000
MAX_SOURCES = 256
#: Rows of one source in a range of hashes that is numbered by itself, about.
RANGE = 1_000


def period(parts: list[int]) -> list[list[int]]:
    """The slots of each source in one period, earliest deadline first."""
    total = sum(parts)
    waiting = [(0, s, 0) for s in range(len(parts))]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in parts]
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // parts[s]), s, i))
        _, s, i = heapq.heappop(ready)
        slots[s].append(t)
        heapq.heappush(waiting, ((i + 1) * total // parts[s], s, i + 1))
    return slots


def phases(blocks: list[int], parts: list[int]) -> list[list[dict]]:
    """For each source its phases: first block, blocks, first slot, length of a period and its slots."""
    out: list[list[dict]] = [[] for _ in blocks]
    used, begin = [0] * len(blocks), 0
    while left := [s for s in range(len(blocks)) if used[s] < blocks[s]]:
        left = [s for s in left if parts[s]] or left
        now = [parts[s] or 1 for s in left]
        slots, size = period(now), sum(now)
        rest = [blocks[s] - used[s] for s in left]
        end = 1 + min((r - 1) // len(p) * size + p[(r - 1) % len(p)] for r, p in zip(rest, slots, strict=True))
        for s, p in zip(left, slots, strict=True):
            n = end // size * len(p) + sum(t < end % size for t in p)
            if n:
                out[s].append({"first": used[s], "n": n, "slot": begin, "size": size, "slots": p})
            used[s] += n
        begin += end
    return out


def parts_by_size(counts: list[int]) -> list[int]:
    """Target weights that flatten sizes: proportional to the square root."""
    return scaled([math.sqrt(n) for n in counts])


def scaled(weights: list[float]) -> list[int]:
    """Whole parts in proportion to the weights, about PARTS in all and at least one for each that isn't 0."""
    total = sum(weights)
    return [max(1, round(PARTS * w / total)) if w else 0 for w in weights]


def order(docs: DataFrame) -> Column:
    """The pseudo-random order of rows, from all columns but maps."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)), F.lit(SEED))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, names: tuple[str, str, str] = ("block", "slot", "place"), key: str | None = None) -> DataFrame:
    """docs with three more columns: the block within its source, its slot, and the place in the block.

    Rows in order of slot and place are the mix. weights: parts by source, scaled if they are not whole or
    add up to more than PARTS; without them they follow from the sizes of the sources. key: the column that
    has `order` already.
    """
    spark = docs.sparkSession
    source = F.col("source").cast("string").alias("source")
    counted = docs.groupBy(source).count()
    known = counted.orderBy(F.desc("count"), F.asc_nulls_first("source")).limit(MAX_SOURCES).collect()
    rest = []
    if len(known) == MAX_SOURCES:  # perhaps not all: the smaller ones are one
        known = known[:-1]
        total = docs.count() - sum(x["count"] for x in known)
        rest = [total] if weights is None else [total, sum(weights.get(x, 1) for x in {*weights} - {x["source"] for x in known}) or 1]
    known = sorted(known, key=lambda x: (x["source"] is not None, x["source"]))
    counts = [x["count"] for x in known] + rest[:1]
    if weights is None:
        parts = parts_by_size(counts)
    else:
        parts = [weights.get(x["source"], 1) for x in known] + rest[1:]
        parts = parts if all(w == int(w) for w in parts) and sum(parts) <= PARTS else scaled(parts)
    plan = [[p | {"id": s} for p in own] for s, own in enumerate(phases([-(-n // block) for n in counts], [int(w) for w in parts]))]
    ids = spark.createDataFrame([(x["source"], s) for s, x in enumerate(known)], "of string, id int")
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([p for own in plan for p in own])), "array<struct<id:int,first:long,n:long,slot:long,size:long,slots:array<int>>>")))
    table = F.broadcast(table.select(F.col("id").alias("phase_id"), "first", "n", F.col("slot").alias("begin"), "size", "slots"))

    bits = max(1, math.ceil(math.log2(max(2, max(counts, default=1) / RANGE))))
    hashed = order(docs) if key is None else F.col(f"`{key}`")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), hashed.alias("key"), source)
    rows = rows.join(F.broadcast(ids), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("id", F.coalesce("id", F.lit(len(known))))
    # the first digit of an unsigned order; within a part the signed order of the keys is the same
    rows = rows.select("row", "key", "id", F.shiftrightunsigned("key", 64 - bits).alias("part"))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("id", "part").orderBy("key")).cast("long") - 1)
    sizes = rows.groupBy("id", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = numbered.join(sizes.select("id", "part", before.alias("before")), ["id", "part"])
    ranked = ranked.select("row", "id", (F.col("at") + F.col("before")).alias("rank")).withColumn("block", F.floor(F.col("rank") / block))
    within = F.col("block") - F.col("first")
    width = F.size("slots")
    slot = F.col("begin") + F.floor(within / width) * F.col("size") + F.element_at("slots", F.pmod(within, width).cast("int") + 1)
    placed = ranked.join(table, (F.col("id") == F.col("phase_id")) & F.expr("first <= block and block < first + n"))
    return placed.select("row.*", F.col("block").alias(names[0]), slot.alias(names[1]), F.pmod("rank", F.lit(block)).cast("int").alias(names[2]))


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """The rows of docs in the order of their mix: as many runs of slots as there are partitions, each sorted in
    a partition of its own. Texts cross two shuffles, one to be numbered and one to their place. Written as Parquet,
    the files keep the order, see `file_places`."""
    names = ("\x01block", "\x01slot", "\x01place")
    mixed = mix_sources(docs, weights, names=names)
    n = partitions(docs.sparkSession)
    blocks = docs.groupBy("source").count().agg(F.sum(F.ceil(F.col("count") / BLOCK))).first()[0] or 1
    run = F.least(F.floor(F.col(names[1]) * n / F.lit(blocks)), F.lit(n - 1)).cast("int")
    return mixed.repartitionById(n, run).sortWithinPartitions(*names[1:]).select(*(F.col(f"`{c}`") for c in docs.columns))


def file_places(docs: DataFrame) -> dict[str, Column] | None:
    """The file and the row in it that each row of docs comes from; None if it comes from no Parquet file."""
    try:
        of = docs.metadataColumn("_metadata")
        found = {"file": of["file_path"], "row": of["row_index"]}
        docs.select(*found.values())
    except AnalysisException:
        return None
    return found


def by_files(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (file, row and any others) with slot and place in the order of the files, for which Spark's names have
    the number of the partition, and of the rows in them. One row for each file is broadcast."""
    files = rows.groupBy("file").agg((F.max("row") + 1).alias("n"))
    earlier = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("row")
    placed = rows.join(F.broadcast(files), "file")
    return placed.withColumn("slot", F.floor(rank / block)).withColumn("place", F.pmod(rank, F.lit(block)).cast("int"))

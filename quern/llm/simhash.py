"""Operator 8, SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits. Of at most MAX_BITS differing bits
two segments hold at most one each, or none and two. The perfect Golay code of length 23 decodes every
segment to the one codeword within 3 bits. If two segments differ in one bit, each has the other's
codeword within 4 bits, of which there are 1 or 6; if they differ in two, they share a codeword within 4
bits of both, the one nearest to the segment halfway. So for each two segments a fingerprint's keys are
the nearest codeword of one with all codewords within 4 bits of the other, 1 to 11 pairs of codeword
indices, and fingerprints within MAX_BITS always meet under one. Those that meet are verified on all 64
bits. Equal fingerprints are one node. A bucket gives the pairs of its links or, if it is large, a
spanning forest of them, and components come from rounds of joins (components.components).

near_dedup compares texts as well. Equal texts are one node, which has several fingerprints of its
different words, seeded differently, and sketches, fingerprints of the set of its shingles of `words`
words. A candidate is a pair within max_bits in one of the fingerprints, within SKETCH_BITS in the first
sketch and within WIDE_BITS in all WIDE of them (texts with 0.8 of the shingles in common differ in about 10
and 39 bits, with 2.7 and 5.5 as deviations; others in about 32 and 128). Candidates are verified by the
Jaccard similarity of the shingles, and components are those of all similar candidates at every bucket size.
A forest of a large bucket is of pairs near in fingerprint and first sketch, so where a link of it turns out
not to be similar, the component of candidates around it stays open. Its nodes are grouped by verified links
alone, and each that is not in the largest group is compared with all its candidates of other groups: both
sides are dealt into blocks of about BLOCK shingles, a task compares one block of askers with one of nodes,
and only links that join two groups leave it.

Edge cases: a null or empty text, or one without words, has fingerprint zero, linked like any other. A
text of fewer words than a shingle has one shingle, the whole. component_id is the smallest doc_id
reachable; null only if no row of the component has one. Repeated rows count as equal fingerprints.
An empty table gives an empty result. Other columns are ignored by simhash and kept by near_dedup, whatever
their names. Of equal texts near_dedup keeps the row with the smallest doc_id, null last, and of rows with
equal ids that with the smallest other columns as JSON. Texts are nodes by 64 bits of a hash; should two
different ones share them, one is compared with no other and stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .components import components
from .repeats import word_ids
from .store import bucketed, mark, partitions, release, text_id, written

SHINGLE = 3
LINK_BITS = 3
#: The most bits that two fingerprints may differ in and still always meet.
MAX_BITS = 4
SEED = 42
#: Of near_dedup: fingerprints of a text, and words of a shingle.
FAMILIES = 3
WORDS = 5
SIMILARITY = 0.8
#: The generator polynomial of the binary Golay code of length 23: x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
#: Buckets of more entries give a spanning forest instead of all pairs.
SMALL = 16
#: In buckets of up to so many entries those without a link are set aside before the search.
MEDIUM = 512
#: Sketches of a text; the most bits that the first of two candidates, and all of them, differ in.
WIDE = 4
SKETCH_BITS = 18
WIDE_BITS = 54
#: Differing bits of sketches up to which the links of a large bucket are sought, one after another.
LEVELS = (5, 10, 14, SKETCH_BITS)
#: Shingles of the askers, and of the others, in one block of comparisons; what a node weighs besides its own.
BLOCK = 1 << 20
NODE_WEIGHT = 1024


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.append(0, ends[:-1] + 1)
    last = max(1, len(words) - size + 1)
    first, to = begins[:last].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(text[a:b], SEED) for a, b in zip(first, to, strict=True)), np.uint64, last))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of h."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        count += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [fingerprint(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.array(made, np.uint64).view(np.int64))], ["doc", "print"])


def wide_sketch(shingles: np.ndarray) -> list[int]:
    return [majority(shingles), *(majority(grams.mix(shingles, np.full(1, seed, np.uint64))) for seed in range(1, WIDE))]


def sketches(data: bytes, families: int = FAMILIES, words: int = WORDS) -> list[int]:
    """The fingerprints of the different words of a text, one for each seed, and its first sketch."""
    one = shingles(data, 1)
    return [*(majority(grams.mix(one, np.full(1, seed, np.uint64))) for seed in range(families)), majority(shingles(data, words))]


def _sketched(batches: Iterator[pa.RecordBatch], families: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            made = np.array([sketches(t, families, words) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, families + 1).view(np.int64)
            prints = pa.array(list(made[:, :families]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("tid"), part.column("doc"), prints, pa.array(made[:, families])], ["tid", "doc", "prints", "sketch"])


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each byte at each of three places, and for each syndrome the 1 or 6 error
    patterns of at most 4 bits that have it, the lightest first, filled up with -1."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GOLAY << (bit - 11)
        return v

    single = [syndrome(1 << b) for b in range(24)][:23] + [0]
    places = np.zeros((3, 256), np.int64)
    for place in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1:
                    places[place, value] ^= single[8 * place + bit]
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s, v = 0, 0
            for b in bits:
                s ^= single[b]
                v |= 1 << b
            patterns[s, used[s]] = v
            used[s] += 1
    return places, patterns


def _codewords(segment: np.ndarray) -> np.ndarray:
    """(n, 6): indices of the codewords within 4 bits, the nearest first; -1 for none."""
    places, patterns = _golay()
    error = patterns[places[0][segment & 255] ^ places[1][segment >> 8 & 255] ^ places[2][segment >> 16]]
    return np.where(error < 0, -1, (segment[:, None] ^ error) >> 11)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arrays key and index of the fingerprint, for all keys of each."""
    segments = [(prints & np.uint64((1 << 23) - 1)).astype(np.int64), (prints >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64), (prints >> np.uint64(46)).astype(np.int64)]
    words = [_codewords(s) for s in segments]
    keys, index = [], []
    for which, (i, j) in enumerate(combinations(range(3), 2)):
        left = np.concatenate([words[i], np.repeat(words[i][:, :1], 5, axis=1)], axis=1)
        right = np.concatenate([np.repeat(words[j][:, :1], 6, axis=1), words[j][:, 1:]], axis=1)
        ok = (left >= 0) & (right >= 0)
        keys.append(((which << 24) | (left << 12) | right)[ok])
        index.append(np.broadcast_to(np.arange(len(prints))[:, None], ok.shape)[ok])
    return np.concatenate(keys), np.concatenate(index)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of a fingerprint, which all columns of the fingerprint go along with; those of
    different families don't meet."""
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        family = columns[batch.schema.names.index("family")].astype(np.int64)
        prints = columns[batch.schema.names.index("print")].view(np.uint64)
        for at in range(0, len(prints), 4096):
            key, index = keys_of(prints[at : at + 4096])
            key += family[at + index] * 3 << 24
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(pa.array(c[at + index]) for c, n in zip(columns, batch.schema.names, strict=True) if n != "family")], ["key", *(n for n in batch.schema.names if n != "family")])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _search(prints: np.ndarray, sketch: np.ndarray, max_bits: int, most: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of indices, of the links of at most max_bits, and `most` of the sketches."""
    left = np.arange(len(prints))
    if len(left) <= MEDIUM:
        near = (_bits(prints[:, None] ^ prints) <= max_bits) & (_bits(sketch[:, None] ^ sketch) <= most)
        left = left[near.sum(axis=1) > 1]
    links: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = (_bits(prints[left] ^ prints[i]) <= max_bits) & (_bits(sketch[left] ^ sketch[i]) <= most)
            found = left[near]
            links += [(int(i), j) for j in found.tolist()]
            queue += list(found)
            left = left[~near]
    return links


def forest(prints: np.ndarray, max_bits: int, node: np.ndarray | None = None, sketch: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among these nodes; with sketches, links of close ones first."""
    node, first = np.unique(prints if node is None else node, return_index=True)
    prints = prints[first]
    if sketch is None:
        return [(int(node[i]), int(node[j])) for i, j in _search(prints, prints, max_bits, max_bits)]
    above = list(range(len(node)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    links = []
    for most in LEVELS:
        for i, j in _search(prints, sketch[first], max_bits, most):
            a, b = top(i), top(j)
            if a != b:
                above[a] = b
                links.append((int(node[i]), int(node[j])))
    return links


def _met(key: np.ndarray, prints: np.ndarray, sketch: np.ndarray | None = None, node: np.ndarray | None = None, *, max_bits: int) -> pa.RecordBatch:
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    links: list[tuple[int, int]] = []
    keys: list[int] = []
    for b, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        found = forest(prints[b : b + n], max_bits, *(None if x is None else x[b : b + n] for x in (node, sketch)))
        links += found
        keys += [int(key[b])] * len(found)
    group = np.repeat(np.arange(len(begin)), size)
    rows = np.flatnonzero((size[group] > 1) & (size[group] <= SMALL))
    n = begin[group[rows]] + size[group[rows]] - rows - 1  # entries after it in its bucket
    left = np.repeat(rows, n)
    right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, y = (prints if node is None else node)[left], (prints if node is None else node)[right]
    near = (x != y) & (_bits(prints[left] ^ prints[right]) <= max_bits)
    if sketch is not None:
        near &= _bits(sketch[left] ^ sketch[right]) <= SKETCH_BITS
    pairs = np.concatenate([np.stack([x[near], y[near]], axis=1), np.array(links, np.int64).reshape(-1, 2)])
    of = np.append(np.full(near.sum(), -1), np.array(keys, np.int64)) if sketch is not None else np.full(len(pairs), -1)
    pairs = np.unique(np.stack([pairs.max(axis=1), pairs.min(axis=1), of], axis=1), axis=0) if len(pairs) else np.empty((0, 3), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(np.int32))], ["a", "b", "key"])


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """a, b and, with sketches, the key of a large bucket that gave the link; -1 for others."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names)
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on
        if cut:
            whole = [np.concatenate(x) for x in zip(*held, tuple(x[:cut] for x in now), strict=True)]
            yield _met(*whole, max_bits=max_bits)
            held = [tuple(x[cut:] for x in now)]
        elif held and held[-1][0][-1] != now[0][0]:
            yield _met(*[np.concatenate(x) for x in zip(*held, strict=True)], max_bits=max_bits)
            held = [now]
        else:
            held.append(now)
    if held:
        yield _met(*[np.concatenate(x) for x in zip(*held, strict=True)], max_bits=max_bits)


def _compared(table: pa.Table, max_bits: int, similarity: float) -> pa.Table:
    """Links (a, b) of similar texts between the askers and the others of one block, as far as they join
    groups that are not joined yet."""
    asking = table.filter(table.column("asking"))
    rest = table.filter(pc.invert(table.column("asking")))
    if not len(asking) or not len(rest):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    a, b = ({c: t.column(c).to_numpy() for c in ("node", "group", "open")} for t in (asking, rest))
    prints, wide = ([_matrix(t.column(c)) for t in (asking, rest)] for c in ("prints", "wide"))
    ids = rest.column("shingles").combine_chunks()
    size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    known, held = np.unique(ids.flatten().to_numpy(), return_inverse=True)
    group = np.concatenate([a["group"], b["group"]])
    mine, others = group[: len(asking)], group[len(asking) :]
    found: list[tuple[int, int]] = []
    own = asking.column("shingles").combine_chunks()
    for i in range(len(asking)):
        bits = _bits(wide[1] ^ wide[0][i])
        near = (_bits(prints[1] ^ prints[0][i]) <= max_bits).any(axis=1) & (bits[:, 0] <= SKETCH_BITS) & (bits.sum(axis=1, dtype=np.int64) <= WIDE_BITS)
        near &= (others != mine[i]) & (~b["open"] | (b["node"] < a["node"][i]))  # two that ask are compared once
        at = np.flatnonzero(near)
        if not len(at):
            continue
        mark = np.zeros(len(known), bool)
        shingled = own[i].values.to_numpy()
        mark[np.searchsorted(known, shingled[np.isin(shingled, known)])] = True
        n = size[at]
        ends = np.cumsum(n)
        hits = np.append(0, np.cumsum(mark[held[np.repeat(begin[at] - ends + n, n) + np.arange(n.sum())]]))
        common = hits[ends] - hits[ends - n]
        for j in at[common >= similarity * (len(shingled) + n - common)].tolist():
            if others[j] != mine[i]:
                found.append((max(a["node"][i], b["node"][j]), min(a["node"][i], b["node"][j])))
                group[group == others[j]] = mine[i]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().reshape(len(lists), -1)


def shingles(data: bytes, size: int) -> np.ndarray:
    """The different runs of `size` lower-cased words, as identifiers."""
    ids = word_ids(data.lower())
    return np.unique(grams.gram_ids(ids, 1, min(size, len(ids)))) if len(ids) else ids


def _shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sketches of each text and its shingles, as 32 bits each."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            sets = [shingles(t, size) for t in part.column("text").cast(pa.binary()).to_pylist()]
            wide = np.array([wide_sketch(x) for x in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
            short = [np.unique((x >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in sets]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("prints"), pa.array(list(wide), pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int32()))], ["node", "prints", "wide", "shingles"])


def _similar(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of links (a, b) whose texts are similar. sets: node, wide, shingles."""
    wide = [sets.select(F.col("node").alias(c), F.col("wide").alias(f"wide_{c}")) for c in ("a", "b")]
    bits = F.aggregate(F.arrays_zip("wide_a", "wide_b"), F.lit(0), lambda n, x: n + F.bit_count(x["wide_a"].bitwiseXOR(x["wide_b"])))
    near = links.join(wide[0], "a").join(wide[1], "b").filter(bits <= WIDE_BITS).select("a", "b")
    own = [sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b")]
    both = near.join(own[0], "a").join(own[1], "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(F.col("common") >= similarity * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def _comparing(max_bits: int, similarity: float) -> Callable[[pa.Table], pa.Table]:
    def compare(table: pa.Table) -> pa.Table:
        return _compared(table, max_bits, similarity)

    return compare


def _members(stars: DataFrame, name: str) -> DataFrame:
    """Of components(...), which has no rows of the roots: each node with its root, in a column of this name."""
    member = stars.withColumnRenamed("root", name)
    return member.unionByName(member.select(F.col(name).alias("node"), name).distinct())


def _all_similar(links: DataFrame, sets: DataFrame, similarity: float, max_bits: int) -> DataFrame:
    """Links (a, b) of similar texts whose components are those of all similar candidates. links: of _links;
    sets: node, prints, wide and shingles of each node that has a link."""
    good = written(_similar(links.select("a", "b").distinct(), sets, similarity), "similar")
    failed = links.filter("key >= 0").join(good, ["a", "b"], "left_anti")
    if failed.isEmpty():  # forests whose links all hold leave nothing open
        return good
    whole, joined = _members(components(links), "root"), components(good)
    going = whole.join(failed.select(F.col("a").alias("node")).distinct(), "node").select("root").distinct()
    nodes = whole.join(going, "root", "left_semi").join(_members(joined, "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    nodes = written(nodes.join(sets, "node"), "open")
    weight = (F.size("shingles") + NODE_WEIGHT).cast("long")
    groups = nodes.groupBy("root", "group").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n"))
    roots = groups.groupBy("root").agg(F.max_by(F.struct("group", "weight"), F.struct("n", "group")).alias("main"), F.sum("weight").alias("weight"))
    roots = roots.select("root", F.col("main.group").alias("main"), F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("weight") - F.col("main.weight")) / BLOCK).cast("int").alias("ask_blocks"))
    dealt = nodes.join(roots.filter("ask_blocks > 0"), "root").withColumn("open", F.col("group") != F.col("main"))
    place = F.xxhash64("node", F.lit(SEED))
    own = ["root", "node", "group", "open", "prints", "wide", "shingles"]
    ask = dealt.filter("open").select(*own, F.lit(True).alias("asking"), F.pmod(place, "ask_blocks").cast("int").alias("ask_block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rest = dealt.select(*own, F.lit(False).alias("asking"), F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("ask_block"), F.pmod(place, "blocks").cast("int").alias("block"))
    more = ask.unionByName(rest).groupBy("root", "ask_block", "block").applyInArrow(_comparing(max_bits, similarity), "a long, b long")
    return joined.toDF("a", "b").unionByName(written(more, "more"))


def _meeting(places: DataFrame, max_bits: int) -> DataFrame:
    return places.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_links, max_bits=max_bits), "a long, b long, key int")


def simhash(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = LINK_BITS) -> DataFrame:
    """Per row of docs: doc_id, fingerprint, component_id. Fingerprints of `shingle`-word shingles, repeats
    included, link at max_bits or fewer differing bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find fingerprints of at most {MAX_BITS} differing bits")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(slim.mapInArrow(partial(_fingerprints, size=shingle), "doc long, print long"), "prints")
    nodes = written(rows.groupBy("print").agg(F.min("doc").alias("least")), "nodes")
    places = nodes.select("print", F.lit(0).alias("family")).mapInArrow(_places, "key int, print long")
    member = components(_meeting(places, max_bits)).withColumnRenamed("node", "print")
    root = nodes.join(member, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = root.join(least, "root").select("print", "component_id")
    return rows.join(labels, "print").select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def different_texts(docs: DataFrame) -> DataFrame:
    """tid, doc and row of each different text: the row of the smallest doc_id. Rows are merged before the
    shuffle, the only one that texts cross; the table is bucketed by tid."""
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    doc = F.col("doc_id").cast("long")
    rows = docs.select(text_id(F.coalesce("text", F.lit(""))).alias("tid"), F.struct(doc.isNull(), doc, F.to_json(F.struct(*others))).alias("order"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    best = rows.groupBy("tid").agg(F.min_by("row", "order").alias("row"))
    return bucketed(best.select("tid", F.col("row.doc_id").cast("long").alias("doc"), "row"), "tid", partitions(spark))


def near_classes(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, max_bits: int = MAX_BITS, families: int = FAMILIES) -> DataFrame:
    """tid, doc and root of each of different_texts that has a near copy; a class has one root."""
    slim = texts.select("tid", "doc", F.coalesce("row.text", F.lit("")).alias("text"))
    kinds = "tid binary, doc long, prints array<bigint>, sketch long"
    made = slim.mapInArrow(partial(_sketched, families=families, words=words), kinds)
    nodes = written(made.withColumn("node", F.xxhash64("tid")), "sketches")
    one = nodes.groupBy("node").agg(F.min_by(F.struct("prints", "sketch"), "tid").alias("x")).select("node", F.col("x.sketch").alias("sketch"), F.posexplode("x.prints").alias("family", "print"))
    places = one.select("family", "print", "sketch", "node").mapInArrow(_places, "key int, print long, sketch long, node long")
    links = written(_meeting(places, max_bits).distinct(), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    of = nodes.groupBy("node").agg(F.min(F.struct("tid", "prints")).alias("x")).join(ends, "node").select("node", "x.tid", "x.prints")
    own = slim.select("tid", "text").join(of.hint("shuffle_hash"), "tid").select("node", "prints", "text")
    sets = written(own.mapInArrow(partial(_shingled, size=words), "node long, prints array<bigint>, wide array<bigint>, shingles array<int>"), "shingles")
    member = _members(components(_all_similar(links, sets, similarity, max_bits)), "root")
    return of.select("node", "tid").join(member, "node").join(nodes.select("tid", "doc"), "tid").select("tid", "doc", "root")


def near_dedup(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, max_bits: int = MAX_BITS, families: int = FAMILIES) -> DataFrame:
    """One row of docs of each class of near copies: that of the smallest doc_id."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find fingerprints of at most {MAX_BITS} differing bits")
    texts = different_texts(docs)
    since = mark()
    classes = written(near_classes(texts, words, similarity, max_bits, families), "classes")
    release(docs.sparkSession, since)
    order = F.struct(F.col("doc").isNull(), F.col("doc"), F.col("tid"))
    first = classes.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.tid").alias("stays"))
    gone = classes.join(first, "root").filter("tid != stays").select("tid")
    return texts.join(gone.hint("shuffle_hash"), "tid", "left_anti").select("row.*")

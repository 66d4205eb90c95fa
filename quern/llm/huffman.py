"""Canonical Huffman codes of limited length, and their encoding and table-driven decoding in numpy."""

from __future__ import annotations

import numpy as np

#: Ids between two checkpoints.
STEP = 256


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """The best code lengths of at most `limit` bits (package-merge); 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(ids)))))
    ids = ids[np.argsort(counts[ids], kind="stable")]
    single = counts[ids].astype(np.int64)
    level, own = single, [np.ones(len(single), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        order = np.argsort(np.concatenate([single, pairs]), kind="stable")
        level = np.concatenate([single, pairs])[order]
        own.append(order < len(single))
    take = 2 * len(ids) - 2
    for singles in reversed(own):
        n = int(singles[:take].sum())
        lengths[ids[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter ones first, ids in order within a length."""
    codes = np.zeros(len(lengths), np.uint64)
    code, bits = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - bits
        bits = n
        ids = np.flatnonzero(lengths == n)
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def encode(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The documents that end at `ends` as bits, each from a whole byte on.

    Returns the bytes, the first byte of each document and after the last, and the bit offset within
    its document of each STEP-th id, document after document.
    """
    n = lengths[ids].astype(np.int64)
    before = np.cumsum(n) - n
    begins = np.append(0, ends[:-1])
    bits = np.add.reduceat(n, begins) if len(ids) else np.zeros(0, np.int64)
    size = (bits + 7) // 8
    first = np.append(0, np.cumsum(size))
    count = ends - begins
    within = before - np.repeat(before[begins], count)
    at = within + np.repeat(first[:-1] * 8, count)
    code = codes[ids]
    word, room = at >> 6, 64 - (at & 63) - n
    out = np.zeros(int(first[-1] + 7) // 8 + 2, np.uint64)
    value = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out[word[new]] = np.bitwise_or.reduceat(value, new)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    index = np.arange(len(ids)) - np.repeat(begins, count)
    return out.astype(">u8").tobytes()[: int(first[-1])], first, within[index % STEP == 0]


class Decoder:
    """Decodes many stretches of STEP ids at once: one table look-up gives id and length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        ids = np.flatnonzero(lengths)
        order = ids[np.lexsort((ids, lengths[ids]))]
        span = 1 << (self.bits - lengths[order].astype(np.int64))
        self.ids = np.zeros(1 << self.bits, np.uint32)
        self.ids[: span.sum()] = np.repeat(order, span)
        self.sizes = np.ones(1 << self.bits, np.int64)
        self.sizes[: span.sum()] = np.repeat(lengths[order].astype(np.int64), span)

    def decode(self, data: bytes, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of stretches that begin at bits `at` and have `counts` ids, one after another."""
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        order = np.argsort(-counts, kind="stable")
        at, left = at[order].astype(np.int64), counts[order]
        out = np.empty((int(left.max(initial=0)), len(at)), np.uint32)
        for step in range(len(out)):
            n = int(np.searchsorted(-left, -step, side="left"))  # stretches that have more than `step` ids
            bit = at[:n]
            peek = (window[bit >> 3] >> (32 - self.bits - (bit & 7)).astype(np.uint32)) & np.uint32((1 << self.bits) - 1)
            out[step, :n] = self.ids[peek]
            at[:n] += self.sizes[peek]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return out.T[back][np.arange(len(out))[None, :] < counts[:, None]]

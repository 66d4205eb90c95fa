"""Identifiers of fixed-length runs of units (bytes or words), and the anchors that sample them.

gram_ids doubles: the identifier of a run of 2n units is made from the identifiers of its two
halves, so each level reuses the one before at a later offset. Equal runs have equal identifiers
in every document and on every executor, without any exchange.

An anchor of a window of `window` units is the run of `gram` units inside it with the smallest
identifier, the leftmost of equal ones. It depends on the window's content alone, so equal windows
have their anchor at the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)
#: Units that are handled in one piece; longer documents are cut into overlapping pieces.
PIECE = 1 << 18
_POS = np.uint64(20)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of each pair (a, b), order counts."""
    h = a * _K1
    h ^= h >> _S
    t = b * _K2
    t ^= t >> _S
    h += t
    h *= _K3
    h ^= h >> _S
    h *= _K1
    h ^= h >> _S
    return h


def byte_grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one integer."""
    x = data.astype(np.uint16)
    x = x[:-1] | x[1:] << np.uint16(8)
    x = x.astype(np.uint32)
    x = x[:-2] | x[2:] << np.uint32(16)
    x = x.astype(np.uint64)
    return x[:-4] | x[4:] << np.uint64(32)


def gram_ids(ids: np.ndarray, have: int, want: int) -> np.ndarray:
    """From identifiers of runs of `have` units those of runs of `want` units, at each start."""
    while have < want:
        step = min(have, want - have)
        if len(ids) <= step:
            return ids[:0]
        ids = mix(ids[:-step], ids[step:])
        have += step
    return ids


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    return keys


def anchors(base: np.ndarray, have: int, starts: np.ndarray, ends: np.ndarray, gram: int, window: int):
    """The anchors of all windows of the documents that base holds one after another.

    base: identifiers of runs of `have` units at each position; starts, ends: where each document's
    units begin and end. Returns arrays doc (index), lo (first window, from the document's start),
    n (windows), bucket and ctx. A row stands for windows lo..lo+n-1, consecutive ones with the same
    anchor; bucket is the anchor's identifier, ctx one of all their units and the anchor's place.
    """
    width = window - gram + 1
    g = gram_ids(base, have, gram)
    total = len(base) + have - 1
    if total < window or len(g) < width:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    w = gram_ids(g, gram, window)
    keys = (g >> _POS << _POS) | np.arange(len(g), dtype=np.uint64)
    at = (_sliding_min(keys, width) & np.uint64((1 << 20) - 1)).astype(np.int64)[: len(w)]
    doc = np.full(total, -1, np.int64)  # the document of each window that lies in one
    for i in np.flatnonzero(ends - starts >= window):
        doc[starts[i] : ends[i] - window + 1] = i
    doc = doc[: len(at)]
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1], out=first[1:])
    first[1:] |= doc[1:] != doc[:-1]
    lo = np.flatnonzero(first)
    n = np.diff(np.append(lo, len(at)))
    ok = doc[lo] >= 0
    lo, n = lo[ok], n[ok]
    d, a = doc[lo], at[lo]
    place = (n.astype(np.uint64) << np.uint64(32)) | (a - lo).astype(np.uint64)
    ctx = mix(mix(w[lo], w[lo + n - 1]), place)
    return d, lo - starts[d], n, g[a], ctx


def pieces(lengths: list[int], overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Deals documents of these lengths into lists of (index, from, to) of about PIECE units.

    A long document is cut into parts that share `overlap` units, so each window lies in one part
    as a whole and begins in the owned range of exactly one.
    """
    now: list[tuple[int, int, int]] = []
    held = 0
    for i, n in enumerate(lengths):
        at = 0
        while True:
            to = min(n, at + PIECE + overlap)
            if held and held + to - at > 2 * PIECE:
                yield now
                now, held = [], 0
            now.append((i, at, to))
            held += to - at
            if to == n:
                break
            at += PIECE
    if now:
        yield now

"""Simple-8b: 64-bit words, a 4-bit selector on top and as many ids below as fit at one width. Numpy, both ways."""

from __future__ import annotations

import numpy as np

#: Ids and bits of a word, by selector. Selector 0 is the escape: one id of more than 60 bits, whose upper
#: four bits stand in the escape stream.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Ids of a block. No word crosses a block, so blocks decode on their own.
BLOCK = 4096
_LOW = (1 << 60) - 1
_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; exact, as a double holds 53 bits and larger ids are shifted first. Ids of 16 bits are looked up."""
    if len(ids) and ids.max() < len(_SHORT):
        return _SHORT[ids]
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[bytes, list[int], bytes]:
    """(words, little-endian; first word of each block; escape stream) of unsigned ids.

    Each word takes the most ids that fit from where the last one ended, up to the block's end.
    """
    ids = ids.astype(np.uint64)
    blocks, pad = -(-len(ids) // BLOCK), int(COUNTS.max())
    if not blocks:
        return b"", [], b""
    row = BLOCK + pad  # each block with zeros behind it, so that no look ahead meets the next block
    padded = np.zeros((blocks, row), np.uint64)
    for k in range(blocks):
        part = ids[k * BLOCK : (k + 1) * BLOCK]
        padded[k, : len(part)] = part
    flat = padded.ravel()
    widths = _widths(flat)
    widest = {1: widths}  # k: the widest of k ids from each place
    for k in range(1, 7):
        half, whole = 1 << (k - 1), 1 << k
        widest[whole] = widest[half].copy()
        np.maximum(widest[whole][:-half], widest[half][half:], out=widest[whole][:-half])
    best = np.full(len(flat), 15, np.uint8)
    best[widths > 60] = 0
    for s in range(14, 0, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        ahead = widest[p].copy()
        np.maximum(ahead[: len(flat) - (c - p)], widest[p][c - p :], out=ahead[: len(flat) - (c - p)])
        np.copyto(best, np.uint8(s), where=ahead <= BITS[s])
    step, ends = COUNTS[best].astype(np.int16), np.minimum(np.arange(1, blocks + 1) * BLOCK, len(ids)) - np.arange(blocks) * BLOCK
    at, base, taken = np.zeros(blocks, np.int64), np.arange(blocks) * row, []
    open_ = np.arange(blocks)
    while len(open_):  # the next word of every block that isn't at its end
        here = base[open_] + at[open_]
        taken.append(here)
        at[open_] += step[here]
        open_ = open_[at[open_] < ends[open_]]
    starts = np.sort(np.concatenate(taken))
    offsets = np.searchsorted(starts, base).tolist()
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        rows, b = np.flatnonzero(chosen == s), int(BITS[s])
        for k in range(int(COUNTS[s]) if b else 0):
            words[rows] |= (flat[starts[rows] + k] & np.uint64(_LOW)) << np.uint64(k * b)
    escapes = (flat[starts[chosen == 0]] >> np.uint64(60)).astype(np.uint8).tobytes()
    return words.astype("<u8").tobytes(), offsets, escapes


def decode(words: bytes, n: int, offsets: list[int], escapes: bytes = b"") -> np.ndarray:
    """The n ids again, all blocks and all words of a selector at once."""
    w = np.frombuffer(words, "<u8")
    if not n:
        return np.zeros(0, np.uint64)
    selector = (w >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selector])
    before = ends - COUNTS[selector]
    first = np.asarray(offsets, np.int64)
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
    starts = before - before[first][block] + block * BLOCK
    limits = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector).tolist():
        rows, c, b = np.flatnonzero(selector == s), int(COUNTS[s]), int(BITS[s])
        places = starts[rows][:, None] + np.arange(c)
        inside = places < limits[rows][:, None]  # the last word of a block may be padded
        values = (w[rows][:, None] >> (np.arange(c) * b).astype(np.uint64)) & np.uint64((1 << b) - 1)
        if s == 0:
            values |= (np.frombuffer(escapes, np.uint8).astype(np.uint64) << np.uint64(60))[:, None]
        out[places[inside]] = values[inside]
    return out

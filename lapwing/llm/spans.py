"""Spans of bytes named by numpy: 128-bit names of many short spans at once, and a table from names to numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Longer spans are hashed one by one.
LONG = 256


def names(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span of data; spans are read eight bytes at a time, all at once."""
    loads = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))
    size = sizes.astype(np.uint64)
    part = loads[starts] & _MASKS[np.minimum(sizes, 8)]
    one, two = (part ^ (size * _C)) * _A, (part + size) * _B
    one ^= one >> np.uint64(32)
    two ^= two >> np.uint64(29)
    at = 8
    more = np.flatnonzero(sizes > 8)
    while len(more) and at < LONG:
        left = sizes[more] - at
        part = loads[starts[more] + at] & _MASKS[np.minimum(left, 8)]
        x, y = (one[more] + part) * _B, (two[more] ^ part) * _C
        one[more], two[more] = x ^ (x >> np.uint64(30)), y ^ (y >> np.uint64(33))
        at += 8
        more = more[left > 8]
    for k in more.tolist():
        whole = xxhash.xxh3_128_intdigest(data[starts[k] : starts[k] + sizes[k]])
        one[k], two[k] = np.uint64(whole >> 64), np.uint64(whole & (2**64 - 1))
    one *= _C
    two *= _A
    return one ^ (one >> np.uint64(31)), two ^ (two >> np.uint64(32))


class Table:
    """Names to the numbers 0, 1, 2 ... in the order in which they were added; open addressing in flat arrays, at most half full."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.slots = np.full(1 << (2 * most - 1).bit_length(), -1, np.int32)
        self.one, self.two, self.n = np.zeros(most, np.uint64), np.zeros(most, np.uint64), 0

    def _place(self, one: np.ndarray) -> np.ndarray:
        return (one & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each name, -1 for an unknown one."""
        place = self._place(one)
        out = self.slots[place]
        wrong = np.flatnonzero((out >= 0) & ((self.one[out] != one) | (self.two[out] != two)))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & (len(self.slots) - 1)
            got = self.slots[place[wrong]]
            out[wrong] = got
            wrong = wrong[(got >= 0) & ((self.one[got] != one[wrong]) | (self.two[got] != two[wrong]))]
        return out

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        """Add names that are new and differ from one another."""
        numbers = np.arange(self.n, self.n + len(one), dtype=np.int32)
        self.one[numbers], self.two[numbers] = one, two
        self.n += len(one)
        place, left = self._place(one), np.arange(len(one))
        while len(left):
            free = left[self.slots[place[left]] < 0]
            self.slots[place[free]] = numbers[free]  # of several at one place the last stays
            left = left[self.slots[place[left]] != numbers[left]]
            place[left] = (place[left] + 1) & (len(self.slots) - 1)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def texts_of(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """(bytes of all texts of a string column without nulls, where each begins and the last ends)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b""), offsets - offsets[0]


def words_of(data: bytes, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its size, words before each text and in all): words are what bytes of `between` part, as a rule ASCII white space; none crosses a text."""
    inside = ~between[np.frombuffer(data, np.uint8)]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, offsets)

"""Numpy kernels over the UTF-8 bytes of many texts at once: segments, hashes, caches by hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}

#: Class of each byte that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_tables.get("up", ())) < n:
        n = max(n, 1 << 22)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            t = np.full(n, base, U)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment's bytes, wherever it stands."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``most`` text bytes (at least a row): rows, their bytes, offsets. Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, to - row), data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def word_bounds(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of all texts."""
    word = ~SPACE[buf]
    cutoff = np.zeros(len(buf) + 1, bool)
    cutoff[at] = True
    before = np.zeros(len(buf), bool)
    before[1:] = word[:-1]
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | cutoff[:-1]))
    ends = np.flatnonzero(word & (~after | cutoff[1:])) + 1
    return starts, ends


def word_hashes(buf: np.ndarray, at: np.ndarray, table: np.ndarray, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, bytes mapped by ``table`` first, and where each text's begin.

    A text of more than ``most`` bytes must be alone; it is worked through in stretches of so many
    that end between words, so that little but its words' hashes is held at once.
    """
    if len(buf) <= most:
        starts, ends = word_bounds(buf, at)
        return hashes(table[buf], starts, ends), np.searchsorted(starts, at)
    found, a = [np.zeros(0, U)], 0
    while a < len(buf):
        part = buf[a : a + most + 1]
        if len(part) > most:
            gaps = np.flatnonzero(SPACE[part])
            if not len(gaps):  # one word: its end is beyond
                end = a + most
                while end < len(buf) and not SPACE[buf[end]]:
                    step = np.flatnonzero(SPACE[buf[end : end + most]])
                    end = end + int(step[0]) if len(step) else min(len(buf), end + most)
                found.append(np.array([xxhash.xxh64_intdigest(table[buf[a:end]].tobytes())], U))
                a = end
                continue
            part = part[: gaps[-1] + 1]
        starts, ends = word_bounds(part, np.array([0, len(part)]))
        found.append(hashes(table[part], starts, ends))
        a += len(part)
    h = np.concatenate(found)
    return h, np.array([0, len(h)])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one run after another."""
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lens)


class RaggedCache:
    """From 64-bit hashes to runs of numbers: an open-addressing table kept by a Python worker.

    ``fill`` gets the hashes that are missing and returns their runs. When more than ``most``
    hashes are kept, the table starts anew.
    """

    def __init__(self, dtype, most: int = 1 << 20):
        self.dtype, self.most = dtype, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(1 << 16, U), np.full(1 << 16, -1, np.int32), 0
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0
        self.start, self.len = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes' runs, -1 where missing."""
        mask = U(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            s = slot[todo]
            v = self.at[s]
            hit = (v >= 0) & (self.keys[s] == h[todo])
            out[todo[hit]] = v[hit]
            todo = todo[(v >= 0) & ~hit]
            slot[todo] = (slot[todo] + 1) & int(mask)
        return out

    def _place(self, h: np.ndarray, values: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (h & U(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self.at[s] < 0
            _, first = np.unique(s[free], return_index=True)
            won = todo[free][first]
            self.at[slot[won]], self.keys[slot[won]] = values[won], h[won]
            lost = np.ones(len(h), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            taken = self.at[slot[todo]] >= 0
            slot[todo[taken]] = (slot[todo[taken]] + 1) & mask

    def add(self, h: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        """Distinct hashes that are not yet there."""
        if (self.n + len(h)) * 2 > len(self.keys):
            size = len(self.keys)
            while size < (self.n + len(h)) * 3:
                size *= 2
            old = self.at >= 0
            keys, values = self.keys[old], self.at[old]
            self.keys, self.at = np.zeros(size, U), np.full(size, -1, np.int32)
            self._place(keys, values)
        if self.n + len(h) > len(self.start):
            grow = max(len(self.start), len(h))
            self.start, self.len = np.concatenate([self.start, np.zeros(grow, np.int64)]), np.concatenate([self.len, np.zeros(grow, np.int32)])
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.dtype)])
        self._place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.start[self.n : self.n + len(h)] = self.used + np.cumsum(lens) - lens
        self.len[self.n : self.n + len(h)] = lens
        self.pool[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(h), self.used + len(flat)

    def runs(self, h: np.ndarray, fill: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All runs one after another, and the length of each. fill(positions of the missing, their hashes) returns their flat runs and lengths."""
        if self.n > self.most:
            self.clear()
        found = self.find(h)
        if (found < 0).any():
            lack = np.flatnonzero(found < 0)
            new, first = np.unique(h[lack], return_index=True)
            self.add(new, *fill(lack[first], new))
            found[lack] = self.find(h[lack])
        lens = self.len[found].astype(np.int64)
        return self.pool[ragged(self.start[found], lens)], lens

"""Words of whole texts as numpy arrays: bounds, 64-bit hashes, shingles and counts, straight from Arrow buffers.

White space is [\\x20\\x09-\\x0D]; a word is a longest run of other characters. All of these are single bytes in
UTF-8, so texts are handled as bytes. Memory: a slice of texts takes a few ten times its bytes, and slices hold
SLICE_BYTES or one text, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the public splitmix64 finaliser; its constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p)
    return _powers[name][:n]


class Texts:
    """A slice of texts: their bytes, row bounds and words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1
        self.word_byte = ~SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        first = first[:-1]
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = self.word_byte[:-1]
        starts = self.word_byte & (first | ~before)
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = self.word_byte[1:] & ~first[1:]
        self.starts = np.nonzero(starts)[0]
        self.ends = np.nonzero(self.word_byte & ~after)[0] + 1
        self.row = np.searchsorted(bounds, self.starts, "right") - 1
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[data] if lower else data] * _power("up", _FACTOR, len(data)), out=self._sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes between each start and end."""
        raw = (self._sums[ends] - self._sums[starts]) * _power("down", _INVERSE, len(self.data) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _FACTOR)

    def per_row(self, chosen: np.ndarray) -> np.ndarray:
        """How many of the chosen bytes (a mask over them) each text has."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(chosen, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def words_per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of `size` words inside one text."""
        words = self.hash(self.starts, self.ends)
        n = max(0, len(words) - size + 1)
        h = words[:n].copy()
        for i in range(1, size):
            h = mix(h * _FACTOR + words[i:i + n])
        inside = np.nonzero(self.row[:n] == self.row[size - 1:size - 1 + n])[0]
        return inside, h[inside]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every line between line feeds."""
        feeds = np.nonzero(self.data == 10)[0]
        starts = np.sort(np.concatenate([self.bounds[:-1], feeds + 1]))
        ends = np.sort(np.concatenate([feeds, self.bounds[1:]]))
        return starts, ends, np.repeat(np.arange(self.n), self.per_row(self.data == 10) + 1)


def slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, Texts]]:
    """Cut a string column into slices; yields the first row of each with its texts. Null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
        yield at, Texts(data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at], lower)
        at = end


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out

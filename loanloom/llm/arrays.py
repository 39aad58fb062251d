"""Texts as flat byte arrays: words, lines and rolling hashes without a Python loop per word.

A chunk holds the UTF-8 bytes of several whole texts end to end. White space is
the ASCII set `[\\x20\\x09-\\x0D]`, whose bytes never occur inside a longer
character, so words and lines can be found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21

# Odd multipliers of the rolling hash and of its final mixing.
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

_WORD_BITS = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier, or of its inverse modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = MULTIPLIER if kind == "up" else pow(MULTIPLIER, -1, 1 << _WORD_BITS)
        have = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


class Rolling:
    """Hashes of any spans of one symbol array, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * _power("up", len(symbols)), out=self.sums[1:])
        self.down = _power("down", len(symbols) + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the symbols in [start, end), equal for equal content."""
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(raw + mixed((ends - starts).astype(np.uint64)))


class Chunk:
    """Some whole texts of one batch: rows first..first+n-1, bytes and their bounds."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def lowered(self) -> Chunk:
        """A-Z in lower case; other bytes unchanged."""
        return Chunk(self.first, _LOWER[self.data], self.bounds)

    def symbols(self) -> np.ndarray:
        """Bytes as hash symbols, none of them zero."""
        return _SYMBOLS[self.data]

    def words(self) -> Words:
        space = _SPACE[self.data]
        before = np.ones(len(space), bool)
        before[1:] = space[:-1]
        inner = self.bounds[:-1][self.bounds[:-1] < len(space)]
        before[inner] = True
        after = np.ones(len(space), bool)
        after[:-1] = space[1:]
        last = self.bounds[1:][self.bounds[1:] > 0] - 1
        after[last] = True
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        return Words(self, starts, ends)


class Words:
    """Spans of the words of a chunk; document i has words first[i]..first[i+1]-1."""

    def __init__(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray):
        self.chunk, self.starts, self.ends = chunk, starts, ends
        self.first = np.searchsorted(starts, chunk.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return Rolling(self.chunk.symbols()).spans(self.starts, self.ends)

    def doc(self) -> np.ndarray:
        """The row, within the chunk, of every word."""
        return np.repeat(np.arange(len(self.chunk)), self.counts())


_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64))


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into chunks of whole texts, about `limit` bytes each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if len(binary) == 0:
        return
    _, offsets, values = binary.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(binary) + 1, 8 * binary.offset)
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    first = 0
    while first < len(binary):
        end = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(binary))
        part = bounds[first : end + 1]
        yield Chunk(first, data[part[0] : part[-1]], part - part[0])
        first = end


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans, end to end."""
    sizes = ends - starts
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, data.dtype)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return data[at + np.arange(total)]

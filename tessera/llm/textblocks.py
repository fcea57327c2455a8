"""Numpy kernels over Arrow string columns: words and n-grams of many whole texts at once.

A column's texts lie back to back in one byte buffer. Words are found as runs of word bytes, and a word's 64-bit
hash comes from prefix sums of a polynomial over the bytes, so no Python object is made per word. Polynomials modulo
2^64 have collisions of long, regular strings, so words of more than LONG bytes are hashed one by one by xxh3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call takes at most, unless a single text is longer.
SLICE_BYTES = 1 << 19

#: Bytes from which on a span is hashed by xxh3.
LONG = 32

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = _lower

#: Word bytes of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(9, 14)]] = False

#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z have been lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of symbols (uint8 or uint64); equal spans get equal hashes."""
    n = len(symbols)
    up, down = _power_tables(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    weighted = symbols.astype(np.uint64)
    weighted += np.uint64(1)
    weighted *= up[:n]
    np.cumsum(weighted, out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts])
    if symbols.dtype == np.uint8 and len(long := np.flatnonzero(ends - starts > LONG)):
        import xxhash

        view = memoryview(np.ascontiguousarray(symbols))
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


@dataclass
class Block:
    """Some consecutive texts of a column: bytes of all, and where each begins and ends in them."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Block]:
    """The column's texts in order (null: empty), cut between texts into blocks of bounded size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Block(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Words:
    """Byte span and hash of each word of a block; word_bounds[i] is the first word of text i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    word_bounds: np.ndarray


def words(block: Block, kind: np.ndarray) -> Words:
    """Maximal runs of the word bytes in kind, never across two texts; hashes ignore the case of A-Z."""
    data, bounds = block.data, block.bounds
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.zeros(len(bounds), np.int64))
    inside = kind[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return Words(starts, ends, span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, bounds))


def word_hash(word: bytes) -> int:
    """The hash that words() gives to this word."""
    data = LOWER[np.frombuffer(word, dtype=np.uint8)]
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0]+lengths[0]-1, then those of the next span, and so on."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    skip = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(starts - skip, lengths) + np.arange(total)


def shingle_sets(w: Words, i: int, grams: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of text i; with fewer words the whole sequence is the only one."""
    a, b = int(w.word_bounds[i]), int(w.word_bounds[i + 1])
    if a == b:
        return np.empty(0, np.uint64)
    if b - a < k:
        return span_hashes(w.hashes[a:b], np.array([0]), np.array([b - a])) ^ np.uint64(b - a)
    g = np.sort(grams[a : b - k + 1])
    keep = np.ones(len(g), bool)
    keep[1:] = g[1:] != g[:-1]
    return g[keep]


def gram_hashes(w: Words, k: int) -> np.ndarray:
    """Hash of the k words from each word on; those that run past a text's end are never looked at."""
    n = len(w.hashes)
    if n < k:
        return np.empty(0, np.uint64)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += w.hashes[j : n - k + 1 + j]
    return mix(out)

"""Vectorised byte-level text kernels on numpy: words, rolling hashes and XXH64.

A batch of texts is one byte array with offsets. All functions work on whole chunks of documents, so
the cost per document is that of its bytes. Chunks are cut between documents at about ``CHUNK`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_U = np.uint64
#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE_CODE = [_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BASES = [int(x) | 1 for x in _RNG.integers(1 << 40, 1 << 62, 4)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def flatten(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(array: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents; a longer document is a run of its own."""
    data, off = flatten(array)
    row, n = 0, len(off) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1))
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def spans(array: pa.Array, size: int = 2 * CHUNK) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows of about ``size`` bytes of text."""
    off = flatten(array)[1]
    row, n = 0, len(off) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1))
        yield row, end
        row = end


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64 and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = -(-n // 65_536) * 65_536 + 1024
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        # Those of a very long text are not kept: a process would hold them for good.
        if size <= 2 * CHUNK:
            _POWERS[which] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Words:
    """The words of a chunk: start and end bytes, and per document the range of its words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.off = data, off
        inside = ~separators[data]
        n = len(data)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = off[1:][off[1:] > 0] - 1
        after[last] = False
        self.inside, self.first = inside, inside & ~before
        self.start = np.flatnonzero(self.first)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bound = np.searchsorted(self.start, off)
        self.bound[-1] = len(self.start)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.bound))

    def hashes(self, which: int = 0, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``which`` picks one of two independent functions."""
        data = self.data if fold is None else fold[self.data]
        power, inverse = powers(which, len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[which][data] * power[: len(data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def joined(self, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words, each followed by one space: bytes, and the new start and end of each word."""
        body = self.data[self.inside]
        if fold is not None:
            body = fold[body]
        length = self.end - self.start
        start = np.cumsum(length + 1) - (length + 1)
        out = np.full(int(length.sum()) + len(length), 32, np.uint8)
        out[np.arange(len(body)) + np.cumsum(self.first[self.inside]) - 1] = body
        return out, start, start + length


def rolling(h: np.ndarray, k: int, which: int = 2) -> np.ndarray:
    """A hash of every k consecutive values (n - k + 1 of them)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = powers(which, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power, out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1])


def inside_document(words: Words, k: int) -> np.ndarray:
    """Of the n - k + 1 windows of k words, those that lie within one document."""
    n = len(words)
    if n < k:
        return np.zeros(0, bool)
    return np.arange(k, n + 1) <= np.repeat(words.bound[1:], np.diff(words.bound))[: n - k + 1]


_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the byte ranges [start, end) of ``data``, all at once."""
    pad = np.zeros(len(data) + 8, np.uint8)
    pad[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", pad.data, 0, (1,))
    four = np.ndarray((len(data) + 1,), "<u4", pad.data, 0, (1,))
    length = end - start
    at = start.astype(np.int64).copy()
    s = _U(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), s + _P5, np.uint64)
        stripes = length // 32
        wide = np.flatnonzero(stripes > 0)
        if len(wide):
            v = [np.full(len(wide), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            rest, pos = stripes[wide], at[wide].copy()
            for step in range(int(rest.max())):
                on = np.flatnonzero(rest > step)
                for lane in range(4):
                    v[lane][on] = _rotl(v[lane][on] + eight[pos[on] + 8 * lane] * _P2, 31) * _P1
                pos[on] += 32
            w = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for lane in range(4):
                w = (w ^ (_rotl(v[lane] * _P2, 31) * _P1)) * _P1 + _P4
            h[wide] = w
            at[wide] = pos
        h += length.astype(np.uint64)
        left = length % 32
        for lane in range(3):
            on = np.flatnonzero(left >= 8 * (lane + 1))
            if len(on):
                g = h[on] ^ (_rotl(eight[at[on] + 8 * lane] * _P2, 31) * _P1)
                h[on] = _rotl(g, 27) * _P1 + _P4
        at += left // 8 * 8
        left = left % 8
        on = np.flatnonzero(left >= 4)
        if len(on):
            g = h[on] ^ (four[at[on]].astype(np.uint64) * _P1)
            h[on] = _rotl(g, 23) * _P2 + _P3
            at[on] += 4
            left[on] -= 4
        for step in range(3):
            on = np.flatnonzero(left > step)
            if len(on):
                g = h[on] ^ (pad[at[on] + step].astype(np.uint64) * _P5)
                h[on] = _rotl(g, 11) * _P1
        h ^= h >> _U(33)
        h *= _P2
        h ^= h >> _U(29)
        h *= _P3
        h ^= h >> _U(32)
    return h

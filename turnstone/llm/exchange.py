"""Packed blobs that chunks of text and buckets of keys send each other, and ragged arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import zstandard

from .common import _BYTE, _powers, mix, text_slices

#: Bytes of text that are hashed at once.
STEP = 1 << 20


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays as one compressed blob; wider numbers byte by byte, so that equal upper bytes stand together."""
    head, body = [np.int64(len(arrays)).tobytes()], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(a.dtype.str.encode().ljust(8) + np.int64(len(a)).tobytes())
        body.append((a.view(np.uint8).reshape(len(a), a.itemsize).T if a.itemsize > 1 and len(a) else a).tobytes())
    return _zstd()[0].compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _zstd()[1].decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for k in range(n):
        dtype = np.dtype(raw[8 + 16 * k : 16 + 16 * k].decode().strip())
        size = int(np.frombuffer(raw, np.int64, 1, 16 + 16 * k)[0])
        a = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at)
        at += len(a)
        if dtype.itemsize > 1 and size:
            a = np.ascontiguousarray(a.reshape(dtype.itemsize, size).T).reshape(-1)
        out.append(a.view(dtype))
    return out


def begin_of(lengths: np.ndarray) -> np.ndarray:
    """Where each part starts, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] to starts[0] + lengths[0] - 1, then those of the next part, and so on."""
    lengths = np.asarray(lengths, np.int64)
    out = np.arange(int(lengths.sum()), dtype=np.int64)
    return out + np.repeat(np.asarray(starts, np.int64) - begin_of(lengths)[:-1], lengths)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the parts one after the other, in steps, as indices take eight times their bytes."""
    at, out, row = begin_of(lengths), [], 0
    while row < len(lengths):
        end = max(row + 1, int(np.searchsorted(at, at[row] + STEP, side="right")) - 1)
        out.append(data[ragged(starts[row:end], lengths[row:end])])
        row = end
    return np.concatenate(out) if out else data[:0]


def byte_set(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of each run of bytes that are not separators in the rows' UTF-8 bytes, in order."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, np.zeros(0, np.uint64)
    sep = separators[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inside = ~sep
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = True, sep[:-1], True, sep[1:]
    starts = np.flatnonzero(inside & (before | cut[:-1]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    up, down = _powers(n)
    v = _BYTE[data] * up
    v[sep] = 0
    h = mix(np.add.reduceat(v, starts) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, h


def words_in_steps(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """As words(), hashed in steps of about STEP bytes, so that scratch memory is bounded by the longest row."""
    parts, row, last = [], 0, len(offsets) - 1
    while row < last:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP, side="right")) - 1)
        base = offsets[row]
        s, e, r, h = words(data[base : offsets[end]], offsets[row : end + 1] - base, separators)
        parts.append((s + base, e + base, r + row, h))
        row = end
    if not parts:
        return words(data[:0], np.zeros(1, np.int64), separators)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


class Segments:
    """128-bit hashes of segments of a sequence of 64-bit hashes, each in constant time."""

    def __init__(self, h: np.ndarray):
        self.up, self.down = _powers(len(h) + 1)
        zero = np.zeros(1, np.uint64)
        self.one = np.concatenate([zero, np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])
        self.two = np.concatenate([zero, np.cumsum(mix(h) * self.up[: len(h)], dtype=np.uint64)])

    def of(self, first: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
        d, n = self.down[first], np.asarray(length).astype(np.uint64)
        return tuple(mix((x[first + length] - x[first]) * d + n) for x in (self.one, self.two))


def slices(column, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """text_slices(), for columns that may be chunked or empty."""
    if len(column):
        yield from text_slices(column, limit)

"""Vectorised text kernels shared by the operators: Arrow buffers to words, hashes and window minima.

Texts are handled as UTF-8 bytes in blocks of about one megabyte, so that temporary arrays stay small; a longer
text is a block of its own. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words cut at ASCII white space.
WORD_BY_SPACE = ~SPACE_BYTES
#: Bytes of words made of digits, lower-case letters and everything beyond ASCII.
WORD_ALNUM = np.zeros(256, bool)
WORD_ALNUM[0x30:0x3A] = WORD_ALNUM[0x61:0x7B] = WORD_ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def splitmix(seed: int, n: int) -> np.ndarray:
    """The first ``n`` outputs of SplitMix64."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed & _MASK) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [_MASK], np.uint64)
_LONG = 64


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place, as a number; zeros stand beyond the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the bytes of the ranges [start, end): eight bytes at a time go through a bijection that isn't
    linear, ranges of over 64 bytes through XXH3."""
    size = end - start
    words = eights(data)
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * np.uint64(_MULTIPLIER) + np.uint64(seed))
    for step in range(0, _LONG, 8):
        some = np.flatnonzero((size > step) & (size <= _LONG)) if step else np.flatnonzero(size <= _LONG)
        if not len(some):
            break
        left = np.minimum(size[some] - step, 8)
        h[some] = mix(h[some] ^ (words[start[some] + step] & _KEEP[left]))
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(view[int(start[i]) : int(end[i])], seed)
    return h


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` bytes at two places hold the same bytes, for each pair of places."""
    out = np.ones(len(size), bool)
    one, two = eights(a), eights(b)
    some, step = np.flatnonzero(size > 0), 0
    while len(some):
        left = np.minimum(size[some] - step, 8)
        same = (one[a_start[some] + step] ^ two[b_start[some] + step]) & _KEEP[left] == 0
        out[some[~same]] = False
        step += 8
        some = some[same & (size[some] > step)]
    return out


def content_hashes(view: memoryview, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH3's 128 bits of the bytes of each range, as two numbers."""
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(view[s:e], 202) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence, from prefix sums. Different sequences can have equal
    hashes by construction (long Thue-Morse strings have): for choosing places, never for equality."""

    def __init__(self, seed: int):
        state = int(splitmix(seed, 1)[0]) | 1
        self.r = state if state % 8 in (3, 5) else state ^ 4  # a multiplier of the largest order
        self.inverse = pow(self.r, -1, 1 << 64)
        self.bytes = splitmix(seed + 1, 256)
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, BLOCK_BYTES + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("up", self.r), ("down", self.inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of 64-bit values, one longer than the sequence."""
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def prefix_bytes(self, data: np.ndarray) -> np.ndarray:
        return self.prefix(self.bytes[data])

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges [start, end); the length is mixed in."""
        with np.errstate(over="ignore"):
            h = (prefix[end] - prefix[start]) * self.down[start]
            return mix(h + (end - start).astype(np.uint64) * np.uint64(_MULTIPLIER))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (large or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, large = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.zeros(1, np.int64)
    if n and offsets is not None:
        at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_, at


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    data, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each text, and for each text where its words start among them."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(at), np.int64)
    inside = table[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    first = at[:-1][at[:-1] < n]
    before[first] = False
    last = at[1:][at[1:] > 0] - 1
    after[last] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def window_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` consecutive keys, the place of its smallest key; the leftmost of equal ones.

    Keys are compared by their upper 40 bits.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    step = 1 << 23
    if n > step:
        return np.concatenate([lo + window_argmin(keys[lo : min(lo + step, n) + width - 1], width) for lo in range(0, n, step)])
    best = (keys & ~np.uint64(0xFFFFFF)) | np.arange(len(keys), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[:n], best[width - span : width - span + n])
    return (best[:n] & np.uint64(0xFFFFFF)).astype(np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges [start, end)."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

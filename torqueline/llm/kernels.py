"""Array kernels on whole Arrow batches of texts: word hashes, window hashes, segment helpers.

A text's words are hashed from its UTF-8 bytes without building strings: with
random 64-bit values per byte and an odd radix r, the prefix sums of value * r**i
modulo 2**64 give every word's polynomial hash as a difference, scaled back by the
inverse radix and mixed.  Work goes over pieces of bounded size, cut at separators,
so memory doesn't follow the length of a text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xCA9B0C7EBA1DA115)
    return h ^ (h >> _U(32))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


@functools.cache
def _radix() -> tuple[np.ndarray, np.ndarray]:
    r = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.r_[_U(1), np.full(PIECE, r, _U)])
        down = np.multiply.accumulate(np.r_[_U(1), np.full(PIECE, pow(r, -1, 1 << 64), _U)])
    return up, down


@functools.cache
def _byte_values(lower: bool, seed: int = 11) -> np.ndarray:
    v = constants(seed, 256)
    if lower:
        v[65:91] = v[97:123]
    return v


def is_space(data: np.ndarray) -> np.ndarray:
    """Of bytes: those of [\\x20\\x09-\\x0D]."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty texts."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _whole(word: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of one very long word, piece by piece."""
    up, _ = _radix()
    total, scale = 0, 1
    for i in range(0, len(word), PIECE):
        part = values[word[i : i + PIECE]] * up[: len(word[i : i + PIECE])]
        total = (total + int(part.sum(dtype=_U)) * scale) % (1 << 64)
        scale = scale * int(up[PIECE]) % (1 << 64)
    return np.array([total], _U)


def word_hashes(col: pa.Array, lower: bool, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ of a column, and each text's first word (n + 1 offsets); other seeds give independent ones."""
    data, off = text_buffer(col)
    up, down = _radix()
    values = _byte_values(lower, seed)
    hashes, counts = [], np.zeros(len(off) - 1, np.int64)
    texts = np.flatnonzero(off[1:] > off[:-1])
    at, end = 0, len(data)
    while at < end:
        to = min(at + PIECE, end)
        if to < end:
            cut = np.flatnonzero(is_space(data[at:to]))
            edge = off[np.searchsorted(off, to, "right") - 1]  # a text's start is a boundary too
            to = max(at + int(cut[-1]) + 1 if len(cut) else at, int(edge))
            if to <= at:  # one word fills the piece: take it whole
                stop = int(off[np.searchsorted(off, at, "right")])
                to = at + PIECE
                while to < stop:
                    cut = np.flatnonzero(is_space(data[to : min(to + PIECE, stop)]))
                    if len(cut):
                        to += int(cut[0])
                        break
                    to = min(to + PIECE, stop)
                word = data[at:to]
                hashes.append(_whole(word, values))
                counts[np.searchsorted(off, at, "right") - 1] += 1
                at = to
                continue
        part = data[at:to]
        inside = ~is_space(part)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = off[texts]
        edges = edges[(edges > at) & (edges < to)] - at
        first[edges] |= inside[edges]
        last[edges - 1] |= inside[edges - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if len(s):
            sums = np.cumsum(values[part] * up[: len(part)], dtype=_U)
            before = np.where(s > 0, sums[np.maximum(s, 1) - 1], _U(0))
            hashes.append((sums[e] - before) * down[s])
            owner = np.searchsorted(off, s + at, "right") - 1
            counts += np.bincount(owner, minlength=len(counts))
        at = to
    flat = mix(np.concatenate(hashes)) if hashes else np.zeros(0, _U)
    return flat, np.r_[0, np.cumsum(counts)]


def window_hashes(flat: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of each ``size`` consecutive values, across text borders too (callers leave those out)."""
    n = len(flat) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    c = constants(seed, size)
    total = np.zeros(n, _U)
    for i in range(size):
        total += flat[i : i + n] * c[i]
    return mix(total)


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def text_slices(b: pa.RecordBatch, text: int = 1, most: int = 1 << 21, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in the column ``text``, or one row of more, and at most ``rows`` rows."""
    col = b.column(text)
    col = col.cast(pa.large_string()) if pa.types.is_string(col.type) else col
    ends = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    at = 0
    while at < b.num_rows:
        to = min(max(int(np.searchsorted(ends, ends[at] + most, "right")) - 1, at + 1), at + rows, b.num_rows)
        yield b.slice(at, to - at)
        at = to


def batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names)


def binary_lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column of slices of a flat array; offsets count elements."""
    off = (np.asarray(offsets, np.int64) * flat.itemsize).astype(np.int64)
    buf = pa.py_buffer(np.ascontiguousarray(flat))
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), buf]).cast(pa.binary())

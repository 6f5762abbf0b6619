"""Vectorised hashes of words and word windows over Arrow text columns.

A text is handled as bytes: words are maximal runs of anything but the six
ASCII white-space bytes. A word's hash is keyed and takes eight bytes a step
through a non-linear mixer, so that words of the same length up to eight bytes
never share one; words over ``_LONG`` bytes take keyed BLAKE2b. A window's hash
is a polynomial over its word hashes, mixed. Two keys give independent hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_STEP = 0xD1342543DE82EF95
_LONG = 256
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PIECE = 1 << 19
#: Keeps the lowest 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[first_of_each(values)]


def first_of_each(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ``values``."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


@dataclass
class Words:
    """Words of some texts: hashes by key, and where each text's words begin and end."""

    keyed: list[np.ndarray]
    first: np.ndarray
    last: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return self.keyed[0]


def _column(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or not n:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, buf


def _hash(buf: np.ndarray, s: np.ndarray, size: np.ndarray, key: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each ``s``; ``buf`` has eight bytes more than it needs."""
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    out = size.astype(np.uint64) * np.uint64(_STEP) ^ np.uint64(key)
    which, k = None, 0
    short = np.flatnonzero(size <= _LONG) if len(size) and size.max() > _LONG else None
    while True:
        if k == 0:
            which = short if short is not None else np.arange(len(s))
        else:
            which = which[size[which] > 8 * k]
        if not len(which):
            break
        lane = lanes[s[which] + 8 * k] & _LOW[np.minimum(size[which] - 8 * k, 8)]
        out[which] = mix((out[which] ^ lane) * np.uint64(0x9E3779B97F4A7C15))
        k += 1
    if short is not None:
        salt = key.to_bytes(8, "little")
        for w in np.flatnonzero(size > _LONG):
            out[w] = int.from_bytes(hashlib.blake2b(buf[s[w] : s[w] + size[w]].tobytes(), digest_size=8, key=salt).digest(), "little")
    return out


def _words_of(buf: np.ndarray, starts: np.ndarray, lower: bool, keys: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first byte, hashes by key) of each word of ``buf``, which texts enter at ``starts``."""
    if not len(buf):
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in keys]
    inside = ~_SPACE[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = starts[(starts > 0) & (starts < len(buf))]
    begin[cuts] = inside[cuts]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop)
    padded = np.concatenate([_LOWER[buf] if lower else buf, np.zeros(8, np.uint8)])
    return s, [_hash(padded, s, e - s + 1, key) for key in keys]


def text_words(column, lower: bool = False, keys: tuple[int, ...] = (0x5851F42D4C957F2D,)) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words of these rows), some rows at a time.

    A long text is cut at white space, so memory doesn't follow its length but
    by the eight bytes of each word's hash.
    """
    at, buf = _column(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        if j == i + 1 and at[j] - at[i] > PIECE:
            parts, a, end = [], int(at[i]), int(at[j])
            while a < end:
                b = min(a + PIECE, end)
                while b < end and not _SPACE[buf[b]]:
                    b += 1
                parts.append(_words_of(buf[a:b], np.zeros(0, np.int64), lower, keys)[1])
                a = b
            hashes = [np.concatenate(x) for x in zip(*parts)]
            yield i, j, Words(hashes, np.zeros(1, np.int64), np.array([len(hashes[0])]))
        else:
            starts = at[i : j + 1] - at[i]
            s, hashes = _words_of(buf[at[i] : at[j]], starts[:-1], lower, keys)
            edge = np.searchsorted(s, starts)
            yield i, j, Words(hashes, edge[:-1], edge[1:])
        i = j


def windows(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each position; the last n - 1 positions are dropped."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m] + np.uint64(salt)
    for k in range(1, n):
        out *= np.uint64(_STEP)
        out += hashes[k : k + m]
    return mix(out)


def windows_at(hashes: np.ndarray, at: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """:func:`windows` at some positions only."""
    out = hashes[at] + np.uint64(salt)
    for k in range(1, n):
        out *= np.uint64(_STEP)
        out += hashes[at + k]
    return mix(out)

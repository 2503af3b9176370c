"""Words of a batch of texts as NumPy arrays: where they are, in which row, and a 64-bit hash of each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words between white space, and of words of letters and digits (bytes of other scripts included).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, end to end, and where each row begins (one more at the end)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all else as it is."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    start: np.ndarray  # first byte
    stop: np.ndarray  # after the last byte
    first: np.ndarray  # of each row: its first word; one more at the end

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of a class that do not cross rows."""
    n = len(data)
    own = inside[data]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    opens, closes = own.copy(), own.copy()
    opens[1:] &= ~own[:-1] | begins[1:n]
    closes[:-1] &= ~own[1:] | begins[1:n]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(start, stop, np.searchsorted(start, at))


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = stop - start
    h = mix(size.astype(np.uint64) + _M1)
    who, at = np.arange(len(start)), start.copy()
    left = size.copy()
    while len(who):
        part = eight[at]
        short = left < 8
        part = np.where(short, part & ((np.uint64(1) << (left.astype(np.uint64) * np.uint64(8) & np.uint64(63))) - np.uint64(1)), part)
        h[who] = mix((h[who] ^ part) * _M1)
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
    return h


def hash_of(word: bytes) -> int:
    """The hash that ``hashes`` gives to one span."""
    data = np.frombuffer(word, np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``n`` words (of all its words, if it has fewer), and each row's first one."""
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(count)), runs)
    at = first[row] + np.arange(begin[-1]) - begin[row]
    long = count[row] >= n
    size = np.where(long, n, count[row])
    h = mix(size.astype(np.uint64) * _M1)
    for k in range(n):
        use = size > k
        part = words[np.minimum(at + k, max(0, len(words) - 1))] if len(words) else np.zeros(0, np.uint64)
        h = np.where(use, mix((h ^ part) * _M1), h)
    return h, begin

"""Numpy over the UTF-8 bytes of an Arrow string column: words, their hashes and rolling hashes, a piece of bounded size at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Base of the rolling hash modulo 2 ** 64, for anchors alone: whatever it takes for equal is compared again by content.
BASE = U(0x9E3779B97F4A7C15)
#: Word hashes are polynomials modulo the prime 2 ** 61 - 1 at this place, which no text was made for.
PRIME = U((1 << 61) - 1)
PLACE = 0x0B57_3D9A_66C1_E82F % ((1 << 61) - 1)
#: Words of more bytes are hashed by BLAKE2b.
LONG_WORD = 4096
#: Bytes hashed at once.
BLOCK = 1 << 18
_M31, _M30 = U((1 << 31) - 1), U((1 << 30) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[str, tuple[np.ndarray, ...]] = {}


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets into them) of a column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them): rows of at most `most` bytes together, or one longer row."""
    data, offsets = _flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def blanks(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; a word never crosses rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:-1]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | begins))
    stops = np.zeros(len(data) + 1, bool)
    stops[offsets[1:]] = True
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | stops[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2 ** 61 - 1, both below it: 2 ** 61 counts as 1."""
    low_a, high_a, low_b, high_b = a & _M31, a >> U(31), b & _M31, b >> U(31)
    middle = low_a * high_b + high_a * low_b
    return _reduced(high_a * high_b * U(2) + (middle >> U(30)) + ((middle & _M30) << U(31)) + low_a * low_b)


def _prime_powers() -> np.ndarray:
    if "prime" not in _tables:
        out, step = np.array([1], np.uint64), U(PLACE)
        while len(out) <= BLOCK + LONG_WORD:
            out = np.concatenate([out, times(out, np.full(len(out), step))])
            step = times(np.array([step]), np.array([step]))[0]
        _tables["prime"] = (out,)
    return _tables["prime"][0]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word data[start:end], whatever stands around it; starts ascend."""
    out = np.empty(len(start), np.uint64)
    size = end - start
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= LONG_WORD)
    ends, power = end[short], _prime_powers()
    i = 0
    while i < len(short):
        base = int(start[short[i]])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK + LONG_WORD, "right")))
        at = short[i:j]
        part = data[base : int(end[at[-1]])].astype(np.uint64) + U(1)
        p = power[: len(part)]
        # sums of the powers' upper and lower halves; both stay far below 2 ** 64 over a block
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * half)]) for half in (p >> U(31), p & _M31)]
        s, e = start[at] - base, end[at] - base
        high, low = (_reduced(x[e] - x[s]) for x in sums)
        value = _reduced(times(high, np.full(len(at), U(1 << 31))) + low)
        value = times(value, power[len(power) - 1 - s])
        out[at] = mix(value + size[at].astype(np.uint64) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def _power(n: int) -> tuple[np.ndarray, ...]:
    """The powers 0 to n of BASE and of its inverse, modulo 2 ** 64."""
    have = _tables.get("wide")
    if have is None or len(have[0]) < n + 1:
        n = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            up, down = np.full(n, BASE), np.full(n, U(pow(int(BASE), -1, 1 << 64)))
            up[0] = down[0] = 1
            have = _tables["wide"] = (np.cumprod(up), np.cumprod(down))
    return have


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span` takes the hash of any stretch."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + U(1)) * _power(len(values))[0][: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, whatever stands around it."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _power(len(sums))[1][start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def sequences(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64 bits of the n values from each index of `at`: sums of values spread by their place."""
    total = np.full(len(at), U(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total + mix(hashes[at + k] ^ U(0xA076_1D64_78BD_642F * (k + 1) % (1 << 64)))
    return mix(total)

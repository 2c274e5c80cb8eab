"""Vectorised word and shingle hashing over Arrow string arrays.

A batch of texts is one flat byte array with offsets. Words are found with table lookups, and a word's 64-bit hash is
a polynomial over its bytes, taken from one running sum: sum(b[i] * P**i) over the word, times P**-start, so that equal
words have equal hashes wherever they stand. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(keep) -> np.ndarray:
    """A 256-entry table that is True for the byte values of keep."""
    out = np.zeros(256, bool)
    out[np.fromiter(keep, np.int64)] = True
    return out


#: Words between ASCII white space.
SPACED = ~table([32, *range(9, 14)])
#: Words of ASCII digits, letters and everything beyond ASCII.
ALNUM = table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least."""
    if len(_powers["pow"]) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("pow", _P), ("inv", pow(_P, -1, 1 << 64))):
            x = np.full(size, base & _MASK, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["pow"], _powers["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with at most that many bytes, or of one longer row."""
    buf, offs = flat(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, len(texts))
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def release() -> None:
    """Gives memory that Arrow has freed back to the system: workers are kept, and their executor's memory is shared."""
    pa.default_memory_pool().release_unused()


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of rows with at most that many bytes, or of one longer row, so that few texts are Python strings at once."""
    _, offs = flat(texts)
    a = 0
    while a < len(texts):
        b = min(len(texts), max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1))
        yield texts.slice(a, b - a)
        a = b
    release()


def words(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray, lower: bool = True):
    """(starts, ends, hashes, offsets of each row's words) of the runs of bytes in keep."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    w = keep[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~w[:-1]
    starts = np.flatnonzero(w & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~w[1:]
    ends = np.flatnonzero(w & (after | edge[1:])) + 1
    power, inverse = grown(n + 1)
    low = LOWER[buf] if lower else buf
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, offs)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, for every place where k words follow."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for i in range(k):
        total = total * factor + hashes[i : i + n]
    return mix(total + np.uint64(k))


def shingle_sets(texts: pa.Array, k: int, keep: np.ndarray = SPACED) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingle hashes). A text of fewer than k words, but not none, is one shingle."""
    for a, b, buf, offs in pieces(texts):
        _, _, hashes, at = words(buf, offs, keep)
        every = runs(hashes, k)
        for i in range(b - a):
            x, y = at[i], at[i + 1]
            if y - x >= k:
                yield a + i, np.unique(every[x : y - k + 1])
            elif y > x:
                yield a + i, runs(hashes[x:y], int(y - x))
            else:
                yield a + i, np.zeros(0, np.uint64)

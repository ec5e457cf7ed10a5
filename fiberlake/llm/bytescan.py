"""Vectorised scanning of UTF-8 bytes in Arrow string columns.

All words of a batch get 64-bit hashes from one pass of array operations: a running
polynomial sum over the bytes, whose difference at a word's ends, shifted back by the
word's start, depends on the word's bytes alone.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(BASE)), np.full(n, U(pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=U) * U(BASE))
    if lower:
        v[65:91] = v[97:123]
    return v


#: Membership tables over byte values.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the rows' offsets in them."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    _, off, data = a.buffers()
    offs = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Gives memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run):
    """A function for ``mapInArrow`` after which the worker gives unused memory back.

    Workers are used again and idle for a while between stages; what they keep would
    be missing to the next stage.
    """

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Slices of a batch, cut between rows at about ``most`` bytes of a string column."""
    if not len(batch):
        return
    offs = utf8(batch.column(column))[1]
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(buf, offs, member, lower=True, prefixes=(), breaks=None, block=1 << 19):
    """Starts, ends, hashes and hashes of prefixes of all words.

    A word is a maximal run of bytes in ``member`` inside a row. ``breaks(bytes)``
    may add cuts before some bytes. Blocks end between words, so the memory in use
    follows the block and not the longest text.
    """
    n = len(buf)
    first = np.zeros(n + 1, bool)
    first[offs[offs < n]] = True
    if breaks is not None and n:
        first[:n] |= breaks(buf)
    values = byte_values(lower)
    out = [[] for _ in range(3 + len(prefixes))]
    lo = 0
    while lo < n:
        size = block
        while True:
            hi = min(n, lo + size)
            if hi == n:
                break
            cut = np.flatnonzero(~member[buf[lo + 1 : hi + 1]] | first[lo + 1 : hi + 1])
            if len(cut):
                hi = lo + 1 + int(cut[-1])
                break
            size *= 2
        b = buf[lo:hi]
        w = member[b]
        f = first[lo:hi]
        begin = w.copy()
        begin[1:] &= ~w[:-1] | f[1:]
        end = w.copy()
        end[:-1] &= ~w[1:] | f[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if len(s):
            up, down = powers(max(block, 1 << (len(b) - 1).bit_length()))
            total = np.zeros(len(b) + 1, U)
            np.cumsum(values[b] * up[: len(b)], out=total[1:])
            at, shift = total[s], down[s]
            out[0].append(s + lo)
            out[1].append(e + lo)
            out[2].append(mix((total[e] - at) * shift))
            for k, size in enumerate(prefixes):
                out[3 + k].append(mix((total[np.minimum(s + size, e)] - at) * shift + U(size)))
        lo = hi
    kinds = [np.int64, np.int64] + [U] * (1 + len(prefixes))
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, kinds)]


def row_bounds(offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each row's words begin in the list of all words, and where the last ends."""
    return np.searchsorted(starts, offs)

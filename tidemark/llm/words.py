"""Vectorised words and word shingles of whole texts: one pass of array operations over a batch's bytes, no loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
#: Bytes of text worked on at once.
SLICE = 4 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


#: Blocks from so many bytes on are given back to the system as soon as they are free, and so is a free end of the heap.
BLOCK = 1 << 20
_held: dict[str, Callable[[], object]] = {}


def holds(module: str, forget: Callable[[], object]) -> None:
    """Says that a module's functions remember something between tasks, and how to forget it."""
    _held[module] = forget


def settle(module: str) -> None:
    """Readies a worker for a module's stage: what other modules' stages remember is forgotten, and free memory goes back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    for other, forget in _held.items():
        if other != module:
            forget()
    try:
        libc = ctypes.CDLL(None)
        # M_MMAP_THRESHOLD and M_TRIM_THRESHOLD, which else grow with the blocks that are freed; M_ARENA_MAX.
        for option, value in ((-3, BLOCK), (-1, BLOCK), (-8, 1)):
            libc.mallopt(option, value)
    except (AttributeError, OSError):  # not glibc
        pass


def trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run):
    """run, a function from Arrow batches to batches, with memory given back to the system as it goes: workers stay for later stages."""
    module = run.__module__

    def wrapped(batches):
        settle(module)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    h = h ^ (h >> np.uint64(32))
    h = h * _M2
    h ^= h >> np.uint64(29)
    h *= _M1
    h ^= h >> np.uint64(32)
    return h


def slices(texts: pa.Array, most: int = SLICE):
    """(first, count) of runs of rows with about `most` bytes each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(sizes)
    while at < n:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


def raw(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (A-Z lower-cased if fold), padded by 16, and the offset of each text; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    body = data[offsets[0] : offsets[-1]]
    buf = np.zeros(len(body) + 16, dtype=np.uint8)
    buf[: len(body)] = _FOLD[body] if fold else body
    return buf, offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes not `outside`), and how many words precede each text."""
    size = int(offsets[-1])
    inside = ~outside[buf[:size]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a], last[b] = inside[a], inside[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings from starts to ends."""
    window = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, 0, (1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _M1)
    if not len(h):
        return h
    h = mix((h ^ (window[starts] & _MASK[np.minimum(left, 8)])) * _M1)
    at, k = np.flatnonzero(left > 8), 8
    while len(at):
        rest = left[at] - k
        h[at] = mix((h[at] ^ (window[starts[at] + k] & _MASK[np.minimum(rest, 8)])) * _M1)
        at, k = at[rest > 8], k + 8
    return h


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of `width` words; of a text with fewer words, of all of them; none without words."""
    buf, offsets = raw(texts)
    starts, ends, before = word_bounds(buf, offsets)
    h = hash_words(buf, starts, ends)
    n = len(h)
    out = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for i in range(width):
        out = mix((out ^ h[i : n - width + 1 + i]) * _M1) if len(out) else out
    found = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= width:
            found.append(np.unique(out[a : b - width + 1]))
        elif b > a:
            short = np.array([0x5EED + b - a], dtype=np.uint64)
            for x in h[a:b]:
                short = mix((short ^ x) * _M1)
            found.append(short)
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found

"""Vectorised views of texts as bytes: words, their 64-bit hashes and byte statistics, a slice of rows at a time."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is taken in parts that end between words.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random number for each byte; A-Z have those of a-z.
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = int(_ODD)
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 1 << 22:  # a single word of megabytes: not kept
        return _powers.__wrapped__(n)
    up, down = _powers(1 << max(21, (n - 1).bit_length()))
    return up[:n], down[:n]


def release() -> None:
    """Gives memory that nothing uses any more back to the system; Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts as UTF-8 (null: empty), about limit bytes of text at a time. At the end, memory that the
    task no longer uses goes back to the system."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end
    batch = texts = None
    release()


def _hash_words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a buffer."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:-1], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ([^\\x20\\x09-\\x0D]+, A-Z folded to a-z) in order, and the number of words of each text."""
    table = _FOLDED if fold else _VALUE
    if len(texts) == 1 and len(texts[0]) > 2 * SLICE:
        parts, at, text = [], 0, texts[0]
        while at < len(text):
            end = min(len(text), at + SLICE)
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            parts.append(_hash_words(np.frombuffer(text, np.uint8, end - at, at), table)[2])
            at = end
        hashes = np.concatenate(parts)
        return hashes, np.array([len(hashes)])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    starts, _, hashes = _hash_words(data, table)
    return hashes, np.diff(np.searchsorted(starts, begins))


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, how many each text has, and how often each occurs."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], np.bincount(o[at], minlength=len(counts)), np.diff(np.append(at, len(h)))

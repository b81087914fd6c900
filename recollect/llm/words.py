"""Words and word-window hashes of whole Arrow string columns, by numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. Null counts as
empty text. Texts are handled in blocks of about ``BLOCK`` bytes (a longer text is one block), so
memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
U = np.uint64


def _return_memory() -> None:
    """Large arrays go back to the system when freed, so a worker that lives on holds little between tasks."""
    pa.set_memory_pool(pa.system_memory_pool())
    lib = ctypes.CDLL(None)
    if hasattr(lib, "mallopt"):
        lib.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows with use


_return_memory()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(base: int, log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        up[0] = 1
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    log2 = max(20, int(n).bit_length())
    return _powers(base, log2) if log2 <= 21 else _powers.__wrapped__(base, log2)


@dataclass
class Words:
    """Words of texts ``lo`` to ``hi`` of a column; ``docs[i]:docs[i + 1]`` are those of text ``lo + i``."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word; ``table`` maps its bytes first."""
        data = self.data if table is None else table[self.data]
        n = len(data)
        up, down = powers(_BYTE_BASE, n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + U(1)) * up[:n], out=sums[1:])
            h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
            return mix(h ^ ((self.ends - self.starts).astype(np.uint64) << U(48)))

    def doc_of(self) -> np.ndarray:
        """For each word, its text, counted from ``lo``."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.docs))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on, as far as they reach."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(_WORD_BASE, len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        return mix((sums[size:] - sums[:n]) * down[:n], size)


def inside(w: Words, size: int) -> np.ndarray:
    """Positions at which ``size`` words of one text begin."""
    n = len(w.starts) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    end = np.repeat(w.docs[1:], np.diff(w.docs))[:n]
    return np.flatnonzero(np.arange(n) + size <= end)


def blocks(texts: pa.Array, limit: int = BLOCK):
    """Words of a column, block by block."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, off, buf = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield _block(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo, hi)
        lo = hi


def _block(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> Words:
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(lo, hi, data, none, none, np.zeros(hi - lo + 1, np.int64))
    solid = _SOLID[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(lo, hi, data, starts, ends, np.searchsorted(starts, off))

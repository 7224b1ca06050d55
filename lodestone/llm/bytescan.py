"""Words and their hashes for many texts at once, straight from Arrow buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on; a longer text is a step of its own.
STEP = 1 << 20
#: Words hashed at once.
WORDS = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_is_word = np.zeros(256, bool)
_is_word[128:] = True
_is_word[ord("0") : ord("9") + 1] = _is_word[ord("a") : ord("z") + 1] = _is_word[ord("A") : ord("Z") + 1] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and the offset of each; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def steps(offsets: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    n = len(offsets) - 1
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
    release()


#: What a worker keeps for the next tasks of one operator, such as tokenizers and their caches.
KEPT: dict = {}


def release() -> None:
    """Give memory back to the system, also what other operators' tasks kept; workers live on through many stages."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim is not None:
        trim(0)


@dataclass
class Words:
    """Words of some texts: hash, place, and the text each belongs to."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  #: of each text its first word's number, and the number of all

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts that ``offsets`` cut ``raw`` into; A-Z count as a-z."""
    inside = _is_word[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = np.empty(len(a), np.uint64)
    for at in range(0, len(a), WORDS):
        x, y = a[at : at + WORDS], b[at : at + WORDS]
        if len(x):
            hashes[at : at + WORDS] = _hash(raw[x[0] : y[-1]], x - x[0], y - x[0])
    return Words(hashes, a, b, np.searchsorted(a, offsets))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {}


def _power(n: int, name: str, base: np.uint64) -> np.ndarray:
    have = _CACHE.get(name)
    if have is None or len(have) < n:
        have = _CACHE[name] = _powers(max(n, 1 << 16), base)
    return have[:n]


def prefix(raw: np.ndarray) -> np.ndarray:
    """Sums of bytes times rising powers, one more than there are bytes."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(len(raw), "up", _ODD), out=out[1:])
    return out


def _hash(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sums = prefix(_lower[raw])
    return mix((sums[b] - sums[a]) * _power(len(raw), "down", _INVERSE)[a])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of all words if there are fewer but some."""
    n = len(hashes)
    k = min(k, n)
    if not n:
        return hashes
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j]
    return mix(out)

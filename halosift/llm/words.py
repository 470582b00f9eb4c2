"""Words and hashes of whole batches of texts, on the UTF-8 bytes that Arrow hands over.

Every separator used here is an ASCII character, so words are runs of bytes and
no text is decoded. Hashes have 64 bits; equal byte strings have equal hashes
in every process. Work goes in runs of rows of about ``CHUNK`` bytes, so memory
is bounded by the longest text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_STEP = 1 << 18  # bytes hashed at once

_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_set(*parts: str | tuple[int, int]) -> np.ndarray:
    """Table of 256 flags: the characters of strings, and whole ranges of bytes."""
    out = np.zeros(256, dtype=bool)
    for part in parts:
        if isinstance(part, str):
            out[[ord(c) for c in part]] = True
        else:
            out[part[0]:part[1] + 1] = True
    return out


SPACE = byte_set(" ", (0x09, 0x0D))
NOT_SPACE = ~SPACE  # words of the kind [^\x20\x09-\x0D]+
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))  # of lower-cased text
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
FIRST_BYTE = ~byte_set((0x80, 0xBF))  # one for each code point


@dataclass
class Texts:
    """Bytes of some rows and where each row begins; row i is data[at[i]:at[i+1]]."""

    first: int  # number of the first row in its batch
    data: np.ndarray
    at: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1

    def lower(self) -> "Texts":
        return Texts(self.first, LOWER[self.data], self.at)


def texts_of(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[Texts]:
    """The column in runs of rows of at most ``most`` bytes, one row at least. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], dtype=kind, count=n + 1, offset=column.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield Texts(row, data[at[row]:at[end]], at[row:end + 1] - at[row])
        row = end


@dataclass
class Spans:
    """Spans of bytes and where the spans of each row begin."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


def words(texts: Texts, inside: np.ndarray) -> Spans:
    """Maximal runs of the bytes ``inside`` says, never across rows."""
    return runs(texts, inside[texts.data])


def runs(texts: Texts, m: np.ndarray) -> Spans:
    """Maximal runs of true flags ``m``, one for each byte, never across rows."""
    n = len(texts.data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Spans(empty, empty, np.zeros(texts.rows + 1, np.int64))
    cut = texts.at[(texts.at > 0) & (texts.at < n)]
    lead = m.copy()
    lead[1:] &= ~m[:-1]
    lead[cut] = m[cut]
    tail = m.copy()
    tail[:-1] &= ~m[1:]
    tail[cut - 1] = m[cut - 1]
    start = np.flatnonzero(lead)
    return Spans(start, np.flatnonzero(tail) + 1, np.searchsorted(start, texts.at))


def lines(texts: Texts) -> Spans:
    r"""The parts between \n; an empty row is one empty line."""
    brk = np.flatnonzero(texts.data == 10)
    row_of = np.searchsorted(texts.at, brk, "right") - 1
    counts = np.bincount(row_of, minlength=texts.rows) + 1
    at = np.concatenate([[0], np.cumsum(counts)])
    start = np.empty(at[-1], np.int64)
    end = np.empty(at[-1], np.int64)
    firsts = np.zeros(at[-1], bool)
    firsts[at[:-1]] = True
    lasts = np.zeros(at[-1], bool)
    lasts[at[1:] - 1] = True
    start[firsts] = texts.at[:-1]
    start[~firsts] = brk + 1
    end[lasts] = texts.at[1:]
    end[~lasts] = brk
    return Spans(start, end, at)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("power", ())) < n:
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        for name, b in (("power", base), ("inverse", inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _cache[name] = np.cumprod(p)
        _cache["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _cache["power"], _cache["inverse"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for ascending, disjoint spans."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, low + _STEP)))
        high = int(end[j - 1])
        power, inverse = _powers(max(high - low + 1, _STEP * 2))
        value = _cache["byte"][data[low:high]]
        value *= power[:high - low]
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size`` consecutive words within a row, and the first word of each."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        factor = int(mix(np.array([k + 1], np.uint64) * np.uint64(0xA0761D6478BD642F))[0]) | 1
        total += hashes[k:k + n] * np.uint64(factor)
    whole = np.ones(n, bool)
    for k in range(1, size):  # a window that begins less than size words before a row's end
        b = at[1:-1] - k
        whole[b[(b >= 0) & (b < n)]] = False
    # rows shorter than a window: their words are all within size-1 of the next border
    first = np.flatnonzero(whole)
    return mix(total[first]), first


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each row's part."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

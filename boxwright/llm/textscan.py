"""Vectorised word scanning over Arrow string arrays.

Words are found and hashed on the UTF-8 bytes of a whole batch at once, with no
Python object per word.  A word's fingerprint is a polynomial hash modulo 2**64
over per-byte constants, finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_R = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_R_64 = np.uint64(_R)
_R_INV = pow(_R, -1, 1 << 64)
#: Bytes that are looked at together: what scanning and hashing hold beyond the bytes and the words themselves is some 40 times this, however long a text is.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche on unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_R), _powers(_R_INV)


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The polynomial hash of each span data[start:stop], before mixing; both starts and stops ascend.

    Sums run over one block of bytes at a time, with powers counted from the
    block's first byte; a span that crosses blocks gathers its parts.
    """
    out = np.zeros(len(start), dtype=np.uint64)
    sums = np.zeros(BLOCK + 1, dtype=np.uint64)
    at = int(start[0]) if len(start) else 0
    while len(start) and at < stop[-1]:
        end = min(at + BLOCK, len(data))
        np.cumsum(_BYTE[data[at:end]] * _UP[: end - at], out=sums[1 : end - at + 1])
        lo, hi = int(np.searchsorted(stop, at, "right")), int(np.searchsorted(start, end, "left"))
        first, last = np.maximum(start[lo:hi], at) - at, np.minimum(stop[lo:hi], end) - at
        part = (sums[last] - sums[first]) * _DOWN[first]
        over = int(np.searchsorted(start[lo:hi], at, "left"))  # spans begun in an earlier block
        if over:
            part[:over] *= np.array([pow(_R, at - x, 1 << 64) for x in start[lo : lo + over].tolist()], dtype=np.uint64)
        out[lo:hi] += part
        at = end
    return out


def space_separated() -> np.ndarray:
    """Byte table of words ``[^\\x20\\x09-\\x0D]+``: True where a byte belongs to a word."""
    keep = np.ones(256, dtype=bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def alphanumeric() -> np.ndarray:
    """Byte table of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    keep = np.zeros(256, dtype=bool)
    keep[0x30:0x3A] = keep[0x61:0x7B] = keep[0x80:] = True
    return keep


def letters() -> np.ndarray:
    """Byte table of runs of a-z and non-ASCII bytes."""
    keep = alphanumeric()
    keep[0x30:0x3A] = False
    return keep


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """The words of a run of texts: word i is data[start[i]:stop[i]]; text d has words ptr[d] to ptr[d+1]."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    ptr: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        return mix(span_hashes(self.data, self.start, self.stop))


def _edges(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, block by block."""
    begins, ends, n = [], [], len(data)
    for at in range(0, n, BLOCK):
        end = min(at + BLOCK, n)
        inside = keep[data[max(at - 1, 0) : end + 1]]  # with the neighbours on both sides
        own = inside[at - max(at - 1, 0) :][: end - at]
        before = np.concatenate([inside[:1] if at else [False], own[:-1]])
        after = np.concatenate([own[1:], inside[-1:] if end < n else [False]])
        edge = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, end, "right")]  # a text's first byte begins a word whatever stands before it
        before[edge[edge < end] - at] = False
        after[edge[edge > at] - 1 - at] = False
        begins.append(np.flatnonzero(own & ~before) + at)
        ends.append(np.flatnonzero(own & ~after) + at + 1)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *begins]), np.concatenate([none, *ends])


def scan(texts: pa.Array, keep: np.ndarray) -> Words:
    """The words of every text (null: none), A-Z lower-cased."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = texts.buffers()[2] if len(texts) else None
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(buf, dtype=np.uint8)[first:last] if buf is not None and last > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    data = LOWER[raw]
    start, stop = _edges(data, offsets, keep)
    return Words(data, start, stop, np.searchsorted(start, offsets), offsets)


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``most`` bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_SHINGLE = [np.uint64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(words: Words, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct word shingles; fewer words than ``width`` form one, none form none."""
    h = words.hashes()
    grams = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for t in range(width):
        grams += mix(h[t : t + len(grams)] + _SHINGLE[t % 5] * np.uint64(1 + t // 5)) * _SHINGLE[t % 5]
    grams = mix(grams)
    ptr = words.ptr
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = mix(np.array([short * _SHINGLE[0] + x], dtype=np.uint64))[0]
            yield np.array([short], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)

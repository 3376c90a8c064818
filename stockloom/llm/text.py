"""Vectorised work on batches of texts: words, their hashes, shingles.

All functions take the buffers of an Arrow string array, so no Python string
is made for a text. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multiplier of the polynomial word hash and its inverse modulo 2**64.
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is its own slice.
SLICE_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words as runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words as runs of ASCII letters, digits and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _MUL, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of a slice of documents: byte starts and ends, and where each document's words begin."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    prefixes: tuple[np.ndarray, ...] = ()

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offset of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of Arrow batches of about ``most`` bytes of text, with their buffers."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        data, offsets = buffers(column)
        at, n = 0, len(column)
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = True, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of ``kind`` and their 64-bit hashes; A-Z counts as a-z if ``lower``.

    ``prefixes`` asks for hashes of the words' first so many bytes, too.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64), none.astype(np.uint64), tuple(none.astype(np.uint64) for _ in prefixes))
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    stops = [end, *[np.minimum(end, start + size) for size in prefixes]]
    hashed = span_hashes(data, start, stops, lower)
    return Words(start, end, np.searchsorted(start, offsets), hashed[0], tuple(h + np.uint64(size) for h, size in zip(hashed[1:], prefixes, strict=True)))


def span_hashes(data: np.ndarray, start: np.ndarray, ends: list[np.ndarray], lower: bool) -> list[np.ndarray]:
    """64-bit hashes of spans of bytes that begin at ``start``, for several ends."""
    n = len(data)
    up, down = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    value = (_LOWER[data] if lower else data).astype(np.uint64)
    value += np.uint64(1)
    value *= up[:n]
    np.cumsum(value, out=total[1:])
    before, scale = total[start], down[start]
    return [mix((total[end] - before) * scale) for end in ends]


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document's runs of ``size`` words, and where each document's begin.

    A document with fewer words has one shingle, of all its words; without words it has none.
    """
    counts, n = found.counts, len(found.hash)
    many = np.where(counts == 0, 0, np.maximum(1, counts - size + 1))
    first = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(counts)), many)
    at = np.arange(first[-1]) - first[:-1][doc] + found.first[:-1][doc]
    stop = found.first[1:][doc]
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = at + k
        here_hash = found.hash[np.minimum(here, max(n - 1, 0))] if n else out
        out = out * np.uint64(_MUL) + np.where(here < stop, here_hash + np.uint64(k + 1), np.uint64(0))
    out = mix(out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[keep], doc[keep]
    return out, np.searchsorted(doc, np.arange(len(counts) + 1))

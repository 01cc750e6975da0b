"""Vectorised words, word hashes and shingles over Arrow string columns.

Texts stay in Arrow's byte buffer: words are found with byte tables, hashed with
a polynomial hash whose prefix sums serve every word of a block at once, and
shingles combine consecutive word hashes.  Nothing here loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = np.random.default_rng(20240607).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.random.default_rng(977).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x20\x09-\x0D]+ by bytes of UTF-8
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and all that is not ASCII
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts. Words of text i are lo[i] up to lo[i + 1]; starts and ends are bytes of buf."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lo: np.ndarray

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + BLOCK_BYTES, side="right")))
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            up, down = _power_tables(int(e[-1]) + 1)
            part = self.buf[base : base + e[-1]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mix(out)


def find_words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """buf: bytes, already lower-cased where that is wanted; offsets: of the texts in buf, first to last."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = table[buf]
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    first, last = first[:-1], last[1:]  # of each byte: a word starts here; a word ends behind it
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batch: pa.RecordBatch, column: str, block: int = 2 * BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows of about block bytes: (rows, bytes, offsets). A longer text is a run of its own."""
    buf, offsets = string_bytes(batch.column(batch.schema.get_field_index(column)))
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        yield slice(at, to), buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of width words; of all words as one, if fewer; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * _STEPS[j]
    return mix(out)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row; words split at white space, A-Z lower-cased."""
    for rows, buf, offsets in text_blocks(batch, column):
        words = find_words(LOWER[buf], offsets, SPACE_WORDS)
        h, lo = words.hashes(), words.lo
        for i in range(len(offsets) - 1):
            yield rows.start + i, distinct(shingles(h[lo[i] : lo[i + 1]], width))

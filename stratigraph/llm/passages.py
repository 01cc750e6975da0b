"""Repeated passages by collinear chaining of shared k-mer seeds.

1. Texts become lower-cased word hashes; of every W consecutive K-word windows the least hash is a
   seed, so a run of K + W - 1 shared words shares one at least. Equal word sequences are one text
   (known by a 64-bit fingerprint), which goes on once per task. A sketch of seed frequencies tells
   which seeds may be hot; their rows are dealt out in parts, so no seed is one task.
2. A seed that several texts have points to its first owner, the text whose least document id is
   smallest. So n holders of a passage give n matches, never pairs within the group. A seed is one
   row of a text with all its places there; each place meets one of the owner's, that on the longest
   diagonal. Repeated seeds are numbered besides, for owners that hold them as often.
3. A text's matches are taken together: stretches of matches, even of one, since edits can leave a
   passage no more, are chained per owner, best score first. The predecessor is that with the best
   score less a gap cost linear in the words skipped, of those within GAP on both sides: the maximum
   of a range of owner positions in a Fenwick tree, which segments leave when they are out of reach. Chains within a longer, dense one add nothing and go.
4. Chains are aligned: the words of both sides around a chain are fetched (the owner's in blocks of
   BLOCK words, each fetched once however many texts need it), matches are extended to both sides
   with an X-drop, gaps are aligned by dynamic programming. Pieces of 75 % equal words stay; a chain
   that has fewer is cut at gaps, and its best parts stay.
5. Pieces of a text are united over owners, since the first owner of a passage may hold only part of
   it; united spans of LEAST words or more with a piece of LONGEST or more are reported, with the
   owner of the longest piece. Copies of a whole text are reported whole.

Edits lose words at a passage's ends and, if they are dense, whole passages. Of passages of 60 to 120 words, with words
replaced, left out and put in, the words found are 0.96 with edits at 8 % of the words, 0.91 at 12 %, 0.84 at 15 % and 0.59 at 20 %
(tests hold 0.94, 0.88 and 0.8 for the first three): nine tenths of them need about 88 % of equal words, though whatever is
found may have as few as 75 %.

Null and empty texts, and texts of fewer than LEAST words, have no spans; rows that repeat an id and its
text are one document; an empty table gives no rows; other columns are not read (cut_repeats keeps
them all). Passages repeated within one document only are left alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sketch
from .storage import Scratch, lean
from .textwords import ALNUM_WORDS, LOWER, find_words, mix, shingles, text_blocks

K, W = 5, 5
LEAST, LONGEST = 50, 15
LIKE = 0.75
GAP = 24
JOIN_GAP = 3
BLOCK = 64
MARGIN = LEAST
GAP_COST = 0.05
DENSE = 0.8
#: rows of a seed that go to one task, about
HOT_ROWS = 1 << 12


def fingerprints(h: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of each text's sequence of word hashes h[lo[i]:lo[i + 1]], signed; 0 without words."""
    n = np.diff(lo)
    if not len(h):
        return np.zeros(len(n), np.int64)
    place = mix(np.arange(1, n.max() + 1, dtype=np.uint64))[np.arange(len(h)) - np.repeat(lo[:-1], n)]
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ place), out=sums[1:])
    return np.where(n > 0, mix(sums[lo[1:]] - sums[lo[:-1]]), 0).view(np.int64)


def _smallest(g: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each w consecutive hashes of a row g[first[i]:first[i + 1]] stands, each place once; of all, if a row has fewer."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    if len(g) >= w:
        begin = np.flatnonzero(row[: len(g) - w + 1] == row[w - 1 :])
        at = np.lib.stride_tricks.sliding_window_view(g, w)[begin].argmin(axis=1) + begin
        found.append(at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < w))
    if len(short):
        at = first[short][:, None] + np.arange(w)
        held = np.where(at < first[short + 1][:, None], g[np.minimum(at, len(g) - 1)], np.uint64(2**64 - 1))
        found.append(held.argmin(axis=1) + first[short])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def seed_places(grams: np.ndarray, w: int = W) -> np.ndarray:
    """Where the least of w consecutive hashes stands, each place once."""
    return _smallest(grams, np.array([0, len(grams)]), w)


def minimizers(h: np.ndarray, lo: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, word where it starts) of the seeds of the rows kept, in order."""
    n = np.diff(lo)
    start = np.flatnonzero(np.arange(len(h)) + K <= np.repeat(np.where(keep, lo[1:], 0), n))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    g, row = shingles(h, K)[start], np.repeat(np.arange(len(n)), n)[start]
    at = _smallest(g, np.searchsorted(row, np.arange(len(n) + 1)), W)
    return row[at], g[at], (start[at] - lo[row[at]]).astype(np.int32)


def grouped(row: np.ndarray, h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, hash, place, more): each hash of a row once with its first place, and bytes of the others or null.

    Then the second, third... place under a hash of its own with empty bytes, for owners that hold it as often.
    """
    order = np.lexsort((h, row))
    row, h, pos = row[order], h[order], pos[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))[: len(h)]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h)))
    number = (np.arange(len(h)) - np.repeat(first, count))[~new].astype(np.uint64)
    numbered = mix(h[~new] + number * np.uint64(0x9E3779B97F4A7C15))
    lengths = np.concatenate((4 * (count - 1), np.zeros(len(numbered), np.int64)))
    valid = np.concatenate((count > 1, np.ones(len(numbered), bool)))
    more = binary_array(lengths, pos[~new], valid)
    return np.concatenate((row[first], row[~new])), np.concatenate((h[first], numbered)), np.concatenate((pos[first], pos[~new])), more


def binary_array(lengths: np.ndarray, values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary column from byte lengths and all values one behind the other."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(lengths), [bits, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def ragged(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where those of each row start, with the end) of a binary column without nulls."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return values, (at - at[0]) // np.dtype(kind).itemsize


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1... count[0] times, then those of the next."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def word_blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, word hashes, bounds of each row's words, first byte and last byte + 1 of each word in its text) by blocks."""
    for rows, buf, offsets in text_blocks(batch, column):
        words = find_words(LOWER[buf], offsets, ALNUM_WORDS)
        base = np.repeat(offsets[:-1], np.diff(words.lo))
        yield rows, words.hashes(), words.lo, words.starts - base, words.ends - base


def first_seen(fps: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows have seeds, and a text that no row of this task had before."""
    keep = np.zeros(len(fps), bool)
    for k in np.flatnonzero(n >= K).tolist():
        if (fp := int(fps[k])) not in seen:
            seen.add(fp)
            keep[k] = True
    return keep


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, fp, n) of each document, then the task's frequencies of seeds."""
    counts, seen, names = sketch.empty(), set(), ["doc_id", "fp", "n", "chunk", "counts"]
    for batch in batches:
        fps, sizes, none = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), pa.nulls(batch.num_rows)
        for rows, h, lo, _, _ in word_blocks(batch, "text"):
            fps[rows], sizes[rows] = own, n = fingerprints(h, lo), np.diff(lo)
            sketch.add(counts, grouped(*minimizers(h, lo, first_seen(own, n, seen)))[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array(sizes), none.cast(pa.int32()), none.cast(pa.binary())], names)
    if seen:
        chunk, own = sketch.chunk_arrays(counts)
        none = pa.nulls(len(chunk)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, chunk, own], names)


def _seeds(frequencies, hot_rows: int):
    """Rows (h, fp, pos, more, part) of each text: a seed once, with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = frequencies.value, set()
        hot = sketch.hot_limit(counts, hot_rows)
        for batch in batches:
            for _, h, lo, _, _ in word_blocks(batch, "text"):
                fps = fingerprints(h, lo)
                row, seed, pos, more = grouped(*minimizers(h, lo, first_seen(fps, np.diff(lo), seen)))
                part = sketch.parts(counts[sketch.slots(seed)], fps[row], hot, hot_rows)
                columns = [pa.array(seed.view(np.int64)), pa.array(fps[row]), pa.array(pos), more, pa.array(part)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "fp", "pos", "more", "part"])

    return run


def follow(p: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """One of the owner's places for each match, those of a match in order: the diagonal that goes on longest, of equals that next to the one before.

    So of what owner and text both repeat each match is taken once, not with all places, and an exact passage is in two
    runs at most: what an earlier run took of it, and the rest. In a row of evenly spaced places a run starts at the first or last.
    """
    if all(len(q) == 1 for q in places):
        return np.array([q[0] for q in places], np.int64)
    own = np.zeros(len(p), np.int64)
    live, start, before = np.zeros(0, np.int64), 0, 0
    for k in range(len(p) + 1):
        if k < len(p) and k and p[k] - p[k - 1] <= K + W:
            q = places[k] - p[k]
            kept = live[q[np.minimum(np.searchsorted(q, live), len(q) - 1)] == live]
            if len(kept):
                live = kept
                continue
        if k:
            before = int(live[np.abs(live - before).argmin()]) if start else int(live[0])
            own[start:k] = p[start:k] + before
        if k < len(p):
            q, steps = places[k], np.diff(places[k])
            live, start = q[np.concatenate(([True], steps[1:] != steps[:-1], [True]))[: len(q)]] - p[k], k
    return own


def on_diagonals(group: np.ndarray, pos: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a group's matches on one diagonal that touch or overlap: (group, rows (start, owner's start, length)), in this order."""
    order = np.lexsort((pos, own - pos, group))
    g, p, d = group[order], pos[order], (own - pos)[order]
    new = (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (p[1:] > p[:-1] + K + W)
    first = np.flatnonzero(np.concatenate(([True], new))[: len(p)])
    last = np.append(first[1:], len(p))[: len(first)] - 1
    g, rows = g[first], np.stack((p[first], p[first] + d[first], p[last] + K - p[first]), axis=1)
    order = np.lexsort((rows[:, 1], rows[:, 0], g))
    return g[order], rows[order]


def segments(pos: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Runs of one group's matches, as rows (start, owner's start, length)."""
    return on_diagonals(np.zeros(len(pos), np.int64), pos, own)[1]


class Fenwick:
    """A Fenwick tree of maxima over places 1 to n: node i holds the best of the places i - lowbit(i) + 1 to i.

    Values may fall as well as rise: a changed place's nodes are made again from the nodes below them.
    """

    NONE = (0.0, -1)

    def __init__(self, n: int):
        self.own, self.tree = [self.NONE] * (n + 1), [self.NONE] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        self.own[at] = value
        while at < len(self.tree):
            best, step, low = self.own[at], 1, at & -at
            while step < low:
                best = max(best, self.tree[at - step])
                step *= 2
            self.tree[at] = best
            at += low

    def best(self, first: int, last: int) -> tuple[float, int]:
        """Of the places first to last."""
        found = self.NONE
        while last >= first:
            low = last & -last
            if last - low + 1 >= first:
                found = max(found, self.tree[last])
                last -= low
            else:
                found = max(found, self.own[last])
                last -= 1
        return found


def chains(rows: np.ndarray) -> list[list[int]]:
    """Chains of segments, best first, each segment in one: ordered on both sides, gaps of GAP words at most.

    Segments are taken as they start in the text. Those before stand in a Fenwick tree at the places where they end in
    the owner, with their score plus the cost of all words up to there, so the best predecessor within reach is the
    maximum of a range; a segment whose end has fallen out of reach in the text leaves the tree.
    """
    n = len(rows)
    score, before = rows[:, 2].astype(float).tolist(), [-1] * n
    if n > 1:
        ends, own_ends = (rows[:, 0] + rows[:, 2]).tolist(), (rows[:, 1] + rows[:, 2]).tolist()
        places = sorted(set(own_ends))
        tree, at = Fenwick(len(places)), [bisect_left(places, b) + 1 for b in own_ends]
        alive: dict[int, list[tuple[float, int]]] = {}  # by place
        coming = sorted(range(n), key=lambda i: ends[i])
        come = gone = 0
        for i, (start, own, length) in enumerate(rows.tolist()):
            # those that end at most a seed into this one come in
            while come < n and ends[coming[come]] <= start + K - 1 and coming[come] < i:
                j = coming[come]
                here = alive.setdefault(at[j], [])
                here.append((score[j] + GAP_COST * (ends[j] + own_ends[j]), j))
                tree.put(at[j], max(here))
                come += 1
            while gone < come and ends[coming[gone]] < start - GAP:
                j = coming[gone]
                here = alive[at[j]] = [x for x in alive[at[j]] if x[1] != j]
                tree.put(at[j], max(here, default=Fenwick.NONE))
                gone += 1
            value, j = tree.best(bisect_left(places, own - GAP) + 1, bisect_right(places, own + K - 1))
            if j >= 0 and value - GAP_COST * (start + own) > 0:
                score[i], before[i] = length + value - GAP_COST * (start + own), j
    out, used = [], set()
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def uncovered(found: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """Chains (owner, segments) of one stretch without those that lie within a longer one whose segments are DENSE: these add no words to the union."""
    ends = [(int(rows[0, 0]), int((rows[:, 0] + rows[:, 2]).max()), int(rows[:, 2].sum())) for _, rows in found]
    kept, dense = [], []
    for i in sorted(range(len(found)), key=lambda i: (ends[i][0] - ends[i][1], ends[i][0], found[i][0])):
        a, b, words = ends[i]
        if any(x <= a and b <= y for x, y in dense):
            continue
        kept.append(found[i])
        if words >= DENSE * (b - a) and b - a > K:
            dense.append((a, b))
    return kept


def chained(fp, pos, more, own_fp, own_pos, own_more) -> list[tuple[int, int, bytes]]:
    """Matches of whole texts, those of a text in a row, to chains (fp, own_fp, segments as bytes).

    more and own_more are the seed's other places as bytes: None for one place, empty for a numbered seed.
    """
    n = len(fp)
    sizes = np.fromiter((len(m) if m else 0 for m in more), np.int64, n)
    numbered = np.fromiter((m is not None and not m for m in more), bool, n)
    owners_more = np.fromiter((bool(m) for m in own_more), bool, n)
    again = np.flatnonzero(sizes)
    row = np.concatenate((np.arange(n), np.repeat(again, sizes[again] // 4)))
    p = np.concatenate((pos.astype(np.int64), *(np.frombuffer(more[k], np.int32) for k in again.tolist())))
    text = np.cumsum(np.concatenate(([0], fp[1:] != fp[:-1])))
    order = np.lexsort((p, text[row]))
    row, p, extra = row[order], p[order], order >= n
    cut = (text[row][1:] != text[row][:-1]) | (np.diff(p) > K + W + GAP)
    stretch = np.cumsum(np.concatenate(([0], cut)))
    owner, group = np.unique(own_fp, return_inverse=True)
    key = stretch * len(owner) + group[row]  # of a stretch and an owner

    found: dict[int, list[tuple[int, np.ndarray]]] = {}

    def add(k: int, rows: np.ndarray) -> None:
        own = int(owner[k % len(owner)])
        found.setdefault(k // len(owner), []).extend((own, rows[c]) for c in (chains(rows) if len(rows) > 1 else [[0]]))

    # first places and numbered ones as they are
    plain = ~extra
    keys, rows = on_diagonals(key[plain], p[plain], own_pos[row[plain]].astype(np.int64))
    for a, b in _runs(keys):
        add(int(keys[a]), rows[a:b])
    # then all places of plain seeds, where either side repeats one
    repeats = np.unique(key[~numbered[row] & (extra | owners_more[row])])
    if len(repeats):
        at = np.flatnonzero(~numbered[row] & np.isin(key, repeats))
        at = at[np.argsort(key[at], kind="stable")]
        for a, b in _runs(key[at]):
            own = row[at[a:b]].tolist()
            places = [np.append(own_pos[k], np.frombuffer(own_more[k], np.int32) if own_more[k] else ()).astype(np.int64) for k in own]
            add(int(key[at[a]]), segments(p[at[a:b]], follow(p[at[a:b]], places)))

    of_stretch = fp[row[np.searchsorted(stretch, np.arange(stretch[-1] + 1))]].tolist()
    out = []
    for s, parts in found.items():
        kept = uncovered(parts) if len(parts) > 1 else parts
        out += sorted({(of_stretch[s], o, rows.astype(np.int32).tobytes()) for o, rows in kept})
    return out


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches (fp, pos, more, own_fp, own_pos, own_more), those of a text in a row, to chains (fp, own_fp, segs)."""
    held: list[np.ndarray] = []

    def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        out = chained(*columns) if len(columns[0]) else []
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["fp", "own_fp", "segs"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held:
            columns = [np.concatenate((a, b)) for a, b in zip(held, columns, strict=True)]
        last = int(np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))[-1])
        held = [c[last:].copy() for c in columns]
        yield batch_of([c[:last] for c in columns])
    if held:
        yield batch_of(held)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(keys):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)


def _items(column: pa.Array, rows: slice, row_of: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, item) of all items of some rows of a list column, of rows in row_of (a mask over rows); null is as empty."""
    part = column.slice(rows.start, rows.stop - rows.start)
    part = part.filter(pa.array(row_of))
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.flatnonzero(row_of), sizes), part.flatten()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, text, regions array<struct<chain, start, end>>, blocks array<int>) to words: of each region, and of each block."""
    seen: set[int] = set()
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for rows, h, lo, _, _ in word_blocks(batch, "text"):
            own, here = fingerprints(h, lo), np.zeros(len(lo) - 1, bool)
            for k in np.flatnonzero(own == fps[rows]).tolist():
                if own[k] not in seen:
                    seen.add(int(own[k]))
                    here[k] = True
            short, n = (h >> np.uint64(32)).astype(np.uint32), np.diff(lo)
            row, region = _items(batch.column(2), rows, here)
            at = np.maximum(0, region.field("start").to_numpy())
            size = np.minimum(region.field("end").to_numpy(), n[row]) - at
            row2, block = _items(batch.column(3), rows, here)
            at2 = block.to_numpy() * BLOCK
            size2 = np.minimum(at2 + BLOCK, n[row2]) - at2
            sizes = np.concatenate((size, np.maximum(0, size2))).astype(np.int64)
            words = short[spread(np.concatenate((lo[row] + at, lo[row2] + at2)), sizes)]
            none = pa.nulls(len(row)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([region.field("chain"), pa.nulls(len(row2)).cast(pa.int64())]),
                    pa.concat_arrays([none, pa.array(own[row2], pa.int64())]),
                    pa.array(np.concatenate((at, block.to_numpy())).astype(np.int32)),
                    binary_array(4 * sizes, words),
                ],
                ["chain", "fp", "at", "words"],
            )


def _extend(a: np.ndarray, b: np.ndarray, other: int = -2) -> tuple[int, int]:
    """How far two sides starting here stay alike: (length, equal words), matches 1, others -2 (or as given), drop 8."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, other))
    high = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.flatnonzero(high - score > 8)
    score = score[: stop[0]] if len(stop) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    length = int(score.argmax()) + 1
    return length, int(same[:length].sum())


def extend_all(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, step: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """As _extend, from many places at once: a[i], a[i + step]... against b[j], b[j + step]..., n words at most."""
    k = np.arange(max(1, n.max(initial=0)))
    inside = k < n[:, None]
    same = inside & (a[np.where(inside, i[:, None] + step * k, 0)] == b[np.where(inside, j[:, None] + step * k, 0)])
    score = np.cumsum(np.where(same, 1, other), axis=1, dtype=np.int32)
    high = np.maximum.accumulate(np.maximum(score, 0), axis=1)
    score[np.logical_or.accumulate(~inside | (high - score > 8), axis=1)] = -(1 << 20)
    rows, best = np.arange(len(n)), score.argmax(axis=1)
    good = score[rows, best] > 0
    return np.where(good, best + 1, 0), np.where(good, np.cumsum(same, axis=1)[rows, best], 0)


def _equal_in_gap(a: np.ndarray, b: np.ndarray) -> int:
    """Most equal words of an alignment of two short stretches."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row = np.concatenate(([0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))))
    return int(row[-1])


def _parts(a: np.ndarray, b: np.ndarray, segs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Segments without overlaps, each with the most equal words of the gap before it: (start in a, start in b, length, equal in gap)."""
    at, own = (int(v) for v in segs[0, :2])
    out = []
    for x, y, n in segs.tolist():
        skip = max(0, at - x, own - y)  # segments may overlap by less than a window
        x, y, n = x + skip, y + skip, n - skip
        if n <= 0:
            continue
        out.append((x, y, n, _equal_in_gap(a[at:x], b[own:y])))
        at, own = x + n, y + n
    return out


def _whole(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int, int]], other: int = -2) -> tuple[int, int, int, int, int]:
    """Parts in one alignment with both sides extended."""
    x, y, _, _ = parts[0]
    back, equal = _extend(a[:x][::-1], b[:y][::-1], other)
    equal += sum(g for *_, g in parts[1:]) + sum(int((a[i : i + n] == b[j : j + n]).sum()) for i, j, n, _ in parts)
    end, own_end = parts[-1][0] + parts[-1][2], parts[-1][1] + parts[-1][2]
    ahead, more = _extend(a[end:], b[own_end:], other)
    return x - back, end + ahead, y - back, own_end + ahead, equal + more


def align(a: np.ndarray, b: np.ndarray, segs: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start, end, owner's start, owner's end, equal words) of a chain; segs are rows (start in a, start in b, length)."""
    return _whole(a, b, _parts(a, b, segs))


def _like(piece: tuple[int, int, int, int, int]) -> bool:
    start, end, own_start, own_end, equal = piece
    return equal >= LIKE * max(end - start, own_end - own_start)


def _paying(parts: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Parts cut so that no end of a piece has more unlike words in its gaps than equal ones."""
    out, todo = [], [parts]
    while todo:
        mine = todo.pop()
        if not mine:
            continue
        best, lo, hi, run, start = -1, 0, 0, 0, 0
        for k, (x, y, n, g) in enumerate(mine):
            if k:
                i, j, m, _ = mine[k - 1]
                run += 2 * g - max(x - i - m, y - j - m)
            if not k or run <= 0:
                run, start = 0, k
            run += n
            if run > best:
                best, lo, hi = run, start, k + 1
        out.append(mine[lo:hi])
        todo += [mine[:lo], mine[hi:]]
    return out


def local_pieces(a: np.ndarray, b: np.ndarray, segs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """A chain's alignment if alike enough; else its best stretch of segments, and so on with what is left on both sides.

    The best has most equal words less LIKE of all, which is never negative: so no segment is lost to its neighbours. Before that a
    chain is cut where a gap has more unlike words than there are equal ones on one side of it.
    """
    out, todo = [], _paying(_parts(a, b, segs))
    while todo:
        parts = todo.pop()
        if not parts:
            continue
        whole = _whole(a, b, parts)
        if _like(whole):
            out.append(whole)
            continue
        best, lo, hi, run, start = -1.0, 0, 0, 0.0, 0
        for k, (x, y, n, g) in enumerate(parts):
            if k:
                i, j, m, _ = parts[k - 1]
                run += g - LIKE * max(x - i - m, y - j - m)
            if not k or run <= 0:
                run, start = 0.0, k
            run += n * (1 - LIKE)
            if run > best:
                best, lo, hi = run, start, k + 1
        piece = _whole(a, b, parts[lo:hi])
        out.append(piece if _like(piece) else _whole(a, b, parts[lo:hi], -3))  # here sides add 75 % equal words at least
        todo += [parts[:lo], parts[hi:]]
    return out


def single_pieces(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, segs: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """local_pieces of the chains picked, of one segment each, all at once: rows (start, end, owner's start, owner's end, equal).

    a and b hold the words of all chains, a_at and b_at where those of each start; segs has a row for each pick.
    """
    x, y, n = segs.T
    equal = (a[spread(a_at[pick] + x, n)] == b[spread(b_at[pick] + y, n)]).astype(np.int64)
    inner = np.add.reduceat(equal, np.cumsum(n) - n)
    out = np.zeros((len(pick), 5), np.int64)
    todo = np.arange(len(pick))
    for other in (-2, -3):  # the second where the first gives a piece that is not alike enough
        p, (u, v, m) = pick[todo], segs[todo].T
        back, more = extend_all(a, b, a_at[p] + u - 1, b_at[p] + v - 1, np.minimum(u, v), -1, other)
        left = np.minimum(a_at[p + 1] - a_at[p] - u - m, b_at[p + 1] - b_at[p] - v - m)
        ahead, extra = extend_all(a, b, a_at[p] + u + m, b_at[p] + v + m, left, 1, other)
        out[todo] = np.stack((u - back, u + m + ahead, v - back, v + m + ahead, inner[todo] + more + extra), axis=1)
        todo = todo[out[todo, 4] < LIKE * (out[todo, 1] - out[todo, 0])]
        if not len(todo):
            break
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, own_fp, segs, at, words, blocks array<struct<at, words>>) to pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        fp, own_fp, at = (batch.column(k).to_numpy() for k in (0, 1, 3))
        flat, seg_at = ragged(batch.column(2), np.int32)
        a, a_at = ragged(batch.column(4), np.uint32)
        blocks = batch.column(5)
        items = blocks.flatten()
        b, block_at = ragged(items.field("words"), np.uint32)
        first = np.cumsum(blocks.value_lengths().to_numpy()) - blocks.value_lengths().to_numpy()
        b_at, own_at = block_at[np.append(first, len(items))], items.field("at").to_numpy()[first].astype(np.int64) * BLOCK
        rows = flat.reshape(-1, 3).astype(np.int64)
        seg_at = seg_at // 3
        of = np.repeat(np.arange(batch.num_rows), np.diff(seg_at))
        rows -= np.stack((at[of], own_at[of], np.zeros(len(of), np.int64)), axis=1)
        one = np.flatnonzero(np.diff(seg_at) == 1)
        chain, pieces = [one], [single_pieces(a, a_at, b, b_at, rows[seg_at[one]], one)] if len(one) else [np.zeros((0, 5), np.int64)]
        for k in np.flatnonzero(np.diff(seg_at) > 1).tolist():
            found = local_pieces(a[a_at[k] : a_at[k + 1]], b[b_at[k] : b_at[k + 1]], rows[seg_at[k] : seg_at[k + 1]])
            chain.append(np.full(len(found), k))
            pieces.append(np.array(found, np.int64).reshape(-1, 5))
        chain, pieces = np.concatenate(chain), np.concatenate(pieces)
        columns = [fp[chain], pieces[:, 0] + at[chain], pieces[:, 1] + at[chain], own_fp[chain], pieces[:, 2] + own_at[chain], pieces[:, 3] + own_at[chain], pieces[:, 4]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["fp", "a", "b", "own_fp", "own_a", "own_b", "equal"])


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_word, last_word, n_words, source_doc_id, source_first_word, source_last_word, similarity, whole, fp):
    spans of each document that an earlier one (by id) has too. Words are runs of letters and digits, from 0.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "passages")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = scratch.keep(docs.mapInArrow(lean(_names), f"doc_id long, fp long, n long, {sketch.CHUNKS}"), "names")
    frequencies = spark.sparkContext.broadcast(sketch.collect(first))
    names = first.where("chunk IS NULL AND n >= 1 AND doc_id IS NOT NULL").select("doc_id", "fp", "n")
    reps = scratch.keep(names.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "reps")

    seeds = docs.select("text").mapInArrow(lean(_seeds(frequencies, HOT_ROWS)), "h long, fp long, pos int, more binary, part int")
    of_seed = Window.partitionBy("h", "part")
    shared = seeds.withColumn("lo", F.min("fp").over(of_seed)).withColumn("hi", F.max("fp").over(of_seed)).where("lo != hi OR part > 0").drop("lo", "hi")
    # copies in different tasks give equal rows; these go behind the join, which puts those of a text together
    shared = scratch.keep(shared.join(reps.select("fp", "rep"), "fp").dropDuplicates(["fp", "h"]), "shared")
    scratch.release()

    best = F.min(F.struct("rep", "pos", F.col("fp").alias("own_fp"), "more")).alias("o")
    owner = shared.groupBy("h").agg(best, F.max("part").alias("parts"))
    owner = owner.select("h", "o", F.explode(F.sequence(F.least(F.lit(1), "parts"), "parts")).alias("part"))
    matches = shared.join(owner, ["h", "part"]).where("fp != o.own_fp").select("fp", "pos", "more", "o.own_fp", F.col("o.pos").alias("own_pos"), F.col("o.more").alias("own_more"))
    chained = matches.repartition("fp").sortWithinPartitions("fp", "pos").mapInArrow(lean(_chain), "fp long, own_fp long, segs binary")
    chained = scratch.keep(chained.withColumn("chain", F.xxhash64("fp", "own_fp", "segs")), "chains")
    ends = chained.mapInArrow(lean(_region_ends), "chain long, fp long, own_fp long, start int, end int, lo int, hi int")
    ends = scratch.keep(ends, "ends")
    regions = ends.groupBy("fp").agg(F.collect_list(F.struct("chain", "start", "end")).alias("regions"))
    wanted = ends.select(F.col("own_fp").alias("fp"), F.explode(F.sequence("lo", "hi")).alias("block")).distinct()
    blocks = wanted.groupBy("fp").agg(F.collect_list("block").alias("blocks"))
    asked = regions.join(blocks, "fp", "full").join(reps, "fp").select(F.col("rep").alias("doc_id"), "fp", "regions", "blocks")
    fetched = docs.join(asked, "doc_id").select("fp", "text", "regions", "blocks").mapInArrow(lean(_fetch), "chain long, fp long, at int, words binary")
    fetched = scratch.keep(fetched, "words")
    scratch.release()

    own_words = fetched.where("fp IS NOT NULL").select(F.col("fp").alias("own_fp"), F.col("at").alias("block"), F.col("words").alias("own_words"))
    need = ends.select("chain", "own_fp", F.explode(F.sequence("lo", "hi")).alias("block"))
    other = need.join(own_words, ["own_fp", "block"]).groupBy("chain").agg(F.sort_array(F.collect_list(F.struct(F.col("block").alias("at"), F.col("own_words").alias("words")))).alias("blocks"))
    sides = chained.join(fetched.where("chain IS NOT NULL").select("chain", "at", "words"), "chain").join(other, "chain")
    pieces = sides.select("fp", "own_fp", "segs", "at", "words", "blocks").mapInArrow(lean(_align), "fp long, a long, b long, own_fp long, own_a long, own_b long, equal long")
    pieces = scratch.keep(pieces, "pieces")

    in_text = Window.partitionBy("fp").orderBy("a", "b", "own_fp", "own_a")
    reached = F.max("b").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("new", F.when(reached.isNull() | (F.col("a") > reached + JOIN_GAP), 1).otherwise(0)).withColumn("span", F.sum("new").over(in_text))
    longest = F.max(F.struct((F.col("b") - F.col("a")).alias("n"), -F.col("own_fp"), "own_fp", "own_a", "own_b", "equal"))
    spans = pieces.groupBy("fp", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"), longest.alias("o")).where(f"b - a >= {LEAST} AND o.n >= {LONGEST}")
    spans = spans.join(reps.select("fp", "rep"), "fp").join(reps.select(F.col("fp").alias("own_fp"), F.col("rep").alias("source_doc_id")), F.col("o.own_fp") == F.col("own_fp"))
    partial = spans.select(
        F.col("rep").alias("doc_id"), F.col("a").alias("first_word"), (F.col("b") - 1).alias("last_word"), (F.col("b") - F.col("a")).alias("n_words"), "source_doc_id",
        F.col("o.own_a").alias("source_first_word"), (F.col("o.own_b") - 1).alias("source_last_word"), (F.col("o.equal") / F.greatest(F.col("o.n"), F.col("o.own_b") - F.col("o.own_a"))).alias("similarity"), F.lit(False).alias("whole"), "fp",
    )
    copies = names.where(f"n >= {LEAST}").join(reps.select("fp", "rep"), "fp").where("doc_id != rep").distinct()
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("first_word"), (F.col("n") - 1).alias("last_word"), F.col("n").alias("n_words"), F.col("rep").alias("source_doc_id"), F.lit(0).cast("long").alias("source_first_word"), (F.col("n") - 1).alias("source_last_word"), F.lit(1.0).alias("similarity"), F.lit(True).alias("whole"), "fp")
    result = scratch.keep(partial.unionByName(whole), "result")
    scratch.drop("names", "reps", "shared", "chains", "ends", "words", "pieces")
    return result


def _region_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges to fetch for each chain: its own with a margin, the owner's as blocks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, at = ragged(batch.column(2), np.int32)
        rows, first = flat.reshape(-1, 3), at[:-1] // 3
        a, x = rows[first, 0], rows[first, 1]
        b, y = (np.maximum.reduceat(rows[:, k] + rows[:, 2], first) for k in (0, 1))
        lo, hi = np.maximum(0, x - MARGIN) // BLOCK, (y + MARGIN) // BLOCK
        yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), batch.column(1), *map(pa.array, ((a - MARGIN).astype(np.int32), (b + MARGIN).astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)))], ["chain", "fp", "own_fp", "start", "end", "lo", "hi"])


def _cut(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (columns..., spans array<struct<fp, a, b>>): texts without their spans; rows with no word left go."""
        for batch in batches:
            at, spans = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1)
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            cut = batch.take(pa.array(hit))
            texts, keep = cut.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for rows, h, lo, first, last in word_blocks(cut, "text"):
                own = fingerprints(h, lo)
                for k in range(len(own)):
                    mine = sorted((s for s in spans[hit[rows.start + k]].as_py() if s["fp"] == own[k]), key=lambda s: s["a"])
                    if not mine:
                        continue
                    begin, end, n = first[lo[k] : lo[k + 1]], last[lo[k] : lo[k + 1]], int(lo[k + 1] - lo[k])
                    raw, kept, done = texts[rows.start + k].encode(), [], 0
                    for s in mine:
                        kept.append(raw[done : begin[s["a"]]])
                        done = begin[s["b"] + 1] if s["b"] + 1 < n else len(raw)
                    texts[rows.start + k] = (b"".join(kept) + raw[done:]).decode()
                    whole = all(s["a"] == 0 and s["b"] >= n - 1 for s in mine)
                    keep[hit[rows.start + k]] = not whole and bool(texts[rows.start + k].strip())
            column = batch.column(at)
            if len(hit):
                place = np.arange(batch.num_rows)
                place[hit] = batch.num_rows + np.arange(len(hit))
                column = pa.concat_arrays([column, pa.array(texts, column.type)]).take(pa.array(place))
            out = [column if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(out, columns).filter(pa.array(keep))

    return run


def cut_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the passages that earlier documents hold; documents with nothing left go. All columns stay; text must be named text."""
    spans = repeated_passages(docs, key, text).groupBy(F.col("doc_id").alias("__span_of")).agg(F.collect_list(F.struct("fp", F.col("first_word").alias("a"), F.col("last_word").alias("b"))).alias("__spans"))
    joined = docs.join(spans, docs[key] == spans["__span_of"], "left").drop("__span_of")
    return joined.mapInArrow(lean(_cut(docs.columns)), docs.schema)

"""SentencePiece BPE by vectorised merge rounds.

Texts are cut into units, a run of word marks with what follows up to the next mark or line end, since
no piece has a mark behind another character and none has a line end. Distinct units are encoded together: flat numpy symbol arrays,
the least pair rank of each segment by a segmented minimum, the leftmost merge of every segment at
once, then compaction, until no pair is left. Segments end where two characters meet that no piece
holds side by side, so long junk words fall apart. A merge whose piece starts or ends no better
ranked piece is made at all its places in a segment at once, which gives the same result.

Null and empty texts have no tokens; repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean

MARK = "▁"
NONE = np.int64(1) << 40
_SHIFT = 22
CACHE_UNITS = 350_000
BLOCK_CHARS = 1 << 20
_UNITS = re.compile(f"{MARK}+[^{MARK} ]*| [^{MARK} ]*")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        normal: dict[str, int] = {}
        for i in range(size):
            p = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                normal[p] = i
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in normal):
            raise ValueError("pieces of this model reach over spaces or line ends")
        scores = {p: lib.get_score(i) for p, i in normal.items()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.size, self.text = size, [str(i) for i in range(size)]
        self.symbols = np.arange(0x110000, dtype=np.int64) + size  # characters without a piece of their own
        for p, i in normal.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        single = lambda c: normal.get(c, size + ord(c))
        pairs, better, beside = {}, set(), set()
        for p, i in normal.items():
            beside.update(zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                for part in (a, b):
                    if part in normal and scores[p] >= scores[part]:
                        better.add(normal[part])
                if (len(a) == 1 or a in normal) and (len(b) == 1 or b in normal):
                    pairs[(single(a) if len(a) == 1 else normal[a]) << _SHIFT | (single(b) if len(b) == 1 else normal[b])] = (ranks[scores[p]], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int64)
        self.one_by_one = np.zeros(size, bool)
        self.one_by_one[list(better)] = True
        self.beside = np.array(sorted(ord(a) << 21 | ord(b) for a, b in beside), np.int64)
        self.run = max((len(p) for p in normal if not p.strip(MARK)), default=0)
        if self.run > 1:  # a long run of marks is a row of the longest piece of marks, if short ones show that
            longest = normal[MARK * self.run]
            units = [MARK * n for n in range(2 * self.run, 4 * self.run)]
            self.run_id = longest
            if any(ids[0] != longest for ids in self.encode_units(units)):
                self.run = 0
        # neither normalisation nor dropped spaces, a mark before the text, bytes for what no piece has
        probes = ["a", " a  b ", "a\tb\r\nc", "\ufb01\u2460\uff21", "e\u0301\u00e9\u212b", "\u200b\u00a0x\u3000", "<s> </s> <unk> <0x41>", "\U0010fffd", f"a{MARK}b"]
        if [ids for ids, _ in encode_texts(self, probes, UnitCache())] != lib.encode(probes) or [lib.decode(lib.encode(p)) for p in probes] != [p.replace(MARK, " ") for p in probes]:
            raise ValueError("this model normalises texts, or isn't merged by pairs")

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, len(keys) for none."""
        key = left << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at, len(self.keys))

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit; a unit is encoded as it stands, without a mark put before it."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(points):
            return [[] for _ in units]
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        joins = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, joins), max(0, len(self.beside) - 1))
        new = np.concatenate(([True], (unit[1:] != unit[:-1]) | (self.beside[at] != joins)))
        segment, symbols, unit_of = np.cumsum(new) - 1, self.symbols[points], unit[new]
        done_symbols, done_segments = [], []
        none = len(self.keys)
        pair = np.full(len(symbols), none)
        same = np.flatnonzero(segment[:-1] == segment[1:])
        pair[same] = self._pairs(symbols[same], symbols[same + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            length = np.diff(np.append(first, len(symbols)))
            rank = self.ranks[pair]
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least < NONE, length)
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_segments.append(segment[~open_])
                symbols, segment, pair, rank, least, length = symbols[open_], segment[open_], pair[open_], rank[open_], least[least < NONE], length[least < NONE]
                if not len(symbols):
                    break
            c = np.flatnonzero(rank == np.repeat(least, length))
            starts = np.concatenate(([True], (c[1:] != c[:-1] + 1) | (segment[c[1:]] != segment[c[:-1]])))
            in_run = np.arange(len(c)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
            leading = np.concatenate(([True], segment[c[1:]] != segment[c[:-1]]))
            made = self.made[pair[c]]
            take = leading | ((in_run % 2 == 0) & ~self.one_by_one[made])
            c = c[take]
            symbols[c] = made[take]
            keep = np.ones(len(symbols), bool)
            keep[c + 1] = False
            where = np.cumsum(keep)[c] - 1
            symbols, segment, pair = symbols[keep], segment[keep], pair[keep]
            touched = np.concatenate((where, where - 1))
            touched = touched[touched >= 0]
            pair[touched] = none
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[segment[touched] == segment[touched + 1]]
            pair[touched] = self._pairs(symbols[touched], symbols[touched + 1])
        symbols, segment = np.concatenate(done_symbols), np.concatenate(done_segments)
        order = np.argsort(segment, kind="stable")
        symbols, owner = symbols[order], unit_of[segment[order]]
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):  # characters that no piece has, as bytes
            raw = [self.byte_ids[list(chr(s - self.size).encode("utf-8", "surrogatepass"))] for s in symbols[odd].tolist()]
            count = np.ones(len(symbols), np.int64)
            count[odd] = [len(r) for r in raw]
            owner, start = np.repeat(owner, count), np.cumsum(count) - count
            symbols = np.repeat(symbols, count)
            symbols[np.concatenate([np.arange(s, s + len(r)) for s, r in zip(start[odd].tolist(), raw, strict=True)])] = np.concatenate(raw)
        ends = np.searchsorted(owner, np.arange(len(units) + 1))
        flat, ends = symbols.tolist(), ends.tolist()
        return [flat[a:b] for a, b in itertools.pairwise(ends)]

    def encode_heads(self, heads: list[str]) -> list[list[int]]:
        """Ids of mark + head, of the head alone if it starts with a line end; long runs of marks are peeled off first."""
        units = [h if h[:1] == "\n" else MARK + h for h in heads]
        peeled = {}
        for k, u in enumerate(units) if self.run else ():
            if len(u) > 2 * self.run and u[1] == MARK:
                n = (len(u) - len(u.lstrip(MARK))) // self.run - 2
                if n > 0:
                    peeled[k], units[k] = n, u[n * self.run :]
        out = self.encode_units(units)
        for k, n in peeled.items():
            out[k] = [self.run_id] * n + out[k]
        return out


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def heads(text: str) -> list[str]:
    """The units of a text: those at a line end as they are, others without their first mark."""
    if not text:
        return []
    if text[0] == " " or "  " in text or MARK in text:
        return [u[1:] for u in _UNITS.findall(MARK + text.replace(" ", MARK).replace("\n", " \n"))]
    return text.replace("\n", " \n").split(" ")


class UnitCache:
    """Ids of units met before in this task, flat, and these as text; emptied when it holds over CACHE_UNITS."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, model: PieceModel, new: list[str]) -> None:
        encoded = model.encode_heads(new)
        self.index.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
        self.text += [",".join([model.text[i] for i in ids]) for ids in encoded]
        ends = self.start[-1] + np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))
        self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(encoded), np.int32, int(ends[-1] - self.start[-1]))))
        self.start = np.concatenate((self.start, ends))


def encode_texts(model: PieceModel, texts: list[str], cache: UnitCache) -> Iterator[tuple[list[int], str]]:
    """(ids, ids as text joined by commas) of each."""
    split = [heads(t) for t in texts]
    if len(cache.text) > CACHE_UNITS:
        cache.clear()
    new = list(set(itertools.chain.from_iterable(split)).difference(cache.index))
    if new:
        cache.add(model, new)
    for hs in split:
        at = np.fromiter(map(cache.index.__getitem__, hs), np.int64, len(hs))
        first = cache.start[at]
        count = cache.start[at + 1] - first
        places = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        yield cache.flat[places].tolist(), ",".join(map(cache.text.__getitem__, at.tolist()))


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = piece_model(path), UnitCache()
        for batch in batches:
            texts, at = batch.column(batch.num_columns - 1), 0
            rest = [batch.column(k) for k in range(batch.num_columns - 1)]
            while at < len(texts):
                block, held, start = [], 0, at
                while at < len(texts) and (not block or held < BLOCK_CHARS):
                    block.append(texts[at].as_py() or "")
                    held += len(block[-1])
                    at += 1
                encoded = list(encode_texts(model, block, cache))
                decoded = model.library.decode([ids for ids, _ in encoded])
                columns = [
                    pa.array([len(ids) for ids, _ in encoded], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in encoded]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([ids for ids, _ in encoded], pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([*(r.slice(start, at - start) for r in rest), *columns], [*batch.schema.names[:-1], *names])

    return run


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids array<int> and decoded if with_ids."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(_encode(path, with_ids)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)

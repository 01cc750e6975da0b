"""Licence scan by a positional rare-token index.

The templates' words are the vocabulary. One pass over all documents counts in how many each vocabulary word
stands, which gives its IDF. The index has postings (template, phrase, position) of each key phrase under the
phrase's rarest word. In the second pass a file is reduced to the places of its vocabulary words; these are looked up by
falling IDF, and each posting gives a place of the template in the file, the word's place less its position. The places that
a template's phrases agree on, within its length, are intersected, and there the phrases are verified word by word. What a
file costs goes by its own words and the templates that they lead to, not by the number of templates; no lookup is left out.

Of a template whose phrases stand, the score is the share of its words that are found in order, each within SLACK words of where
the ones before it lead, at the best of its places. A label needs LEAST_SCORE. Base phrases are templates that are
their own key phrase, and all places where they stand are returned.

Null and empty texts have no words, no labels and score 0; a file that is all licence words is
aligned like any other, whole; repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import BASE, TEMPLATES
from .storage import lean
from .textwords import ALNUM_WORDS, LOWER, find_words, text_blocks

#: how far a template's next word may stand from where the words before it lead
SLACK = 6
#: what share of a template's words has to be found for its label
LEAST_SCORE = 0.8


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return find_words(LOWER[raw], np.array([0, len(raw)]), ALNUM_WORDS).hashes()


@dataclass
class Index:
    labels: list[str] = field(default_factory=list)
    words: list[list[int]] = field(default_factory=list)
    phrases: list[list[list[int]]] = field(default_factory=list)
    base_of: list[str | None] = field(default_factory=list)
    vocabulary: np.ndarray | None = None
    idf: dict[int, float] = field(default_factory=dict)
    #: word -> (template, phrase, position in the template, position in the phrase) of the phrases that it is the rarest of
    postings: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)


def build_index(templates: dict | None = None, base: dict | None = None) -> Index:
    index = Index()
    entries = [(label, phrase, (phrase,), label) for phrase, label in (BASE if base is None else base).items()]
    entries += [(label, text, phrases, None) for label, (text, phrases) in (TEMPLATES if templates is None else templates).items()]
    for label, text, phrases, own in entries:
        index.labels.append(label)
        index.words.append(_hashes(text).tolist())
        index.phrases.append([_hashes(p).tolist() for p in phrases])
        index.base_of.append(own)
    index.vocabulary = np.array(sorted({w for words in index.words for w in words}), np.uint64)
    return index


def _posted(index: Index) -> None:
    """Posts each key phrase under its rarest word, at every place of the phrase in its template."""
    postings = defaultdict(list)
    for t, (words, phrases) in enumerate(zip(index.words, index.phrases, strict=True)):
        for f, phrase in enumerate(phrases):
            starts = [q for q in range(len(words) - len(phrase) + 1) if words[q : q + len(phrase)] == phrase]
            if not phrase or not starts:
                raise ValueError(f"a key phrase of {index.labels[t]} is no part of it")
            k = min(range(len(phrase)), key=lambda x: (-index.idf.get(phrase[x], 0.0), x))
            postings[phrase[k]] += [(t, f, q + k, k) for q in starts]
    index.postings = dict(postings)


def _hits(index: Index, batch: pa.RecordBatch, column: str):
    """Of each row: (row, number of words, positions of vocabulary words, these words' hashes)."""
    v = index.vocabulary
    for rows, buf, offsets in text_blocks(batch, column):
        words = find_words(LOWER[buf], offsets, ALNUM_WORDS)
        h = words.hashes()
        at = np.minimum(np.searchsorted(v, h), len(v) - 1)
        hit = np.flatnonzero(v[at] == h)
        cuts = np.searchsorted(hit, words.lo)
        for i in range(len(offsets) - 1):
            own = hit[cuts[i] : cuts[i + 1]]
            yield rows.start + i, int(words.lo[i + 1] - words.lo[i]), own - words.lo[i], h[own]


def _count_words(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, count = 0, Counter()
        for batch in batches:
            for _, _, _, h in _hits(index, batch, "text"):
                n += 1
                count.update(np.unique(h).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array([None, *count], pa.int64()), pa.array([n, *count.values()], pa.int64())], ["word", "n"])

    return run


def with_idf(index: Index, docs: DataFrame, text: str = "text") -> Index:
    """Counts over all documents; what comes to the driver is one row per vocabulary word."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(lean(_count_words(index)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = {r["word"]: r["n"] for r in rows}
    total = count.pop(None, 0)
    index.idf = {int(w): float(np.log((total + 1) / (count.get(int(w.view(np.int64)), 0) + 1))) for w in index.vocabulary}
    _posted(index)
    return index


def _stands(phrase: list[int], place: dict[int, int], start: int) -> bool:
    return all(place.get(start + k) == w for k, w in enumerate(phrase))


def _aligned(words: list[int], place: dict[int, int], start: int) -> float:
    """The share of a template's words found from a place on, each within SLACK of where the last one found leads."""
    found, shift = 0, start
    for q, w in enumerate(words):
        for d in range(2 * SLACK + 1):
            step = (d + 1) // 2 * (1 if d % 2 else -1)  # 0, 1, -1, 2, -2 and so on
            if place.get(shift + q + step) == w:
                found, shift = found + 1, shift + step
                break
    return found / len(words)


def scan_file(index: Index, positions: list[int], hashes: list[int]) -> tuple[list[tuple[int, str]], dict[str, float]]:
    """(base places (start, label), labels with their scores) from a file's vocabulary words and where they stand."""
    place = dict(zip(positions, hashes, strict=True))
    where: dict[int, list[int]] = defaultdict(list)
    for p, h in place.items():
        where[h].append(p)
    led: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
    for w in sorted(where, key=lambda x: (-index.idf[x], x)):
        for t, f, q, k in index.postings.get(w, ()):
            led[t][f] |= {(p - q, p - k) for p in where[w]}
    base: list[tuple[int, str]] = []
    scores: dict[str, float] = {}
    for t, phrases in led.items():
        if len(phrases) < len(index.phrases[t]):
            continue
        words, own = index.words[t], index.base_of[t]
        stand = [sorted(x for x in phrases[f] if _stands(index.phrases[t][f], place, x[1])) for f in sorted(phrases)]
        if own:
            base += [(s, own) for _, s in stand[0]]
            if stand[0]:
                scores[own] = 1.0
            continue
        # where all phrases stand within the template's length of one another
        rest = [np.array([d for d, _ in s], dtype=np.int64) for s in stand]
        if not all(len(r) for r in rest):
            continue
        starts = rest[min(range(len(rest)), key=lambda f: len(rest[f]))]
        near = [np.searchsorted(r, starts + len(words), side="right") > np.searchsorted(r, starts - len(words)) for r in rest]
        best = max((_aligned(words, place, int(d)) for d in np.unique(starts[np.all(near, axis=0)])), default=0.0)
        if best >= LEAST_SCORE:
            scores[index.labels[t]] = best
    return sorted(base), scores


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, n, positions, h in _hits(index, batch, "text"):
                base, scores = scan_file(index, positions.tolist(), h.tolist()) if len(h) > 1 else ([], {})
                starts, own = [s for s, _ in base], sorted({x for _, x in base})
                out.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted(scores)), max(scores.values(), default=0.0)))
            got = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]).astype({"first_word": "Int64", "last_word": "Int64"})
            columns = pa.RecordBatch.from_pandas(got, preserve_index=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.columns], ["doc_id", *columns.schema.names])

    return run


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    index = with_idf(index or build_index(), docs, text)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(_scan(index)), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

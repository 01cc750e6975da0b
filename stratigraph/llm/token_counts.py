"""Token counts: a tokenizer library called in Arrow functions that return lengths only.

Texts go to the library in batches of about the same bytes. A text longer than that is split where
the tokenizer can't join what stands left and right, so its parts' counts add up to the whole's:
at a single space between two other characters. A .model that puts its own mark before a text makes
it anew for each part, so the space itself is dropped there; in a .json's byte-level pattern the
space belongs to the word behind it, so it stays.

Null and empty texts have 0 tokens (or what the library gives for an empty text); a text without
such a space is one part; repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean

BATCH_BYTES = 1 << 20


@functools.lru_cache(maxsize=4)
def counter(path: str):
    """(texts -> token counts, whether the space at a split is dropped) for a tokenizer file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or model.encode("a b") != model.encode("a") + model.encode("b"):
            raise ValueError("pieces of this model reach over spaces")
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], True
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if any(ids(a + " " + b) != ids(a) + ids(" " + b) for a in _BESIDE for b in _BESIDE):
        raise ValueError("tokens of this tokenizer reach over spaces")
    return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)], False


#: what stands beside a space where a text may be split, in samples that a tokenizer has to pass
_BESIDE = ("a", "the", "Word", "7", "1999", ".", "it's", "n't", "'", '"', "-", "(", "é", "ß", "日本", "😀", "\u0301", "_", "@x", "\x7f")
_SPLIT = re.compile(r"(?<=[^\s▁<>|]) (?=[^\s▁<>|])")


def parts(text: str, most: int, drop_space: bool) -> list[str]:
    """The text in parts of about most bytes, split at safe spaces; longer where there is none."""
    out, at = [], 0
    while len(text) - at > most // 4:  # a character has four bytes at most
        step = most
        while (held := len(text[at : at + step].encode())) > most and step > most // 4:
            step = max(most // 4, step * most // held)
        if len(text) - at <= step or not (m := _SPLIT.search(text, at + step)):
            break
        out.append(text[at : m.start()])
        at = m.end() if drop_space else m.start()
    out.append(text[at:])
    return out


def count_tokens(path: str, column: str, batch_bytes: int = BATCH_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, drop_space = counter(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            n, n_bytes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            part, owner, held = [], [], 0

            def flush():
                if part:
                    np.add.at(n, owner, count(part))
                part.clear()
                owner.clear()

            for i in range(len(texts)):
                text = texts[i].as_py()
                if text is None:
                    continue
                n_bytes[i] = len(text.encode())
                pieces = parts(text, batch_bytes, drop_space) if n_bytes[i] > batch_bytes else (text,)
                for piece in pieces:
                    size = int(n_bytes[i]) if len(pieces) == 1 else len(piece.encode())
                    if held + size > batch_bytes:
                        flush()
                        held = 0
                    part.append(piece)
                    owner.append(i)
                    held += size
            flush()
            rest = [k for k in range(batch.num_columns) if batch.schema.field(k).name != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(n_bytes), pa.array(n)], [*(batch.schema.field(k).name for k in rest), "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) by the tokenizer file at path."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(count_tokens(path, "text")), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

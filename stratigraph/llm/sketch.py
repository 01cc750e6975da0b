"""Frequencies of 64-bit hashes in 2**BITS counters: 4 MB whatever the input.

A counter bounds the frequency of each hash in it from above. That is enough to order hashes and to
tell which may be hot, and nothing is ever decided by it that changes results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BITS, CHUNK_BITS = 20, 14
CHUNKS = "chunk int, counts binary"


def empty() -> np.ndarray:
    return np.zeros(1 << BITS, dtype=np.uint32)


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def add(counts: np.ndarray, h: np.ndarray) -> None:
    counts += np.bincount(slots(h), minlength=len(counts)).astype(np.uint32)


def chunk_arrays(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(chunk, counts) of a task's counters."""
    chunks = counts.reshape(-1, 1 << CHUNK_BITS)
    return pa.array(range(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())


def _add_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << CHUNK_BITS, dtype=np.uint64)
    for c in pdf["counts"]:
        total += np.frombuffer(c, dtype=np.uint32)
    return pd.DataFrame({"chunk": pdf["chunk"][:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def collect(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters, from rows with chunk and counts; 2**BITS counters come to the driver at any input size."""
    counts = empty().reshape(-1, 1 << CHUNK_BITS)
    for c in rows.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInPandas(_add_chunks, CHUNKS).collect():
        counts[c["chunk"]] = np.frombuffer(c["counts"], dtype=np.uint32)
    return counts.reshape(-1)


def hot_limit(counts: np.ndarray, hot_rows: int) -> float:
    """What a counter has to hold for its hashes to be hot: far over hot_rows besides its share of all."""
    return hot_rows + 8 * float(counts.mean())


def parts(df: np.ndarray, owner: np.ndarray, limit: float, hot_rows: int) -> np.ndarray:
    """0 for each hash, but for those whose counters df are over the limit: one of the parts of about hot_rows rows, from 1, by owner."""
    return np.where(df > limit, 1 + owner % (df.astype(np.int64) // hot_rows + 1), 0).astype(np.int32)

"""Token clones as ranges: equal runs of tokens found by a rolling hash, united along diagonals.

Every window of min_tokens tokens has a 64-bit rolling hash, computed from sums over a file's bytes and tokens, and is
dealt out by it once. A window that others hold as well points to its first holder by (path, place), so n copies make n - 1
matches; consecutive matches of two files at the same distance are one range, as long as it goes on.
A key's first holder is an aggregation and a join over that one exchange; a key has a row for each of its holders there, never a
pair of them. Behind it, what is in one task is the matches of two files on one diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: any odd numbers do: powers of the first can be divided out again
BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def _ranges_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each range, wherever it stands: sums of value * base**place, divided by base**start."""
    n = len(values) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * _powers(base, n)[:-1], dtype=np.uint64)))
    back = _powers(pow(base, -1, 1 << 64), n)
    return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(OTHER))


def window_hashes(text: str, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first lines, last lines) of all windows of tokens between blanks; lines count from 1."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate(([False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < window:
        return (np.zeros(0, np.int64),) * 3
    tokens = _ranges_hashed(data.astype(np.uint64) + np.uint64(1), starts, ends, BASE)
    lines = 1 + np.cumsum(data == 10)
    at = np.arange(len(tokens) - window + 1)
    hashes = _ranges_hashed(tokens, at, at + window, BASE)
    return hashes.view(np.int64), lines[starts[at]], lines[starts[at + window - 1]]


def token_windows(files: DataFrame, window: int) -> DataFrame:
    """(path, at, h, first_line, last_line) of every window of a table (path, text); null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                h, first, last = window_hashes(text.as_py() or "", window)
                for i in range(0, len(h), 1 << 16):  # long files in parts
                    some = slice(i, i + (1 << 16))
                    n = len(h[some])
                    paths = pa.repeat(path, n)
                    yield pa.RecordBatch.from_arrays([paths, pa.array(np.arange(i, i + n), pa.int64()), pa.array(h[some]), pa.array(first[some], pa.int64()), pa.array(last[some], pa.int64())], ["path", "at", "h", "first_line", "last_line"])

    kind = files.schema["path"].dataType.simpleString()
    return files.select("path", F.col("text").cast("string").alias("text")).mapInArrow(run, f"path {kind}, at long, h long, first_line long, last_line long")


def _dealt(windows: DataFrame) -> DataFrame:
    """Windows dealt out by their hash: what groups and joins by it reads this one exchange, and nothing is kept beside it."""
    return windows.repartition(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")


def _matches(windows: DataFrame) -> DataFrame:
    """Each window that is not the first of its hash, with that first one as own; windows as _dealt has them."""
    own = windows.groupBy("h").agg(F.min(F.struct("path", "at", "first_line", "last_line")).alias("own"), F.count("*").alias("n")).where("n > 1").select("h", "own")
    return windows.join(own.hint("merge"), "h").where((F.col("path") != F.col("own.path")) | (F.col("at") != F.col("own.at")))


def _bounds(min_tokens: int, min_lines: int) -> None:
    if not 10 <= min_tokens <= 500 or not 2 <= min_lines <= 100:
        raise ValueError("10 to 500 tokens and 2 to 100 lines")


def clone_ranges(files: DataFrame, min_tokens: int = 50, min_lines: int = 5) -> DataFrame:
    """(clone_id, first, second, tokens, lines): equal ranges of at least min_tokens tokens that reach over min_lines line ends.

    first and second are (path, start_line, end_line); first holds the earlier copy. Within one file copies don't overlap.
    Of three copies the second and the third each make a range with the first.
    """
    _bounds(min_tokens, min_lines)
    met = _matches(_dealt(token_windows(files, min_tokens)))
    met = met.where((F.col("path") != F.col("own.path")) | (F.col("at") - F.col("own.at") >= min_tokens))
    met = met.withColumn("diagonal", F.col("at") - F.col("own.at"))
    along = Window.partitionBy("own.path", "path", "diagonal").orderBy("at")
    islands = met.withColumn("island", F.col("at") - F.row_number().over(along)).groupBy(F.col("own.path").alias("own_path"), "path", "diagonal", "island").agg(
        F.count("*").alias("n"), F.min("at").alias("at"), F.min("first_line").alias("a"), F.max("last_line").alias("b"), F.min("own.first_line").alias("own_a"), F.max("own.last_line").alias("own_b")
    )
    lines = F.least(F.col("b") - F.col("a"), F.col("own_b") - F.col("own_a"))
    kept = islands.where(lines >= min_lines)
    side = lambda p, a, b: F.struct(F.col(p).cast("string").alias("path"), F.col(a).alias("start_line"), F.col(b).alias("end_line"))
    clone_id = F.sha2(F.concat_ws("\x1f", "own_path", "path", F.col("at") - F.col("diagonal"), "at"), 256)
    return kept.select(clone_id.alias("clone_id"), side("own_path", "own_a", "own_b").alias("first"), side("path", "a", "b").alias("second"), (F.col("n") + min_tokens - 1).alias("tokens"), (lines + 1).alias("lines"))


def token_clones(docs: DataFrame, window: int = 50) -> DataFrame:
    """(left_id, right_id, shared): how many different windows a document has in common with their first holder."""
    _bounds(window, 2)
    windows = token_windows(docs.select(F.col("doc_id").alias("path"), "text"), window)
    grams = _dealt(windows.select("path", "h").where("path IS NOT NULL AND h IS NOT NULL")).distinct()  # both sides read the same rows
    first = grams.groupBy("h").agg(F.min("path").alias("left_id"), F.max("path").alias("hi")).where("left_id != hi").drop("hi")
    return grams.join(first.hint("merge"), "h").where("path != left_id").groupBy("left_id", F.col("path").alias("right_id")).agg(F.count("*").alias("shared"))

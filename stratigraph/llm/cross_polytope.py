"""Nearest neighbours by cross-polytope hashing.

Each table rotates a unit vector by three rounds of random signs and a fast Hadamard transform and
takes the nearest signed axis: 2 D buckets, D the dimension padded to a power of two. Larger tables
concatenate a second rotation's nearest axis, of its first coordinates only, and so on, until a
bucket holds about BUCKET_ROWS rows: so buckets grow with the rows. A query probes the buckets with
the largest sums of coordinates in every table; a bucket's vectors and the queries that probe it meet
in one group, where inner products are a matrix product and each query keeps its best.

Buckets that a sketch of all buckets' frequencies puts over HOT rows or HOT_QUERIES queries are split on
both sides, and each part of the rows meets each part of the queries: so a vector that a third of
all rows repeat is spread out and still compared in whole. Vectors travel once per table as they
are stored, with their row's number, and results as numbers and scores.

If lengths differ, vectors get one more component that makes them equally long (queries get 0), which
turns the largest inner product into the smallest angle.

How many buckets to probe is fitted: SAMPLE queries (those with the least hashes of their ids) are
answered by brute force over all rows, in place, and the least number is taken that finds RECALL of
their true neighbours.

Vectors null, zero, or with null or non-finite components take no part, nor do rows without an id;
vectors of different dimension are never compared; a row is never its own neighbour, but rows that
repeat an id, or id and vector, are rows of their own, as queries and as candidates; an empty table
gives no rows; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .storage import Scratch, lean
from .textwords import mix

TABLES, ROUNDS = 4, 3
SAMPLE, RECALL = 100, 0.95
BUCKET_ROWS = 256
HOT, HOT_QUERIES = 8192, 2048
SCORES_AT_ONCE = 4_000_000
QUERIES_AT_ONCE = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, in n log n steps."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, seed: int = 5) -> np.ndarray:
    signs = np.random.default_rng((seed, table, x.shape[1])).choice((-1.0, 1.0), (ROUNDS, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def padded(x: np.ndarray, longest: float, query: bool, dimension: int) -> np.ndarray:
    """Unit vectors in a power of two of dimensions; longest > 0: with the component that makes all equally long."""
    size = np.linalg.norm(x, axis=1)
    extra = np.zeros(len(x)) if query or not longest else np.sqrt(np.maximum(0, longest**2 - size**2))
    need = x.shape[1] + (longest > 0)
    out = np.zeros((len(x), max(dimension, 1 << (need - 1).bit_length())))
    out[:, : x.shape[1]] = x
    if longest:
        out[:, x.shape[1]] = extra
    return out / np.linalg.norm(out, axis=1)[:, None]


def widths(dimension: int, rows: int, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Coordinates of each rotation whose nearest axis is part of a bucket: the first takes all, the last as many as give buckets of bucket_rows."""
    out, buckets = [dimension], 2 * dimension
    while 2 * buckets * bucket_rows <= rows and len(out) < 4:
        out.append(min(dimension, 1 << int(np.log2(rows / (2 * buckets * bucket_rows)))))
        buckets *= 2 * out[-1]
    return out


def _signed(x: np.ndarray, table: int, part: int, width: int) -> np.ndarray:
    """Coordinates of a rotation with both signs: 2 k is +k, 2 k + 1 is -k."""
    r = rotated(x, 64 * part + table)[:, :width]
    return np.stack((r, -r), axis=2).reshape(len(r), -1)


def own_bucket(x: np.ndarray, table: int, parts: list[int]) -> np.ndarray:
    """The bucket of each unit vector."""
    out = np.zeros(len(x), np.int64)
    for k, width in enumerate(parts):
        out = out * 2 * width + _signed(x, table, k, width).argmax(axis=1)
    return out


def score_of(x: np.ndarray, keys: np.ndarray, table: int, parts: list[int]) -> np.ndarray:
    """Of each unit vector and the buckets in its row of keys, the sum of the coordinates that a bucket names."""
    out = np.zeros(keys.shape)
    for k in range(len(parts) - 1, -1, -1):
        out += np.take_along_axis(_signed(x, table, k, parts[k]), keys % (2 * parts[k]), axis=1)
        keys = keys // (2 * parts[k])
    return out


def better_buckets(x: np.ndarray, scores: np.ndarray, table: int, parts: list[int]) -> np.ndarray:
    """Of each unit vector, how many buckets have more than the scores in its row: one half's sums looked up in the other's."""
    parts_of = [_signed(x, table, k, width) for k, width in enumerate(parts)]
    out = np.zeros(scores.shape, np.int64)
    for i in range(len(x)):
        halves = [np.zeros(1), np.zeros(1)]
        for k, part in enumerate(parts_of):
            halves[k % 2] = (halves[k % 2][:, None] + part[i]).ravel()
        second = np.sort(halves[1])
        for j, s in enumerate(scores[i].tolist()):
            out[i, j] = (len(second) - np.searchsorted(second, s - halves[0] + 1e-12)).sum()
    return out


def probed(x: np.ndarray, table: int, parts: list[int], probes: int) -> np.ndarray:
    """The buckets of each unit vector with the best scores. The best of all begin with the best of the first rotations, so no more are kept."""
    score, key = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for k, width in enumerate(parts):
        score = (score[:, :, None] + _signed(x, table, k, width)[:, None, :]).reshape(len(x), -1)
        key = (key[:, :, None] * 2 * width + np.arange(2 * width)).reshape(len(x), -1)
        if probes < score.shape[1]:
            best = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
            score, key = np.take_along_axis(score, best, axis=1), np.take_along_axis(key, best, axis=1)
    return key


def vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each dimension there is, of the rows that take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.where(np.asarray(column.is_null()), 0, np.asarray(column.value_lengths().fill_null(0)))
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")))
    starts, out = np.cumsum(lengths) - lengths, []
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = values[starts[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if fine.any():
            out.append((rows[fine], x[fine]))
    return out


class Space:
    """What hashing needs to know of the whole table: the largest length if lengths differ, the number of rows."""

    def __init__(self, longest: float, rows: int, dimension: int, tables: int, bucket_rows: int):
        self.longest, self.rows, self.dimension, self.tables, self.bucket_rows = longest, rows, dimension, tables, bucket_rows

    def units(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, list[int]]:
        unit = padded(x, self.longest, query, self.dimension)
        return unit, widths(unit.shape[1], self.rows, self.bucket_rows)

    def keys(self, x: np.ndarray, query: bool, probes: int) -> Iterator[np.ndarray]:
        """Of each table the buckets of all vectors, one column for each probe; a bucket's number holds dimension and table."""
        unit, parts = self.units(x, query)
        for t in range(self.tables):
            near = probed(unit, t, parts, probes) if query else own_bucket(unit, t, parts)[:, None]
            yield (np.int64(x.shape[1]) << 48) + (np.int64(t) << 40) + near


def _rows_of(batch: pa.RecordBatch, query: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, vectors) of the rows (row, vec_id, embedding, is_row, is_query) that are searched, or that search."""
    flag = batch.column(4 if query else 3).to_numpy(zero_copy_only=False)
    for rows, x in vectors(batch.column(2)):
        at = np.flatnonzero(flag[rows])
        step = QUERIES_AT_ONCE if query else max(1, len(at))
        for a in range(0, len(at), step):
            yield rows[at[a : a + step]], x[at[a : a + step]]


def _count_buckets(space: Space, query: bool, probes: int):
    """The task's frequencies of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.empty()
        for batch in batches:
            for _, x in _rows_of(batch, query):
                for key in space.keys(x, query, probes):
                    sketch.add(counts, mix(key.ravel().astype(np.uint64)))
        yield pa.RecordBatch.from_arrays(list(sketch.chunk_arrays(counts)), ["chunk", "counts"])

    return run


def _hashed(space: Space, query: bool, probes: int, row_counts, query_counts, hot: int, hot_queries: int):
    """Rows (bucket, row_part, query_part, row, vec_id, v): a vector once per table and part of its queries, a query once per probe and part of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            kind = np.float32 if pa.types.is_float32(batch.column(2).type.value_type) else np.float64
            for at, x in _rows_of(batch, query):
                raw = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                for key in space.keys(x, query, probes):
                    of, key = np.repeat(np.arange(len(at)), key.shape[1]), key.ravel()
                    slot = sketch.slots(mix(key.astype(np.uint64)))
                    n_rows = row_counts.value[slot].astype(np.int64) // hot + 1
                    n_queries = query_counts.value[slot].astype(np.int64) // hot_queries + 1
                    own, other = (n_queries, n_rows) if query else (n_rows, n_queries)
                    place = mix(row[at].astype(np.uint64))[of].view(np.int64) % own
                    copy = np.repeat(np.arange(len(of)), other)
                    visit = np.arange(len(copy)) - np.repeat(np.cumsum(other) - other, other)
                    parts = (visit, place[copy]) if query else (place[copy], visit)
                    of, key = of[copy], key[copy]
                    columns = [pa.array(key), *(pa.array(p.astype(np.int32)) for p in parts), pa.array(row[at[of]]), pa.array(ids[at[of]]), raw.take(pa.array(of))]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "row_part", "query_part", "row", "vec_id", "v"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, x in _rows_of(batch, False):
            size = np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([size.min(initial=np.inf)]), pa.array([size.max(initial=0.0)]), pa.array([len(x)])], ["lo", "hi", "n"])


def best_in_group(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, place in x, score) of each query's top nearest other rows, ties to smaller ids, then rows.

    The matrix product only selects; the scores are row-wise sums, the same whatever else is in the group.
    """
    out = []
    step = max(1, SCORES_AT_ONCE // max(1, len(x)))
    for a in range(0, len(q), step):
        block = q[a : a + step]
        s = block @ x.T
        s[q_rows[a : a + step, None] == rows[None, :]] = -np.inf
        if len(x) > top:
            least = np.partition(s, len(x) - top, axis=1)[:, len(x) - top]
            slack = 1e-11 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            i, j = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        else:
            i, j = np.nonzero(s > -np.inf)
        exact = np.einsum("ij,ij->i", block[i], x[j])
        order = np.lexsort((rows[j], ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < top
        out.append((i[keep] + a, j[keep], exact[keep]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def _search(top: int, width: int):
    def matrix(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), dtype=f"<f{width}").reshape(len(column), -1).astype(np.float64)

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        q_rows, q_ids, rows, ids = q["row"].to_numpy(), q["vec_id"].to_numpy(), x["row"].to_numpy(), x["vec_id"].to_numpy()
        if len(q) and len(x):
            i, j, score = best_in_group(q_rows, matrix(q["v"]), rows, ids, matrix(x["v"]), top)
        else:
            i = j = np.zeros(0, np.int64)
            score = np.zeros(0)
        return pd.DataFrame({"query_row": q_rows[i], "query_id": q_ids[i], "row": rows[j], "vec_id": ids[j], "score": score})

    return run


def _true_neighbours(sample: list[tuple[np.ndarray, np.ndarray]], top: int):
    """The top rows of each sampled query among those of a task: (query_row, row, vec_id, score, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple | None] = [None] * len(sample)
        for batch in batches:
            row, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, x in _rows_of(batch, False):
                for k, (q_rows, q) in enumerate(sample):
                    if q.shape[1] != x.shape[1] or not len(at):
                        continue
                    i, j, score = best_in_group(q_rows, q, row[at], ids[at], x, top)
                    new = (i, row[at[j]], ids[at[j]], score, x[j])
                    if best[k]:
                        new = tuple(np.concatenate(c) for c in zip(best[k], new, strict=True))
                        order = np.lexsort((new[1], new[2], -new[3], new[0]))
                        first = new[0][order]
                        new = tuple(c[order[np.arange(len(order)) - np.searchsorted(first, first) < top]] for c in new)
                    best[k] = new
        for found, (q_rows, _) in zip(best, sample, strict=True):
            if found:
                raw = pa.array([v.tobytes() for v in found[4]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[found[0]]), *map(pa.array, found[1:4]), raw], ["query_row", "row", "vec_id", "score", "v"])

    return run


def fit_probes(table: DataFrame, top: int, space: Space) -> int:
    """The least number of probes that finds RECALL of the sampled queries' true neighbours; SAMPLE x top rows come to the driver."""
    picked = table.where("is_query").orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).toArrow()
    numbers = picked.column("row").to_numpy()
    sample = [(numbers[r], x) for r, x in vectors(picked.column("embedding"))] if picked.num_rows else []
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    found = table.mapInArrow(lean(_true_neighbours(sample, top)), "query_row long, row long, vec_id long, score double, v binary")
    true: dict[int, list[np.ndarray]] = {}
    for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).collect():
        true.setdefault(r["query_row"], []).append(np.frombuffer(r["v"]))
    needed: list[int] = []
    for q_rows, q in sample:
        unit, parts = space.units(q, True)
        for k, number in enumerate(q_rows.tolist()):
            if number in true:
                x, _ = space.units(np.array(true[number]), False)
                one, ranks = unit[k : k + 1], []
                for t in range(space.tables):
                    ranks.append(better_buckets(one, score_of(one, own_bucket(x, t, parts)[None, :], t, parts), t, parts)[0])
                needed += np.min(ranks, axis=0).tolist()
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1 if needed else 1


def nearest(
    rows: DataFrame, queries: Column | str | DataFrame, top: int = 20, tables: int = TABLES, probes: int | None = None, dimension: int = 0, bucket_rows: int = BUCKET_ROWS, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): each query's nearest rows that the index finds.

    queries: which of the rows search all the others (a condition), or vectors of their own (a table).
    query_row numbers the queries, for ids that repeat.
    """
    scratch = Scratch(rows.sparkSession, "nearest")
    own = isinstance(queries, DataFrame)
    flags = lambda df, row, query: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), row.alias("is_row"), F.coalesce(query, F.lit(False)).alias("is_query")).where("vec_id IS NOT NULL")
    if own:
        table = flags(rows, F.lit(True), F.lit(False)).unionByName(flags(queries, F.lit(False), F.lit(True)))
    else:
        table = flags(rows, F.lit(True), F.expr(queries) if isinstance(queries, str) else queries)
    table = scratch.keep(table.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")

    size = table.mapInArrow(lean(_lengths), "lo double, hi double, n long").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).first()
    longest = float(size["hi"]) if size["n"] and size["hi"] > 1.001 * size["lo"] else 0.0
    space = Space(longest, size["n"] or 0, dimension, tables, bucket_rows)
    probes = probes or fit_probes(table, top, space)
    searching = table.where("is_query")
    context = rows.sparkSession.sparkContext
    row_counts = context.broadcast(sketch.collect(table.mapInArrow(lean(_count_buckets(space, False, 1)), sketch.CHUNKS)))
    query_counts = context.broadcast(sketch.collect(searching.mapInArrow(lean(_count_buckets(space, True, probes)), sketch.CHUNKS)))

    schema = "bucket long, row_part int, query_part int, row long, vec_id long, v binary"
    meet = ["bucket", "row_part", "query_part"]
    index = table.mapInArrow(lean(_hashed(space, False, 1, row_counts, query_counts, HOT, HOT_QUERIES)), schema)
    probing = searching.mapInArrow(lean(_hashed(space, True, probes, row_counts, query_counts, HOT, HOT_QUERIES)), schema)
    width = 4 if table.schema["embedding"].dataType.elementType.simpleString() == "float" else 8
    found = probing.groupBy(*meet).cogroup(index.groupBy(*meet)).applyInPandas(_search(top, width), FOUND)
    # a pair that several tables find has the same score in all
    once = found.repartition("query_row").dropDuplicates(["query_row", "row"])
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    result = scratch.keep(best.select("query_id", "rank", "vec_id", "score", "query_row"), "result")
    scratch.drop("rows")
    return result

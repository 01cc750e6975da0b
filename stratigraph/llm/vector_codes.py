"""Vectors as short codes: codebooks of vector parts, made by filtering Lloyd rounds.

A vector's components become integers floor(1024 * x) and the vector is cut into PARTS equal parts. In
each partition the parts of up to CHUNK rows form a balanced kd-tree, written once to the shared folder: points
in tree order, so that a node is a run of equal length and its box, sum and count come from a reshape and are
kept for all nodes of a level at once. A round walks the levels down with the entries that are left in each node. An
entry goes when another one is nearer at every point of the node's box (for equal distances: has the
lower index); where a single entry is left the node's sum and count are added to it, and with them the
whole subtree is assigned; leaves compare their points with what is left. Boxes only ever save work: assignments are
those of comparing every part with every entry.

Everything is integers, held in doubles where all products are exact and in 64-bit integers beyond;
components too large for these raise an error (from about 2**28 for 16 components). Of each task at most one sum for each entry travels; codebooks
(256 entries for each part) go to the driver and to the tasks, at any number of rows.

Rows whose vector is null or holds null or non-finite components take no part. Vectors of another length than
that of the least vec_id's take no part either. If PARTS does not divide the length the last part
is filled with zeros. Null vec_ids come last in the order of vec_ids, equal ones are ordered by their vectors, and
rows that repeat are rows of their own. Fewer than 256 rows make smaller codebooks, an empty table gives no rows.
Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, lean

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CHUNK, LEAF = 4096, 16
PAIRS = 1 << 16
TREES = "vec_ids array<long>, labels array<long>, points array<binary>, orders array<binary>"


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): finite vectors as integers floor(scale * component)."""
    c = F.col("embedding")
    finite = c.isNotNull() & F.forall(c, lambda v: F.coalesce((v.cast("double") > float("-inf")) & (v.cast("double") < float("inf")), F.lit(False)))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return embeddings.where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))


def in_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width) of rows of components, zeros at the end if need be."""
    width = -(-x.shape[1] // parts)
    out = np.zeros((len(x), parts * width), dtype=np.int64)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, width)


def exact(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all sums of products are below 2**53, else as 64-bit integers."""
    most = max(max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in (points, entries))
    bound = 8 * max(1, points.shape[-1]) * (most + 1) ** 2
    if bound >= 2**62:
        raise ValueError(f"components of {most} are too large for exact distances")
    kind = np.float64 if bound < 2**52 else np.int64
    return points.astype(kind), entries.astype(kind)


def kd_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The order of a balanced kd-tree: nodes of a level are equal runs, cut at the median of their widest side.

    Its length is leaf times a power of two; places beyond the points are -1, at the end of each cut.
    """
    n = len(points)
    leaves = 1
    while leaves * leaf < n:
        leaves *= 2
    order = np.full((1, leaves * leaf), -1, dtype=np.int64)
    order[0, :n] = np.arange(n)
    while order.shape[0] < leaves:
        there = order >= 0
        p = points[order]
        low = np.where(there[..., None], p, np.iinfo(np.int64).max).min(1)
        high = np.where(there[..., None], p, np.iinfo(np.int64).min).max(1)
        side = np.where(there.any(1), (high.astype(float) - low).argmax(1), 0)
        keys = np.where(there, np.take_along_axis(p, side[:, None, None], 2)[..., 0], np.iinfo(np.int64).max)
        # a row's own places come last, so both halves of a full node are full
        order = np.take_along_axis(order, np.lexsort((~there, keys), axis=1), 1)
        order = order.reshape(order.shape[0] * 2, -1)
    return order.reshape(-1)


class Tree:
    """Boxes, sums and counts of all nodes, by level, of points in kd_order."""

    def __init__(self, points: np.ndarray, order: np.ndarray, leaf: int = LEAF):
        self.points, self.order, self.there = points[order], order, order >= 0
        n, leaves = len(order), len(order) // leaf
        big = np.iinfo(np.int64).max
        t = self.there[:, None]
        low = np.where(t, self.points, big).reshape(leaves, leaf, -1).min(1)
        high = np.where(t, self.points, -big).reshape(leaves, leaf, -1).max(1)
        total = np.where(t, self.points, 0).reshape(leaves, leaf, -1).sum(1)
        count = self.there.reshape(leaves, leaf).sum(1)
        self.levels = [(low, high, total, count)]
        while len(low) > 1:
            low, high = low.reshape(-1, 2, low.shape[1]).min(1), high.reshape(-1, 2, high.shape[1]).max(1)
            total, count = total.reshape(-1, 2, total.shape[1]).sum(1), count.reshape(-1, 2).sum(1)
            self.levels.insert(0, (low, high, total, count))
        self.leaf, self.n = leaf, n

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes of points in tree order, sums of entries, counts of entries); codes at empty places mean nothing."""
        k, width = entries.shape
        codes = np.zeros(self.n, dtype=np.int64)
        sums, counts = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        points, z = exact(self.points, entries)
        norm = (z * z).sum(1)
        nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        for depth, (low, high, total, count) in enumerate(self.levels):
            some = count[nodes] > 0
            nodes, left = nodes[some], left[some]
            if not len(nodes):
                break
            left = self._filtered(low[nodes].astype(z.dtype), high[nodes].astype(z.dtype), left, z, norm)
            single = left.sum(1) == 1
            if single.any():
                whole, entry = nodes[single], left[single].argmax(1)
                np.add.at(sums, entry, total[whole])
                np.add.at(counts, entry, count[whole])
                run = self.n >> depth
                codes.reshape(-1, run)[whole] = entry[:, None]
            nodes, left = nodes[~single], left[~single]
            if depth + 1 < len(self.levels):
                nodes, left = np.concatenate((2 * nodes, 2 * nodes + 1)), np.concatenate((left, left))
        for at in range(0, len(nodes), 256):  # leaves with several entries left
            leaf, alive = nodes[at : at + 256], left[at : at + 256]
            p = points.reshape(-1, self.leaf, width)[leaf]
            far = norm - 2 * (p @ z.T)
            limit = np.inf if far.dtype == np.float64 else np.iinfo(np.int64).max
            code = np.where(alive[:, None, :], far, limit).argmin(2)
            codes.reshape(-1, self.leaf)[leaf] = code
            there = self.there.reshape(-1, self.leaf)[leaf]
            np.add.at(sums, code[there], self.points.reshape(-1, self.leaf, width)[leaf][there])
            counts += np.bincount(code[there], minlength=k)
        return codes, sums, counts

    @staticmethod
    def _filtered(low: np.ndarray, high: np.ndarray, left: np.ndarray, z: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """left without the entries to which the one nearest the box's middle is preferred at every point of the box."""
        limit = np.inf if z.dtype == np.float64 else np.iinfo(np.int64).max
        best = np.where(left, norm - (low + high) @ z.T, limit).argmin(1)
        out = left.copy()
        node, entry = left.nonzero()
        for at in range(0, len(node), PAIRS):
            n, e = node[at : at + PAIRS], entry[at : at + PAIRS]
            b = best[n]
            u = z[b] - z[e]
            # d(best, p) - d(entry, p) = |best|^2 - |entry|^2 - 2 p (best - entry), at its largest corner of the box
            gain = norm[b] - norm[e] - 2 * (np.where(u > 0, low[n], high[n]) * u).sum(1)
            loses = (gain < 0) | ((gain == 0) & (b < e))
            loses &= b != e
            out[n[loses], e[loses]] = False
        return out


def stored(points: np.ndarray) -> np.ndarray:
    """With half the bytes where the numbers allow it."""
    small = -(2**31) <= points.min(initial=0) and points.max(initial=0) < 2**31
    return np.ascontiguousarray(points, dtype=np.int32 if small else np.int64)


def read(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int32 if len(data) == 4 * rows * width else np.int64).reshape(rows, width).astype(np.int64)


def _grow(width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows, n = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            x = in_parts(np.concatenate(rows), parts)
            orders = [kd_order(x[:, p]) for p in range(parts)]
            row = {"vec_ids": pa.concat_arrays(ids).to_pylist(), "labels": pa.concat_arrays(labels).to_pylist(), "points": [stored(x[:, p]).tobytes() for p in range(parts)], "orders": [o.astype(np.int32).tobytes() for o in orders]}
            kinds = pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("points", pa.list_(pa.binary())), ("orders", pa.list_(pa.binary()))])
            return pa.RecordBatch.from_pylist([row], kinds)

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                if n and n + some.num_rows > CHUNK:
                    yield chunk()
                    ids, labels, rows, n = [], [], [], 0
                x = some.column("x")
                ids.append(some.column("vec_id"))
                labels.append(some.column("label"))
                rows.append(x.flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, width))
                n += some.num_rows
        if n:
            yield chunk()

    return lean(run)


def _trees(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[dict, list[Tree]]]:
    for row in batch.to_pylist():
        yield row, [Tree(read(row["points"][p], len(row["vec_ids"]), width), np.frombuffer(row["orders"][p], dtype=np.int32)) for p in range(parts)]


def _round(codebooks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(c) for c in codebooks], [np.zeros(len(c), dtype=np.int64) for c in codebooks]
        for batch in batches:
            for _, trees in _trees(batch, len(codebooks), codebooks[0].shape[1]):
                for p, tree in enumerate(trees):
                    _, s, c = tree.assign(codebooks[p])
                    sums[p] += s
                    counts[p] += c
        for p in range(len(codebooks)):
            used = counts[p].nonzero()[0]
            arrays = [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[p][used], pa.int64())]
            names = ["part", "entry", "n"]
            for j in range(sums[p].shape[1]):
                arrays.append(pa.array(sums[p][used, j], pa.int64()))
                names.append(f"s{j}")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return lean(run)


def _codes(codebooks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, trees in _trees(batch, len(codebooks), codebooks[0].shape[1]):
                n = len(row["vec_ids"])
                codes, error = np.zeros((n, len(codebooks)), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for p, tree in enumerate(trees):
                    found = tree.assign(codebooks[p])[0][tree.there]
                    where = tree.order[tree.there]
                    codes[where, p] = found
                    error[where] += ((tree.points[tree.there] - codebooks[p][found]) ** 2).sum(1)
                text = [c.tobytes().hex() for c in codes]
                arrays = [pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array(text, pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "code", "error"])

    return lean(run)


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.reshape(-1).tolist()).encode()).hexdigest()


class VectorCodes:
    """Fitted codebooks with the trees of all rows; encode() gives a row of codes for each."""

    def __init__(self, embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
        if not 1 <= entries <= 256:
            raise ValueError("codes have one byte a part")
        rows = integer_vectors(embeddings, scale)
        order = [F.asc_nulls_last("vec_id"), F.asc("x")]
        first = rows.select("vec_id", "x").orderBy(*order).limit(1).collect()
        self.scratch, self.parts, self.rows = Scratch(embeddings.sparkSession, "codes"), parts, rows
        self.codebooks: list[np.ndarray] = []
        if not first or not first[0]["x"]:
            return
        width = len(first[0]["x"])
        rows = rows.where(F.size("x") == width)
        start = in_parts(np.array([r["x"] for r in rows.select("vec_id", "x").orderBy(*order).limit(entries).collect()], dtype=np.int64), parts)
        self.codebooks = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
        self.trees = self.scratch.keep(rows.mapInArrow(_grow(width, parts), TREES), "trees")
        for _ in range(rounds):
            self._improve()

    def _improve(self) -> None:
        """Every entry becomes the floor of the mean of its parts; entries without parts stay."""
        sides = [f"s{j}" for j in range(self.codebooks[0].shape[1])]
        schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sides)
        sums = self.trees.mapInArrow(_round(self.codebooks), schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sides)])
        after = [c.copy() for c in self.codebooks]
        for r in sums.collect():  # parts x entries rows at most
            after[r["part"]][r["entry"]] = [r[s] // r["n"] for s in sides]
        self.codebooks = after

    def encode(self) -> DataFrame:
        """(vec_id, label, code, error)."""
        schema = "vec_id long, label long, code string, error long"
        if not self.codebooks:
            return self.rows.where("false").selectExpr("vec_id", "label", "'' AS code", "0L AS error")
        return self.trees.mapInArrow(_codes(self.codebooks), schema)


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    fitted = VectorCodes(embeddings, parts, entries, rounds)
    rows = fitted.scratch.keep(fitted.encode(), "rows")
    fitted.scratch.drop("trees")
    sums = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    found = rows.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(fitted.codebooks)).alias("codebooks_sha256"))

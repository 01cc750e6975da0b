"""Whitened embeddings: projections on the principal components, each divided by its deviation.

A component c stands for the integer floor(1024 * c) + 100000; the offset goes out of n * x - sum, and so out of every
result, exactly, and is never added. Each partition keeps (count, exact sums, local mean, centred
scatter) of its vectors, block by block; two of these merge by Chan's formula, scatter + scatter + d d' * a * b / (a + b)
with d the difference of the means, in a tree reduction, so what travels is one matrix for each partition and the driver holds a
few of them, at any number of rows. Its eigenvectors are found on the driver. A second pass writes the whitened rows,
and a third one over what was written merges their covariance in the same way, which has to be the identity.

What is projected is (n * x - sum) / n with an exact numerator. Integers over 2**52 raise an error. Sums and squares are whole numbers of any size: what does not fit 64 bits in the
end, as the deviation of very many rows, is null.

Rows whose vector is null or holds null or non-finite entries take no part, nor do vectors of another length than
that of the least vec_id's (null ids last, equal ids by vector). Components whose eigenvalue is zero within the precision of the matrix
have a null whitened value and are left out of the identity's error; a table of equal rows has a null
explained share, and an empty one no rows. Rows that repeat are rows of their own. Other columns are not read, so
their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, lean
from .vector_codes import integer_vectors

SCALE, COMPONENTS = 1024, 8
BLOCK = 4096
#: integers up to here are doubles, and their differences exact
LARGEST = 2**52
MOMENTS = "n long, sums array<string>, mean binary, scatter binary"


class Moments(NamedTuple):
    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def moments(x: np.ndarray, sums: list[int] | None = None) -> Moments:
    """Of a block of rows; the mean is taken first and then the centred products."""
    mean = x.mean(0, dtype=np.float64)
    c = x - mean
    mean = mean + c.mean(0)
    c = x - mean
    return Moments(len(x), sums if sums is not None else [int(v) for v in x.sum(0)], mean, c.T @ c)


def merge(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's pairwise merge; None is that of no rows."""
    if a is None or b is None:
        return b if a is None else a
    n, d = a.n + b.n, b.mean - a.mean
    return Moments(n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], a.mean + d * (b.n / n), a.scatter + b.scatter + np.outer(d, d) * (a.n * b.n / n))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _moments(column: str, width: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(column), width)
            for at in range(0, len(x), BLOCK):
                block = x[at : at + BLOCK]
                if whole and max(block.max(initial=0), -block.min(initial=0)) > LARGEST:
                    raise ValueError("components are too large for exact sums")
                total = merge(total, moments(block, None if whole else []))
        if total is not None:
            row = [pa.array([total.n], pa.int64()), pa.array([[str(s) for s in total.sums]], pa.list_(pa.string())), pa.array([total.mean.tobytes()], pa.binary()), pa.array([total.scatter.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["n", "sums", "mean", "scatter"])

    return lean(run)


def all_moments(rows: DataFrame, column: str, width: int, whole: bool = True) -> Moments | None:
    """Moments of an array column over all rows, merged as a tree on the executors."""

    def read(r) -> Moments:
        return Moments(r["n"], [int(s) for s in r["sums"]], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(width, width))

    return rows.mapInArrow(_moments(column, width, whole), MOMENTS).rdd.map(read).treeAggregate(None, merge, merge)


class Whitening:
    """Fitted components of all vectors; whiten() gives a row for each of them."""

    def __init__(self, embeddings: DataFrame, components: int = COMPONENTS):
        rows = integer_vectors(embeddings, SCALE)
        first = rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), F.asc("x")).limit(1).collect()
        self.width = len(first[0]["x"]) if first else 0
        self.rows = rows.where(F.size("x") == self.width).select("vec_id", "x")
        self.fit = all_moments(self.rows, "x", self.width) if self.width else None
        self.values, self.vectors = np.zeros(0), np.zeros((self.width, 0))
        if self.fit is None:
            return
        v = self.fit.scatter / self.fit.n
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        vectors = vectors[:, ::-1][:, :components]
        self.values, self.trace = values[::-1][:components], float(np.trace(v))
        # an eigenvector's sign is free: its largest entry is made positive
        self.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        self.sure = self.values > 1e-12 * max(self.trace, 0.0)

    def whiten(self) -> DataFrame:
        """(vec_id, deviation, whitened): whitened has a component for each fitted one, NaN where its eigenvalue is zero."""
        n, sums, width = self.fit.n, self.fit.sums, self.width
        scaled = np.where(self.sure, self.vectors / np.sqrt(np.where(self.sure, self.values, 1.0)), np.nan)
        # n * x - sum in 64 bits where that is sure to fit
        small = n < 2**31 and all(abs(s) < 2**61 for s in sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = np.array(sums, dtype=np.int64 if small else object)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    some = batch.slice(at, BLOCK)
                    x = _matrix(some.column("x"), width)
                    if small and np.abs(x).max(initial=0) < 2**30:
                        far = n * x - of
                    else:
                        far = n * x.astype(object) - np.array(sums, dtype=object)
                    if far.dtype == object or int(np.abs(far).max(initial=0)) ** 2 * width >= 2**63:
                        wide = [sum(int(v) ** 2 for v in row) for row in far]
                        deviation = [v if v < 2**63 else None for v in wide]
                    else:
                        deviation = (far * far).sum(1)
                    white = (far.astype(np.float64) / n) @ scaled
                    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], pa.array(white.reshape(-1), pa.float64()))
                    yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

        return self.rows.mapInArrow(lean(run), "vec_id long, deviation long, whitened array<double>")

    def identity_error(self, white: DataFrame) -> float | None:
        """The largest absolute entry of the whitened rows' covariance minus the identity."""
        if not self.sure.any():
            return None
        found = all_moments(white.select("whitened"), "whitened", len(self.values), whole=False)
        off = np.abs(found.scatter / found.n - np.eye(len(self.values)))
        return float(off[np.ix_(self.sure, self.sure)].max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    model = Whitening(embeddings, components)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model.fit is None:
        return embeddings.sparkSession.createDataFrame([], kinds)
    white = Scratch(embeddings.sparkSession, "whitening").keep(model.whiten(), "rows")
    error = model.identity_error(white)
    shares = [float(e) / model.trace if model.trace > 0 else None for e in model.values]
    share = F.get(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("k"))
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "w"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.fit.n).cast("long").alias("n"), "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"), share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))

"""Exact nearest neighbours of 64-bit fingerprints by multi-index hashing.

Fingerprints are cut into parts of about log2(n) bits. Two at a distance of parts * (r + 1) - 1 or less agree in some part but for r
bits, so a search looks up its own parts with 0, 1, 2... bits flipped, and is certain of its k nearest when the k-th is
that near. Each pair is met once, in the part that agrees best, and only up to the distance at which a search has k items
already. Searches whose lookups would cost more than comparing them with all fingerprints are compared with all, in blocks, up to
the same distance. Equal fingerprints are one node with their number and their k + 1 least ids, so a fingerprint of a third of all items is
searched once.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed

#: flips that are looked up at once, and fingerprints of one side that a block compares
MOST_FLIPS, BLOCK = 20_000, 4096
#: fingerprints that are compared at the cost of one lookup, lookups made in one part, and a distance that all are within
COMPARED, LOOKUPS, ANY = 256, 1 << 21, 64
SALTS = 64


def _members(items: DataFrame, most: int) -> DataFrame:
    """(fp, id): the first ids of each fingerprint, found in parts first."""
    part = Window.partitionBy("fp", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    some = items.withColumn("k", F.row_number().over(part)).where(F.col("k") <= most)
    return some.withColumn("k", F.row_number().over(Window.partitionBy("fp").orderBy("id"))).where(F.col("k") <= most).select("fp", "id")


def _bounds(parts: int) -> list[int]:
    return [64 * i // parts for i in range(parts + 1)]


def _cut(fp: Column, parts: int) -> list[Column]:
    cuts = _bounds(parts)
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _values(fp: Column, parts: int) -> Column:
    return F.array(*_cut(fp, parts))


def _flips(parts: int, r: int) -> list[tuple[int, int]]:
    """(part, bits to flip) of all ways to flip r bits of a part."""
    cuts = _bounds(parts)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return [(p, signed(sum(1 << b for b in bits))) for p in range(parts) for bits in combinations(range(cuts[p + 1] - cuts[p]), r)]


def _nearest(candidates: DataFrame, k: int) -> DataFrame:
    """Of candidates (q, fp, n, d) those up to the distance at which a search has k items, all of that distance."""
    before = F.sum(F.col("n") - (F.col("d") == 0).cast("long")).over(Window.partitionBy("q").orderBy("d").rangeBetween(Window.unboundedPreceding, -1))
    return candidates.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k).select("q", "fp", "n", "d")


def _in_blocks(searches: DataFrame, nodes: DataFrame, total: int, k: int) -> DataFrame:
    """Searches (q, reach) against all fingerprints: each pair of blocks keeps what may be among the k nearest, within reach."""
    blocks = max(1, -(-total // BLOCK))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = searches.select("q", "reach", place("q").alias("row"), every.alias("column"))
    right = nodes.select("fp", "n", every.alias("row"), place("fp").alias("column"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        fps, n, out = b["fp"].to_numpy(), b["n"].to_numpy(), []
        for at in range(0, len(a) if len(b) else 0, 512):
            q, limit = a["q"].to_numpy()[at : at + 512], a["reach"].to_numpy()[at : at + 512].copy()
            d = np.bitwise_count(q.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :])
            far = np.nonzero(limit >= ANY)[0]  # without a distance yet: up to that of the block's own k-th item
            if len(far):
                order = np.argsort(d[far], axis=1, kind="stable")
                near = np.take_along_axis(d[far], order, 1)
                held = np.cumsum(n[order] - (near == 0), axis=1)
                limit[far] = np.where(held[:, -1] >= k, np.take_along_axis(near, np.minimum((held < k).sum(1), len(fps) - 1)[:, None], 1)[:, 0], ANY)
            row, column = np.nonzero(d <= limit.astype(np.uint8)[:, None])
            out.append(pd.DataFrame({"q": q[row], "fp": fps[column], "n": n[column], "d": d[row, column].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q", "fp", "n", "d")})

    return left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInPandas(run, "q long, fp long, n long, d long")


def looked_up(searches: DataFrame, index: DataFrame, parts: int, r: int) -> DataFrame:
    """(q, fp, n, d): what the lookups of searches (q, perhaps reach) with r flipped bits meet in the index (part, value, fp, n), up to the reach.

    Over all r a pair is met once: where its least distance in a part is r, in the first such part.
    """
    flips = searches.sparkSession.createDataFrame(_flips(parts, r), "part int, flip long")
    reach = F.col("reach") if "reach" in searches.columns else F.lit(ANY)
    probes = searches.crossJoin(F.broadcast(flips))  # MOST_FLIPS rows at most
    probes = probes.select("q", reach.cast("int").alias("reach"), "part", F.get(_values(F.col("q"), parts), F.col("part")).bitwiseXOR(F.col("flip")).alias("value"))
    unlike = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(True)
    for i, bits in enumerate(_cut(unlike, parts)):
        first = first & ((F.bit_count(bits) > r) | ((F.bit_count(bits) == r) & (F.col("part") <= i)))
    met = probes.join(index, ["part", "value"]).where((F.bit_count(unlike) <= F.col("reach")) & first)
    return met.select("q", "fp", "n", F.bit_count(unlike).cast("long").alias("d"))


def index_of(nodes: DataFrame, parts: int) -> DataFrame:
    return nodes.select("fp", "n", F.posexplode(_values(F.col("fp"), parts)).alias("part", "value"))


def parts_for(total: int) -> int:
    return max(1, min(16, round(64 / max(1.0, math.log2(total + 1)))))


def near_fingerprints(nodes: DataFrame, k: int) -> DataFrame:
    """(q, fp, n, d): for each fingerprint of nodes (fp, n items) the others up to the distance of its k-th item."""
    total = nodes.count()
    parts = parts_for(total)
    index = checkpointed(index_of(nodes, parts))
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    searches, found, out, r = nodes.select(F.col("fp").alias("q"), F.lit(ANY).cast("long").alias("reach")), None, [], 0
    while True:
        ways = sum(math.comb(b - a, r) for a, b in zip(_bounds(parts), _bounds(parts)[1:], strict=False))
        if ways > min(MOST_FLIPS, total // COMPARED):
            out.append(_nearest(_in_blocks(searches, nodes, total, k), k))
            break
        met = looked_up(searches.repartition(max(cores, total * ways // LOOKUPS), "q"), index, parts, r)
        found = checkpointed(_nearest(met if found is None else met.unionByName(found), k))
        whole = found.groupBy("q").agg(F.sum(F.col("n") - (F.col("d") == 0).cast("long")).alias("items"), F.max("d").alias("far")).where(F.col("items") >= k)
        searches = checkpointed(searches.select("q").join(whole, "q", "left").select("q", F.coalesce("far", F.lit(ANY)).alias("reach")))
        certain = F.col("reach") <= parts * (r + 1) - 1
        sure, searches = searches.where(certain).select("q"), searches.where(~certain)
        out.append(found.join(sure, "q", "left_semi"))
        found = found.join(sure, "q", "left_anti")
        if not searches.limit(1).count():
            break
        r += 1
    near = out[0]
    for df in out[1:]:
        near = near.unionByName(df)
    return near


def nearest_fingerprints(prints: DataFrame, k: int = 32, most_pairs: int | None = None) -> DataFrame:
    """(left_id, right_id, distance): each item's k nearest by Hamming distance, ties to smaller ids, as unordered pairs; then the first most_pairs in order of discovery."""
    if not 1 <= k <= 256:
        raise ValueError("k out of bounds")
    items = checkpointed(prints.select("id", "fp"))
    nodes = checkpointed(items.groupBy("fp").agg(F.count("*").alias("n")))
    near = near_fingerprints(nodes, k)
    members = _members(items, k + 1)
    first = Window.partitionBy("q").orderBy("d", "id")
    lists = near.join(members, "fp").withColumn("k", F.row_number().over(first)).where(F.col("k") <= k + 1)
    lists = checkpointed(lists.select(F.col("q").alias("fp"), F.col("id").alias("other"), F.col("d").alias("distance")))
    each = items.join(lists, "fp").where("id != other")
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))).where(F.col("rank") <= k)
    pairs = best.groupBy(F.least("id", "other").alias("left_id"), F.greatest("id", "other").alias("right_id")).agg(F.min("distance").alias("distance"), F.min(F.struct("id", "rank")).alias("first"))
    if most_pairs is not None:
        pairs = pairs.orderBy("first").limit(most_pairs)
    return pairs.select("left_id", "right_id", "distance")

"""Nearest fingerprints against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from stratigraph.operators import hamming


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def near_by(g, n, spread, centres=12):
    of = [g.getrandbits(64) for _ in range(centres)]
    return [(f"i{k:05}", signed(g.choice(of) ^ sum(1 << b for b in g.sample(range(64), g.randrange(spread + 1))))) for k in range(n)]


def plain(items, k):
    pairs = {}
    for a, x in items:
        others = sorted((((x ^ y) & (2**64 - 1)).bit_count(), b) for b, y in items if b != a)
        for d, b in others[:k]:
            pairs[min(a, b), max(a, b)] = d
    return pairs


@pytest.mark.parametrize("n,spread,k", [(300, 4, 5), (250, 30, 8), (200, 0, 3), (3, 9, 8), (1, 0, 2)], ids=["near", "random", "equal", "few", "one"])
def test_as_all_pairs(spark, n, spread, k):
    items = near_by(random.Random(n), n, spread) + [(f"same{i}", 5) for i in range(20 if n > 3 else 0)]
    df = spark.createDataFrame(items, "id string, fp long")
    got = {(r.left_id, r.right_id): r.distance for r in hamming.nearest_fingerprints(df, k).collect()}
    assert got == plain(items, k)


def test_blocks_alone_are_exact(spark, monkeypatch):
    monkeypatch.setattr(hamming, "MOST_FLIPS", 0)
    items = near_by(random.Random(2), 150, 9)
    got = {(r.left_id, r.right_id): r.distance for r in hamming.nearest_fingerprints(spark.createDataFrame(items, "id string, fp long"), 4).collect()}
    assert got == plain(items, 4)


def test_share_of_compared_pairs_falls(spark):
    share = []
    for n in (500, 4000):
        items = near_by(random.Random(n), n, 3, centres=n // 20)
        nodes = spark.createDataFrame(items, "id string, fp long").groupBy("fp").agg(F.count("*").alias("n"))
        parts = hamming.parts_for(n)
        index = hamming.index_of(nodes, parts)
        searches = nodes.select(F.col("fp").alias("q"))
        met = sum(hamming.looked_up(searches, index, parts, r).count() for r in (0, 1))
        share.append(met / nodes.count() ** 2)
    assert share[1] < 0.3 * share[0] and share[1] < 0.05


def test_pairs_are_met_once_and_within_reach(spark, monkeypatch):
    monkeypatch.setattr(hamming, "COMPARED", 1)  # lookups as long as they are fewer than fingerprints
    items = near_by(random.Random(7), 400, 5)
    df = spark.createDataFrame(items, "id string, fp long")
    nodes = df.groupBy("fp").agg(F.count("*").alias("n"))
    index = hamming.index_of(nodes, 5)
    searches = nodes.select(F.col("fp").alias("q"))
    met = [r for k in (0, 1, 2) for r in hamming.looked_up(searches, index, 5, k).collect()]
    assert len({(r.q, r.fp) for r in met}) == len(met)
    cut = lambda v: [(v & (2**64 - 1)) >> (64 * i // 5) & ((1 << 64 * (i + 1) // 5 - 64 * i // 5) - 1) for i in range(5)]
    fps = {f for _, f in items}
    assert {(r.q, r.fp) for r in met} == {(a, b) for a in fps for b in fps if min((x ^ y).bit_count() for x, y in zip(cut(a), cut(b), strict=True)) <= 2}
    near = hamming.looked_up(searches.withColumn("reach", F.lit(3)), index, 5, 0).collect()
    assert near and max(r.d for r in near) <= 3
    got = {(r.left_id, r.right_id): r.distance for r in hamming.nearest_fingerprints(df, 6).collect()}
    assert got == plain(items, 6)

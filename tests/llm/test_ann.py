import numpy as np
import pytest

from pyspark.sql import functions as F

from stratigraph.llm.cross_polytope import better_buckets, hadamard, nearest, own_bucket, padded, probed, score_of, widths

from ..conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, top=20):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = {}
    for q, v in fine:
        if q % 20 == 0:
            s = sorted((-float(np.einsum("i,i->", v, x)), i) for i, x in fine if i != q and len(x) == len(v))
            want.setdefault(q, s[:top])
    return want


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in nearest(df, "vec_id % 20 = 0", **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute(rows), run(spark, rows)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vector = dict(rows)
    for q, found in got.items():
        assert [k for k, _, _ in found] == list(range(1, len(found) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(float(np.dot(np.array(vector[q], np.float64), np.array(vector[i], np.float64))), abs=1e-12)


def test_awkward_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 0.0]
    rows = [(0, same), (20, None), (40, [0.0, 0.0, 0.0]), (60, [nan, 1.0, 1.0]), (80, [inf, 1.0, 1.0]), (100, [1.0]), (120, []), (140, [None, 1.0, 2.0])]
    rows += [(k, same) for k in range(1, 60, 2)] + [(61, [5.0, 10.0, 0.0]), (63, [-1.0, -2.0, 0.0]), (62, [3.0, 4.0])]
    got = run(spark, rows, probes=99)
    assert [i for _, i, _ in got[0]] == [61, *range(1, 39, 2)]
    assert set(got) == {0}
    assert run(spark, []) == {}


def test_hot_buckets_are_split(spark, monkeypatch):
    import stratigraph.llm.cross_polytope as module

    monkeypatch.setattr(module, "HOT", 16)
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in (rng.normal(size=8) if k % 2 else np.ones(8) + rng.normal(size=8) * 1e-3)]) for k in range(400)]
    want, got = brute(rows, 5), run(spark, rows, top=5, probes=99)
    assert {q: [i for _, i in w] for q, w in want.items()} == {q: [i for _, i, _ in g] for q, g in got.items()}


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("row", F.lit("clash")).withColumn("rank", F.lit("clash"))
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, probes=99).orderBy("query_row", "rank").collect():
        got.setdefault(r.query_row, []).append(r.vec_id)
    assert sorted(got.values()) == [[1, 1, 2, 20], [2, 1, 1, 20]]


def test_queries_from_another_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], SCHEMA)
    got = nearest(df, spark.createDataFrame([(1, [1.0, 0.2], 0)], SCHEMA), probes=99).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(1, 1), (1, 2)]


def test_hot_queries_are_split(spark, monkeypatch):
    import stratigraph.llm.cross_polytope as module

    monkeypatch.setattr(module, "HOT", 16)
    monkeypatch.setattr(module, "HOT_QUERIES", 4)
    rng = np.random.default_rng(2)
    rows = [(20 * k, [float(x) for x in np.ones(4) + rng.normal(size=4) * 1e-3]) for k in range(150)]
    want, got = brute(rows, 5), run(spark, rows, top=5, probes=99)
    assert {q: [i for _, i in w] for q, w in want.items()} == {q: [i for _, i, _ in g] for q, g in got.items()}


def test_buckets_grow_with_the_rows_and_less_is_compared():
    assert widths(64, 51_282) == [64] and widths(64, 500) == [64] and widths(64, 1 << 20) == [64, 16] and widths(64, 1 << 40)[:2] == [64, 64]
    rng, shares = np.random.default_rng(3), []
    for n in (2_000, 32_000):
        centres = rng.normal(size=(n // 40, 32))
        x = padded(np.repeat(centres, 40, axis=0) + 0.9 * rng.normal(size=(n // 40 * 40, 32)), 0.0, False, 0)
        q = rng.choice(len(x), 100, replace=False)
        s = x[q] @ x.T
        s[np.arange(100), q] = -1
        true, parts = np.argsort(-s, axis=1)[:, :20], widths(32, n, 32)
        own = [own_bucket(x, t, parts) for t in range(4)]
        rank = np.min([better_buckets(x[q], score_of(x[q], own[t][true], t, parts), t, parts) for t in range(4)], axis=0)
        probes = int(np.quantile(rank, 0.95)) + 1
        seen = np.zeros((100, len(x)), bool)
        for t in range(4):
            for k, near in enumerate(probed(x[q], t, parts, probes)):
                seen[k] |= np.isin(own[t], near)
        assert np.take_along_axis(seen, true, 1).mean() >= 0.9
        shares.append(seen.mean())
    assert shares[1] < 0.7 * shares[0]


def test_probes_are_the_best_buckets():
    x = padded(np.random.default_rng(6).normal(size=(20, 8)), 0.0, True, 0)
    parts = [8, 8, 2]
    every = np.tile(np.arange(16 * 16 * 4), (20, 1))
    scores = score_of(x, every, 1, parts)
    got = probed(x, 1, parts, 37)
    assert np.allclose(np.sort(np.take_along_axis(scores, got, 1), axis=1), np.sort(scores, axis=1)[:, -37:])
    assert (better_buckets(x, scores[:, :50], 1, parts) == (scores[:, None, :] > scores[:, :50, None] + 1e-12).sum(axis=2)).all()
    assert (score_of(x, own_bucket(x, 1, parts)[:, None], 1, parts)[:, 0] >= scores.max(axis=1) - 1e-9).all()

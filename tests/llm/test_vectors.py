"""Vector codes and whitening against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from stratigraph.llm.vector_codes import Tree, VectorCodes, compressed, exact, kd_order
from stratigraph.llm.whitening import Whitening, merge, moments, whitened

KINDS = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, KINDS)


def finite(rows):
    return [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]


def order(r):
    return (r[0] is None, r[0] or 0, r[2])


def lloyd(rows, parts=4, entries=256, rounds=4):
    """[(vec_id, code, error, label_error)], digest."""
    kept = sorted([(r[0], r[2], [math.floor(1024 * float(np.float32(v))) for v in r[1]]) for r in finite(rows)], key=order)
    if not kept:
        return [], None
    x = np.array([r[2] for r in kept]).reshape(len(kept), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]

    def codes(p):
        return ((x[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1)

    for _ in range(rounds):
        for p in range(parts):
            c = codes(p)
            for e in set(c.tolist()):
                mine = x[c == e, p]
                books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    all_codes = np.stack([codes(p) for p in range(parts)], 1)
    error = sum(((x[:, p] - books[p][all_codes[:, p]]) ** 2).sum(1) for p in range(parts))
    of = {}
    for r, e in zip(kept, error, strict=True):
        of[r[1]] = of.get(r[1], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{v:02x}" for v in c), int(e), of[r[1]]) for r, c, e in zip(kept, all_codes, error, strict=True)], key=str), digest


def vectors(n, d=16, seed=1, spread=1.0, centres=9):
    g = np.random.default_rng(seed)
    c = g.normal(size=(centres, d))
    return [(i, [float(v) for v in (c[g.integers(centres)] + spread * g.normal(size=d)).astype(np.float32)], int(g.integers(4)) if i % 7 else None) for i in range(n)]


BAD = [(-5, None, 1), (-6, [float("nan")] * 16, 1), (-7, [1.0] * 15 + [None], None), (-8, [float("inf")] + [0.0] * 15, 2), (-9, [-float("inf")] * 16, 2)]


@pytest.mark.parametrize("rows", [vectors(1500), vectors(700, spread=0.01) + BAD, vectors(300, spread=0) + BAD, vectors(40) * 3 + BAD, [(None, [0.5] * 16, None)] * 5 + vectors(30)], ids=["plain", "bad rows", "ties", "repeated", "no ids"])
def test_codes_as_plain(spark, rows):
    want, digest = lloyd(rows)
    got = compressed(table(spark, rows).repartition(3)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_nothing_and_clashing_columns(spark):
    assert compressed(table(spark, [])).collect() == [] and compressed(table(spark, BAD)).collect() == []
    rows = vectors(200)
    extra = table(spark, rows).selectExpr("*", "1 AS x", "2 AS code", "3 AS error", "4 AS of_label", "5 AS points")
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in compressed(extra).collect()), key=str) == lloyd(rows)[0]


@pytest.mark.parametrize("n,d,k,spread", [(1, 3, 2, 50), (17, 1, 5, 3), (500, 4, 40, 3), (3000, 16, 256, 200), (800, 2, 64, 8)])
def test_filtering_is_comparing_all(n, d, k, spread):
    g = np.random.default_rng(n)
    points, entries = g.integers(-spread, spread, (n, d)), g.integers(-spread, spread, (k, d))
    tree = Tree(points, kd_order(points))
    codes, sums, counts = tree.assign(entries)
    want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    got = np.empty(n, dtype=int)
    got[tree.order[tree.there]] = codes[tree.there]
    assert (got == want).all()
    assert (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[e] == points[want == e].sum(0)).all() for e in range(k))


def test_boxes_save_comparisons():
    """Clustered points: whole subtrees are assigned, and leaves have few entries left."""
    g = np.random.default_rng(3)
    centres = g.integers(-4000, 4000, (64, 4))
    points = centres[g.integers(64, size=4096)] + g.integers(-40, 40, (4096, 4))
    tree = Tree(points, kd_order(points))
    seen = []
    plain = Tree._filtered

    def counting(low, high, left, z, norm):
        seen.append(int(left.sum()))
        return plain(low, high, left, z, norm)

    Tree._filtered = staticmethod(counting)
    try:
        tree.assign(centres)
    finally:
        Tree._filtered = staticmethod(plain)
    assert sum(seen) < 0.2 * 4096 * 64


def test_large_components(spark):
    rows = [(i, [float((-1) ** i * 1e4 * (j + i))for j in range(8)], 0) for i in range(30)]
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in compressed(table(spark, rows), entries=256).collect()), key=str) == lloyd(rows)[0]
    assert exact(np.array([[2**27]]), np.array([[1]]))[0].dtype == np.int64
    with pytest.raises(ValueError):
        exact(np.array([[2**40]]), np.array([[1]]))


def test_rounds_lower_the_error(spark):
    df = table(spark, vectors(2000))
    assert VectorCodes(df, entries=32, rounds=6).encode().agg({"error": "sum"}).first()[0] < VectorCodes(df, entries=32, rounds=0).encode().agg({"error": "sum"}).first()[0]


def check_whitening(spark, rows, parts=3):
    kept = finite(rows)
    x = np.array([[math.floor(1024 * float(np.float32(v))) + 100_000 for v in r[1]] for r in kept], dtype=np.int64)
    n, s = len(x), x.sum(0)
    deviation = sorted((str(r[0]), int(sum(int(v) ** 2 for v in n * row - s))) for r, row in zip(kept, x, strict=True))
    got = whitened(table(spark, rows).repartition(parts)).collect()
    c = x - s / n
    cov = c.T @ c / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:8], vecs[:, ::-1][:, :8]
    assert len(got) == n * len(values)
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == deviation
    assert {r["n"] for r in got} == {n}
    for k in range(len(values)):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        assert all(abs(r["explained"] - values[k] / np.trace(cov)) <= 1e-9 for r in mine.values())
        want = c @ vecs[:, k] / np.sqrt(values[k])
        have = np.array([mine[r[0]]["whitened"] for r in kept])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert all(r["identity_error"] < 1e-9 for r in mine.values())


def test_whitening_as_plain(spark):
    check_whitening(spark, vectors(1200, d=16) + BAD)
    check_whitening(spark, vectors(300, d=5), parts=7)


def test_whitening_of_little(spark):
    assert whitened(table(spark, [])).collect() == [] and whitened(table(spark, BAD)).collect() == []
    one = whitened(table(spark, [(1, [1.0, 2.0], 0)] * 4)).collect()
    assert len(one) == 8 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    line = whitened(table(spark, [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and max(r["identity_error"] for r in line) < 1e-12
    assert abs(next(r["explained"] for r in line if r["component"] == 1) - 1) < 1e-12
    extra = table(spark, vectors(50)).selectExpr("*", "1 AS x", "2 AS n", "3 AS whitened", "4 AS k")
    assert whitened(extra).count() == 400


def test_merge_is_that_of_all():
    g = np.random.default_rng(2)
    x = g.integers(-500, 500, (1000, 6)) + 10**6
    parts = np.array_split(x, [1, 2, 400, 400, 999])
    total = None
    for p in parts:
        total = merge(total, moments(p) if len(p) else None)
    c = x - x.mean(0)
    assert total.n == 1000 and total.sums == x.sum(0).tolist()
    assert np.allclose(total.scatter, c.T @ c, rtol=1e-11) and np.allclose(total.mean, x.mean(0), rtol=1e-14)


def test_whitening_is_one_pass_of_moments(spark):
    model = Whitening(table(spark, vectors(400)).repartition(40))
    assert model.fit.n == 400 and len(model.values) == 8 and (np.diff(model.values) <= 0).all()

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratigraph.llm import passages as module
from stratigraph.llm.passages import align, chains, cut_repeats, repeated_passages, seed_places, segments

from . import common


def planted(seed):
    """(rows, {doc_id: (first, last) of its planted passage}, first holders)."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(10**6)}"
    line = " ".join(word() for _ in range(12))
    rows, spans, first = [], {}, set()
    for p in range(8):
        passage = [word() for _ in range(rng.randrange(55, 140))]
        for c in range(rng.randrange(2, 7)):
            copy = list(passage)
            if c and p % 2:
                for _ in range(len(copy) // 25):
                    copy[rng.randrange(8, len(copy) - 8)] = word()
            before = line.split() + [word() for _ in range(rng.randrange(0, 200))]
            i = len(rows)
            rows.append((i, " ".join(before + copy + [word() for _ in range(rng.randrange(0, 200))]), "", "", 0))
            if c:
                spans[i] = (len(before), len(before) + len(copy) - 1)
            else:
                first.add(i)
    for _ in range(20):
        rows.append((len(rows), line + " " + " ".join(word() for _ in range(rng.randrange(10, 300))), "", "", 0))
    return rows, spans, first


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed):
    rows, spans, first = planted(seed)
    got = repeated_passages(common.docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(spans) and {r.source_doc_id for r in got} <= set(spans) | first
    for r in got:
        a, b = spans[r.doc_id]
        assert abs(r.first_word - a) <= 12 and abs(r.last_word - b) <= 12  # the shared line stands in front of some


def test_awkward_rows(spark):
    got = [(r.doc_id, r.n_words, r.source_doc_id, r.whole) for r in repeated_passages(common.docs(spark)).collect()]
    assert got == [(9, 30_001, 8, False)] or got == [(9, 30_000, 8, False)]
    assert repeated_passages(common.docs(spark, [])).count() == 0
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(5, text, "", "", 0), (3, text.upper() + "!", "", "", 0), (4, "x " + text, "", "", 0), (6, " ".join(text.split()[:49]), "", "", 0)]
    found = {(r.doc_id, r.n_words, r.source_doc_id, r.whole) for r in repeated_passages(common.docs(spark, rows)).collect()}
    assert found == {(5, 60, 3, True), (4, 60, 3, False)}


def test_parts_of_a_passage_in_several_owners(spark):
    p = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(p[:42]) + " end one", "", "", 0), (2, "start " + " ".join(p), "", "", 0), (3, "other " + " ".join(p) + " tail", "", "", 0)]
    assert {(r.doc_id, r.n_words) for r in repeated_passages(common.docs(spark, rows)).collect()} >= {(3, 60)}


def test_cut(spark):
    rows, spans, _ = planted(3)
    docs = common.docs(spark, rows + [(900, rows[0][1], "", "", 0), (None, "no id", "", "", 0), (901, None, "", "", 0)]).withColumn("fp", F.lit("clash"))
    out = cut_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert 900 not in got and got[None] == "no id" and got[901] is None
    for i, text, *_ in rows:
        if i in spans:
            assert len(got[i].split()) <= len(text.split()) - (spans[i][1] - spans[i][0]) + 12
        else:
            assert got[i] == text
    assert repeated_passages(spark.createDataFrame([(k, v) for k, v in got.items()], "doc_id long, text string")).count() == 0


def brute_chain(rows):
    """Best chain score by trying all predecessors."""
    score = []
    for i, (x, y, n) in enumerate(rows.tolist()):
        best = 0.0
        for j, (a, b, m) in enumerate(rows[:i].tolist()):
            if a + m <= x + module.K - 1 and b + m <= y + module.K - 1 and x - a - m <= module.GAP and y - b - m <= module.GAP:
                best = max(best, score[j] - module.GAP_COST * (x - a - m + y - b - m))
        score.append(n + best)
    return max(score)


def test_chaining():
    rng = np.random.default_rng(4)
    for _ in range(100):
        pos = np.sort(rng.choice(60, 8, replace=False))
        rows = segments(pos, np.maximum(0, pos + rng.integers(-3, 4, 8)))
        found = chains(rows)
        assert sorted(i for c in found for i in c) == list(range(len(rows)))
        best = rows[found[0]]
        assert (np.diff(best[:, 0]) >= 0).all() and (np.diff(best[:, 1] + best[:, 2]) >= -module.K).all()
        total = best[:, 2].sum() - module.GAP_COST * sum(best[k + 1, 0] - best[k, 0] - best[k, 2] + best[k + 1, 1] - best[k, 1] - best[k, 2] for k in range(len(best) - 1))
        assert abs(total - brute_chain(rows)) < 1e-9


def test_fenwick_tree_is_the_maximum_of_a_range():
    rng = np.random.default_rng(3)
    tree, own = module.Fenwick(23), [module.Fenwick.NONE] * 24
    for k in range(2000):
        at = int(rng.integers(1, 24))
        own[at] = module.Fenwick.NONE if rng.random() < 0.3 else (float(rng.integers(50)), k)
        tree.put(at, own[at])
        first, last = sorted(rng.integers(1, 24, 2).tolist())
        assert tree.best(first, last) == max(own[first : last + 1])


def test_align_finds_ends_and_edits():
    a = np.arange(100, 200, dtype=np.uint32)
    b = np.concatenate((np.arange(5, dtype=np.uint32), a[10:40], np.array([7, 8], np.uint32), a[41:90]))
    assert align(a, b, np.array([[20, 15, 6], [60, 56, 8]])) == (10, 90, 5, 86, 79)


def test_seeds_are_minimizers():
    g = np.random.default_rng(1).integers(0, 2**60, 500).astype(np.uint64)
    want = sorted({i + int(g[i : i + module.W].argmin()) for i in range(501 - module.W)})
    assert seed_places(g).tolist() == want


def spans_of(spark, rows):
    return {(r.doc_id, r.first_word, r.last_word) for r in repeated_passages(common.docs(spark, [(i, t, "", "", 0) for i, t in rows])).collect()}


def test_every_occurrence_is_found(spark):
    p, u = [f"p{i}" for i in range(60)], [[f"u{k}x{i}" for i in range(80)] for k in range(6)]
    lines = [[f"l{k}x{i}" for i in range(20)] for k in range(5)]
    text = lambda *parts: " ".join(w for part in parts for w in part)
    rows = [
        (1, text(u[0], p, u[1])),
        (2, text(u[2], p, u[3], p, u[4])),  # twice what the owner holds once
        (3, text(u[5][:40], p[:30], u[5][40:], p)),  # a part first, then the whole
        (4, text(*lines, ["between"] * 3, *lines[::-1])),
        (5, text(["new"] * 3, *lines[::-1], ["end"])),  # the owner's second order of repeated lines
    ]
    assert spans_of(spark, rows) == {(2, 80, 139), (2, 220, 279), (3, 110, 169), (5, 3, 102)}


def test_repeated_lines_stay_linear():
    q = [np.arange(0, 18 * 3000, 18)] * 3000
    assert module.follow(np.arange(0, 18 * 3000, 18), q).shape == (3000,)
    step = module.K + module.W  # matches as far apart as a run allows
    p = 5 + step * np.arange(3)
    assert module.follow(p, [np.array([1, 50, 90]), np.array([10, 50 + step]), np.array([50 + 2 * step])]).tolist() == (p + 45).tolist()


def test_exact_passage_between_sparse_phrases():
    w = lambda c, n: [hash((c, i)) % 2**32 for i in range(n)]
    one, p, two = w("one", 6), w("p", 52), w("two", 6)
    a = np.array(w("a", 60) + one + w("b", 20) + p + w("c", 20) + two + w("d", 60), np.uint32)
    b = np.array(w("e", 60) + one + w("f", 20) + p + w("g", 20) + two + w("h", 60), np.uint32)
    segs = np.array([[60, 60, 6], [86, 86, 52], [158, 158, 6]])
    assert chains(segs) == [[0, 1, 2]]
    assert (86, 138, 86, 138, 52) in module.local_pieces(a, b, segs)
    assert all(module._like(x) for x in module.local_pieces(a, b, segs))


def test_best_predecessor_within_reach():
    jump = [(0, 0, 150)] + [(150 + 18 * k, 1000 + 19 * k, 12) for k in range(6)]
    assert chains(np.array(jump)) == [[0], [1, 2, 3, 4, 5, 6]]
    rng = np.random.default_rng(7)
    for _ in range(300):
        pos = np.sort(rng.choice(200, 20, replace=False))
        rows = segments(pos, np.maximum(0, pos + rng.choice([0, 0, 3, 60, 150], 20)))
        best = rows[chains(rows)[0]]
        total = best[:, 2].sum() - module.GAP_COST * sum(best[1:, 0] - best[:-1, 0] - best[:-1, 2] + best[1:, 1] - best[:-1, 1] - best[:-1, 2])
        assert abs(total - brute_chain(rows)) < 1e-9


@pytest.mark.parametrize("edits", [(10,), (13, 36), (10, 41)])
def test_edits_near_the_ends_of_a_passage(spark, edits):
    rows = []
    for k in range(20):
        p = [f"p{k}x{i}" for i in range(52)]
        copy = [f"new{k}x{i}" if i in edits else w for i, w in enumerate(p)]
        for i, words in ((k, p), (100 + k, copy)):
            rows.append((i, " ".join([f"a{i}x{j}" for j in range(70)] + words + [f"z{i}x{j}" for j in range(70)])))
    assert spans_of(spark, rows) == {(100 + k, 70, 121) for k in range(20)}


def edited(g, words, rate, name):
    """(words with edits, share of equal words): replaced, left out and put in."""
    out, equal = [], 0
    for i, w in enumerate(words):
        x = g.random()
        if x < 0.7 * rate:
            out.append(f"e{name}x{i}")
        elif x >= 0.85 * rate:
            out += [w, f"i{name}x{i}"] if x < rate else [w]
            equal += 1
    return out, equal / max(len(words), len(out))


@pytest.mark.parametrize("rate,least", [(0.08, 0.94), (0.12, 0.88), (0.15, 0.8)])
def test_recall_of_edited_passages(spark, rate, least):
    """Of passages down to 75 % of equal words, the share of words that the whole operator finds, and nothing beside them."""
    g, rows, planted = random.Random(int(100 * rate)), [], []
    for k in range(60):
        p = [f"p{k}x{i}" for i in range(g.randrange(60, 121))]
        copy, like = edited(g, p, rate, k)
        fill = lambda c, n, k=k: [f"{c}{k}x{j}" for j in range(n)]
        rows += [(k, " ".join(fill("a", 70) + p + fill("b", 50))), (1000 + k, " ".join(fill("c", 60) + copy + fill("d", 80)))]
        if like >= 0.75:
            planted.append((1000 + k, 60, 59 + len(copy)))
    got = {}
    for i, a, b in spans_of(spark, rows):
        got.setdefault(i, []).append((a, b))
    found = sum(max(0, min(z, b) - max(y, a) + 1) for i, y, z in planted for a, b in got.get(i, []))
    assert found >= least * sum(z - y + 1 for _, y, z in planted)
    assert sum(b - a + 1 for i, _, _ in planted for a, b in got.get(i, [])) == found


def test_long_run_of_a_word_behind_a_short_one(spark):
    fill = lambda c: [f"{c}{i}" for i in range(70)]
    rows = [(k, " ".join(fill(f"a{k}x") + ["pour"] * n + fill(f"z{k}x"))) for k, n in ((1, 16), (2, 60), (3, 60))]
    assert (3, 70, 129) in spans_of(spark, rows)

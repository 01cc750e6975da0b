"""Clone ranges against a plain search, and what they lead to."""

import collections
import random
import re

import numpy as np
import pytest

from stratigraph.operators import clones, similarity

TOKEN = re.compile(r"[^\x20\x09-\x0d]+")


def plain(files, w, least):
    """[(path, lines, path, lines, tokens)] by windows of token lists."""
    tokens = {p: [(m.group(), 1 + t.count("\n", 0, m.start())) for m in TOKEN.finditer(t or "")] for p, t in files}
    first, met = {}, collections.defaultdict(list)
    places = sorted((p, i) for p, t in tokens.items() for i in range(len(t) - w + 1))
    for p, i in places:
        key = tuple(x for x, _ in tokens[p][i : i + w])
        q, j = first.setdefault(key, (p, i))
        if (q, j) != (p, i) and (q != p or i - j >= w):
            met[q, p, i - j].append(i)
    out = []
    for (q, p, d), at in met.items():
        at.sort()
        runs = np.split(np.array(at), np.flatnonzero(np.diff(at) != 1) + 1)
        for run in runs:
            a, b = run[0], run[-1] + w - 1
            sides = [(f, tokens[f][x][1], tokens[f][y][1]) for f, x, y in ((q, a - d, b - d), (p, a, b))]
            if min(s[2] - s[1] for s in sides) >= least:
                out.append((*sides[0], *sides[1], int(b - a + 1)))
    return sorted(out)


def found(df):
    return sorted((r.first.path, r.first.start_line, r.first.end_line, r.second.path, r.second.start_line, r.second.end_line, r.tokens) for r in df.collect())


def text(g, n):
    return "".join(g.choice(["foo", "bar", "baz", "é", "x1", "y_2", "(", ")"]) + str(g.randrange(9)) + g.choice([" ", " ", "\t", "\n", " \n\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_as_plain(spark, seed):
    g = random.Random(seed)
    blocks = [text(g, 60) for _ in range(4)]
    files = [(f"f{i:02}", "".join(text(g, 25) + g.choice(blocks) for _ in range(3)) + text(g, 20)) for i in range(12)]
    files += [("null", None), ("empty", ""), ("short", "a b c"), ("same", files[0][1]), ("again", blocks[0] + blocks[0] + blocks[0]), ("run", "a\n" * 200)]
    df = spark.createDataFrame(files, "path string, text string").repartition(3)
    assert found(clones.clone_ranges(df, 20, 2)) == plain(files, 20, 2)
    with pytest.raises(ValueError):
        clones.clone_ranges(df, 9, 5)


def test_rolling_hashes_are_those_of_the_tokens():
    g = random.Random(1)
    a, b = text(g, 300), text(g, 30)
    h, first, last = clones.window_hashes(a, 20)
    k, _, _ = clones.window_hashes(b + a, 20)
    assert (h == k[-len(h) :]).all() and len(set(h.tolist())) == len(h) and (first <= last).all()
    assert len(clones.window_hashes("a b", 3)[0]) == 0 and len(clones.window_hashes("a b c", 3)[0]) == 1


def test_ranges_become_pairs_of_symbols(spark):
    g = random.Random(5)
    block = "".join(f"tok{i}\n" for i in range(40))
    files = [("a.cs", text(g, 30) + "\n" + block), ("b.cs", block + text(g, 30)), ("c.g.cs", block)]
    rows = clones.clone_ranges(spark.createDataFrame(files, "path string, text string"), 20, 5)
    ends = {p: t.count("\n") + 1 for p, t in files}
    nodes = spark.createDataFrame([(f"m:{p}", p, 1, n) for p, n in ends.items()], "stable_id string, file_path string, node_start int, node_end int")
    got = {(r.left_id, r.right_id, r.exclusion) for r in similarity.map_clones(rows.select("clone_id", "first", "second"), nodes).collect()}
    assert got == {("m:a.cs", "m:b.cs", None), ("m:a.cs", "m:c.g.cs", "generated")}


def test_windows_shared_with_the_first_holder(spark):
    g = random.Random(2)
    block = text(g, 60)
    df = spark.createDataFrame([(1, block), (2, text(g, 9) + block), (3, block + block), (4, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in clones.token_clones(df, 20).collect()) == [(1, 2, 41), (1, 3, 41)]

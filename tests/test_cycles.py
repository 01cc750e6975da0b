"""Shortest cycles against a plain search."""

import collections
import random

import pytest

from stratigraph.operators import cycles


def graph(spark, rows):
    return spark.createDataFrame(rows, "edge_id string, source string, target string")


def reachable(out, start):
    seen, todo = set(), [start]
    while todo:
        for _, t in out[todo.pop()]:
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return seen


def plain(rows):
    """{component: (nodes, edges)}: from every node over every first edge the first shortest way back, the least by its edges' ids."""
    out = collections.defaultdict(list)
    for e, s, t in rows:
        out[s].append((e, t))
    nodes = sorted({x for _, s, t in rows for x in (s, t)})
    reach = {n: reachable(out, n) for n in nodes}
    parts = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}
    best = {}
    for start in parts:
        for first, to in out[start]:
            if parts.get(to) != parts[start]:
                continue
            level, seen, got = [(to, [start, to], [first])], {to}, None
            if to == start:
                got = level[0]
            while level and not got:
                after = []
                for at, path, ids in level:
                    for e, t in sorted(out[at], key=lambda x: (x[1], x[0])):
                        if parts.get(t) != parts[start]:
                            continue
                        if t == start and not got:
                            got = (t, [*path, t], [*ids, e])
                        if t not in seen:
                            seen.add(t)
                            after.append((t, [*path, t], [*ids, e]))
                level = after
            key = (len(got[2]), "\x1f".join(got[2]))
            if parts[start] not in best or key < best[parts[start]][0]:
                best[parts[start]] = (key, ",".join(got[1]), ",".join(got[2]))
    return {c: (v[1], v[2]) for c, v in best.items()}


def found(spark, rows):
    return {r.component: (r.path, r.edges) for r in cycles.shortest_cycles(graph(spark, rows)).collect()}


def random_graph(seed):
    g = random.Random(seed)
    rows = []
    for part in range(g.choice([1, 3])):
        n = g.choice([4, 9, 14])
        for _ in range(int(n * g.choice([1.1, 1.6]))):
            s, t = g.randrange(n), g.randrange(n)
            if s != t or g.random() < 0.1:
                rows.append((f"e{g.randrange(10**6)}-{len(rows)}", f"{part}n{s}", f"{part}n{t}"))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_as_plain_search(spark, seed):
    rows = random_graph(seed)
    assert found(spark, rows) == plain(rows)


def test_long_rings_are_found(spark):
    """Longer than any cap: a ring of 19 with a chain into it, and one of 3 with two hubs around it."""
    rows = [(f"r{i:02}", f"a{i:02}", f"a{(i + 1) % 19:02}") for i in range(19)] + [("in", "x", "a03")]
    rows += [("b0", "b0", "b1"), ("b1", "b1", "b2"), ("b2", "b2", "b0")] + [(f"h{i}", "b0", f"c{i}") for i in range(9)] + [(f"k{i}", f"c{i}", "b2") for i in range(9)]
    assert found(spark, rows) == plain(rows) and len(found(spark, rows)["a00"][1].split(",")) == 19


def test_without_cycles(spark):
    assert found(spark, [("e", "a", "b"), ("f", "b", "c")]) == {} and found(spark, []) == {}


def test_hard_edges_of_assigned_nodes(spark):
    nodes = spark.createDataFrame([("a", "src/a.cs"), ("b", "src/b.cs"), ("c", "other/c.cs"), ("d", None)], "stable_id string, file_path string")
    rows = [("1", "a", "b", "uses", 1.0), ("2", "b", "a", "uses", 1.0), ("3", "a", "c", "uses", 1.0), ("4", "c", "a", "uses", 1.0), ("5", "b", "b", "uses", 0.9), ("6", "a", "a", "notes", 1.0), ("7", "a", "d", "uses", 1.0), ("8", "d", "a", "uses", 1.0)]
    edges = spark.createDataFrame(rows, "edge_id string, source string, target string, edge_kind string, confidence double")
    got = cycles.detect_cycles(nodes, edges, {"s": (["src/**"], [])}, ["uses"]).collect()
    assert [(r.component, r.path, r.edges, r.cycle_length) for r in got] == [("a", "a,b,a", "1,2", 2)]


def test_searches_start_at_the_highest_rank_only(spark):
    """Of a hub with 40 neighbours that point back, the first level has one start."""
    rows = [(f"o{i:02}", "hub", f"n{i:02}") for i in range(40)] + [(f"i{i:02}", f"n{i:02}", "hub") for i in range(40)]
    assert found(spark, rows) == plain(rows)

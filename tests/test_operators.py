"""Golden cases of the graph engine's operators."""

import pytest
from pyspark.sql import functions as F

from stratigraph.functions import text
from stratigraph.operators import advice, cycles, graph, hamming, history, providers, rules, similarity, stores


def edges(spark, pairs, confidence=1.0, kind="calls"):
    return spark.createDataFrame([(f"edge:{a}-{b}", a, b, kind, confidence) for a, b in pairs], "edge_id string, source string, target string, edge_kind string, confidence double")


def nodes(spark, paths):
    return spark.createDataFrame([(k, "method", k, p, "fixture", 1.0) for k, p in paths.items()], "stable_id string, node_kind string, display_name string, file_path string, provider string, confidence double")


def test_rounding_modes(spark):
    r = spark.range(1).select(text.r6(F.lit(0.0000005)).alias("a"), text.r6e(F.lit(0.0000005)).alias("b")).first()
    assert (r.a, r.b) == (1e-6, 0.0)


def test_tokens(spark):
    r = spark.range(1).select(text.tokens(F.lit("src/fooBar.Baz_qux-x")).alias("a"), text.name_tokens(F.lit("get2Users_byID")).alias("b")).first()
    assert set(r.a) == {"SRC", "FOO", "BAR", "BAZ", "QUX", "X"} and set(r.b) == {"GET2", "USERS", "BY", "ID"}


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("*.cs", "a/b/c.cs", True), ("src/*.cs", "src/a/b.cs", False), ("src/**/*.cs", "src/b.cs", True), ("src/**/*.cs", "src/x/y/b.cs", True), ("src/**", "src", True), ("src/**", "src/a/b", True),
        ("src/**", "srcs/a", False), ("**/x/*", "x/y", True), ("**/x/*", "a/b/x/y", True), ("a?c", "z/abc/d", True), ("A/*", "a/b", False), ("**", "any/thing", True), ("bin", "a/bin/c", True), ("bin", "a/bins/c", False),
    ],
)
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(text.glob_regex(glob)).alias("x")).first().x is hit


def test_traverse_follows_simple_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")])
    got = lambda *how: sorted((r.edge_id, r.depth) for r in graph.traverse(e, *how).collect())
    assert got("a", "dependencies", 6) == [("edge:a-b", 1), ("edge:b-c", 2)]
    assert got("b", "dependents", 6) == [("edge:a-b", 1), ("edge:c-a", 2), ("edge:d-b", 1)]
    cut = graph.traverse(e, "b", "dependents", 6, 2).collect()
    assert len(cut) == 2 and all(r.truncated for r in cut)
    with pytest.raises(ValueError, match="bounds"):
        graph.traverse(e, "a", "dependencies", 9)


def test_traverse_a_chain(spark):
    e = edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(511)])
    assert graph.traverse(e, "n3", "dependencies", 6, 64).count() == 6 and graph.traverse(e, "n509", "dependencies", 6, 64).count() == 2


def test_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("self", "self"), ("x", "a"), ("c", "y")])
    got = {r.component: (r.path, r.edges) for r in cycles.shortest_cycles(e).collect()}
    assert got == {"a": ("a,b,a", "edge:a-b,edge:b-a"), "self": ("self,self", "edge:self-self")}
    assert cycles.strongly_connected(edges(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_impact_and_paths(spark):
    e = edges(spark, [("a", "b"), ("c", "b"), ("d", "a"), ("d", "c")])
    got = {(r.direction, r.stable_id): (r.depth, r.direct) for r in graph.impact(e, "b").collect()}
    assert got == {("dependents", "a"): (1, True), ("dependents", "c"): (1, True), ("dependents", "d"): (2, False)}
    assert graph.shortest_path(e, "d", "b").first().path == "d>a>b"
    assert graph.shortest_path(e, "b", "d").count() == 0


def test_layers(spark):
    layers = {"ui": (["src/ui/**"], ["core"]), "core": (["src/core/**"], []), "both": (["src/ui/x.cs"], [])}
    n = nodes(spark, {"u": "src/ui/a.cs", "c": "src/core/b.cs", "x": "src/ui/x.cs", "o": "other.cs", "none": None})
    state = {r.stable_id: (r.state, r.layers) for r in rules.layer_membership(n, layers).collect()}
    assert state == {"u": ("Assigned", "ui"), "c": ("Assigned", "core"), "x": ("Ambiguous", "both,ui"), "o": ("Unassigned", ""), "none": ("NotApplicable", "")}
    e = edges(spark, [("u", "c"), ("c", "u"), ("c", "x")]).unionByName(edges(spark, [("c", "u")], 0.8))
    assert [r.edge_id for r in rules.layer_violations(n, e, layers, ["calls"]).collect()] == ["edge:c-u"]


def test_baseline_and_exceptions(spark):
    now = spark.createDataFrame([("a",), ("b",), ("c",)], "finding_key string")
    base = spark.createDataFrame([("b",), ("gone",)], "finding_key string")
    assert {r.status for r in rules.compare_baseline(now, base, "x", "y").collect()} == {"Introduced"}
    compared = rules.compare_baseline(now, base, "x", "x")
    exc = spark.createDataFrame([("a", "e1", 1, 50, 90), ("a", "e2", 2, 5, 90), ("c", "e3", 1, 5, 8), ("z", "e4", 1, 50, 90)], "finding_key string, exception_id string, created_at int, review_at int, expires_at int")
    got = {r.finding_key: (r.status, r.exception_id, r.exception_state) for r in rules.apply_exceptions(compared, exc, F.lit(10)).collect()}
    assert got == {"a": ("Excepted", "e2", "ReviewDue"), "b": ("Legacy", None, None), "c": ("Introduced", "e3", "Expired"), "gone": ("Resolved", None, None), "z": (None, "e4", "Unused")}
    levels = {r.finding_key: (r.level, r.baseline_state) for r in rules.sarif_results(rules.apply_exceptions(compared, exc, F.lit(10))).collect()}
    assert levels == {"a": ("none", "unchanged"), "b": ("warning", "unchanged"), "c": ("error", "new"), "gone": ("note", "absent")}


def test_versions_close_and_open(spark):
    snaps = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (1, "b", "x"), (3, "b", "x")], "revision long, stable_id string, content_hash string")
    want = {("a", "x", 1, 2), ("a", "y", 3, None), ("b", "x", 1, 1), ("b", "x", 3, None)}
    assert {tuple(r) for r in history.versions(snaps, ["content_hash"]).collect()} == want
    table = spark.createDataFrame([], "stable_id string, content_hash string, valid_from long, valid_to long")
    for r in (1, 2, 3):
        table = history.commit_versions(table, snaps.where(F.col("revision") == r), ["content_hash"], r)
    assert {tuple(r) for r in table.collect()} == want
    assert {r.stable_id for r in history.as_of(table, 2).collect()} == {"a"}


def test_moved_files(spark):
    s = "path string, language string, bytes long, hash string"
    a = spark.createDataFrame([("a", "cs", 1, "h1"), ("b", "cs", 2, "h2"), ("c", "cs", 3, "h3"), ("d", "cs", 9, "hh"), ("e", "cs", 9, "hh")], s)
    b = spark.createDataFrame([("a2", "cs", 1, "h1"), ("b", "cs", 2, "h2"), ("c", "cs", 3, "new"), ("f", "cs", 9, "hh")], s)
    got = {r.path: (r.status, r.moved_from) for r in history.inventory_diff(a, b).collect()}
    assert got == {"a2": ("Moved", "a"), "b": ("Unchanged", None), "c": ("Changed", None), "d": ("Deleted", None), "e": ("Deleted", None), "f": ("Added", None)}


def test_hybrid_similarity(spark):
    n = nodes(spark, {"source": "src/a.cs", "beta": "src/b.cs", "alpha": "src/b.cs"}).withColumn("layer", F.lit("l"))
    got = similarity.find_similar(similarity.similarity_facts(n), "source").collect()
    assert [r.candidate_id for r in got] == ["alpha", "beta"] and got[0].score == got[1].score
    assert similarity.find_similar(similarity.similarity_facts(n), "unknown").count() == 0


def test_signatures(spark):
    s = "struct<symbol_id:string,name:string,parameter_types:array<string>,return_type:string,arity:int>"
    rows = spark.createDataFrame([(("a", "getUser", ["int"], "User", 0), ("b", "getUser", ["int"], "User", 0)), (("a", "f", [], None, 0), ("b", "g", [], None, 1))], f"left {s}, right {s}")
    got = [r.score for r in similarity.signature_similarity(rows).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.35 + 0.20 + 0.30 * 0.0)


def test_fingerprints_and_signs(spark):
    assert {similarity.projection_sign(b, i) for b in range(8) for i in range(8)} == {1, -1}
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [-1.0, -0.1])], "id string, embedding array<double>")
    pairs = {(r.left_id, r.right_id): r.distance for r in hamming.nearest_fingerprints(similarity.fingerprints(rows, 2), 1).collect()}
    assert pairs[("a", "b")] == 0 and len(pairs) == 2


def test_narrowest_container(spark):
    ranges = spark.createDataFrame([("r1", "f", 5, 6), ("r2", "f", 1, 50), ("r3", "f", 12, 13), ("r4", "g", 1, 2)], "range_id string, file_path string, start_line int, end_line int")
    n = spark.createDataFrame([("wide", "f", 1, 20), ("tight", "f", 4, 7), ("x", "f", 11, 14), ("y", "f", 11, 14)], "stable_id string, file_path string, node_start int, node_end int")
    got = {r.range_id: (r.stable_id, r.state) for r in similarity.narrowest_container(ranges, n).collect()}
    assert got == {"r1": ("tight", "mapped"), "r2": (None, "unmapped"), "r3": (None, "ambiguous"), "r4": (None, "unmapped")}


def test_louvain_finds_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    e = edges(spark, [*clique("a"), *clique("b"), ("a0", "b0")])
    members = advice.louvain(e)
    groups = {}
    for r in members.collect():
        groups.setdefault(r.community, set()).add(r.stable_id[0])
    assert all(len(g) == 1 for g in groups.values()) and advice.modularity(e, members) > 0.3


def test_questions():
    assert advice.map_question("What breaks if I delete Foo.Bar?") == ("Foo.Bar", "dependents", 3)
    assert advice.map_question("what does X use") == ("X", "dependencies", 3) and advice.map_question("what uses Y") == ("Y", "dependents", 3)
    assert advice.map_question("why") is None


def test_placement_abstains(spark):
    d = spark.createDataFrame([("s", "a", 0.9), ("s", "b", 0.1), ("t", "a", 0.5), ("t", "b", 0.5)], "subject string, cluster string, confidence double")
    got = {r.subject: (r.cluster, r.score, r.abstained) for r in advice.placement_overlap(d).collect()}
    assert got == {"s": ("a", 0.9, False), "t": ("a", 0.5, True)}


def test_louvain_levels_weights_and_lonely_nodes(spark):
    ring = [(f"{c}{i}", f"{c}{j}") for c in "abcdefgh" for i in range(4) for j in range(i)] + [(f"{a}0", f"{b}1") for a, b in zip("abcdefgh", "bcdefgha", strict=True)]
    e = edges(spark, ring)
    members = advice.louvain(e, spark.createDataFrame([("alone",)], "stable_id string"))
    got = {r.stable_id: r.community for r in members.collect()}
    assert got["alone"] == "alone" and all(got[f"{c}{i}"] == got[f"{c}0"] for c in "abcdefgh" for i in range(4))
    assert all(got[x] == x for x in set(got.values()))
    heavy = edges(spark, [("x", "y"), ("y", "z"), ("z", "w")]).withColumn("weight", F.when(F.col("source") == "y", 9.0).otherwise(1.0))
    got = {r.stable_id: r.community for r in advice.louvain(heavy).collect()}
    assert got["y"] == got["z"]


SYMS = "symbol_id string, node_id string, fully_qualified_name string, visibility string, normalized_signature string, parameter_metadata_json string, return_metadata_json string"


def test_reuse_decisions(spark):
    n = nodes(spark, {"loadUser": "src/a.cs", "loadUsers": "src/b.cs", "saveUser": "src/c.cs", "other": "lib/d.cs", "plain": "src/e.cs"})
    s = spark.createDataFrame(
        [("1", "loadUser", "x", "internal", "f(int)", "{}", "{}"), ("2", "loadUsers", "x", "public", "f(int)", "{}", "{}"), ("3", "saveUser", "x", "public", "g()", "{}", "{}"), ("4", "other", "x", "PUBLIC", "h()", "{}", "{}")], SYMS
    )
    asked = spark.createDataFrame([("loadUsers",), ("saveUser",), ("other",), ("plain",), ("missing",)], "candidate_id string")
    got = {r.candidate_id: r.decision for r in similarity.explain_reuse(asked, n, s, "loadUser").collect()}
    assert got == {"loadUsers": "Reuse", "saveUser": "Extend", "other": "InsufficientEvidence", "plain": "InsufficientEvidence", "missing": "InsufficientEvidence"}
    public = {r.candidate_id: r.decision for r in similarity.explain_reuse(asked, n, s, "saveUser").collect()}
    assert public["other"] == "DoNotReuse" and public["loadUsers"] == "DoNotReuse"


def test_signature_evidence(spark):
    n = nodes(spark, {"a": "src/a.cs", "b": "src/b.cs", "c": None})
    s = spark.createDataFrame([("1", "a", "N.Load", "public", "load(int)", "{}", "{}"), ("2", "b", "N.Load", "public", "load(int)", "{}", "{}")], SYMS)
    facts = similarity.similarity_facts(n, None, s)
    pairs = facts.where("stable_id = 'a'").select(F.struct("*").alias("a")).crossJoin(facts.where("stable_id != 'a'").select(F.struct("*").alias("b")))
    got = {r.b.stable_id: r for r in similarity.hybrid_scores(pairs).collect()}
    assert got["b"].signature == 1.0 and "c" not in got  # nothing but an unavailable path and other names
    assert got["b"].score == pytest.approx(round(1 * 0.25 / 0.8, 6) + round(round(0.5 * 2 / 4 + 0.5, 6) * 0.15 / 0.8, 6))


def test_reconciliation(spark):
    n = nodes(spark, {"a": "a.cs", "b": "b.cs", "ext": None, "lost": None}).select("stable_id", "display_name", "file_path")
    e = edges(spark, [("b", "ext"), ("a", "b")]).select("edge_id", "source", "target")
    fresh = spark.createDataFrame([("a2", "A", "a.cs")], n.schema)
    changed = spark.createDataFrame([("a.cs",)], "path string")
    got_n, got_e = history.reconcile_facts(n, e, fresh, e.limit(0), changed)
    assert {r.stable_id for r in got_n.collect()} == {"a2", "b", "ext"} and {r.edge_id for r in got_e.collect()} == {"edge:b-ext"}
    with pytest.raises(ValueError, match="conflicting node b"):
        history.reconcile_facts(n, e, spark.createDataFrame([("b", "other", "a.cs")], n.schema), e.limit(0), changed)


def test_smallest_scope(spark):
    import random

    rng = random.Random(3)
    spans = [(f"s{k}", f"f{k % 3}", a, rng.randrange(9), a + rng.choice([0, 3, 40, 900]), 20) for k in range(200) for a in [rng.randrange(1000)]]
    places = [(k, f"f{k % 4}", rng.randrange(1100), rng.randrange(30)) for k in range(300)]
    got = {r.site_id: r.symbol_id for r in providers.smallest_scope(spark.createDataFrame(places, "site_id int, file_path string, line int, column int"), spark.createDataFrame(spans, "symbol_id string, file_path string, start_line int, start_column int, end_line int, end_column int")).collect()}
    for site, file, line, column in places:
        held = [((d - b) * 10**6 + e - c, s) for s, f, b, c, d, e in spans if f == file and (b, c) <= (line, column) <= (d, e)]
        assert got[site] == (min(held)[1] if held else None)


def test_records_are_inserted_once(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")], "key string, created_at int, label string")
    assert {tuple(r) for r in stores.record_once(rows, ["key"], ["created_at"]).collect()} == {("a", 1, "early"), ("b", 5, "only")}

"""Join keys, chunks, reuse, plans' reasons, maps and neighbourhoods, by hand and by brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stratigraph.operators import graph, history, providers, similarity

KEYS = "site_id string, capture_name string, strategy string, raw_value string, normalized_value string, normalizer_id string, steps array<struct<kind:string,value:string>>, schema_version string"


def test_join_keys(spark):
    rows = [
        ("ok", "c", "StringEquality", " A ", "a", "text", [("trim", None), ("case", "lower")], None),
        ("none", "c", "StringEquality", None, "a", "text", [], "provider-join-key/v1"),
        ("name", "  ", "StringEquality", "a", "a", "text", [], None),
        ("way", "c", "literal", "a", "a", "text", [], None),
        ("value", "c", "StringEquality", "a", "\t", "text", [], None),
        ("normaliser", "c", "StringEquality", "a", "a", None, [], None),
        ("steps", "c", "StringEquality", "a", "a", "text", None, None),
        ("kind", "c", "StringEquality", "a", "a", "text", [(" ", "x")], None),
        ("null step", "c", "StringEquality", "a", "a", "text", [None], None),
        ("twice", "c", "StringEquality", "a", "a", "text", [("x", None), ("x", "")], None),
        ("old", "c", "StringEquality", "a", "a", "text", [], "v0"),
        ("type", "c", "TypeEquality", "a", "a", "text", [], None),
        ("type ok", "c", "TypeEquality", "a", "a", "csharp-symbol/v1", [], None),
        ("pattern", "c", "CanonicalPattern", "a", "a", "text", [("separator", ":")], None),
        ("pattern ok", "c", "CanonicalPattern", "a", "a", "text", [("placeholder", "{id}")], None),
        ("path", "c", "ConfigurationPath", "a", "a", "text", [("placeholder", "x")], None),
        ("path ok", "c", "ConfigurationPath", "a", "a", "text", [("separator", ":"), ("placeholder", "x")], None),
    ]
    got = {r.site_id: (r.problem, None if r.steps is None else [tuple(s) for s in r.steps]) for r in providers.join_keys(spark.createDataFrame(rows, KEYS)).collect()}
    bad = {"name": "incomplete", "way": "incomplete", "value": "incomplete", "normaliser": "incomplete", "steps": "incomplete", "kind": "incomplete", "null step": "incomplete", "twice": "repeated_step", "old": "unsupported_schema", "type": "symbol_normalizer_needed", "pattern": "placeholder_needed", "path": "separator_needed"}
    assert {k: v[0] for k, v in got.items() if v[0]} == bad and all(got[k][1] is None for k in bad)
    assert got["ok"][1] == [("case", "lower"), ("trim", None)] and got["path ok"][1] == [("placeholder", "x"), ("separator", ":")]


DECLARED = "path string, decl_start int, decl_end int, is_type boolean, declaration_kind string, signature string, documentation string, body string, text string"


def test_chunks(spark):
    sources = spark.createDataFrame([("t", "a.cs", 1, 20), ("m", "a.cs", 5, 9), ("e", "a.cs", 11, 12), ("x", "a.cs", 1, 20), ("far", "b.cs", 1, 200_000)], "stable_id string, path string, start_line int, end_line int")
    declared = [
        ("a.cs", 1, 20, True, "ClassDeclaration", None, "/// all", None, "class A { long }"),
        ("a.cs", 2, 3, True, "EnumDeclaration", None, None, None, " enum E "),
        ("a.cs", 5, 9, False, None, "void M()", "/// does", " { go(); } ", "void M() { go(); }"),
        ("a.cs", 11, 12, False, None, "void N()", None, " ", "void N();"),
        ("b.cs", 150_000, 150_001, False, None, "int F()", None, "=> 1", "int F() => 1;"),
    ]
    eligible = spark.createDataFrame([("t", "PublicType"), ("m", "PublicApi"), ("e", "PublicApi"), ("x", "Module"), ("far", "PublicApi")], "stable_id string, kind string")
    got = {r.stable_id: (r.content, r.content_hash) for r in providers.embedding_chunks(sources, spark.createDataFrame(declared, DECLARED), eligible).collect()}
    want = {"t": "declaration: EnumDeclaration\ndocumentation: \nsource:\nenum E", "m": "signature: void M()\ndocumentation: /// does\nbody:\n{ go(); }", "far": "signature: int F()\ndocumentation: \nbody:\n=> 1"}
    assert got == {k: (v, hashlib.sha256(v.encode()).hexdigest().upper()) for k, v in want.items()}


def test_chunks_of_several_ranges_and_unknown_lengths(spark):
    sources = spark.createDataFrame([("a", "x.cs", 1, 20), ("a", "y.cs", 1, 20), ("b", "z.cs", 1, 9), ("c", "z.cs", 20, 29), ("d", "w.cs", 1, 9)], "stable_id string, path string, start_line int, end_line int")
    declared = [
        ("x.cs", 2, 3, True, "Long", None, None, None, "class Long {}"),
        ("y.cs", 2, 3, True, "Short", None, None, None, "class S {}"),
        ("z.cs", 2, 3, True, "Unknown", None, None, None, None),
        ("z.cs", 4, 5, True, "Known", None, None, None, "class K {}"),
        ("z.cs", 21, 22, True, "Alone", None, None, None, None),
        ("w.cs", 2, 3, None, "Neither", "f", None, "1", "f"),
        ("w.cs", 4, 5, False, None, "long()", None, " 2 ", "long() => 2"),
    ]
    eligible = spark.createDataFrame([(i, "PublicType") for i in "abcd"], "stable_id string, kind string")
    got = sorted((r.stable_id, r.path, r.content) for r in providers.embedding_chunks(sources, spark.createDataFrame(declared, DECLARED), eligible).collect())
    text = "declaration: {}\ndocumentation: \nsource:\n{}"
    assert got == [("a", "y.cs", text.format("Short", "class S {}")), ("b", "z.cs", text.format("Known", "class K {}")), ("c", "z.cs", text.format("Alone", "")), ("d", "w.cs", "signature: long()\ndocumentation: \nbody:\n2")]


def test_chunks_join_on_blocks(spark):
    spans = spark.range(200).selectExpr("concat('s', id) AS stable_id", "'one.cs' AS path", "CAST(id * 40 AS INT) AS start_line", "CAST(id * 40 + 30 AS INT) AS end_line")
    declared = spark.range(200).selectExpr("'one.cs' AS path", "CAST(id * 40 + 3 AS INT) AS decl_start", "CAST(id * 40 + 5 AS INT) AS decl_end", "true AS is_type", "'c' AS declaration_kind", "'' AS signature", "'' AS documentation", "'' AS body", "concat('t', id) AS text")
    rows = providers.embedding_chunks(spans, declared, spans.select("stable_id", F.lit("PublicType").alias("kind")))
    assert rows.count() == 200
    plan = rows._jdf.queryExecution().toString()
    assert "block" in plan and "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan


def reuse(spark, proposed, intent=""):
    nodes = spark.createDataFrame([("loadUser", "loadUser", "src/a.cs"), ("loadUsers", "loadUsers", "src/b.cs"), ("zeta", "zeta", None)], "stable_id string, display_name string, file_path string")
    symbols = spark.createDataFrame([("1", "loadUser", "internal", "f()"), ("2", "loadUsers", "public", "f()")], "symbol_id string, node_id string, visibility string, normalized_signature string")
    asked = spark.createDataFrame([("loadUsers",), ("zeta",), ("gone",)], "candidate_id string")
    return {r.candidate_id: (r.supporting, r.differentiating, r.decision, r.checks) for r in similarity.explain_reuse(asked, nodes, symbols, proposed, intent).collect()}


def test_reuse_without_node_or_proposal(spark):
    gone = ("", "candidate_missing", "InsufficientEvidence", "")
    assert reuse(spark, "nowhere") == {"loadUsers": ("", "proposal_missing", "InsufficientEvidence", ""), "zeta": ("", "proposal_missing", "InsufficientEvidence", ""), "gone": gone}
    assert reuse(spark, None, "load the user") == {"loadUsers": ("symbol_overlap", "", "InsufficientEvidence", "find_similar,get_dependents"), "zeta": ("", "", "InsufficientEvidence", "find_similar,get_dependents"), "gone": gone}
    got = reuse(spark, "loadUser")
    assert got["loadUsers"] == ("symbol_overlap,public_signature_match,file_ownership_overlap", "", "Reuse", "get_dependents,check_violation")
    assert got["zeta"] == ("", "file_ownership_difference", "InsufficientEvidence", "find_similar,get_dependents") and got["gone"] == gone


def test_neighbourhoods_are_counts(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "z"), ("p", "a"), ("p", "b"), ("q", "a")], "source string, target string")
    got = {r.stable_id: r.shared_ends for r in similarity.shared_ends(edges, "a").collect()}
    assert got["a"] == 1.0 and got["b"] == pytest.approx((1 / 3 + 1 / 2) / 2) and "c" not in got
    plan = similarity.shared_ends(edges, "a")._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_plan_reasons(spark):
    changes = spark.createDataFrame([("a.cs", "Changed", None)], "path string, status string, moved_from string")
    files = spark.createDataFrame([("a.cs", "csharp"), ("b.cs", "csharp"), ("c.md", "markdown")], "path string, language string")
    nodes = spark.createDataFrame([("n", "a.cs", "csharp-syntax", "file"), ("m", "b.cs", "csharp-syntax", "file")], "stable_id string, file_path string, provider string, node_kind string")
    edges = spark.createDataFrame([("e", "n", "m", "p", "k")], "edge_id string, source string, target string, provider string, join_key string")
    got = lambda *how: sorted(tuple(r) for r in history.incremental_plan(*how).collect())
    assert got(changes.where("false"), nodes, edges, files) == [("reason", "NoSourceChanges")]
    assert got(changes, None, None, files) == [("changed_path", "a.cs"), ("parse", "a.cs"), ("parse", "b.cs"), ("reason", "InitialScan")]
    assert got(changes, nodes.where("stable_id = 'n'"), edges, files) == [("changed_path", "a.cs"), ("parse", "a.cs"), ("parse", "b.cs"), ("reason", "SnapshotCoverageUnavailable")]
    assert got(changes, nodes, edges, files) == [("affected", "m"), ("affected", "n"), ("changed_path", "a.cs"), ("dependent_path", "b.cs"), ("join_key", "k"), ("parse", "a.cs"), ("provider", "p"), ("reason", "IncrementalReuse")]


def plain_walk(nodes, edges, focus, most, per_node):
    order, queue, met = {focus: 0}, [focus], {}
    while queue and len(order) < most:
        at = queue.pop(0)
        for _, e, s, t in sorted((-c, e, s, t) for e, s, t, c in edges if at in (s, t))[:per_node]:
            other = t if s == at else s
            if other not in order:
                if len(order) >= most:
                    continue
                order[other] = len(order)
                queue.append(other)
            met[e] = (s, t)
    known = {n for n in order if n in nodes}
    return {(n, order[n]) for n in known}, {e for e, (s, t) in met.items() if s in known and t in known}


@pytest.mark.parametrize("most,per_node", [(12, 3), (40, 18), (1, 2)])
def test_neighbourhood_as_a_plain_walk(spark, most, per_node):
    g = random.Random(most)
    names = [f"n{i:02}" for i in range(30)]
    edges = [(f"e{i:03}", g.choice(names), g.choice([*names, "lost"]), g.choice([0.5, 0.8, 1.0])) for i in range(80)]
    n = spark.createDataFrame([(x, x) for x in names], "stable_id string, display_name string")
    e = spark.createDataFrame(edges, "edge_id string, source string, target string, confidence double")
    rows = graph.explore_neighbourhood(n, e, "n03", most, per_node).collect()
    assert ({(r.id, r.step) for r in rows if r.item == "node"}, {r.id for r in rows if r.item == "edge"}) == plain_walk(names, edges, "n03", most, per_node)


def test_map_says_when_it_is_cut(spark):
    n = spark.createDataFrame([(f"n{i}", "k", f"n{i}", None, 1.0) for i in range(4)], "stable_id string, node_kind string, display_name string, file_path string, confidence double")
    e = spark.createDataFrame([("e1", "n0", "n1", "x", 1.0), ("e2", "n0", "n3", "x", 0.5)], "edge_id string, source string, target string, edge_kind string, confidence double")
    whole, cut = graph.graph_map(n, e).collect(), graph.graph_map(n, e, 2).collect()
    assert len(whole) == 6 and not any(r.truncated for r in whole)
    assert {(r.item, r.id) for r in cut} == {("node", "n0"), ("node", "n1"), ("edge", "e1")} and all(r.truncated for r in cut)


def test_important_nodes(spark):
    from stratigraph.operators import records

    nodes = spark.createDataFrame(
        [("n", "namespace", "N", "src/a/n.cs"), ("g", "Semantic_Namespace", "G", "src/obj/g.cs"), ("t", "class", "T", "src/a/t.cs"), ("m", "method", "M", "src/a/t.cs"), ("d", "class", "D", "src\\x.Designer.cs"), ("none", "class", "X", None)],
        "stable_id string, node_kind string, display_name string, file_path string",
    )
    symbols = spark.createDataFrame([("s2", "t", "N.T2", "Public"), ("s1", "t", "N.T", "public"), ("s3", "m", "N.M", "public"), ("s4", "m", "N.Private", "private"), ("s5", "d", "N.D", "public"), ("s6", "none", "X", "public")], "symbol_id string, node_id string, fully_qualified_name string, visibility string")
    got = {(r.item, r.kind, r.stable_id, r.display_name, r.sources) for r in records.important_nodes(nodes, symbols, ["/src/a/", "lib"]).collect()}
    assert got == {
        ("target", "Directory", "directory:src", "src", 2), ("target", "Directory", "directory:src/a", "src/a", 2), ("target", "Module", "module:src/a", "src/a", 2), ("target", "Namespace", "n", "N", 1),
        ("target", "PublicType", "t", "N.T", 1), ("target", "PublicApi", "m", "N.M", 1), ("excluded", None, "file:src/obj/g.cs", "src/obj/g.cs", None), ("excluded", None, "file:src\\x.Designer.cs", "src\\x.Designer.cs", None),
        ("excluded", None, "g", "G", None), ("excluded", None, "s5", "N.D", None),
    }
    every = records.important_nodes(nodes, symbols, include_generated=True)
    assert every.where("item = 'excluded'").count() == 0 and every.where("stable_id = 'd'").count() == 1


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans_hold_no_group_in_one_task(spark):
    """Statistics of a band, members of bands, roll-ups and queues: sums and rows instead of windows and lists over a whole group."""
    from stratigraph.operators import advice, records

    vectors = spark.createDataFrame([(f"v{i}", "b", [float(i), 1.0]) for i in range(6)], "id string, band string, embedding array<double>")
    assert "Window" not in plan_of(similarity.band_cosine(vectors))
    methods = spark.createDataFrame([(f"m{i}", "cs", 5, 2, False) for i in range(4)], "method_id string, language string, logical_line_count int, cyclomatic_complexity int, is_data_shape boolean")
    bands = similarity.partition_bands(methods)
    assert "collect_list" not in plan_of(bands) and {(r.method_id, r.n_members) for r in bands.collect()} == {(f"m{i}", 4) for i in range(4)}
    summaries = spark.createDataFrame([("a/b/c.md", "1", "x", "Fresh"), ("a/d.md", "2", "y", "Fresh"), ("a/e.md", "3", "z", "Stale")], "path string, id string, text string, state string")
    rolled = advice.directory_rollup(summaries)
    assert "collect_list" not in plan_of(rolled) and {(r.directory, r.n, r.id) for r in rolled.collect()} == {("a", 2, "1"), ("a", 2, "2"), ("a/b", 1, "1")}
    requests = spark.range(500).selectExpr("concat('t', id % 300) AS target", "timestamp_seconds(1000 + id * 7 % 500) AS requested_at")
    queue = records.regeneration_queue(requests, spark.createDataFrame([("t7",)], "target string"))
    first = {}
    for r in requests.collect():
        first[r.target] = min(first.get(r.target, r.requested_at), r.requested_at)
    want = [t for _, t in sorted((v, k) for k, v in first.items() if k != "t7")]
    assert [r.target for r in sorted(queue.collect(), key=lambda r: r.position)] == want
    assert sorted(r.position for r in queue.collect()) == list(range(1, 300))

"""Commits of facts: versions, conflicts, what is read and written, and two commits at once."""

import os
import random

import pytest

from stratigraph.sources.versioned import Conflict, VersionStore

NODE = "stable_id string, node_kind string, content_hash string"
EDGE = "edge_id string, source string, target string, edge_kind string, join_key string, confidence double"
SYMBOL = "symbol_id string, node_id string, visibility string, signature_hash string"
FINGERPRINT = "symbol_id string, fingerprint_kind string, fingerprint_hash string"


def facts(spark, nodes, edges=(), symbols=(), fingerprints=()):
    rows = {"nodes": (nodes, NODE), "edges": (edges, EDGE), "symbols": (symbols, SYMBOL), "fingerprints": (fingerprints, FINGERPRINT)}
    return {t: spark.createDataFrame(list(r), k) for t, (r, k) in rows.items()}


def versions(store, table, *columns):
    return sorted(((*[r[c] for c in columns], r.valid_from, r.valid_to) for r in store.versions(table).collect()), key=str)


def files(folder):
    return {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(folder) for f in names}


def test_ranges_over_changes_and_removals(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path), buckets=4)
    edge = ("e", "a", "b", "calls", None, 0.5)
    assert store.commit(facts(spark, [("a", "file", "1"), ("b", "type", "1")], [edge], [("s", "b", "public", "v1")], [("s", "members", "f1")]), "r1") == 1
    assert store.commit(facts(spark, [("a", "file", "1"), ("b", "type", "2")], [edge], [("s", "b", "public", "v2")], [("s", "members", "f1"), ("s", "docs", "d")]), "r2", base=1) == 2
    assert store.commit(facts(spark, [("a", "file", "1")]), "r3", base=2) == 3
    assert versions(store, "nodes", "stable_id", "content_hash") == [("a", "1", 1, None), ("b", "1", 1, 1), ("b", "2", 2, 2)]
    assert versions(store, "edges", "edge_id") == [("e", 1, 2)]
    assert versions(store, "symbols", "symbol_id", "signature_hash") == [("s", "v1", 1, 1), ("s", "v2", 2, 2)]
    assert versions(store, "fingerprints", "fingerprint_kind") == [("docs", 2, 2), ("members", 1, 2)]
    assert [r.stable_id for r in store.snapshot("nodes").collect()] == ["a"] and store.snapshot("nodes", 2).count() == 2
    assert sorted((r.edge_id, r.source, r.first_seen, r.last_seen) for r in store.identities("edges").collect()) == [("e", "a", 1, 2)]
    # back again, after its versions are closed
    store.commit(facts(spark, [("a", "file", "1"), ("b", "type", "1")], [edge]), "r4")
    assert versions(store, "edges", "edge_id") == [("e", 1, 2), ("e", 4, None)]
    # an older manifest still reads as it was
    assert store.versions("edges", 2).where("valid_to IS NULL").count() == 1


def test_conflicts_commit_nothing(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path), buckets=4)
    nodes = [("a", "file", "1"), ("b", "type", "1")]
    store.commit(facts(spark, nodes, [("e", "a", "b", "calls", "k", 0.5)], [("s", "a", "public", "v1")]), "r1")
    store.commit(facts(spark, nodes), "r2")
    before = files(tmp_path)
    for wrong in ([("e", "b", "a", "calls", "k", 0.5)], [("e", "a", "b", "uses", "k", 0.5)], [("e", "a", "b", "calls", None, 0.5)]):
        with pytest.raises(Conflict, match="edge e changed"):
            store.commit(facts(spark, nodes, wrong), "r3")
    with pytest.raises(Conflict, match="symbol s changed"):
        store.commit(facts(spark, nodes, [], [("s", "b", "public", "v1")]), "r3")
    with pytest.raises(ValueError, match="missing_target"):
        store.commit(facts(spark, nodes[:1], [("e", "a", "b", "calls", "k", 0.5)]), "r3")
    with pytest.raises(ValueError, match="repeated"):
        store.commit(facts(spark, nodes * 2), "r3")
    with pytest.raises(Conflict, match="run r2"):
        store.commit(facts(spark, nodes), "r2")
    assert store.active_revision() == 2 and {f for f in files(tmp_path) if "/data/" in f[0]} == {f for f in before if "/data/" in f[0]}


def test_a_revision_is_committed_once(spark, tmp_path):
    store, other = VersionStore(spark, str(tmp_path)), VersionStore(spark, str(tmp_path))
    store.commit(facts(spark, [("a", "file", "1")]), "r1")
    live = files(tmp_path)
    with pytest.raises(Conflict):
        other.commit(facts(spark, [("a", "file", "2")]), "x", revision=1)
    with pytest.raises(Conflict):
        other.commit(facts(spark, [("a", "file", "2")]), "x", base=0)
    assert live <= files(tmp_path)
    # both have read revision 1; the second to publish fails, and its files are gone
    publish = other._publish

    def late(manifest):
        store.commit(facts(spark, [("a", "file", "3")]), "r2")
        publish(manifest)

    other._publish = late
    with pytest.raises(Conflict, match="another commit"):
        other.commit(facts(spark, [("a", "file", "2")]), "x")
    assert live <= files(tmp_path) and store.active_revision() == 2
    assert versions(store, "nodes", "content_hash") == [("1", 1, 1), ("3", 2, None)]
    assert len(os.listdir(tmp_path / "data")) == 2


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path), buckets=16)
    rows = [(f"n{i}", "file", "1") for i in range(400)]
    store.commit(facts(spark, rows), "r1")
    first = store.manifest()["tables"]["nodes"]["buckets"]
    assert len(first) == 16
    read = []
    plain = store._rows
    store._rows = lambda m, t, schema, buckets=None: read.append((t, buckets)) or plain(m, t, schema, buckets)
    store.commit(facts(spark, [("n7", "file", "2"), *[r for r in rows if r[0] != "n7"]]), "r2")
    assert [t for t, b in read] == ["nodes"] and len(read[0][1]) == 1
    second = store.manifest()["tables"]["nodes"]["buckets"]
    assert [b for b in second if second[b] != first[b]] == [str(read[0][1][0])]
    store._rows = plain
    one = store.history_of("nodes", "n7")
    assert sorted((r.content_hash, r.valid_to) for r in one.collect()) == [("1", 1), ("2", None)]
    assert len(one.inputFiles()) == 1
    before = files(tmp_path / "data")
    store.commit(facts(spark, [("n7", "file", "2"), *[r for r in rows if r[0] != "n7"]]), "r3")
    assert files(tmp_path / "data") == before and store.active_revision() == 3


def test_half_a_commit_is_not_seen(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    assert store.active_revision() == 0
    store.commit(facts(spark, [("a", "file", "1")]), "r1")
    (tmp_path / "manifests" / "_half").write_text("{")
    (tmp_path / "data" / "lost").mkdir()
    assert store.active_revision() == 1 and store.snapshot("nodes").count() == 1


def test_as_a_loop_of_facts(spark, tmp_path):
    """Random snapshots against a dictionary of open versions."""
    g = random.Random(4)
    store = VersionStore(spark, str(tmp_path), buckets=3)
    open_, done = {}, []
    for r in range(1, 6):
        now = {f"n{i}": g.choice("xyz") for i in range(30) if g.random() < 0.8}
        for k in [k for k in open_ if now.get(k) != open_[k][0]]:
            v, since = open_.pop(k)
            done.append((k, v, since, r - 1))
        for k, v in now.items():
            open_.setdefault(k, (v, r))
        store.commit(facts(spark, [(k, "file", v) for k, v in now.items()]), f"run {r}", base=r - 1)
    want = sorted([*done, *[(k, v, since, None) for k, (v, since) in open_.items()]], key=str)
    assert versions(store, "nodes", "stable_id", "content_hash") == want

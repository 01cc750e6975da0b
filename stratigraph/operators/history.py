"""Versioned facts: slowly changing history, as-of reads, diffs, re-introductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import directory, jaccard, r6e, tokens
from ..llm.storage import Scratch
from ..sources.storage import parts_of


def versions(snapshots: DataFrame, attributes: list[str]) -> DataFrame:
    """(stable_id, attributes..., valid_from, valid_to) from full snapshots (revision, stable_id, attributes...).

    Islands of equal attributes over consecutive revisions; valid_to is inclusive, null while open. A
    revision that lacks the id closes its version.
    """
    revisions = snapshots.select("revision").distinct()
    # the number of a revision among all: a small table, one row a revision
    numbered = revisions.select("revision", F.row_number().over(Window.orderBy("revision")).alias("k"), F.lead("revision").over(Window.orderBy("revision")).alias("next"))
    rows = snapshots.join(numbered, "revision")
    of_id = Window.partitionBy("stable_id").orderBy("revision")
    same = F.lag("k").over(of_id) == F.col("k") - 1
    for a in attributes:
        same = same & F.lag(a).over(of_id).eqNullSafe(F.col(a))
    rows = rows.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(of_id))
    ends = rows.groupBy("stable_id", "island", *attributes).agg(F.min("revision").alias("valid_from"), F.max(F.struct("revision", "next")).alias("e"))
    return ends.select("stable_id", *attributes, "valid_from", F.when(F.col("e.next").isNotNull(), F.col("e.next") - 1).alias("valid_to"))


def commit_versions(open_versions: DataFrame, incoming: DataFrame, attributes: list[str], revision: int) -> DataFrame:
    """One commit on the version table: new ids open, changed ones close at revision - 1 and open anew, missing ones close."""
    was = open_versions.where("valid_to IS NULL")
    a = was.select("stable_id", F.struct(*attributes).alias("old"), "valid_from")
    b = incoming.select("stable_id", F.struct(*attributes).alias("new"))
    both = a.join(b, "stable_id", "full")
    same = F.col("old").eqNullSafe(F.col("new"))
    closed = both.where(F.col("old").isNotNull()).select("stable_id", "old.*", "valid_from", F.when(~same, F.lit(revision - 1)).cast("long").alias("valid_to"))
    opened = both.where(F.col("new").isNotNull() & ~same).select("stable_id", "new.*", F.lit(revision).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return open_versions.where("valid_to IS NOT NULL").select("stable_id", *attributes, "valid_from", "valid_to").unionByName(closed).unionByName(opened)


def identities(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("stable_id").agg(F.min("revision").alias("first_seen"), F.max("revision").alias("last_seen"))


def as_of(version_rows: DataFrame, revision: int) -> DataFrame:
    return version_rows.where((F.col("valid_from") <= revision) & (F.coalesce("valid_to", F.lit(2**62)) >= revision))


def latest_state(events: DataFrame, key: str, order: list[str], revision: int | None = None) -> DataFrame:
    """The last event of each key, up to a revision."""
    if revision is not None:
        events = events.where(F.col("revision") <= revision)
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(key, "m.*")


def revision_delta(before: DataFrame, after: DataFrame, attributes: list[str]) -> DataFrame:
    """(stable_id, change): added, removed or changed nodes between two snapshots."""
    a, b = before.select("stable_id", F.struct(*attributes).alias("x")), after.select("stable_id", F.struct(*attributes).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return a.join(b, "stable_id", "full").select("stable_id", change.alias("change")).where("change IS NOT NULL")


def change_summary(before: DataFrame, after: DataFrame, edges_before: DataFrame, edges_after: DataFrame, most: int = 500) -> DataFrame:
    """(change, stable_id, file_path, detail, added_edges, removed_edges): the first nodes by id of each kind of change, with the net change of the edges' number.

    Nodes (stable_id, node_kind, file_path, content_hash) are compared by all of these; one row without a node if none changed.
    """
    delta = revision_delta(before, after, ["node_kind", "file_path", "content_hash"])
    facts = after.select("stable_id", "node_kind", "file_path").unionByName(before.join(after.select("stable_id"), "stable_id", "left_anti").select("stable_id", "node_kind", "file_path"))
    # of each kind the first by id, without a window over all of them
    parts = [delta.where(F.col("change") == c).orderBy("stable_id").limit(most) for c in ("added", "removed", "changed")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(facts, "stable_id")
    detail = F.concat("node_kind", F.lit(" at "), F.coalesce("file_path", F.lit("unknown source path")), F.lit("."))
    net = edges_after.agg(F.count("*").alias("a")).crossJoin(edges_before.agg(F.count("*").alias("b"))).select((F.col("a") - F.col("b")).alias("net"))
    told = net.join(rows.select("change", "stable_id", "file_path", detail.alias("detail")), F.lit(True), "left")
    return told.select("change", "stable_id", "file_path", "detail", F.greatest(F.lit(0), "net").alias("added_edges"), F.greatest(F.lit(0), -F.col("net")).alias("removed_edges"))


def surface_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(symbol_id, change): symbols compared by signature and the ordered kind:hash list of their fingerprints."""
    told = lambda df, name: df.groupBy("symbol_id").agg(F.min("signature_hash").alias("s"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "fingerprint_kind", "fingerprint_hash"))), "|").alias("f")).select("symbol_id", F.concat_ws("#", "s", "f").alias(name))
    change = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Removed").when(F.col("old") != F.col("new"), "Changed")
    return told(before, "old").join(told(after, "new"), "symbol_id", "full").select("symbol_id", change.alias("change")).where("change IS NOT NULL")


def inventory_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, moved_from): Added, Changed, Unchanged, Deleted, or Moved where content is unique among added and deleted files."""
    a, b = before.select("path", F.struct("language", "bytes", "hash").alias("x")), after.select("path", F.struct("language", "bytes", "hash").alias("y"))
    both = a.join(b, "path", "full").select("path", "x", "y", F.when(F.col("x").isNull(), "Added").when(F.col("y").isNull(), "Deleted").when(F.col("x") == F.col("y"), "Unchanged").otherwise("Changed").alias("status"))
    only = lambda s, c, name: both.where(F.col("status") == s).groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")
    moved = only("Deleted", "x", "moved_from").join(only("Added", "y", "path"), "key")
    left = both.join(moved.select(F.explode(F.array("moved_from", "path")).alias("path")), "path", "left_anti").select("path", "status", F.lit(None).cast("string").alias("moved_from"))
    return left.unionByName(moved.select("path", F.lit("Moved").alias("status"), "moved_from"))


def changed_paths(before: DataFrame, after: DataFrame, hooked: DataFrame) -> DataFrame:
    """(path, category): files that a snapshot pair or a hook names."""
    diff = inventory_diff(before, after).where("status != 'Unchanged'").select("path", "status")
    return diff.join(hooked.select("path", F.lit(True).alias("hooked")), "path", "full").select("path", F.when(F.col("status").isNull(), "reported").when(F.col("hooked"), F.concat(F.lit("confirmed_"), F.lower("status"))).otherwise(F.concat(F.lit("unreported_"), F.lower("status"))).alias("category"))


def reintroduced(version_rows: DataFrame, current: DataFrame, revision: int, most: int = 500) -> DataFrame:
    """(stable_id, former_id, removed_at, score, kinds): current nodes like versions that were closed before.

    Evidence: same id 1, name tokens, path tokens, same content 1; two kinds at least and a mean of .6. The
    last most closed versions are looked at. Token sets are compared once per kind and path, with the
    versions broadcast (most rows); what can't reach the mean with both other evidences goes there.
    """
    old = version_rows.where(F.col("valid_to") < revision).orderBy(F.desc("valid_to"), "stable_id", "valid_from").limit(most)
    old = old.select(F.col("stable_id").alias("former_id"), F.col("valid_to").alias("removed_at"), F.col("content_hash").alias("old_hash"), tokens(F.col("node_kind")).alias("old_name"), tokens(F.col("file_path")).alias("old_path"))
    forms = current.select("node_kind", "file_path").distinct().withColumn("name", tokens(F.col("node_kind"))).withColumn("path", tokens(F.col("file_path")))
    met = forms.crossJoin(F.broadcast(old)).withColumn("by_name", jaccard(F.col("name"), F.col("old_name"))).withColumn("by_path", jaccard(F.col("path"), F.col("old_path")))
    # whether id and content are equal leaves four scores, which are made here, not for each node
    scores = F.array(*[_likeness(i, h) for i in (0.0, 1.0) for h in (0.0, 1.0)])
    able = met.withColumn("scores", scores).where(F.exists("scores", lambda s: s["score"] >= 0.6)).select("node_kind", "file_path", "former_id", "removed_at", "old_hash", "scores")
    # few bytes that become up to most rows each: by their number, or they would be put together into one task
    dealt = current.select("stable_id", "content_hash", "node_kind", "file_path").repartition(int(current.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stable_id")
    both = dealt.join(able, ["node_kind", "file_path"])
    equal = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))
    score = F.get("scores", 2 * equal("stable_id", "former_id") + equal("content_hash", "old_hash"))
    return both.select("stable_id", "former_id", "removed_at", score.alias("s")).where("s.score >= 0.6").select("stable_id", "former_id", "removed_at", "s.score", "s.kinds")


def _likeness(same_id: float, same_hash: float) -> Column:
    """(score, kinds) of evidence by name and path with that of id and content; no score with fewer than two kinds."""
    parts = F.filter(F.array(F.lit(same_id), F.col("by_name"), F.col("by_path"), F.lit(same_hash)), lambda x: x.isNotNull() & (x > 0))
    kinds = F.size(parts).cast("long")
    score = F.when(kinds >= 2, r6e(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / kinds))
    return F.struct(score.alias("score"), kinds.alias("kinds"))


def incremental_plan(changes: DataFrame, nodes: DataFrame | None, edges: DataFrame | None, inventory: DataFrame | None = None, language: str = "csharp", provider: str = "csharp-syntax") -> DataFrame:
    """(kind, value): what an incremental analysis has to look at, from changes (path, status, moved_from).

    Changed and deleted paths, moved-from ones among both; affected nodes, those on changed paths and their
    neighbours; paths of these that did not change; providers and join keys of the edges touched; the reason.
    With an inventory (path, language) the files to parse as well: the changed ones of the language, or all of them if there is no
    revision yet (nodes is None: InitialScan) or if an unchanged file has no file node of the provider
    (SnapshotCoverageUnavailable); such a plan names no nodes.
    """
    from ..sources.storage import checkpointed

    changed = checkpointed(changes.where("status != 'Unchanged'"))
    paths = changed.select("path").unionByName(changed.where("moved_from IS NOT NULL").select(F.col("moved_from").alias("path"))).distinct()
    gone = changed.where("status = 'Deleted'").select("path").unionByName(changed.where("status = 'Moved'").select(F.col("moved_from").alias("path")))
    told = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    files = inventory.where(F.col("language") == language).select("path").distinct() if inventory is not None else None
    full = None
    if changed.limit(1).count():
        if nodes is None:
            full = "InitialScan"
        elif files is not None:
            covered = nodes.where((F.col("provider") == provider) & (F.col("node_kind") == "file") & F.col("file_path").isNotNull()).select(F.col("file_path").alias("path"))
            if files.join(changed.select("path"), "path", "left_anti").join(covered, "path", "left_anti").limit(1).count():
                full = "SnapshotCoverageUnavailable"
    if full or nodes is None:
        reason = changed.sparkSession.createDataFrame([(full or "NoSourceChanges",)], "value string")
        out = told(reason, "reason", "value").unionByName(told(paths, "changed_path", "path")).unionByName(told(gone, "deleted_path", "path"))
        return out.unionByName(told(files, "parse", "path")) if full and files is not None else out
    hit = checkpointed(nodes.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("stable_id"))
    ends = lambda c: edges.join(hit.withColumnRenamed("stable_id", c), c, "left_semi")
    touched = checkpointed(ends("source").unionByName(ends("target")).dropDuplicates(["edge_id"]))
    affected = checkpointed(hit.union(touched.select("source")).union(touched.select("target")).distinct())
    near = nodes.join(affected, "stable_id", "left_semi").where("file_path IS NOT NULL").select(F.col("file_path").alias("path")).distinct().join(paths, "path", "left_anti")
    reason = changed.agg(F.when(F.count("*") == 0, "NoSourceChanges").otherwise("IncrementalReuse").alias("value"))
    out = told(reason, "reason", "value").unionByName(told(paths, "changed_path", "path")).unionByName(told(gone, "deleted_path", "path")).unionByName(told(affected, "affected", "stable_id")).unionByName(told(near, "dependent_path", "path"))
    if files is not None:
        out = out.unionByName(told(files.join(changed.select("path").distinct(), "path", "left_semi"), "parse", "path"))
    out = out.unionByName(told(touched.select("provider").distinct(), "provider", "provider"))
    return out.unionByName(told(touched.where(F.btrim("join_key") != "").select("join_key").distinct(), "join_key", "join_key"))


def merged(preserved: DataFrame, fresh: DataFrame, key: str, name: str) -> DataFrame:
    """Both sets of facts, equal ones once; an id with two different facts is an error.

    Facts are written as they come, then dealt out by id in parts of a size of these files, so that a task doesn't grow with the
    tables; an id's least and greatest facts are one, or it is in conflict.
    """
    spark, scratch = preserved.sparkSession, Scratch(preserved.sparkSession, f"merged-{name}")
    every = scratch.keep(preserved.select(*fresh.columns).unionByName(fresh), "every").repartition(parts_of(spark, scratch.path("every")), key)
    fact = F.struct(*[c for c in fresh.columns if c != key])
    once = scratch.keep(every.groupBy(key).agg(F.min(fact).alias("fact"), (~F.min(fact).eqNullSafe(F.max(fact))).alias("differs")), "once")
    bad = once.where("differs").orderBy(key).limit(1).collect()
    if bad:
        raise ValueError(f"conflicting {name} {bad[0][key]}")
    return once.select(*[c if c == key else F.col(f"fact.{c}").alias(c) for c in fresh.columns])


def reconcile_facts(nodes: DataFrame, edges: DataFrame, fresh_nodes: DataFrame, fresh_edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a provider: those of unchanged paths as they were, those of changed paths anew.

    Edges that touch a replaced node go; nodes without a path stay only if an edge names them.
    """
    scratch = Scratch(nodes.sparkSession, "reconciled")  # what is joined with whole tables is written first, so that Spark knows its size
    paths = scratch.keep(changed.select(F.col("path").alias("file_path")).distinct(), "paths")
    replaced = scratch.keep(nodes.join(paths, "file_path", "left_semi").select("stable_id"), "replaced")
    kept = edges
    for end in ("source", "target"):
        kept = kept.join(replaced.withColumnRenamed("stable_id", end), end, "left_anti")
    all_edges = merged(kept, fresh_edges, "edge_id", "edge")
    all_nodes = merged(nodes.join(paths, "file_path", "left_anti"), fresh_nodes, "stable_id", "node")
    pathless = scratch.keep(all_nodes.where("file_path IS NULL"), "pathless")
    named = all_edges.select(F.explode(F.array("source", "target")).alias("stable_id")).join(pathless.select("stable_id"), "stable_id", "left_semi").distinct()
    without = pathless.join(scratch.keep(named, "named"), "stable_id", "left_semi").select(*all_nodes.columns)
    return all_nodes.where("file_path IS NOT NULL").unionByName(without), all_edges


def migrated_versions(snapshots: DataFrame, key: str = "stable_id", order: str = "revision") -> DataFrame:
    """Version rows of nodes or edges from the full snapshots of an older store: each is valid for its own revision, the last of an id stays open.

    A content hash that is missing becomes legacy:revision:id.
    """
    last = snapshots.groupBy(key).agg(F.max(order).alias("last"))
    rest = [c for c in snapshots.columns if c not in (key, order)]
    hashed = F.coalesce("content_hash", F.concat_ws(":", F.lit("legacy"), F.col(order).cast("string"), key))
    rows = snapshots.withColumn("content_hash", hashed) if "content_hash" in rest else snapshots
    return rows.join(last, key).select(key, *rest, F.col(order).alias("valid_from"), F.when(F.col(order) != F.col("last"), F.col(order)).alias("valid_to"))


def migrated_identities(snapshots: DataFrame, key: str = "stable_id", fixed: list[str] | None = None, order: str = "revision") -> DataFrame:
    """(key, fixed attributes, first_seen, last_seen): an id's attributes are those of its last revision."""
    found = snapshots.groupBy(key).agg(F.max(F.struct(order, *(fixed or []))).alias("m"), F.min(order).alias("first_seen"))
    return found.select(key, *[F.col(f"m.{c}").alias(c) for c in fixed or []], "first_seen", F.col(f"m.{order}").alias("last_seen"))


def staleness_plan(changed: DataFrame, prior: DataFrame, current: DataFrame) -> DataFrame:
    """(stable_id): changed nodes and the direct sources of edges, prior or current, that lead to them."""
    edges = prior.select("source", "target").union(current.select("source", "target")).distinct()
    into = edges.join(changed.select(F.col("stable_id").alias("target")), "target", "left_semi").select(F.col("source").alias("stable_id"))
    return changed.select("stable_id").union(into).distinct()


def directory_prefixes(paths: DataFrame) -> DataFrame:
    """(directory, n_files): every proper ancestor of every path."""
    parts = F.split("path", "/")
    every = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("directory")).where(F.col("directory") != "")
    return every.groupBy("directory").agg(F.count("*").alias("n_files"))


def same_directory(a: str, b: str):
    return directory(F.col(a)) == directory(F.col(b))

"""Versioned facts: days of events as revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history
from ..projections import SNAPSHOTS
from ..registry import query

ATTRS = ["node_kind", "file_path", "content_hash"]
VERSIONS = """, num AS (SELECT revision, row_number() OVER (ORDER BY revision) AS k, lead(revision) OVER (ORDER BY revision) AS nxt FROM (SELECT DISTINCT revision FROM snaps)),
 r AS (SELECT s.*, k, nxt, CASE WHEN lag(k) OVER w = k - 1 AND lag(node_kind) OVER w = node_kind AND lag(file_path) OVER w = file_path AND lag(content_hash) OVER w = content_hash THEN 0
 ELSE 1 END AS fresh FROM snaps s JOIN num USING (revision) WINDOW w AS (PARTITION BY stable_id ORDER BY revision)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY stable_id ORDER BY revision) AS island FROM r),
 ver AS (SELECT stable_id, node_kind, file_path, content_hash, min(revision) AS valid_from, max_by(nxt, revision) IS NULL AS is_open, CASE
 WHEN max(coalesce(nxt, 99)) = 99 THEN NULL ELSE max(nxt) - 1 END AS valid_to FROM i GROUP BY stable_id, island, node_kind, file_path, content_hash)"""


@query("snaps", VERSIONS + " SELECT stable_id, node_kind, file_path, content_hash, valid_from, valid_to FROM ver")
def scd2_versions(snaps: DataFrame) -> DataFrame:
    return history.versions(snaps, ATTRS)


@query("snaps", VERSIONS + " SELECT stable_id, node_kind, file_path, content_hash, valid_from, valid_to FROM ver WHERE valid_from <= 11 AND (valid_to IS NULL OR valid_to >= 11)")
def scan_snapshot_as_of(snaps: DataFrame) -> DataFrame:
    return history.as_of(history.versions(snaps, ATTRS), 11)


@query("snaps", """ SELECT stable_id, node_kind, file_path, content_hash, CAST(valid_from AS BIGINT) AS valid_from, CAST(valid_to AS BIGINT) AS valid_to FROM (
 SELECT a.stable_id, a.node_kind, a.file_path, a.content_hash, 1 AS valid_from, CASE
 WHEN b.stable_id IS NULL OR (a.node_kind, a.file_path, a.content_hash) != (b.node_kind, b.file_path, b.content_hash) THEN 1 END AS valid_to FROM (SELECT * FROM snaps
 WHERE revision = 1) a LEFT JOIN (SELECT * FROM snaps WHERE revision = 2) b USING (stable_id)
 UNION ALL SELECT b.stable_id, b.node_kind, b.file_path, b.content_hash, 2, NULL FROM (SELECT * FROM snaps WHERE revision = 2) b LEFT JOIN (SELECT * FROM snaps
 WHERE revision = 1) a USING (stable_id) WHERE a.stable_id IS NULL OR (a.node_kind, a.file_path, a.content_hash) != (b.node_kind, b.file_path, b.content_hash))""")
def scd2_commit(snaps: DataFrame) -> DataFrame:
    first = snaps.where("revision = 1").select("stable_id", *ATTRS, F.lit(1).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return history.commit_versions(first, snaps.where("revision = 2"), ATTRS, 2)


@query("snaps", " SELECT stable_id, min(revision) AS first_seen, max(revision) AS last_seen FROM snaps GROUP BY 1")
def graph_identities(snaps: DataFrame) -> DataFrame:
    return history.identities(snaps)


@query("snaps", " SELECT stable_id, max(revision) AS revision, max_by(content_hash, revision) AS content_hash FROM snaps WHERE revision <= 20 GROUP BY 1")
def lifecycle_as_of(snaps: DataFrame) -> DataFrame:
    return history.latest_state(snaps.select("stable_id", "revision", "content_hash"), "stable_id", ["revision"], 20)


@query("snaps", """ SELECT stable_id, CASE WHEN a.revision IS NULL THEN 'added' WHEN b.revision IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM snaps
 WHERE revision = 3) a FULL JOIN (SELECT * FROM snaps WHERE revision = 4) b USING (stable_id)
 WHERE a.revision IS NULL OR b.revision IS NULL OR (a.node_kind, a.file_path, a.content_hash) != (b.node_kind, b.file_path, b.content_hash)""")
def revision_delta(snaps: DataFrame) -> DataFrame:
    return history.revision_delta(snaps.where("revision = 3"), snaps.where("revision = 4"), ATTRS)


SYMBOLS = "SELECT CAST(day(ts) AS BIGINT) AS revision, concat('u', user_id) AS symbol_id, concat('sig', user_id % 7) AS signature_hash, event_type AS fingerprint_kind, CAST(count(*) AS VARCHAR(9)) AS fingerprint_hash FROM {events} GROUP BY day(ts), user_id, event_type"


@query("", """, t AS (SELECT revision, symbol_id, concat(min(signature_hash), '#', array_to_string(list_sort(list(concat(fingerprint_kind, ':', fingerprint_hash))), '|')) AS s
 FROM symbols WHERE revision IN (5, 6) GROUP BY 1, 2)
 SELECT symbol_id, CASE WHEN a.s IS NULL THEN 'Added' WHEN b.s IS NULL THEN 'Removed' ELSE 'Changed' END AS change FROM (SELECT * FROM t WHERE revision = 5) a FULL
 JOIN (SELECT * FROM t WHERE revision = 6) b USING (symbol_id) WHERE a.s IS DISTINCT FROM b.s""", symbols=SYMBOLS)
def public_surface_diff(symbols: DataFrame) -> DataFrame:
    return history.surface_diff(symbols.where("revision = 5"), symbols.where("revision = 6"))


#: two inventories of documents: in the second the sources swap names, some texts are edited and some are gone
BEFORE = "SELECT concat(source, '/', doc_id) AS path, lang AS language, n_chars AS bytes, md5(text) AS hash FROM {documents} WHERE doc_id % 11 != 3"
AFTER = "SELECT CASE WHEN doc_id % 5 = 0 THEN concat('moved/', doc_id) ELSE concat(source, '/', doc_id) END AS path, lang AS language, n_chars AS bytes, CASE WHEN doc_id % 7 = 0 THEN md5(concat(text, '!')) ELSE md5(text) END AS hash FROM {documents} WHERE doc_id % 13 != 4"
INVENTORY = """, st AS (SELECT path, (a.language, a.bytes, a.hash) AS x, (b.language, b.bytes, b.hash) AS y, CASE WHEN a.hash IS NULL THEN 'Added' WHEN b.hash IS NULL THEN 'Deleted'
 WHEN (a.language, a.bytes, a.hash) = (b.language, b.bytes, b.hash) THEN 'Unchanged' ELSE 'Changed' END AS status FROM bef a FULL JOIN aft b USING (path)),
 d AS (SELECT x AS key, min(path) AS moved_from FROM st WHERE status = 'Deleted' GROUP BY x HAVING count(*) = 1), n AS (SELECT y AS key, min(path) AS path FROM st
 WHERE status = 'Added' GROUP BY y HAVING count(*) = 1), mv AS (SELECT path, moved_from FROM d JOIN n USING (key)),
 inv AS (SELECT path, status, CAST(NULL AS VARCHAR) AS moved_from FROM st WHERE path NOT IN (SELECT path FROM mv) AND path NOT IN (SELECT moved_from FROM mv) UNION ALL
 SELECT path, 'Moved', moved_from FROM mv)"""


@query("", INVENTORY + " SELECT * FROM inv", bef=BEFORE, aft=AFTER)
def inventory_diff(bef: DataFrame, aft: DataFrame) -> DataFrame:
    return history.inventory_diff(bef, aft)


HOOKED = "SELECT concat(source, '/', doc_id) AS path FROM {documents} WHERE doc_id % 3 = 0"


@query("", INVENTORY + ", c AS (SELECT path, status FROM inv WHERE status != 'Unchanged') SELECT path, CASE WHEN status IS NULL THEN 'reported' WHEN h.p IS NOT NULL THEN concat('confirmed_', lower(status)) ELSE concat('unreported_', lower(status)) END AS category FROM c FULL JOIN (SELECT path, 1 AS p FROM hooked) h USING (path)", bef=BEFORE, aft=AFTER, hooked=HOOKED)
def changed_paths(bef: DataFrame, aft: DataFrame, hooked: DataFrame) -> DataFrame:
    return history.changed_paths(bef, aft, hooked)


TOK = "list_distinct(list_transform(list_filter(string_split_regex(regexp_replace({0}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '[.:/\\\\_\\- ]+'), lambda t: t != ''), lambda t: upper(t)))"


def jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)"


@query("snaps", VERSIONS + f""", old AS (SELECT stable_id AS former_id, valid_to AS removed_at, content_hash AS h, {TOK.format('node_kind')} AS n, {TOK.format('file_path')} AS p FROM ver
 WHERE valid_to < 28 ORDER BY valid_to DESC, stable_id, valid_from LIMIT 500),
 cur AS (SELECT stable_id, content_hash, {TOK.format('node_kind')} AS n2, {TOK.format('file_path')} AS p2 FROM snaps WHERE revision = 28),
 m AS (SELECT stable_id, former_id, removed_at, list_filter([CASE WHEN stable_id = former_id THEN 1.0::DOUBLE END, {jac('n2', 'n')}, {jac('p2', 'p')}, CASE
 WHEN content_hash = h THEN 1.0::DOUBLE END], lambda x: x > 0) AS parts FROM cur, old)
 SELECT stable_id, former_id, CAST(removed_at AS BIGINT) AS removed_at, round_even(list_sum(parts) / len(parts), 6) AS score, len(parts) AS kinds FROM m
 WHERE len(parts) >= 2 AND round_even(list_sum(parts) / len(parts), 6) >= 0.6""")
def reintroduced(snaps: DataFrame) -> DataFrame:
    return history.reintroduced(history.versions(snaps, ATTRS), snaps.where("revision = 28"), 28)


#: files of suppliers: some changed, some moved from where the customers of their nation are
CHANGES = """SELECT concat('src/', r_name, '/', n_name, '/supplier.cs') AS path, CASE n_nationkey % 3 WHEN 0 THEN 'Moved' WHEN 1 THEN 'Changed' ELSE 'Unchanged' END AS status,
CASE WHEN n_nationkey % 3 = 0 THEN concat('src/', r_name, '/', n_name, '/customer.cs') END AS moved_from FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""


@query("nodes edges", """, paths AS (SELECT path FROM changes WHERE status != 'Unchanged' UNION SELECT moved_from FROM changes WHERE moved_from IS NOT NULL),
 hit AS (SELECT stable_id FROM nodes WHERE file_path IN (SELECT path FROM paths)),
 touched AS (SELECT * FROM edges WHERE source IN (SELECT stable_id FROM hit) OR target IN (SELECT stable_id FROM hit)),
 affected AS (SELECT stable_id FROM hit UNION SELECT source FROM touched UNION SELECT target FROM touched)
 SELECT 'reason' AS kind, 'IncrementalReuse' AS value UNION ALL SELECT 'changed_path', path FROM paths UNION ALL SELECT 'deleted_path', moved_from FROM changes
 WHERE status = 'Moved' UNION ALL SELECT 'affected', stable_id FROM affected
 UNION ALL SELECT DISTINCT 'dependent_path', file_path FROM nodes WHERE stable_id IN (SELECT stable_id FROM affected) AND file_path NOT IN (SELECT path FROM paths)
 UNION ALL SELECT DISTINCT 'provider', edge_kind FROM touched UNION ALL SELECT DISTINCT 'join_key', 'supply' FROM touched WHERE edge_kind = 'supplied_by'""", changes=CHANGES)
def incremental_plan(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    known = edges.withColumn("provider", F.col("edge_kind")).withColumn("join_key", F.when(F.col("edge_kind") == "supplied_by", "supply"))
    return history.incremental_plan(changes, nodes, known)


@query("nodes edges", """, rep AS (SELECT stable_id FROM nodes WHERE node_kind = 'supplier'),
 e AS (SELECT edge_id, source, target FROM edges WHERE source NOT IN (SELECT stable_id FROM rep) AND target NOT IN (SELECT stable_id FROM rep)
 UNION SELECT edge_id, source, target FROM edges WHERE edge_kind = 'references' AND source IN (SELECT stable_id FROM rep) UNION SELECT 'uses:s:1>x:2', 's:1', 'x:2')
 SELECT 'edge' AS fact, edge_id AS id, concat(source, '>', target) AS told FROM e UNION ALL SELECT 'node', stable_id, display_name FROM nodes
 WHERE node_kind != 'supplier'
 UNION ALL SELECT 'node', stable_id, upper(display_name) FROM nodes WHERE node_kind = 'supplier' UNION ALL SELECT 'node', 'x:2', 'two'""")
def reconcile_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Suppliers' files are read anew; of two nodes without a path one is named by an edge."""
    rows = nodes.select("stable_id", "display_name", "file_path").unionByName(nodes.sparkSession.sql("SELECT concat('x:', id) AS stable_id, if(id = 1, 'one', 'two') AS display_name, CAST(NULL AS STRING) AS file_path FROM range(1, 3)"))
    own = nodes.where("node_kind = 'supplier'")
    ends = edges.select("edge_id", "source", "target")
    fresh = edges.where("edge_kind = 'references' AND source LIKE 's:%'").select("edge_id", "source", "target").unionByName(nodes.sparkSession.sql("SELECT 'uses:s:1>x:2' AS edge_id, 's:1' AS source, 'x:2' AS target"))
    anew = own.select("stable_id", F.upper("display_name").alias("display_name"), "file_path")
    n, e = history.reconcile_facts(rows, ends, anew, fresh, own.select(F.col("file_path").alias("path")))
    return e.select(F.lit("edge").alias("fact"), F.col("edge_id").alias("id"), F.concat_ws(">", "source", "target").alias("told")).unionByName(n.select(F.lit("node").alias("fact"), F.col("stable_id").alias("id"), F.col("display_name").alias("told")))


#: the first days' contents were stored without a hash
OLD_NODES = "SELECT revision, stable_id, node_kind, file_path, CASE WHEN revision > 3 THEN content_hash END AS content_hash FROM (" + SNAPSHOTS + ") AS s"
OLD_EDGES = """SELECT CAST(day(ts) AS BIGINT) AS revision, concat('u', user_id, '>', event_type) AS edge_id, concat('u', user_id) AS source, event_type AS target, CASE
 WHEN day(ts) < 9 THEN 'calls' ELSE 'uses' END AS edge_kind,
 CASE WHEN count(*) > 1 THEN 'many' END AS join_key FROM {events} GROUP BY day(ts), user_id, event_type"""


@query("", """, l AS (SELECT 'node' AS fact, stable_id AS id, concat_ws('|', node_kind, file_path, coalesce(content_hash,
 concat('legacy:', revision, ':', stable_id))) AS told, revision FROM olds
 UNION ALL SELECT 'edge', edge_id, concat_ws('|', source, target, edge_kind, join_key), revision FROM links)
 SELECT fact, id, told, revision AS valid_from, CASE WHEN revision != max(revision) OVER (PARTITION BY fact, id) THEN revision END AS valid_to FROM l
 UNION ALL SELECT 'node identity', stable_id, '', min(revision), max(revision) FROM olds GROUP BY stable_id
 UNION ALL SELECT 'edge identity', edge_id, max_by(concat_ws('|', source, target, edge_kind, join_key), revision), min(revision), max(revision) FROM links
 GROUP BY edge_id""", olds=OLD_NODES, links=OLD_EDGES)
def migrate_snapshots(olds: DataFrame, links: DataFrame) -> DataFrame:
    """Versions and identities of nodes and edges from snapshots of every day."""
    fixed = ["source", "target", "edge_kind", "join_key"]
    nodes, edges = history.migrated_versions(olds), history.migrated_versions(links, "edge_id")
    told = lambda df, fact, key, columns, a, b: df.select(F.lit(fact).alias("fact"), F.col(key).alias("id"), F.concat_ws("|", *columns).alias("told"), F.col(a).alias("valid_from"), F.col(b).alias("valid_to"))
    out = told(nodes, "node", "stable_id", ["node_kind", "file_path", "content_hash"], "valid_from", "valid_to").unionByName(told(edges, "edge", "edge_id", fixed, "valid_from", "valid_to"))
    out = out.unionByName(told(history.migrated_identities(olds), "node identity", "stable_id", [], "first_seen", "last_seen"))
    return out.unionByName(told(history.migrated_identities(links, "edge_id", fixed), "edge identity", "edge_id", fixed, "first_seen", "last_seen"))


#: an inventory of documents, the changes of one source's, and file nodes of those of the other sources that are long enough
PLANNED = "SELECT concat(source, '/', doc_id) AS path, lang AS language FROM {documents}"
EDITED = "SELECT concat(source, '/', doc_id) AS path, CASE WHEN n_chars < 900 THEN 'Deleted' ELSE 'Changed' END AS status, CAST(NULL AS VARCHAR(9)) AS moved_from FROM {documents} WHERE source = (SELECT min(source) FROM {documents})"
FILED = "SELECT concat('f:', doc_id) AS stable_id, concat(source, '/', doc_id) AS file_path, 'syntax' AS provider, 'file' AS node_kind, n_chars FROM {documents}"


@query("", """, c AS (SELECT path FROM edited), d AS (SELECT path FROM edited WHERE status = 'Deleted'), p AS (SELECT path FROM planned WHERE language = 'en'),
 f AS (SELECT unnest(['initial', 'uncovered']) AS asked),
 n AS (SELECT stable_id FROM filed WHERE file_path IN (SELECT path FROM c))
 SELECT 'none' AS asked, 'reason' AS kind, 'NoSourceChanges' AS value UNION ALL SELECT 'initial', 'reason', 'InitialScan' UNION ALL
 SELECT 'uncovered', 'reason', 'SnapshotCoverageUnavailable' UNION ALL SELECT 'covered', 'reason', 'IncrementalReuse'
 UNION ALL SELECT asked, 'changed_path', path FROM c, f UNION ALL SELECT asked, 'deleted_path', path FROM d, f UNION ALL SELECT asked, 'parse', path FROM p, f
 UNION ALL SELECT 'covered', 'changed_path', path FROM c UNION ALL SELECT 'covered', 'deleted_path', path FROM d UNION ALL SELECT 'covered', 'parse', path FROM p
 WHERE path IN (SELECT path FROM c) UNION ALL SELECT 'covered', 'affected', stable_id FROM n""", planned=PLANNED, edited=EDITED, filed=FILED)
def incremental_reasons(planned: DataFrame, edited: DataFrame, filed: DataFrame) -> DataFrame:
    """The four reasons of a plan: nothing changed, no revision yet, a file that no revision covers, and reuse."""
    edges = edited.sparkSession.createDataFrame([], "edge_id string, source string, target string, provider string, join_key string")
    plan = lambda name, changes, nodes: history.incremental_plan(changes, nodes, edges, planned, "en", "syntax").select(F.lit(name).alias("asked"), "*")
    out = plan("none", edited.where("false"), filed).unionByName(plan("initial", edited, None))
    return out.unionByName(plan("uncovered", edited, filed.where("n_chars > 1200"))).unionByName(plan("covered", edited, filed))


@query("nodes edges", " SELECT stable_id FROM nodes WHERE node_kind = 'nation' UNION SELECT source FROM edges WHERE target IN (SELECT stable_id FROM nodes WHERE node_kind = 'nation')")
def staleness_plan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return history.staleness_plan(nodes.where("node_kind = 'nation'"), edges.where("edge_kind = 'references'"), edges.where("edge_kind != 'calls'"))


@query("page_paths", ", s AS (SELECT string_split(path, '/') AS parts FROM page_paths), e AS (SELECT array_to_string(parts[1:k], '/') AS directory FROM (SELECT parts, unnest(range(1, len(parts))) AS k FROM s)) SELECT directory, count(*) AS n_files FROM e WHERE directory != '' GROUP BY 1")
def important_directories(page_paths: DataFrame) -> DataFrame:
    return history.directory_prefixes(page_paths.where("path LIKE '%/%'"))

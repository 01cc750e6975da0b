"""Facts of three revisions, made from all events, through the version store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..llm.storage import Scratch
from ..operators import history
from ..registry import query
from ..sources.storage import checkpoint_folder
from ..sources.versioned import TABLES, VersionStore

#: a third of a month is a revision; what a user did how often is a node
COUNTS = """SELECT CAST(floor((day(ts) - 1) / 11) AS BIGINT) + 1 AS revision, concat('u', user_id, ':', event_type) AS stable_id,
 user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY floor((day(ts) - 1) / 11), user_id, event_type"""

FACTS = {
    "nodes": f"""SELECT revision, stable_id, event_type AS node_kind, concat('users/', user_id % 10, '/', event_type, '.cs') AS file_path,
 CAST(n AS VARCHAR(20)) AS content_hash FROM ({COUNTS}) AS c""",
    "edges": f"""SELECT a.revision, concat(a.stable_id, '>', b.event_type) AS edge_id, a.stable_id AS source, b.stable_id AS target, 'beside' AS edge_kind,
 CASE WHEN a.user_id % 2 = 0 THEN a.event_type END AS join_key, CAST(CASE WHEN a.n < b.n THEN 0.25 WHEN a.n = b.n THEN 0.5 ELSE 0.75 END AS DOUBLE) AS confidence
 FROM ({COUNTS}) AS a JOIN ({COUNTS}) AS b ON a.revision = b.revision AND a.user_id = b.user_id AND a.event_type < b.event_type""",
    "symbols": f"""SELECT revision, concat('sym:', stable_id) AS symbol_id, stable_id AS node_id, concat('Users.', event_type) AS fully_qualified_name,
 CASE WHEN n > 2 THEN 'public' ELSE 'private' END AS visibility, concat(event_type, '()') AS normalized_signature, CAST(n % 3 AS VARCHAR(9)) AS signature_hash
 FROM ({COUNTS}) AS c""",
    "fingerprints": f"""SELECT revision, concat('sym:', stable_id) AS symbol_id, 'members' AS fingerprint_kind, CAST(n % 2 AS VARCHAR(9)) AS fingerprint_hash,
 '[]' AS normalized_members_json FROM ({COUNTS}) AS c""",
}
#: id and attributes of a table's rows as text
TOLD = {
    "nodes": ("stable_id", "concat_ws('|', node_kind, file_path, content_hash)"),
    "edges": ("edge_id", "concat_ws('|', source, target, edge_kind, join_key, CAST(CAST(100 * confidence AS INT) AS VARCHAR(9)))"),
    "symbols": ("symbol_id", "concat_ws('|', node_id, fully_qualified_name, visibility, normalized_signature, signature_hash)"),
    "fingerprints": ("concat_ws('|', symbol_id, fingerprint_kind)", "concat_ws('|', fingerprint_hash, normalized_members_json)"),
}
REVISIONS = 3


def _committed(**facts: DataFrame) -> VersionStore:
    spark, scratch = facts["nodes"].sparkSession, Scratch(facts["nodes"].sparkSession, "facts")
    facts = {t: scratch.keep(df, t) for t, df in facts.items()}  # made once, not for each revision
    store = VersionStore(spark, f"{checkpoint_folder(spark)}/versions-{uuid.uuid4().hex[:12]}", buckets=8)
    for r in range(1, REVISIONS + 1):
        store.commit({t: df.where(F.col("revision") == r).drop("revision") for t, df in facts.items()}, f"run {r}", base=r - 1)
    return store


ROWS = ", f AS (" + " UNION ALL ".join(f"SELECT '{t}' AS fact, {k} AS id, {v} AS told, revision FROM {t}" for t, (k, v) in TOLD.items()) + ")"
ISLANDS = f"""{ROWS}, n AS (SELECT *, CASE WHEN lag(revision) OVER w = revision - 1 AND lag(told) OVER w = told THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY fact, id
 ORDER BY revision)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY fact, id ORDER BY revision) AS island FROM n)
 SELECT fact, id, told, min(revision) AS valid_from, CASE WHEN max(revision) < {REVISIONS} THEN max(revision) END AS valid_to, concat('run ', min(revision)) AS run_id
 FROM i GROUP BY fact, id, island, told"""


@query("", ISLANDS, **FACTS)
def commit_merge(**facts: DataFrame) -> DataFrame:
    """Three snapshots of four tables committed one after the other: every version of every fact."""
    store = _committed(**facts)
    parts = [store.versions(t).selectExpr(f"'{t}' AS fact", f"{k} AS id", f"{v} AS told", "valid_from", "valid_to", "run_id") for t, (k, v) in TOLD.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("", f"{ROWS} SELECT fact, id, min(revision) AS first_seen, max(revision) AS last_seen FROM f GROUP BY 1, 2", **FACTS)
def fact_identities(**facts: DataFrame) -> DataFrame:
    """First and last revision of every node, edge and symbol that ever was."""
    store = _committed(**facts)
    parts = [store.identities(t).selectExpr(f"'{t}' AS fact", f"concat_ws('|', {', '.join(TABLES[t].keys)}) AS id", "first_seen", "last_seen") for t in TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("", """, a AS (SELECT * FROM nodes WHERE revision = 1), b AS (SELECT * FROM nodes WHERE revision = 3),
 net AS (SELECT count(*) FILTER (revision = 3) - count(*) FILTER (revision = 1) AS n FROM edges),
 d AS (SELECT stable_id, CASE WHEN a.revision IS NULL THEN 'added' WHEN b.revision IS NULL THEN 'removed' ELSE 'changed' END AS change,
 coalesce(b.node_kind, a.node_kind) AS node_kind, coalesce(b.file_path, a.file_path) AS file_path
 FROM a FULL JOIN b USING (stable_id) WHERE a.revision IS NULL OR b.revision IS NULL OR (a.node_kind, a.file_path, a.content_hash) != (b.node_kind, b.file_path, b.content_hash)),
 k AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY stable_id) AS k FROM d)
 SELECT change, stable_id, file_path, concat(node_kind, ' at ', file_path, '.') AS detail, greatest(0, n) AS added_edges, greatest(0, -n) AS removed_edges FROM k, net
 WHERE k <= 200""", nodes=FACTS["nodes"], edges=FACTS["edges"])
def change_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The first and the last revision: at most 200 nodes of each kind of change."""
    at = lambda df, r: df.where(F.col("revision") == r).drop("revision")
    return history.change_summary(at(nodes, 1), at(nodes, 3), at(edges, 1), at(edges, 3), 200)

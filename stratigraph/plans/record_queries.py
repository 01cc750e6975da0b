"""Record stores over events, orders and the graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records
from ..registry import query

RUNS = "SELECT concat('r', user_id % 60) AS run_id, event_id, ts AS occurred_at, CASE WHEN event_id % 41 = 0 THEN 'succeeded' WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'cancelled' ELSE 'running' END AS state FROM {events}"
TARGETS = "SELECT concat('d', l_orderkey) AS decision_id, CAST(l_linenumber AS BIGINT) AS target_ordinal, concat('p', min(l_partkey)) AS target FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
DECIDED = "SELECT concat('d', o_orderkey) AS decision_id, o_orderdate AS occurred_at FROM {orders}"
OBSERVED = "SELECT concat('u', user_id % 40) AS left_id, concat('u', event_id % 40) AS right_id, CAST(day(ts) AS BIGINT) AS revision, ts AS observed_at, CAST(event_id % 100 AS DOUBLE) AS score FROM {events} WHERE user_id % 40 != event_id % 40"
OBSERVATIONS = ", obs AS (SELECT sha256(concat_ws(chr(31), least(left_id, right_id), greatest(left_id, right_id))) AS pair_id, least(left_id, right_id) AS left_id, greatest(left_id, right_id) AS right_id, revision, min_by(score, (observed_at, score)) AS score FROM seen GROUP BY 1, 2, 3, 4)"
MEMBERSHIP = "SELECT DISTINCT CAST(day(ts) AS BIGINT) % 3 AS revision, concat('c', user_id % 7) AS cluster_id, concat('u', user_id) AS stable_id, user_id AS member_ordinal FROM {events}"


@query("", " SELECT run_id, CASE WHEN bool_or(state = 'succeeded') THEN 'succeeded' ELSE max_by(state, (occurred_at, event_id)) END AS state, count(*) AS events FROM runs GROUP BY 1", runs=RUNS)
def run_lifecycle(runs: DataFrame) -> DataFrame:
    return records.run_states(runs)


@query("", ", p AS (SELECT *, (SELECT count(*) FROM decided) AS total FROM decided ORDER BY occurred_at DESC, decision_id DESC LIMIT 20 OFFSET 5) SELECT decision_id, total, coalesce(string_agg(target, ',' ORDER BY target_ordinal), '') AS targets FROM p LEFT JOIN targets USING (decision_id) GROUP BY 1, 2", decided=DECIDED, targets=TARGETS)
def decision_page(decided: DataFrame, targets: DataFrame) -> DataFrame:
    return records.decision_page(decided, targets, 20, 5)


@query("", " SELECT decision_id, target_ordinal, target FROM targets WHERE decision_id IN (SELECT decision_id FROM targets WHERE target = 'p7')", targets=TARGETS)
def decisions_about(targets: DataFrame) -> DataFrame:
    return records.decisions_about(targets, "p7")


@query("", OBSERVATIONS + " SELECT * FROM obs", seen=OBSERVED)
def observation_record(seen: DataFrame) -> DataFrame:
    return records.record_observations(seen)


@query("", OBSERVATIONS + " SELECT *, (SELECT count(*) FROM obs) AS total FROM obs ORDER BY revision, pair_id LIMIT 50 OFFSET 20", seen=OBSERVED)
def observation_page(seen: DataFrame) -> DataFrame:
    return records.observation_page(records.record_observations(seen), 50, 20)


@query("", OBSERVATIONS + " SELECT DISTINCT pair_id FROM obs WHERE left_id = 'u3' OR right_id = 'u3'", seen=OBSERVED)
def finding_lookup(seen: DataFrame) -> DataFrame:
    return records.findings_about(records.record_observations(seen), "u3")


@query("", " SELECT stable_id, cluster_id, concat('label', cluster_id) AS label FROM members WHERE revision = (SELECT max(revision) FROM members)", members=MEMBERSHIP)
def latest_clusters(members: DataFrame) -> DataFrame:
    named = members.select("revision", "cluster_id", F.concat(F.lit("label"), "cluster_id").alias("label")).distinct()
    return records.latest_clusters(members, named)


@query("", ", m AS (SELECT * FROM members WHERE cluster_id = 'c2') SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY member_ordinal, stable_id, revision LIMIT 30 OFFSET 3", members=MEMBERSHIP.replace("% 3 AS revision", "* 0 AS revision"))
def cluster_member_page(members: DataFrame) -> DataFrame:
    return records.member_page(members, "c2", 30, 3)


@query("", " SELECT stable_id, cluster_id, (SELECT max(revision) FROM members) != 1 AS stale, true AS historical FROM members WHERE revision = 0", members=MEMBERSHIP)
def similarity_cluster_get(members: DataFrame) -> DataFrame:
    return records.cluster_at(members, 0, 1)


@query("nodes edges", " SELECT DISTINCT concat('edge:', upper(sha256(concat_ws(chr(31), source, target, edge_kind, '')))) AS edge_identity, source, target, edge_kind FROM edges WHERE edge_kind IN ('contains', 'references', 'calls') AND source IN (SELECT stable_id FROM nodes WHERE provider != 'erp') AND target IN (SELECT stable_id FROM nodes WHERE provider != 'erp')")
def semantic_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return records.map_semantics(nodes.where("provider != 'erp'"), edges)


KINDS = "CASE node_kind WHEN 'region' THEN 'namespace' WHEN 'order' THEN 'namespace' WHEN 'supplier' THEN 'class' ELSE node_kind END"


@query("nodes syms", f""", n AS (SELECT stable_id, display_name, file_path, {KINDS} AS node_kind, regexp_matches(lower(file_path), '(^|/)(generated|obj)(/|$)|\\.(g|generated|designer)\\.cs$') AS made FROM nodes),
 kept AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS p FROM n WHERE NOT made), s AS (SELECT * FROM syms WHERE lower(visibility) = 'public'),
 t AS (SELECT 'Directory' AS kind, concat('directory:', d) AS stable_id, d AS display_name, 'DirectoryContainsSource' AS reason, file_path FROM (SELECT file_path, array_to_string(p[1:k], '/') AS d FROM (SELECT p, file_path, unnest(range(1, len(p))) AS k FROM kept))
 UNION ALL SELECT 'Module', 'module:src/ASIA', 'src/ASIA', 'ConfiguredModule', file_path FROM kept WHERE file_path LIKE 'src/ASIA/%'
 UNION ALL SELECT 'Namespace', stable_id, display_name, 'NamespaceDeclaration', file_path FROM n WHERE node_kind = 'namespace' AND NOT made
 UNION ALL SELECT CASE node_kind WHEN 'class' THEN 'PublicType' ELSE 'PublicApi' END, stable_id, fully_qualified_name, CASE node_kind WHEN 'class' THEN 'PublicTypeDeclaration' ELSE 'PublicApiDeclaration' END, file_path FROM n JOIN s ON node_id = stable_id WHERE NOT made)
 SELECT 'target' AS item, kind, stable_id, display_name, reason, count(DISTINCT file_path) AS sources FROM t GROUP BY kind, stable_id, display_name, reason
 UNION ALL SELECT DISTINCT 'excluded', NULL, concat('file:', file_path), file_path, 'generated-source', NULL FROM n WHERE made
 UNION ALL SELECT 'excluded', NULL, stable_id, display_name, 'generated-source', NULL FROM n WHERE made AND node_kind = 'namespace'""")
def important_nodes(nodes: DataFrame, syms: DataFrame) -> DataFrame:
    """Regions and orders as namespaces (the orders' files are generated), suppliers as types, parts as APIs, one configured module."""
    kinds = nodes.withColumn("node_kind", F.when(F.col("node_kind").isin("region", "order"), "namespace").when(F.col("node_kind") == "supplier", "class").otherwise(F.col("node_kind")))
    return records.important_nodes(kinds, syms, ["/src/ASIA/", "src/NOWHERE"])


SCORED = "SELECT concat('u', user_id) AS source_id, concat('e', event_id % 97) AS candidate_id, concat('f', user_id % 5) AS source_path, concat('f', event_id % 5) AS candidate_path, CAST(event_id % 100 AS DOUBLE) / 100 AS score FROM {events}"


@query("", ", b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, candidate_id) AS k FROM scored WHERE source_path != candidate_path AND score >= 0.6) SELECT source_id, candidate_id, score FROM b WHERE k = 1 ORDER BY score DESC, source_id LIMIT 3", scored=SCORED)
def post_edit_reuse(scored: DataFrame) -> DataFrame:
    return records.post_edit_reuse(scored)


@query("", " SELECT target, row_number() OVER (ORDER BY min(requested_at), target) AS position FROM requests WHERE target NOT IN (SELECT target FROM flying) GROUP BY 1", requests="SELECT concat('t', event_id % 400) AS target, ts AS requested_at FROM {events}", flying="SELECT concat('t', s_suppkey) AS target FROM {supplier}")
def regen_queue(requests: DataFrame, flying: DataFrame) -> DataFrame:
    return records.regeneration_queue(requests, flying)


SITES = "SELECT concat('u', user_id) AS source, concat('t', event_id % 50) AS target, 'di_consumes' AS edge_kind, concat('type_equality:', event_id % 3) AS join_key, CASE event_id % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'degraded' ELSE 'matched' END AS state, CASE event_id % 5 WHEN 0 THEN 'semantic' WHEN 1 THEN 'explicit_syntax' WHEN 2 THEN 'literal' ELSE 'advisory' END AS evidence FROM {events}"


@query("", """ SELECT concat('edge:', upper(sha256(concat_ws(chr(31), source, target, edge_kind, join_key)))) AS edge_identity, source, target, max(CASE evidence WHEN 'semantic' THEN 1.0::DOUBLE WHEN 'explicit_syntax' THEN 0.8::DOUBLE WHEN 'literal' THEN 0.65::DOUBLE ELSE 0.4::DOUBLE END) AS confidence FROM sites WHERE state = 'matched' GROUP BY source, target, edge_kind, join_key""", sites=SITES)
def provider_edges(sites: DataFrame) -> DataFrame:
    return records.emitted_edges(sites)


@query("", " SELECT finding_key, rationale, row_number() OVER (ORDER BY finding_key, rationale) AS line, concat('- ', finding_key, ': ', rationale) AS text FROM exc", exc="SELECT o_clerk_key AS finding_key, concat('order of ', o_custkey) AS rationale FROM (SELECT concat('order ', o_orderkey) AS o_clerk_key, o_custkey FROM {orders}) AS o")
def exception_notes(exc: DataFrame) -> DataFrame:
    return records.exception_notes(exc)


@query("", " SELECT batch_id, a, b FROM pairs x WHERE NOT EXISTS (SELECT 1 FROM pairs y WHERE y.batch_id = x.batch_id AND y.a = x.b AND y.b = x.a)", pairs="SELECT DISTINCT user_id AS batch_id, event_id % 6 AS a, event_id % 7 AS b FROM {events}")
def summary_batch_symmetry(pairs: DataFrame) -> DataFrame:
    return records.asymmetric_touches(pairs)

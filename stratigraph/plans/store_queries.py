"""Provider joins and append-only stores over events, orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, providers, rules, similarity, stores
from ..registry import query
from .rule_queries import BROKEN, HARD, LAYERS, MEMBER
from .similarity_queries import BEST, NODE_FACTS, REUSE

REGISTERED = "SELECT concat('p', p_partkey) AS source, concat('i', p_size % 4) AS target FROM {part} UNION ALL SELECT concat('p', p_partkey), concat('j', p_size % 3) FROM {part}"
CONSUMED = """, inside AS (SELECT file_path, name AS consumer_type, min(stable_id) AS source FROM types GROUP BY 1, 2 HAVING count(*) = 1), anywhere AS (SELECT name AS service_type,
 min(stable_id) AS target FROM types GROUP BY 1 HAVING count(*) = 1),
 reg AS (SELECT source AS target, count(DISTINCT target) AS n FROM registered GROUP BY 1), found AS (SELECT * FROM calls JOIN inside USING (file_path, consumer_type)
 LEFT JOIN anywhere USING (service_type) LEFT JOIN reg USING (target))"""
SPARSE_TYPES = "SELECT concat('p', p_partkey) AS stable_id, concat('T', p_partkey) AS name, concat('f', p_partkey % 50, '.cs') AS file_path FROM {part} UNION ALL SELECT concat('q', s_suppkey), concat('T', 3 * s_suppkey), concat('f', s_suppkey % 50, '.cs') FROM {supplier}"
CONSUMERS = "SELECT o_orderkey AS site_id, concat('f', o_custkey % 50, '.cs') AS file_path, concat('T', o_custkey) AS consumer_type, concat('T', o_orderkey % 3000) AS service_type FROM {orders}"


@query("", CONSUMED + " SELECT DISTINCT concat('edge:', upper(sha256(concat_ws(chr(31), source, target, 'di_consumes', service_type)))) AS edge_identity, source, target, service_type AS join_key, 0.8::DOUBLE AS confidence FROM found WHERE n IS NOT NULL",
    calls=CONSUMERS, types=SPARSE_TYPES, registered=REGISTERED)
def dependency_consumptions(calls: DataFrame, types: DataFrame, registered: DataFrame) -> DataFrame:
    return providers.dependency_consumptions(calls, types, registered)[0]


@query("", CONSUMED + """ SELECT site_id, CASE WHEN target IS NULL THEN 'unresolved_constructor_dependency' WHEN n IS NULL THEN 'unregistered_constructor_dependency'
 ELSE 'ambiguous_di_registration' END AS diagnostic
 FROM found WHERE target IS NULL OR n IS NULL OR n > 1""", calls=CONSUMERS, types=SPARSE_TYPES, registered=REGISTERED)  # fmt: skip
def dependency_diagnostics(calls: DataFrame, types: DataFrame, registered: DataFrame) -> DataFrame:
    return providers.dependency_consumptions(calls, types, registered)[1]


PLACES = "SELECT o_orderkey AS site_id, concat('f', o_orderkey % 101, '.cs') AS file_path, CAST(o_custkey % 600 AS INT) AS line, CAST(o_orderkey % 80 AS INT) AS column FROM {orders}"
SCOPES = "SELECT concat('m', l_partkey % 4000, '.', l_linenumber) AS symbol_id, concat('f', l_partkey % 100, '.cs') AS file_path, CAST(min(l_partkey) % 500 AS INT) AS start_line, 4 AS start_column, CAST(min(l_partkey) % 500 + 3 * l_linenumber * l_linenumber AS INT) AS end_line, 40 AS end_column FROM {lineitem} GROUP BY l_partkey % 4000, l_partkey % 100, l_linenumber"


@query("", """, held AS (SELECT site_id, symbol_id, (end_line - start_line)::BIGINT * 1000000 + end_column - start_column AS span FROM places JOIN scopes USING (file_path)
 WHERE (line, places.column) >= (start_line, start_column) AND (line, places.column) <= (end_line, end_column))
 SELECT site_id, id AS symbol_id FROM places LEFT JOIN (SELECT site_id, min_by(symbol_id, (span, symbol_id)) AS id FROM held GROUP BY 1) USING (site_id)""", places=PLACES, scopes=SCOPES)  # fmt: skip
def call_site_scope(places: DataFrame, scopes: DataFrame) -> DataFrame:
    return providers.smallest_scope(places, scopes)


#: nodes are line ranges of documents, declarations are pages, both spread over as many files as there are customers
SPANS = "SELECT concat('d', doc_id) AS stable_id, concat('f', n_chars % 400) AS path, CAST(doc_id % 100 AS INT) AS start_line, CAST(doc_id % 100 + 30 AS INT) AS end_line FROM {documents}"
DECLARED = """SELECT concat('f', page_id % 400) AS path, CAST(page_id % 110 AS INT) AS decl_start, CAST(page_id % 110 + page_id % 25 AS INT) AS decl_end, page_id % 3 = 0 AS is_type,
 CASE page_id % 2 WHEN 0 THEN 'ClassDeclaration' ELSE 'StructDeclaration' END AS declaration_kind, concat('void M', page_id, '()') AS signature, CASE
 WHEN page_id % 5 > 0 THEN concat('/// page ', page_id) END AS documentation,
 CASE WHEN page_id % 17 = 0 THEN '  ' ELSE concat(' [ ', url, ' ] ') END AS body, url AS text FROM {pages}"""
ELIGIBLE = "SELECT concat('d', doc_id) AS stable_id, CASE WHEN quality = 1 THEN 'PublicApi' WHEN toxic = 1 THEN 'Module' ELSE 'PublicType' END AS kind FROM {labels}"


@query("", """, held AS (SELECT s.stable_id, s.path, d.* EXCLUDE (path) FROM spans s JOIN declared d USING (path)
 WHERE decl_start >= start_line AND decl_end <= end_line AND stable_id IN (SELECT stable_id FROM eligible WHERE kind != 'Module')),
 best AS (SELECT *, row_number() OVER (PARTITION BY stable_id ORDER BY NOT is_type, length(text), decl_start, decl_end) AS k FROM held),
 told AS (SELECT stable_id, path, CASE WHEN is_type THEN concat('declaration: ', declaration_kind, chr(10), 'documentation: ', documentation, chr(10), 'source:', chr(10), trim(text))
 WHEN trim(body) != '' THEN concat('signature: ', signature, chr(10), 'documentation: ', documentation, chr(10), 'body:', chr(10), trim(body)) END AS content FROM best
 WHERE k = 1)
 SELECT stable_id, path, content, upper(sha256(content)) AS content_hash FROM told WHERE content IS NOT NULL""", spans=SPANS, declared=DECLARED, eligible=ELIGIBLE)  # fmt: skip
def chunk_select(spans: DataFrame, declared: DataFrame, eligible: DataFrame) -> DataFrame:
    return providers.embedding_chunks(spans, declared, eligible)


#: keys of all events: each fault of the contract, one by one, and valid keys of the four strategies
KEYED = """SELECT event_id AS site_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END AS capture_name, CASE event_id % 5 WHEN 0 THEN 'TypeEquality'
 WHEN 1 THEN 'StringEquality' WHEN 2 THEN 'CanonicalPattern' WHEN 3 THEN 'ConfigurationPath' ELSE 'Guess' END AS strategy,
 concat(' ', event_type) AS raw_value, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS normalized_value, CASE WHEN event_id % 3 = 0 THEN 'csharp-symbol/v2'
 WHEN event_id % 17 = 0 THEN '' ELSE 'text' END AS normalizer_id, user_id % 6 AS way,
 CASE WHEN event_id % 19 = 0 THEN 'provider-join-key/v0' END AS schema_version FROM {events}"""
#: steps by way: none, a placeholder, a separator and a placeholder, a placeholder twice, a blank kind, no list
STEPS = "SELECT * FROM (VALUES (0, ''), (1, 'placeholder=id'), (2, 'separator=:|placeholder=x'), (3, 'placeholder=a|placeholder=a'), (4, '=a'), (5, NULL)) AS t(way, said)"


@query("", """, parts AS (SELECT keyed.*, said, list_filter(string_split(said, '|'), lambda x: x != '') AS steps FROM keyed JOIN steps USING (way)),
 p AS (SELECT site_id, coalesce(schema_version, 'provider-join-key/v1') AS schema_version, steps, CASE WHEN schema_version IS NOT NULL THEN 'unsupported_schema'
 WHEN trim(capture_name) = '' OR strategy = 'Guess' OR normalized_value IS NULL OR normalizer_id = '' OR said IS NULL OR said = '=a' THEN 'incomplete'
 WHEN len(list_distinct(steps)) != len(steps) THEN 'repeated_step'
 WHEN strategy = 'TypeEquality' AND NOT starts_with(normalizer_id, 'csharp-symbol') THEN 'symbol_normalizer_needed'
 WHEN strategy = 'CanonicalPattern' AND NOT contains(said, 'placeholder=') THEN 'placeholder_needed'
 WHEN strategy = 'ConfigurationPath' AND NOT contains(said, 'separator=') THEN 'separator_needed' END AS problem FROM parts)
 SELECT site_id, schema_version, CASE WHEN problem IS NULL THEN array_to_string(list_sort(steps), '|') END AS steps, problem FROM p""", keyed=KEYED, steps=STEPS)  # fmt: skip
def join_key_contract(keyed: DataFrame, steps: DataFrame) -> DataFrame:
    step = lambda s: F.struct(F.split_part(s, F.lit("="), F.lit(1)).alias("kind"), F.split_part(s, F.lit("="), F.lit(2)).alias("value"))
    listed = steps.select("way", F.transform(F.filter(F.split("said", "\\|"), lambda x: x != ""), step).alias("steps"))
    found = providers.join_keys(keyed.join(F.broadcast(listed), "way"))  # six rows
    return found.withColumn("steps", F.array_join(F.transform("steps", lambda s: F.concat_ws("=", s["kind"], s["value"])), "|"))


SUMMARY_VERSIONS = "SELECT concat('s', user_id) AS summary_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version_number, event_id AS version_id FROM {events}"


@query("", ", own AS (SELECT * FROM versions WHERE summary_id = 's3') SELECT *, (SELECT count(*) FROM own) AS total FROM own ORDER BY version_number LIMIT 20 OFFSET 4", versions=SUMMARY_VERSIONS)
def summary_page(versions: DataFrame) -> DataFrame:
    return stores.summary_page(versions, "s3", 20, 4)


@query("", " SELECT * FROM versions WHERE summary_id = 's5'", versions=SUMMARY_VERSIONS)
def summary_list(versions: DataFrame) -> DataFrame:
    return stores.summary_list(versions, "s5")


HEALTH = "SELECT event_id AS snapshot_id, CAST(day(ts) AS BIGINT) AS revision, concat('v', event_id % 2) AS calculation_version, ts AS recorded_at, value AS score FROM {events}"
COMPONENTS = "SELECT event_id AS snapshot_id, concat('c', k) AS component_key, event_id % 10 + k AS value FROM {events} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 0) AS t"
LINKED = "SELECT event_id AS snapshot_id, concat('d', event_id % 3) AS decision_id FROM {events} UNION ALL SELECT event_id, concat('d', event_id % 5) FROM {events}"


@query("", """, kept AS (SELECT revision, calculation_version, min_by(snapshot_id, (recorded_at, snapshot_id)) AS snapshot_id, min_by(score, (recorded_at, snapshot_id)) AS score
 FROM health GROUP BY 1, 2),
 parts AS (SELECT snapshot_id, string_agg(concat(component_key, '=', value), ',' ORDER BY component_key, value) AS components FROM components GROUP BY 1),
 told AS (SELECT snapshot_id, string_agg(DISTINCT decision_id, ',' ORDER BY decision_id) AS decision_ids FROM linked GROUP BY 1)
 SELECT revision, calculation_version, snapshot_id, score, coalesce(components, '') AS components, coalesce(decision_ids, '') AS decision_ids FROM kept LEFT
 JOIN parts USING (snapshot_id) LEFT JOIN told USING (snapshot_id)""",
    health=HEALTH, components=COMPONENTS, linked=LINKED)
def health_record(health: DataFrame, components: DataFrame, linked: DataFrame) -> DataFrame:
    return stores.health_record(health, components, linked)


@query("", ", own AS (SELECT * FROM components WHERE snapshot_id = (SELECT min(snapshot_id) FROM components)) SELECT *, (SELECT count(*) FROM own) AS total FROM own ORDER BY component_key LIMIT 2 OFFSET 1", components=COMPONENTS)
def health_component_page(components: DataFrame) -> DataFrame:
    return stores.health_component_page(components, components.agg(F.min("snapshot_id")).first()[0], 2, 1)


OFFERED = "SELECT CAST(day(ts) AS BIGINT) AS revision, concat('a', event_id % 2) AS algorithm, CAST(1 AS BIGINT) AS version, concat('h', event_id % 3) AS hash, ts AS created_at, event_id AS set_id, event_type AS label FROM {events}"
ONCE = ", kept AS (SELECT * FROM offered QUALIFY row_number() OVER (PARTITION BY revision, algorithm, version, hash ORDER BY created_at, set_id) = 1)"


@query("", ONCE + " SELECT * FROM kept", offered=OFFERED)
def similarity_cluster_store(offered: DataFrame) -> DataFrame:
    return stores.cluster_store(offered)


@query("", ONCE + " SELECT * FROM kept WHERE revision = 7 ORDER BY created_at DESC, set_id DESC LIMIT 1", offered=OFFERED)
def similarity_cluster_set_at(offered: DataFrame) -> DataFrame:
    return stores.cluster_sets_at(stores.cluster_store(offered), 7)


DECIDED = "SELECT concat('d', event_id % 400) AS decision_id, concat('s', user_id) AS session_id, ts AS occurred_at, event_type AS resolution FROM {events}"
AIMED = "SELECT concat('d', o_orderkey % 400) AS decision_id, CAST(o_orderkey AS BIGINT) AS target_ordinal, concat('t', o_custkey) AS target FROM {orders}"
FIRST = ", kept AS (SELECT * FROM decided QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY occurred_at, resolution, session_id) = 1), told AS (SELECT decision_id, string_agg(target, ',' ORDER BY target_ordinal, target) AS targets FROM aimed GROUP BY 1)"


@query("", FIRST + " SELECT decision_id, occurred_at, session_id, resolution, coalesce(targets, '') AS targets FROM kept LEFT JOIN told USING (decision_id)", decided=DECIDED, aimed=AIMED)
def decision_record(decided: DataFrame, aimed: DataFrame) -> DataFrame:
    return stores.record_decisions(decided.select("decision_id", "occurred_at", "resolution", "session_id"), aimed)[0]


@query("", FIRST + " SELECT session_id, 'decision_recorded' AS event_type, occurred_at, decision_id AS payload FROM kept", decided=DECIDED, aimed=AIMED)
def decision_events(decided: DataFrame, aimed: DataFrame) -> DataFrame:
    return stores.record_decisions(decided.select("decision_id", "occurred_at", "resolution", "session_id"), aimed)[1]


@query("", " SELECT * FROM decided WHERE session_id = 's1'", decided=DECIDED)
def decision_list(decided: DataFrame) -> DataFrame:
    return stores.decision_list(decided, "s1")


LINKS = "SELECT concat('f', event_id % 300) AS finding_id, concat('d', event_id % 400) AS decision_id FROM {events}"
FOUND = "SELECT DISTINCT concat('f', s_suppkey % 250) AS finding_id FROM {supplier}"
RESOLVED = "SELECT concat('d', c_custkey) AS decision_id, CASE c_custkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'ignored' ELSE 'modified' END AS resolution FROM {customer}"


@query("", " SELECT finding_id, decision_id, resolution FROM found JOIN links USING (finding_id) JOIN resolved USING (decision_id)", found=FOUND, links=LINKS, resolved=RESOLVED)
def finding_resolutions(found: DataFrame, links: DataFrame, resolved: DataFrame) -> DataFrame:
    return stores.finding_resolutions(found, links, resolved)


GROUPED = "SELECT DISTINCT concat('c', user_id % 9) AS cluster_id, concat('u', user_id, ':', event_type) AS stable_id FROM {events}"


@query("snaps", """, seen AS (SELECT stable_id, min(revision) AS first_seen, max(revision) AS last_seen FROM snaps GROUP BY 1)
 SELECT cluster_id, stable_id, first_seen, last_seen, last_seen < (SELECT max(last_seen) FROM seen) AS gone FROM grouped JOIN seen USING (stable_id)""", grouped=GROUPED)  # fmt: skip
def similarity_member_identities(snaps: DataFrame, grouped: DataFrame) -> DataFrame:
    return stores.member_identities(grouped, history.identities(snaps))


OBSERVED = "SELECT concat('f', o_orderkey) AS finding_id, concat('c:', o_custkey) AS left_id, concat('o:', o_orderkey) AS right_id FROM {orders}"
SIGNALS = "SELECT concat('f', l_orderkey) AS finding_id, CASE l_linenumber % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'signature' ELSE 'structural' END AS kind, CAST(l_linenumber AS BIGINT) AS score FROM {lineitem}"
RULED = "SELECT concat('f', event_id) AS finding_id, ts AS occurred_at, event_id AS decision_id, CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'ignored' ELSE 'modified' END AS resolution FROM {events} UNION ALL SELECT concat('f', event_id), ts, event_id + 1, 'ignored' FROM {events}"


@query("nodes", """, told AS (SELECT finding_id, string_agg(concat(kind, ':', score), ',' ORDER BY kind, score) AS signals FROM signs GROUP BY 1),
 past AS (SELECT finding_id, string_agg(CAST(decision_id AS VARCHAR), ','
 ORDER BY occurred_at DESC, decision_id DESC) AS decisions, max_by(resolution, (occurred_at, decision_id)) = 'ignored' AS ignored FROM ruled GROUP BY 1)
 SELECT finding_id, a.display_name AS left_name, b.display_name AS right_name, coalesce(signals, '') AS signals, coalesce(decisions, '') AS decisions, CASE
 WHEN ignored THEN 'review_ignored' ELSE 'decide' END AS advice
 FROM observed JOIN nodes a ON a.stable_id = left_id JOIN nodes b ON b.stable_id = right_id LEFT JOIN told USING (finding_id) LEFT JOIN past USING (finding_id)""", observed=OBSERVED, signs=SIGNALS, ruled=RULED)  # fmt: skip
def duplicate_inspection(nodes: DataFrame, observed: DataFrame, signs: DataFrame, ruled: DataFrame) -> DataFrame:
    return stores.inspection(observed, nodes, signs, ruled)


@query("", " SELECT count(*) FILTER (severity = 'ok') AS healthy, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') AS errors, CASE WHEN bool_or(severity = 'error') THEN 'error' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'ok' END AS state FROM checks",
    checks="SELECT event_id AS check_id, CASE event_type WHEN 'click' THEN 'warning' WHEN 'error' THEN 'error' ELSE 'ok' END AS severity FROM {events}")
def doctor_counts(checks: DataFrame) -> DataFrame:
    return stores.doctor_counts(checks)


@query("nodes edges syms", NODE_FACTS + BEST.replace("LIMIT 20", "LIMIT 3") + REUSE + BROKEN + " SELECT (SELECT count(*) FROM told) AS candidates, (SELECT count(*) FROM told WHERE decision = 'Reuse') AS reuse, (SELECT count(*) FROM broken) AS violations, (SELECT count(*) FROM broken) > 0 AS blocked")
def preflight_change(nodes: DataFrame, edges: DataFrame, syms: DataFrame) -> DataFrame:
    best = similarity.find_similar(similarity.similarity_facts(nodes, None, syms), "p:7", 3, edges)
    return stores.preflight(similarity.explain_reuse(best, nodes, syms, "p:7"), rules.layer_violations(nodes, edges, LAYERS, HARD))


LINES = [f"- {n}: {', '.join(i)} may depend on {', '.join(m) or 'nothing'}" for n, (i, m) in sorted(LAYERS.items())]
NAMES = sorted(LAYERS)


@query("nodes", MEMBER + f""" SELECT CAST(k AS BIGINT) AS ordinal, name AS layer, line AS text, (SELECT count(*) FROM ms WHERE ms.layer = name) AS nodes
 FROM (SELECT unnest(range(0, {len(LINES)})) AS k, unnest({NAMES}) AS name, unnest([{", ".join(f"'{x}'" for x in LINES)}]) AS line)""")
def layer_conventions(nodes: DataFrame) -> DataFrame:
    return stores.layer_conventions(LAYERS, rules.layer_membership(nodes, LAYERS))

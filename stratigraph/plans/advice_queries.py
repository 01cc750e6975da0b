"""Placement, health, planning, joins of providers, and session records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advice, similarity
from ..registry import query
from ..streaming import sessions
from .similarity_queries import BEST, NODE_FACTS, REUSE


@query("baskets", " SELECT a.path AS left_path, b.path AS right_path, count(*) AS commits, round_even(count(*)::DOUBLE / 1000, 6) AS score FROM baskets a JOIN baskets b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 2")
def cochange(baskets: DataFrame) -> DataFrame:
    return advice.cochange(baskets)


MEMBERS = "SELECT concat('m', lpad(CAST(k AS VARCHAR(9)), 2, '0')) AS stable_id, concat('g', k % 4) AS community FROM (SELECT DISTINCT l_partkey % 40 AS k FROM {lineitem}) AS t"


@query("", """, e AS (SELECT s.community AS sc, t.community AS tc, least(greatest(confidence, 0.0), 1.0) AS w FROM pairs JOIN members s ON s.stable_id = source
 JOIN members t ON t.stable_id = target), x AS (SELECT sc AS c, w, sc = tc AS i FROM e UNION ALL SELECT tc, w, false FROM e WHERE sc != tc),
 g AS (SELECT c AS community, coalesce(sum(w) FILTER (i), 0) AS a, coalesce(sum(w) FILTER (NOT i), 0) AS b FROM x GROUP BY 1)
 SELECT community, round(a, 4) AS inside, round(b, 4) AS boundary, round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END, 4) AS cohesion FROM g""",
    pairs="SELECT concat('m', lpad(CAST(l_partkey % 40 AS VARCHAR(9)), 2, '0')) AS source, concat('m', lpad(CAST(l_suppkey % 40 AS VARCHAR(9)), 2, '0')) AS target, CAST(1.0 AS DOUBLE) - l_discount AS confidence FROM {lineitem}", members=MEMBERS)
def module_cohesion(pairs: DataFrame, members: DataFrame) -> DataFrame:
    return advice.cohesion(pairs, members).select("community", *[F.round(c, 4).alias(c) for c in ("inside", "boundary", "cohesion")])


@query("", """, g AS (SELECT subject, cluster, sum(confidence) AS c FROM deps GROUP BY 1, 2), s AS (SELECT *, round(c / sum(c) OVER (PARTITION BY subject), 6) AS score FROM g),
 r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS nxt FROM s WINDOW w AS (PARTITION BY subject ORDER BY score DESC, cluster))
 SELECT subject, cluster, score, round(score - nxt, 6) AS gap, score < 0.5 OR round(score - nxt, 6) < 0.15 AS abstained FROM r WHERE k = 1""",
    deps="SELECT concat('o', l_orderkey) AS subject, concat('b', l_partkey % 25) AS cluster, CAST(l_linenumber AS DOUBLE) AS confidence FROM {lineitem}")
def placement_overlap(deps: DataFrame) -> DataFrame:
    return advice.placement_overlap(deps)


MODULES = "SELECT concat('c', c_custkey) AS module, c_custkey % 50 AS members, CAST(c_custkey % 100 AS DOUBLE) / 100 AS cohesion, c_custkey % 30 AS fan_out, c_nationkey % 2 = 0 AS named FROM {customer}"


@query("", " SELECT module, CASE WHEN members >= 24 AND cohesion <= 0.45 AND fan_out >= 12 AND named THEN 'CreateNewFile' WHEN members < 24 AND cohesion > 0.45 THEN 'Append' ELSE 'Abstain' END AS advice FROM modules", modules=MODULES)
def split_append(modules: DataFrame) -> DataFrame:
    return advice.split_or_append(modules)


TYPES = "SELECT concat('src/n', s_nationkey, '/', CASE WHEN s_nationkey % 2 = 0 THEN 'Order' ELSE concat('Item', s_suppkey) END, CASE WHEN s_nationkey % 3 = 0 THEN 'Handler' ELSE 'Reader' END, '.cs') AS file_path, concat(CASE WHEN s_nationkey % 2 = 0 THEN 'Order' ELSE concat('Item', s_suppkey) END, CASE WHEN s_nationkey % 3 = 0 THEN 'Handler' ELSE 'Reader' END) AS name FROM {supplier}"


@query("", """, t AS (SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, name, regexp_extract(file_path, '([^/.]*)[^/]*$', 1) AS stem, regexp_extract(name, '^\\p{Lu}?[^\\p{Lu}]*(\\p{Lu}.*)$', 1) AS suffix
 FROM types)
 SELECT directory, max(suffix) AS suffix, count(*) AS siblings FROM t GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT CASE
 WHEN suffix != '' THEN suffix END) = 1 AND bool_and(stem = name)""", types=TYPES)
def sibling_naming(types: DataFrame) -> DataFrame:
    return advice.sibling_naming(types)


DOC_ROWS = "SELECT concat('d', doc_id) AS stable_id, quality = 1 AS eligible, toxic = 0 AS ai, doc_id % 12 AS last_revision FROM {labels}"


@query("", ", totals AS (SELECT count(*) AS eligible, count(*) FILTER (12 - last_revision >= 5) AS stale, max(12 - last_revision) AS max_age FROM rows_ WHERE eligible AND ai) SELECT stable_id, 12 - last_revision AS age, eligible.eligible, stale, max_age FROM rows_, totals AS eligible WHERE rows_.eligible AND ai AND 12 - last_revision >= 5", rows_=DOC_ROWS)
def doc_debt(rows_: DataFrame) -> DataFrame:
    return advice.documentation_debt(rows_, 12)


HEALTH = "SELECT o_orderkey, o_orderkey % 3 AS introduced, o_orderkey % 9 AS legacy, o_custkey % 14 AS duplicates, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS documentation, CAST(o_custkey % 11 AS DOUBLE) / 10 AS decisions FROM {orders}"


@query("", """, r AS (SELECT *, least(1.0, (introduced + legacy) / 10::DOUBLE)::DOUBLE AS architecture_raw, least(1.0, duplicates / 10::DOUBLE)::DOUBLE AS duplicate_raw FROM h),
 s AS (SELECT *, round(100 * (1 - (round_even(architecture_raw * 0.4::DOUBLE, 6) + round_even(duplicate_raw * 0.2::DOUBLE, 6) + round_even(documentation * 0.2::DOUBLE, 6) + round_even(decisions * 0.2::DOUBLE, 6))), 2) AS sc
 FROM r)
 SELECT o_orderkey, introduced, legacy, duplicates, documentation, decisions, architecture_raw, duplicate_raw, CASE WHEN introduced > 0 THEN least(sc, 49.0::DOUBLE)
 ELSE sc END AS score FROM s""", h=HEALTH)
def health_score(h: DataFrame) -> DataFrame:
    return advice.health_score(h)


@query("", " SELECT * FROM parts ORDER BY confidence DESC, kind, target LIMIT 10", parts="SELECT event_type AS kind, concat('u', user_id) AS target, round(value, 2) AS confidence FROM {events} GROUP BY event_type, user_id, round(value, 2)")
def unified_advisories(parts: DataFrame) -> DataFrame:
    return advice.unified_advisories(parts)


SUMMARIES = "SELECT concat('src/', lang, '/', source, '/f', doc_id, '.md') AS path, concat('s', doc_id) AS id, text, CASE WHEN doc_id % 4 = 0 THEN 'Stale' ELSE 'Fresh' END AS state FROM {documents}"


@query("", """, e AS (SELECT path, id, text, unnest([array_to_string(p[1:1], '/'), array_to_string(p[1:2], '/'), array_to_string(p[1:3], '/')]) AS directory
 FROM (SELECT *, string_split(path, '/') AS p FROM summaries WHERE state = 'Fresh'))
 SELECT directory, count(*) OVER (PARTITION BY directory) AS n, row_number() OVER (PARTITION BY directory ORDER BY path, id) AS place, path, id, text FROM e""", summaries=SUMMARIES)
def directory_rollup(summaries: DataFrame) -> DataFrame:
    return advice.directory_rollup(summaries)


@query("", " SELECT session_id, string_agg(concat('- ', diff, ' (summary ', version, '; target ', target, ')'), chr(10) ORDER BY target, version, diff) AS text FROM changes GROUP BY 1", changes="SELECT concat('s', user_id) AS session_id, concat('t', event_id) AS target, event_id % 7 AS version, event_type AS diff FROM {events}")
def session_changelog(changes: DataFrame) -> DataFrame:
    return advice.changelog(changes)


@query("sess", """, f AS (SELECT session_id, event_type AS path, min(sequence_number) AS k FROM sess GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id
 ORDER BY k, path) AS r FROM f)
 SELECT session_id, string_agg(path, ',' ORDER BY r) AS paths FROM r WHERE r <= 8 GROUP BY 1""")
def session_context(sess: DataFrame) -> DataFrame:
    return advice.session_context(sess.withColumnRenamed("event_type", "path"))


@query("sess", """, f AS (SELECT session_id, event_type AS target, min(sequence_number) AS k FROM sess GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY session_id
 ORDER BY k, target) AS ordinal, count(*) OVER (PARTITION BY session_id) AS n FROM f)
 SELECT session_id, target, ordinal, array_to_string(list_filter(range(1, n + 1), lambda i: i != ordinal), ',') AS co_touched FROM o""")
def touched_batch(sess: DataFrame) -> DataFrame:
    return advice.touched_batches(sess.withColumnRenamed("event_type", "target"))


@query("sess", " SELECT session_id, event_id AS request_id, sequence_number <= 40 AND sum(tokens) OVER (PARTITION BY session_id ORDER BY sequence_number) <= 500 AS allowed FROM (SELECT *, event_id % 30 AS tokens FROM sess)")
def request_governor(sess: DataFrame) -> DataFrame:
    return advice.governed(sess.withColumn("tokens", F.col("event_id") % 30).withColumnRenamed("event_id", "request_id"), 40, 500)


@query("sess", " SELECT session_id AS summary_id, event_id AS version_id, sequence_number AS version_number, lag(event_id) OVER w AS supersedes, lead(event_id) OVER w IS NULL AS latest FROM sess WINDOW w AS (PARTITION BY session_id ORDER BY sequence_number)")
def summary_append(sess: DataFrame) -> DataFrame:
    return advice.summary_chain(sess.selectExpr("session_id AS summary_id", "event_id AS version_id", "occurred_at AS created_at"))


@query("sess", """, l AS (SELECT session_id AS work_id, max_by(event_type, sequence_number) AS t, max_by(occurred_at, sequence_number) AS at_ FROM sess GROUP BY 1)
 SELECT work_id, CASE WHEN t = (SELECT min(event_type) FROM sess) THEN 'completed' ELSE 'failed' END AS state, at_ AS next_attempt FROM l
 WHERE t != (SELECT min(event_type) FROM sess)""")
def failure_work(sess: DataFrame) -> DataFrame:
    first = sess.agg(F.min("event_type").alias("m"))
    rows = sess.crossJoin(F.broadcast(first)).select(F.col("session_id").alias("work_id"), F.col("sequence_number").alias("ordinal"), F.when(F.col("event_type") == F.col("m"), "completed").otherwise("failed").alias("state"), F.lit(None).cast("timestamp_ntz").alias("next_attempt"), F.col("occurred_at").alias("created_at"))
    return advice.failure_work(rows)


@query("", " SELECT count(*) AS chunks, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens FROM (SELECT * FROM docs ORDER BY id LIMIT 2048)", docs="SELECT doc_id AS id, text FROM {documents}")
def embedding_index(docs: DataFrame) -> DataFrame:
    return advice.token_budget(docs, 5000)


@query("", """, n AS (SELECT name, count(*) AS n, min(stable_id) AS id FROM types GROUP BY 1) SELECT site_id, name, CASE WHEN n = 1 THEN id END AS stable_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' END AS diagnostic FROM sites LEFT JOIN n USING (name)""",
    sites="SELECT event_id AS site_id, concat('T', event_id % 700) AS name FROM {events}", types="SELECT concat('c', c_custkey) AS stable_id, concat('T', c_custkey % 600 + c_nationkey % 2) AS name FROM {customer}")
def resolve_unique_names(sites: DataFrame, types: DataFrame) -> DataFrame:
    return advice.resolve_unique(sites, types)


@query("", " SELECT DISTINCT source, target, message, CASE WHEN target IS NULL THEN 'no_consumer' END AS diagnostic FROM (SELECT DISTINCT stable_id AS source, message FROM pub) p LEFT JOIN (SELECT DISTINCT stable_id AS target, message FROM con) c USING (message)",
    pub="SELECT concat('u', user_id) AS stable_id, concat('m', event_id % 90) AS message FROM {events}", con="SELECT concat('s', s_suppkey) AS stable_id, concat('m', s_suppkey % 70) AS message FROM {supplier}")
def message_contracts(pub: DataFrame, con: DataFrame) -> DataFrame:
    return advice.message_edges(pub, con)


KEYS = "SELECT concat(' App', user_id % 9, CASE WHEN event_id % 2 = 0 THEN '__' ELSE ':' END, ' ', event_type, CASE WHEN event_id % 50 = 0 THEN '::x' ELSE '' END) AS key FROM {events}"


@query("", """, k AS (SELECT 'r' AS w, list_transform(string_split(replace(key, '__', ':'), ':'), lambda x: trim(x)) AS p FROM reads UNION ALL
 SELECT 'd', list_transform(string_split(replace(key, '__', ':'), ':'), lambda x: trim(x)) FROM defs),
 g AS (SELECT array_to_string(p, ':') AS key, count(*) FILTER (w = 'r') AS reads, count(*) FILTER (w = 'd') AS definitions FROM k
 WHERE NOT list_has_any(p, ['', '.', '..']) GROUP BY 1)
 SELECT key, reads, definitions, CASE WHEN definitions = 0 THEN 'missing_definition' WHEN reads = 0 THEN 'unused_definition' END AS diagnostic FROM g""", reads=KEYS, defs="SELECT concat('App', s_suppkey % 12, ':click') AS key FROM {supplier} UNION ALL SELECT '..:x' FROM {region}")
def configuration_keys(reads: DataFrame, defs: DataFrame) -> DataFrame:
    return advice.configuration_edges(reads, defs)


TOPOLOGY = {"pub": "SELECT concat('u', user_id % 40) AS source, concat('x', event_id % 12) AS exchange FROM {events}", "routes": "SELECT concat('x', s_suppkey % 12) AS exchange, concat('q', s_nationkey) AS queue FROM {supplier}", "con": "SELECT concat('q', c_nationkey) AS queue, concat('c', c_custkey % 50) AS source FROM {customer}"}


@query("", " SELECT DISTINCT source, exchange AS target, 'queue_publish' AS edge_kind FROM pub UNION SELECT exchange, queue, 'queue_route' FROM routes UNION SELECT queue, source, 'queue_consume' FROM con", **TOPOLOGY)
def queue_topology(pub: DataFrame, routes: DataFrame, con: DataFrame) -> DataFrame:
    return advice.queue_topology(pub, routes, con)


@query("mods")
def louvain_communities(mods: DataFrame) -> DataFrame:
    return advice.louvain(mods)


#: decisions on suppliers, and their versions by the day of an event of the user of that number
JUDGED = """SELECT concat('s:', user_id) AS target, concat('d', event_id) AS decision_id, event_type AS resolution, CASE WHEN value > 100 THEN 'dear' END AS note, ts AS occurred_at
 FROM {events} WHERE event_type = 'purchase'"""
VERSIONED = """SELECT concat('s:', user_id) AS stable_id, CAST(day(ts) AS BIGINT) AS valid_from, CASE WHEN day(ts) < 29 THEN CAST(day(ts) AS BIGINT) END AS valid_to,
 max(concat('src/', event_type)) AS file_path FROM {events} GROUP BY user_id, day(ts)"""


def explained_sql(target: str) -> str:
    return f"""
 SELECT 'facts' AS section, 'declaration' AS kind, 1 AS place, concat(node_kind, ' ', chr(39), display_name, chr(39), ' (', stable_id, ').') AS detail, 'graph_nodes' AS provenance FROM nodes WHERE stable_id = '{target}'
 UNION ALL SELECT 'facts', 'source', 1, concat('Defined at ', file_path, ':?.'), 'graph_nodes' FROM nodes WHERE stable_id = '{target}'
 UNION ALL SELECT 'facts', 'provider', 1, concat('Provider ', chr(39), provider, chr(39), ' reported confidence ', CASE WHEN confidence = 1 THEN '1' ELSE CAST(confidence AS VARCHAR) END, '.'), 'graph_nodes'
 FROM nodes WHERE stable_id = '{target}'
 UNION ALL SELECT 'facts', 'dependency', k, concat(CASE WHEN source = '{target}' THEN concat('Depends on ', target) ELSE concat('Is depended on by ', source) END, ' through ', edge_kind, '.'), 'graph_edges'
 FROM (SELECT *, row_number() OVER (ORDER BY edge_id) AS k FROM edges WHERE source = '{target}' OR target = '{target}') WHERE k <= 40
 UNION ALL SELECT 'facts', 'public_surface', row_number() OVER (ORDER BY symbol_id), concat(visibility, ' symbol ', fully_qualified_name, ' (', normalized_signature, ').'), 'graph_symbols' FROM syms WHERE node_id = '{target}'
 UNION ALL SELECT 'decisions', 'decision', row_number() OVER (ORDER BY occurred_at, decision_id), concat_ws(' ', decision_id, resolution, note), 'architecture_decisions' FROM judged WHERE target = '{target}'
 UNION ALL SELECT 'history', CASE WHEN valid_to IS NULL THEN 'active' ELSE 'historical' END, k, concat('Present from revision ', valid_from, CASE WHEN valid_to IS NULL THEN '' ELSE concat(' through ', valid_to) END, '.'), file_path
 FROM (SELECT *, row_number() OVER (ORDER BY valid_from DESC) AS k FROM versioned WHERE stable_id = '{target}') WHERE k <= 5
 UNION ALL SELECT 'unknown', 'unknown', 1, 'No bounded historical revision evidence is available for this node.', 'none' WHERE NOT EXISTS (SELECT 1 FROM versioned WHERE stable_id = '{target}')
 UNION ALL SELECT 'unknown', 'unknown', 2, 'No architecture decisions target this graph node.', 'none' WHERE NOT EXISTS (SELECT 1 FROM judged WHERE target = '{target}')"""


@query("nodes edges syms", f" SELECT 's:3' AS asked, * FROM ({explained_sql('s:3')}) UNION ALL SELECT 'nation_1', * FROM ({explained_sql('n:1')})", judged=JUDGED, versioned=VERSIONED)
def explain_architecture(nodes: DataFrame, edges: DataFrame, syms: DataFrame, judged: DataFrame, versioned: DataFrame) -> DataFrame:
    """A supplier by its id, and a nation by its name: facts, decisions, history, and what is not known."""
    told = lambda text: advice.explain_architecture(nodes, edges, syms, judged, versioned, text, 5).select(F.lit(text).alias("asked"), "*")
    return told("s:3").unionByName(told("nation_1"))


@query("nodes edges syms", NODE_FACTS + BEST.replace("LIMIT 20", "LIMIT 3") + REUSE + """, first AS (SELECT min(CASE decision WHEN 'Reuse' THEN 0 WHEN 'Extend' THEN 1 WHEN 'DoNotReuse' THEN 2 ELSE 3 END) AS k FROM told)
 SELECT candidate_id, decision, ['Reuse', 'Extend', 'NewCapability', 'InsufficientEvidence'][k + 1] AS recommendation FROM told, first""")
def plan_change(nodes: DataFrame, edges: DataFrame, syms: DataFrame) -> DataFrame:
    """The best three candidates and the recommendation that goes first: reuse, extend, then a new capability."""
    best = similarity.find_similar(similarity.similarity_facts(nodes, None, syms), "p:7", 3, edges)
    told = similarity.explain_reuse(best, nodes, syms, "p:7").select("candidate_id", "decision")
    order = F.when(F.col("decision") == "Reuse", 0).when(F.col("decision") == "Extend", 1).when(F.col("decision") == "DoNotReuse", 2).otherwise(3)
    first = told.agg(F.min_by("decision", order).alias("d")).select(F.when(F.col("d") == "DoNotReuse", "NewCapability").otherwise(F.col("d")).alias("recommendation"))
    return told.crossJoin(F.broadcast(first))  # one row


@query("nodes", " SELECT stable_id AS target, CAST(i AS BIGINT) AS ordinal, c AS checkpoint FROM nodes, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i, unnest(['baseline', 'impact', 'public_surface', 'change', 'verify', 'record']) AS c) WHERE node_kind = 'supplier'")
def safe_refactor(nodes: DataFrame) -> DataFrame:
    """The plan of a refactoring of each supplier."""
    return advice.safe_refactor(nodes.where("node_kind = 'supplier'").select(F.col("stable_id").alias("target")))


@query("sess", """, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_number) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM sess
 WHERE sequence_number > 10)
 SELECT session_id, sequence_number, event_type, occurred_at, event_id, value, n > 25 AS has_more FROM k WHERE k <= 25""")
def session_replay(sess: DataFrame) -> DataFrame:
    return sessions.replay(sess, 10, 25)


@query("sess", " SELECT session_id, count(*) AS event_count, max(sequence_number) AS last_sequence, max(occurred_at) FILTER (event_type = 'purchase') AS ended_at FROM sess GROUP BY 1")
def session_summary(sess: DataFrame) -> DataFrame:
    return sessions.summary(sess, "purchase")


@query("sess", """, g AS (SELECT *, CASE WHEN occurred_at < lag(occurred_at) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM sess WINDOW w AS (PARTITION BY session_id
 ORDER BY occurred_at, event_id)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY occurred_at, event_id) AS b FROM g) SELECT session_id, min(occurred_at) AS started_at,
 count(*) AS changes FROM i GROUP BY session_id, b""")
def debounce(sess: DataFrame) -> DataFrame:
    return sessions.debounce(sess.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")), "6 hours").withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))

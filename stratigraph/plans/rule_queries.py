"""Layer rules over the foreign-key graph, cycles over the module graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cycles, rules
from ..registry import query
from ..sources.storage import checkpointed

LAYERS: rules.Layers = {"geo": (["src/**/region.cs", "src/**/nation.cs"], []), "crm": (["src/**/customer.cs", "src/**/supplier.cs", "Features/parts/**"], []), "orders": (["Features/orders/**"], ["crm"]), "goods": (["**/supplier.cs", "Features/parts/BRAND1?/*.cs", "Features/parts/Brand1?/*.cs"], [])}
HARD = ["contains", "references"]

MEMBER = """, member AS (SELECT stable_id, file_path, list_filter([
 CASE WHEN regexp_matches(file_path, '^src/(.*/)?(customer|supplier)\\.cs$') OR regexp_matches(file_path, '^Features/parts(/.*)?$') THEN 'crm' END,
 CASE WHEN regexp_matches(file_path, '^src/(.*/)?(region|nation)\\.cs$') THEN 'geo' END,
 CASE WHEN regexp_matches(file_path, '^(.*/)?supplier\\.cs$') OR regexp_matches(file_path, '^Features/parts/(BRAND|Brand)1[^/]/[^/]*\\.cs$') THEN 'goods' END,
 CASE WHEN regexp_matches(file_path, '^Features/orders(/.*)?$') THEN 'orders' END], lambda x: x IS NOT NULL) AS found FROM nodes),
 ms AS (SELECT stable_id, CASE WHEN file_path IS NULL THEN 'NotApplicable' WHEN len(found) = 0 THEN 'Unassigned' WHEN len(found) = 1 THEN 'Assigned'
 ELSE 'Ambiguous' END AS state, array_to_string(found, ',') AS layers, CASE WHEN len(found) = 1 THEN found[1] END AS layer FROM member)"""
BROKEN = MEMBER + """, broken AS (SELECT edge_id, source, target, a.layer AS source_layer, b.layer AS target_layer FROM edges JOIN ms a ON a.stable_id = source
 JOIN ms b ON b.stable_id = target
 WHERE confidence = 1.0 AND edge_kind IN ('contains', 'references') AND a.layer != b.layer AND NOT (a.layer = 'orders' AND b.layer = 'crm'))"""
FINDINGS = BROKEN + """, finding AS (SELECT concat_ws('|', 'layer', source_layer, target_layer, edge_id) AS finding_key, 'layer_violation' AS kind, edge_id AS target FROM broken
 UNION ALL SELECT concat_ws('|', 'coverage', state, stable_id), 'coverage', stable_id FROM ms WHERE state IN ('Unassigned', 'Ambiguous'))"""
#: the baseline of these queries: findings whose key has an even length, and one that is gone
BASE = ", base AS (SELECT finding_key FROM finding WHERE length(finding_key) % 2 = 0 UNION ALL SELECT 'layer|gone'), cmp AS (SELECT finding_key, CASE WHEN b.finding_key IS NULL THEN 'Introduced' WHEN a.finding_key IS NULL THEN 'Resolved' ELSE 'Legacy' END AS status FROM (SELECT DISTINCT finding_key FROM finding) a FULL JOIN base b USING (finding_key))"
EXCEPTED = BASE + """, exc AS (SELECT finding_key, 'e' || (length(finding_key) % 5) AS exception_id, TIMESTAMP '2024-01-01' AS created_at, CASE
 WHEN length(finding_key) % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2025-01-01' END AS review_at,
 CASE WHEN length(finding_key) % 7 = 0 THEN TIMESTAMP '2024-05-01' ELSE TIMESTAMP '2025-06-01' END AS expires_at FROM (SELECT DISTINCT finding_key FROM finding)
 WHERE length(finding_key) % 5 != 0 UNION ALL SELECT 'layer|never', 'e9', TIMESTAMP '2024-01-01', TIMESTAMP '2025-01-01', TIMESTAMP '2025-06-01'),
 st AS (SELECT finding_key, status, exception_id, CASE WHEN exception_id IS NULL THEN NULL WHEN status IS NULL OR status = 'Resolved' THEN 'Unused'
 WHEN expires_at <= TIMESTAMP '2024-06-01' THEN 'Expired' WHEN review_at <= TIMESTAMP '2024-06-01' THEN 'ReviewDue' ELSE 'Active' END AS exception_state FROM cmp FULL
 JOIN exc USING (finding_key)),
 cls AS (SELECT finding_key, CASE WHEN status = 'Introduced' AND exception_state IN ('Active', 'ReviewDue') THEN 'Excepted'
 ELSE status END AS status, exception_id, exception_state FROM st)"""


def _findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Membership and findings are each made once, however often a query uses them."""
    member = checkpointed(rules.layer_membership(nodes, LAYERS))
    return checkpointed(rules.findings(rules.layer_violations(nodes, edges, LAYERS, HARD, member), rules.layer_coverage(nodes, LAYERS, member)))


def _compared(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    now = _findings(nodes, edges)
    base = now.where("length(finding_key) % 2 = 0").select("finding_key").unionByName(nodes.sparkSession.sql("SELECT 'layer|gone' AS finding_key"))
    mark = rules.rule_fingerprint(LAYERS, HARD)
    return now, rules.compare_baseline(now, base, mark, mark)


def _classified(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    now, compared = _compared(nodes, edges)
    made = now.where("length(finding_key) % 5 != 0").selectExpr(
        "finding_key", "concat('e', length(finding_key) % 5) AS exception_id", "timestamp'2024-01-01' AS created_at",
        "if(length(finding_key) % 3 = 0, timestamp'2024-02-01', timestamp'2025-01-01') AS review_at", "if(length(finding_key) % 7 = 0, timestamp'2024-05-01', timestamp'2025-06-01') AS expires_at",
    )
    more = nodes.sparkSession.sql("SELECT 'layer|never' AS finding_key, 'e9' AS exception_id, timestamp'2024-01-01' AS created_at, timestamp'2025-01-01' AS review_at, timestamp'2025-06-01' AS expires_at")
    return rules.apply_exceptions(compared, made.unionByName(more), F.lit("2024-06-01").cast("timestamp"))


@query("nodes", MEMBER + " SELECT * FROM ms")
def layer_membership(nodes: DataFrame) -> DataFrame:
    return rules.layer_membership(nodes, LAYERS)


@query("nodes edges", BROKEN + " SELECT * FROM broken")
def layer_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return rules.layer_violations(nodes, edges, LAYERS, HARD)


@query("nodes", MEMBER + " SELECT stable_id, state, layers FROM ms WHERE state IN ('Unassigned', 'Ambiguous')")
def layer_coverage(nodes: DataFrame) -> DataFrame:
    return rules.layer_coverage(nodes, LAYERS)


@query("nodes edges", MEMBER + """ SELECT count(*) AS total_edges, count(*) FILTER (confidence = 1.0 AND edge_kind IN ('contains', 'references')) AS eligible_edges, array_to_string(list_sort(list(DISTINCT edge_kind)), ',') AS observed_kinds,
 (SELECT count(DISTINCT layer) FROM ms WHERE state = 'Assigned') AS populated_layers, 'contains,references' AS configured_kinds, false AS unenforceable FROM edges""")
def enforcement_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return rules.enforcement_reach(nodes, edges, LAYERS, HARD)


@query("edges", " SELECT edge_id FROM edges WHERE confidence = 1.0 AND edge_kind IN ('contains', 'references')")
def hard_edge_policy(edges: DataFrame) -> DataFrame:
    return rules.hard_edges(edges, HARD).select("edge_id")


@query("nodes edges", FINDINGS + " SELECT finding_key, min(kind) AS kind, min(target) AS target FROM finding GROUP BY 1")
def findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _findings(nodes, edges)


@query("nodes edges", FINDINGS + BASE + " SELECT * FROM cmp")
def baseline_compare(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _compared(nodes, edges)[1]


@query("nodes edges", FINDINGS + EXCEPTED + " SELECT * FROM cls")
def apply_exceptions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _classified(nodes, edges)


@query("nodes edges", FINDINGS + EXCEPTED + """ SELECT CASE split_part(finding_key, '|', 1) WHEN 'layer' THEN '001' WHEN 'cycle' THEN '002' WHEN 'coverage' THEN '003' ELSE '004' END AS rule_id,
 CASE status WHEN 'Introduced' THEN 'error' WHEN 'Legacy' THEN 'warning' WHEN 'Resolved' THEN 'note' ELSE 'none' END AS level, CASE status WHEN 'Introduced' THEN 'new'
 WHEN 'Resolved' THEN 'absent' ELSE 'unchanged' END AS baseline_state, finding_key FROM cls WHERE status IS NOT NULL""")
def sink_sarif(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return rules.sarif_results(_classified(nodes, edges))


@query("nodes edges", FINDINGS + EXCEPTED + " SELECT count(*) FILTER (status = 'Introduced') AS introduced, count(*) FILTER (status = 'Legacy') AS legacy FROM cls")
def violation_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return rules.violation_counts(_classified(nodes, edges))


@query("nodes edges", BROKEN + ", l AS (SELECT source AS x, edge_id FROM broken UNION ALL SELECT target, edge_id FROM broken), t AS (SELECT x, count(*) AS n FROM l GROUP BY x) SELECT stable_id, state, layer, coalesce(n, 0) AS violation_count, edge_id FROM ms LEFT JOIN t ON t.x = stable_id LEFT JOIN l ON l.x = stable_id")
def module_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return rules.module_rules(nodes, edges, LAYERS, HARD)


@query("nodes edges syms", """, own AS (SELECT stable_id FROM nodes WHERE node_kind != 'supplier')
 SELECT 'node' AS fact, stable_id AS id, 'confidence' AS problem FROM nodes WHERE node_kind = 'region'
 UNION ALL SELECT 'node', stable_id, 'line_range' FROM nodes WHERE node_kind = 'nation'
 UNION ALL SELECT 'edge', edge_id, 'missing_source' FROM edges WHERE source NOT IN (SELECT stable_id FROM own) UNION ALL SELECT 'edge', edge_id, 'missing_target'
 FROM edges WHERE target NOT IN (SELECT stable_id FROM own)
 UNION ALL SELECT 'symbol', symbol_id, 'missing_node' FROM syms WHERE node_id NOT IN (SELECT stable_id FROM own) UNION ALL
 SELECT 'symbol', symbol_id, 'json_return_metadata_json' FROM syms WHERE visibility = 'private'
 UNION ALL SELECT 'fingerprint', concat(symbol_id, '|members'), 'repeated' FROM syms WHERE visibility = 'Public' UNION ALL
 SELECT 'fingerprint', 'none|members', 'missing_symbol'""")
def fact_validate(nodes: DataFrame, edges: DataFrame, syms: DataFrame) -> DataFrame:
    broken = nodes.where("node_kind != 'supplier'").withColumn("confidence", F.when(F.col("node_kind") == "region", 1.5).otherwise(F.col("confidence")))
    broken = broken.withColumn("start_line", F.when(F.col("node_kind") == "nation", 9)).withColumn("end_line", F.when(F.col("node_kind") == "nation", 3))
    symbols = syms.withColumn("return_metadata_json", F.when(F.col("visibility") == "private", "{").otherwise(F.col("return_metadata_json")))
    prints = syms.select("symbol_id", F.lit("members").alias("fingerprint_kind"), F.lit("h").alias("fingerprint_hash"), F.lit("[]").alias("normalized_members_json"))
    prints = prints.unionByName(prints.join(syms.where("visibility = 'Public'"), "symbol_id", "left_semi")).unionByName(nodes.sparkSession.sql("SELECT 'none' AS symbol_id, 'members' AS fingerprint_kind, 'h' AS fingerprint_hash, '[]' AS normalized_members_json"))
    return rules.fact_problems(broken, edges, symbols, prints)


@query("nodes edges", " SELECT edge_id FROM edges WHERE source NOT IN (SELECT stable_id FROM nodes WHERE node_kind != 'part') OR target NOT IN (SELECT stable_id FROM nodes WHERE node_kind != 'part')")
def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return rules.fact_problems(nodes.where("node_kind != 'part'"), edges).where("problem LIKE 'missing%'").select(F.col("id").alias("edge_id")).distinct()


@query("page_paths", """, d AS (SELECT path, CASE WHEN regexp_matches(path, '(^|/)(bin|obj)(/|$)') THEN 'build_output' WHEN regexp_matches(path, '^(.*/)?[0-9]$') THEN CASE
 WHEN regexp_matches(path, '^(.*/)?5$') THEN 0 ELSE 1 END::VARCHAR END AS x FROM page_paths)
 SELECT path, CASE WHEN x = 'build_output' THEN x WHEN x = '1' THEN 'ignored'
 WHEN NOT regexp_matches(path, '^[^/]+/en(/.*)?$') AND NOT regexp_matches(path, '^[^/]+/de(/.*)?$') THEN 'not_included'
 WHEN regexp_matches(path, '^[^/]*\\.example\\.org(/.*)?$') THEN 'excluded' ELSE 'included' END AS reason FROM d""")
def scope_filter(page_paths: DataFrame) -> DataFrame:
    return rules.scope_filter(page_paths, ["*/en/**", "*/de/**"], ["*.example.org/**"], ["**/0", "**/1", "**/2", "**/3", "**/4", "**/5", "**/6", "**/7", "**/8", "**/9", "!**/5"])


@query("mods", """, reach AS (SELECT DISTINCT source, target FROM mods UNION SELECT r.source, m.target FROM reach r JOIN mods m ON m.source = r.target)
 SELECT a.source AS stable_id, min(b.target) AS component FROM reach a JOIN reach b ON b.source = a.source JOIN reach c ON c.source = b.target AND c.target = a.source
 WHERE a.source = a.target GROUP BY 1""")
def strongly_connected(mods: DataFrame) -> DataFrame:
    return cycles.strongly_connected(mods)


@query("mods", """, reach AS (SELECT DISTINCT source, target FROM mods UNION SELECT r.source, m.target FROM reach r JOIN mods m ON m.source = r.target),
 comp AS (SELECT a.source AS x, min(b.target) AS c FROM reach a JOIN reach b ON b.source = a.source JOIN reach d ON d.source = b.target AND d.target = a.source
 WHERE a.source = a.target GROUP BY 1),
 inn AS (SELECT a.c, m.* FROM mods m JOIN comp a ON a.x = source JOIN comp b ON b.x = target WHERE a.c = b.c),
 walk AS (SELECT c, source AS start, target AS here, [source, target] AS path, [edge_id] AS ids FROM inn UNION ALL
 SELECT w.c, start, target, list_append(path, target), list_append(ids, edge_id) FROM walk w JOIN inn e ON e.c = w.c AND e.source = w.here
 WHERE w.here != w.start AND (e.target = w.start OR NOT list_contains(path, e.target)) AND len(ids) < 3),
 best AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY len(ids), array_to_string(ids, chr(31))) AS k FROM walk WHERE here = start)
 SELECT c AS component, array_to_string(path, ',') AS path, array_to_string(ids, ',') AS edges, CAST(len(ids) AS BIGINT) AS cycle_length FROM best WHERE k = 1""")
def module_cycles(mods: DataFrame) -> DataFrame:
    return cycles.shortest_cycles(mods)


#: each part depends on the supplier of its cheapest line with another number; a tenth of the modules lie outside the layers
SUPPLY = """SELECT concat('m', l_partkey) AS source, concat('m', min_by(l_suppkey,
 concat(lpad(CAST(CAST(100 * l_extendedprice AS BIGINT) AS VARCHAR(20)), 20, '0'), lpad(CAST(l_orderkey AS VARCHAR(20)), 20, '0'), CAST(l_linenumber AS VARCHAR(9))))) AS target
 FROM {lineitem} WHERE l_partkey != l_suppkey GROUP BY l_partkey"""
MODULES = "SELECT concat('m', p_partkey) AS stable_id, concat(CASE p_partkey % 10 WHEN 0 THEN 'tools/' WHEN 1 THEN 'src/a/' ELSE 'src/b/' END, p_partkey, '.cs') AS file_path FROM {part}"
MODULE_LAYERS: rules.Layers = {"a": (["src/a/**"], []), "b": (["src/b/**"], [])}


@query("", """, own AS (SELECT stable_id FROM modules WHERE file_path LIKE 'src/%'), e AS (SELECT concat(source, '>', target) AS id, source, target FROM supply
 WHERE source IN (SELECT stable_id FROM own) AND target IN (SELECT stable_id FROM own)),
 walk AS (SELECT source AS start, target AS here, [source, target] AS nodes, [id] AS ids FROM e UNION ALL
 SELECT start, e.target, list_append(nodes, e.target), list_append(ids, id) FROM walk JOIN e ON e.source = here
 WHERE here != start AND NOT list_contains(nodes[2:], e.target)),
 ring AS (SELECT list_min(nodes) AS component, array_to_string(nodes, ',') AS path, array_to_string(ids, ',') AS edges, len(ids) AS cycle_length, ids[1] AS first_id
 FROM walk WHERE here = start)
 SELECT component, min_by(path, first_id) AS path, min_by(edges, first_id) AS edges, min(cycle_length) AS cycle_length FROM ring GROUP BY component""", supply=SUPPLY, modules=MODULES)
def detect_cycles(supply: DataFrame, modules: DataFrame) -> DataFrame:
    """Every module depends on one other, so each component is a ring, of any length."""
    edges = supply.select(F.concat_ws(">", "source", "target").alias("edge_id"), "source", "target", F.lit("references").alias("edge_kind"), F.lit(1.0).alias("confidence"))
    return cycles.detect_cycles(modules, edges, MODULE_LAYERS, HARD)

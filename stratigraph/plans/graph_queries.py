"""Graph operators over the foreign-key graph and the module graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..registry import query

DEG = ", deg AS (SELECT x AS stable_id, count(*) AS degree FROM (SELECT source AS x FROM edges UNION ALL SELECT target FROM edges) GROUP BY x)"
MODULE = """CASE WHEN file_path IS NULL THEN 'References/External' WHEN contains(file_path, '.g.') OR contains(file_path, '/obj/') THEN concat('Generated/', provider)
 WHEN contains(file_path, '/') THEN array_to_string(string_split(file_path, '/')[1:2], '/') ELSE file_path END"""


def walk_sql(edges: str, start: str, near: str, far: str, depth: int, limit: int) -> str:
    return f""", walk AS (SELECT edge_id, {far} AS at, [{start}, {far}] AS seen, 1 AS depth FROM {edges} WHERE {near} = {start} AND {far} != {near}
 UNION ALL SELECT e.edge_id, e.{far}, list_append(w.seen, e.{far}), w.depth + 1 FROM walk w JOIN {edges} e ON e.{near} = w.at
 WHERE w.depth < {depth} AND NOT list_contains(w.seen, e.{far})),
 least AS (SELECT edge_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY edge_id),
 top AS (SELECT e.edge_id, e.source, e.target, l.depth, row_number() OVER (ORDER BY l.depth, e.edge_id) AS k, count(*) OVER () > {limit} AS truncated FROM least l
 JOIN {edges} e USING (edge_id))"""


@query("nodes edges", " SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, CAST(1 AS BIGINT) AS revision")
def scan_revision_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.revision_metadata(nodes, edges)


@query("nodes", " SELECT *, (SELECT count(*) FROM nodes) AS total FROM nodes ORDER BY stable_id LIMIT 100 OFFSET 50")
def page_nodes(nodes: DataFrame) -> DataFrame:
    return graph.page_nodes(nodes, 100, 50)


@query("edges", " SELECT *, (SELECT count(*) FROM edges) AS total FROM edges ORDER BY edge_id LIMIT 200 OFFSET 10")
def page_edges(edges: DataFrame) -> DataFrame:
    return graph.page_edges(edges, 200, 10)


@query("nodes edges", """, seen AS (SELECT * FROM nodes ORDER BY coalesce(file_path, ''), display_name, stable_id LIMIT 30000), best AS (SELECT * FROM edges
 ORDER BY confidence DESC, edge_id LIMIT 15000)
 , inside AS (SELECT edge_id, source, target, edge_kind, confidence FROM best WHERE source IN (SELECT stable_id FROM seen) AND target IN (SELECT stable_id FROM seen)),
 more AS (SELECT (SELECT count(*) FROM nodes) > (SELECT count(*) FROM seen) OR (SELECT count(*) FROM edges) > (SELECT count(*) FROM inside) AS truncated)
 SELECT 'node' AS item, stable_id AS id, NULL AS source, NULL AS target, node_kind AS kind, display_name AS name, file_path, confidence, truncated FROM seen, more
 UNION ALL SELECT 'edge', edge_id, source, target, edge_kind, NULL, NULL, confidence, truncated FROM inside, more""")
def map_scan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.graph_map(nodes, edges, 30000, 15000)


@query("nodes edges", DEG + " SELECT stable_id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (stable_id) ORDER BY degree DESC, stable_id LIMIT 1")
def hub_node(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.hub_node(nodes, edges)


@query("edges", DEG + " SELECT * FROM deg")
def node_degrees(edges: DataFrame) -> DataFrame:
    return graph.degrees(edges)


SEARCH = """ SELECT stable_id, display_name, file_path, CAST(CASE WHEN display_name = '{0}' THEN 0 WHEN starts_with(lower(display_name), lower('{0}')) THEN 1
 ELSE 2 END AS BIGINT) AS rank
 FROM nodes WHERE contains(lower(display_name), lower('{0}')) OR contains(lower(stable_id), lower('{0}')) OR contains(lower(file_path), lower('{0}'))"""


@query("nodes", SEARCH.format("Order#1") + " ORDER BY rank, display_name, stable_id LIMIT 16")
def node_search(nodes: DataFrame) -> DataFrame:
    return graph.node_search(nodes, "Order#1")


@query("nodes", ", hit AS (" + SEARCH.format("supplier") + "), k AS (SELECT *, row_number() OVER (ORDER BY rank, display_name, stable_id) AS k, count(*) OVER () > 10 AS truncated FROM hit) SELECT stable_id, display_name, rank, truncated FROM k WHERE k <= 10")
def resolve_symbol(nodes: DataFrame) -> DataFrame:
    return graph.resolve_symbol(nodes, "supplier")


@query("nodes", """ SELECT stable_id, way FROM (SELECT stable_id, CAST(CASE WHEN stable_id = 'CUSTOMER' THEN 0 WHEN file_path = 'CUSTOMER' THEN 1
 WHEN contains(lower(display_name), 'customer') OR contains(lower(stable_id), 'customer') THEN 2 END AS BIGINT) AS way FROM nodes)
 WHERE way IS NOT NULL ORDER BY way, stable_id LIMIT 1""")
def explain_resolve(nodes: DataFrame) -> DataFrame:
    return graph.explain_resolve(nodes, "CUSTOMER")


@query("edges", walk_sql("edges", "'n:1'", "target", "source", 2, 500) + " SELECT edge_id, source, target, depth, truncated FROM top WHERE k <= 500")
def traverse_dependents(edges: DataFrame) -> DataFrame:
    return graph.traverse(edges, "n:1", "dependents", 2, 500)


@query("edges", walk_sql("edges", "'o:1'", "source", "target", 3, 100) + " SELECT edge_id, source, target, depth, truncated FROM top WHERE k <= 100")
def traverse_dependencies(edges: DataFrame) -> DataFrame:
    return graph.traverse(edges, "o:1", "dependencies", 3, 100)


@query("mods", walk_sql("mods", "(SELECT min(source) FROM mods)", "source", "target", 3, 100) + " SELECT edge_id, source, target, depth, truncated FROM top WHERE k <= 100")
def traverse_cyclic(mods: DataFrame) -> DataFrame:
    return graph.traverse(mods, mods.agg(F.min("source")).first()[0], "dependencies", 3, 100)


IMPACT = """, found AS (SELECT 'dependents' AS direction, source AS stable_id, depth, edge_id, truncated FROM top WHERE k <= 300),
 best AS (SELECT direction, stable_id, min_by((depth, edge_id), (depth, edge_id)) AS b, bool_or(truncated) AS truncated FROM found GROUP BY direction, stable_id),
 reached AS (SELECT direction, stable_id, b[1] AS depth, b[2] AS via_edge_id, b[1] = 1 AS direct, truncated FROM best ORDER BY b[1], stable_id LIMIT 300)"""


@query("edges", walk_sql("edges", "'s:3'", "target", "source", 2, 300) + IMPACT + " SELECT * FROM reached")
def impact_analysis(edges: DataFrame) -> DataFrame:
    return graph.impact(edges, "s:3", "dependents", 2, 300)


PUBLIC = ", open AS (SELECT DISTINCT stable_id FROM reached WHERE stable_id IN (SELECT node_id FROM syms WHERE lower(visibility) = 'public'))"
RISK = PUBLIC + """ SELECT risk FROM (SELECT unnest([CASE WHEN (SELECT count(*) FROM open) > 0 THEN 'public_api' END, CASE
 WHEN count(DISTINCT (direction, stable_id)) >= 50 THEN 'high_blast_radius' END,
 CASE WHEN bool_or(truncated) THEN 'incomplete_analysis' END]) AS risk FROM reached) WHERE risk IS NOT NULL"""


@query("edges syms", walk_sql("edges", "'n:1'", "target", "source", 2, 300) + IMPACT + RISK)
def impact_risks(edges: DataFrame, syms: DataFrame) -> DataFrame:
    return graph.impact_risks(graph.impact(edges, "n:1", "dependents", 2, 300), edges, syms)


AHEAD = IMPACT.replace("'dependents' AS direction, source", "'dependencies' AS direction, target")


@query("edges syms", walk_sql("edges", "'o:1'", "source", "target", 2, 300) + AHEAD + PUBLIC + " SELECT stable_id FROM open")
def impact_public_surface(edges: DataFrame, syms: DataFrame) -> DataFrame:
    return graph.public_surface(graph.impact(edges, "o:1", "dependencies", 2, 300), syms)


@query("mods", """, lev AS (SELECT (SELECT min(source) FROM mods) AS here, [(SELECT min(source) FROM mods)] AS path, 0 AS n
 UNION ALL SELECT target, list_append(path, target), n + 1 FROM lev JOIN mods ON source = here WHERE NOT list_contains(path, target) AND n < 3)
 SELECT CAST(n AS BIGINT) AS path_length, array_to_string(path, '>') AS path FROM lev WHERE here = (SELECT max(target) FROM mods) AND n > 0
 ORDER BY n, array_to_string(path, '>') LIMIT 1""")
def trace_path(mods: DataFrame) -> DataFrame:
    ends = mods.agg(F.min("source").alias("a"), F.max("target").alias("b")).first()
    return graph.shortest_path(mods, ends["a"], ends["b"], 3)


@query("nodes edges", """, l1 AS (SELECT DISTINCT source AS x FROM edges WHERE target = 'n:1' AND source != 'n:1'), l2 AS (SELECT DISTINCT source AS x FROM edges WHERE target IN (SELECT x
 FROM l1) AND source NOT IN (SELECT x FROM l1) AND source != 'n:1'),
 got AS (SELECT x, 1 AS d FROM l1 UNION ALL SELECT x, 2 FROM l2), cut AS (SELECT x FROM got ORDER BY d, x LIMIT 1000)
 SELECT """ + MODULE + " AS module, count(*) AS node_count FROM cut JOIN nodes ON x = stable_id GROUP BY 1")
def downstream_impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.downstream_impact(nodes, edges, "n:1", 2)


@query("nodes edges", ", m AS (SELECT stable_id, " + MODULE + " AS module FROM nodes) SELECT a.module AS source_module, b.module AS target_module, count(*) AS edge_count FROM edges JOIN m a ON a.stable_id = source JOIN m b ON b.stable_id = target WHERE a.module != b.module GROUP BY 1, 2")
def module_scene(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.module_scene(nodes, edges)


@query("nodes edges", ", m AS (SELECT stable_id, coalesce(concat('file:', file_path), concat('node:', stable_id)) AS file, coalesce(file_path, stable_id) AS told, " + MODULE + """ AS module FROM nodes),
 e AS (SELECT a.module AS sm, b.module AS tm, a.file AS sf, b.file AS tf, a.told AS st, b.told AS tt, source, target FROM edges JOIN m a ON a.stable_id = source JOIN m b ON b.stable_id = target WHERE 'src/ASIA' IN (a.module, b.module)),
 i AS (SELECT sf, tf, count(*) AS n FROM e WHERE sm = tm AND sf != tf GROUP BY 1, 2),
 x AS (SELECT CASE WHEN sm = 'src/ASIA' THEN sf ELSE tf END AS file, CASE WHEN sm = 'src/ASIA' THEN tm ELSE sm END AS directory, CASE WHEN sm = 'src/ASIA' THEN target ELSE source END AS node,
 CASE WHEN sm = 'src/ASIA' THEN concat('remote:', tm, ':', tt) ELSE concat('remote:', sm, ':', st) END AS remote, CASE WHEN sm = 'src/ASIA' THEN 'outgoing' ELSE 'incoming' END AS direction FROM e WHERE sm != tm),
 f AS (SELECT file, count(*) AS nodes FROM m WHERE module = 'src/ASIA' GROUP BY 1), t AS (SELECT file, sum(n) AS internal FROM (SELECT sf AS file, n FROM i UNION ALL SELECT tf, n FROM i) GROUP BY 1), o AS (SELECT file, count(*) AS external FROM x GROUP BY 1)
 SELECT 'file' AS item, file AS id, NULL AS other, NULL AS direction, nodes, CAST(coalesce(internal, 0) AS BIGINT) AS internal, coalesce(external, 0) AS external, NULL::BIGINT AS incoming, NULL::BIGINT AS outgoing, NULL::BIGINT AS connections
 FROM f LEFT JOIN t USING (file) LEFT JOIN o USING (file)
 UNION ALL SELECT 'internal_connection', sf, tf, NULL, NULL, NULL, NULL, NULL, NULL, n FROM i
 UNION ALL SELECT 'directory_connection', file, directory, direction, NULL, NULL, NULL, NULL, NULL, count(*) FROM x GROUP BY file, directory, direction
 UNION ALL SELECT 'connected_directory', directory, NULL, NULL, NULL, NULL, NULL, count(*) FILTER (direction = 'incoming'), count(*) FILTER (direction = 'outgoing'), count(*) FROM x GROUP BY directory
 UNION ALL SELECT 'remote_file', remote, directory, NULL, count(DISTINCT node), NULL, NULL, count(*) FILTER (direction = 'incoming'), count(*) FILTER (direction = 'outgoing'), count(*) FROM x GROUP BY remote, directory
 UNION ALL SELECT 'cross_connection', file, remote, direction, NULL, NULL, NULL, NULL, NULL, count(*) FROM x GROUP BY file, remote, direction""")
def module_detail(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The files of one region, how they are connected, and what they meet outside."""
    return graph.module_detail(nodes, edges, "src/ASIA")


@query("nodes", " SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS node_count FROM nodes GROUP BY 1")
def modules_by_directory(nodes: DataFrame) -> DataFrame:
    return graph.modules_by_directory(nodes)


@query("nodes edges")
def explore_neighbourhood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.explore_neighbourhood(nodes, edges)


@query("nodes", " SELECT node_kind, provider, count(*) AS n FROM nodes WHERE node_kind IN ('part', 'customer', 'supplier') AND provider = 'crm' AND confidence >= 0.7 GROUP BY 1, 2")
def canvas_filter(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_kind").isin("part", "customer", "supplier") & (F.col("provider") == "crm") & (F.col("confidence") >= 0.7)).groupBy("node_kind", "provider").agg(F.count("*").alias("n"))

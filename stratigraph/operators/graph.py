"""Graph reads: pages, search, traversal, impact, paths, modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import directory, page, top_truncated


def revision_metadata(nodes: DataFrame, edges: DataFrame, revision: int = 1) -> DataFrame:
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count"))).withColumn("revision", F.lit(revision).cast("long"))


def page_nodes(nodes: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(nodes, ["stable_id"], limit, offset)


def page_edges(edges: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(edges, ["edge_id"], limit, offset)


def graph_map(nodes: DataFrame, edges: DataFrame, most_nodes: int = 5000, most_edges: int = 15000) -> DataFrame:
    """(item, id, source, target, kind, name, file_path, confidence, truncated): the nodes and edges of a map.

    Nodes are the first by path and name; edges the most confident ones, of these those whose both ends are among the nodes.
    truncated says that the graph has more of either.
    """
    from ..sources.storage import checkpointed

    seen = checkpointed(nodes.orderBy(F.coalesce("file_path", F.lit("")), "display_name", "stable_id").limit(most_nodes).select("stable_id", "node_kind", "display_name", "file_path", "confidence"))
    best = edges.orderBy(F.desc("confidence"), "edge_id").limit(most_edges)
    for end in ("source", "target"):
        best = best.join(seen.select(F.col("stable_id").alias(end)), end, "left_semi")
    best = checkpointed(best.select("edge_id", "source", "target", "edge_kind", "confidence"))
    none = F.lit(None).cast("string")
    rows = seen.select(F.lit("node").alias("item"), F.col("stable_id").alias("id"), none.alias("source"), none.alias("target"), F.col("node_kind").alias("kind"), F.col("display_name").alias("name"), "file_path", "confidence")
    rows = rows.unionByName(best.select(F.lit("edge").alias("item"), F.col("edge_id").alias("id"), "source", "target", F.col("edge_kind").alias("kind"), none.alias("name"), none.alias("file_path"), "confidence"))
    # four counts, one row each
    counts = [df.agg(F.count("*").alias(c)) for df, c in ((nodes, "n"), (seen, "m"), (edges, "e"), (best, "f"))]
    more = reduce(lambda a, b: a.crossJoin(b), counts).select(((F.col("n") > F.col("m")) | (F.col("e") > F.col("f"))).alias("truncated"))
    return rows.crossJoin(F.broadcast(more))


def degrees(edges: DataFrame) -> DataFrame:
    """(stable_id, degree): a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("stable_id"))
    return ends.groupBy("stable_id").agg(F.count("*").alias("degree"))


def hub_node(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The node of most edges, ties and edgeless graphs to the smallest id."""
    return nodes.select("stable_id").join(degrees(edges), "stable_id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), "stable_id").limit(1)


def fold_ascii(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def node_search(nodes: DataFrame, text: str, limit: int = 16) -> DataFrame:
    """Nodes whose name, id or path holds the text: equal names first, then those that begin so."""
    if not 1 <= len(text) <= 160 or not 1 <= limit <= 25:
        raise ValueError("search out of bounds")
    needle = fold_ascii(F.lit(text))
    found = nodes.where(reduce(lambda a, b: a | b, [F.contains(fold_ascii(F.col(c)), needle) for c in ("display_name", "stable_id", "file_path")]))
    rank = F.when(F.col("display_name") == text, 0).when(F.startswith(fold_ascii(F.col("display_name")), needle), 1).otherwise(2)
    return found.withColumn("rank", rank.cast("long")).orderBy("rank", "display_name", "stable_id").limit(limit).select("stable_id", "display_name", "file_path", "rank")


def resolve_symbol(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    limit = max(1, min(25, limit))
    needle = fold_ascii(F.lit(text))
    found = nodes.where(reduce(lambda a, b: a | b, [F.contains(fold_ascii(F.col(c)), needle) for c in ("display_name", "stable_id", "file_path")]))
    rank = F.when(F.col("display_name") == text, 0).when(F.startswith(fold_ascii(F.col("display_name")), needle), 1).otherwise(2)
    return top_truncated(found.select("stable_id", "display_name", rank.cast("long").alias("rank")), ["rank", "display_name", "stable_id"], limit)


def explain_resolve(nodes: DataFrame, text: str) -> DataFrame:
    """One node: by id, else by path, else by part of its name or id in any case, each the smallest id."""
    folded = F.lower(F.lit(text))
    way = F.when(F.col("stable_id") == text, 0).when(F.col("file_path") == text, 1).when(F.contains(F.lower("display_name"), folded) | F.contains(F.lower("stable_id"), folded), 2)
    return nodes.withColumn("way", way.cast("long")).where("way IS NOT NULL").agg(F.min(F.struct("way", "stable_id")).alias("m")).where("m IS NOT NULL").select("m.stable_id", "m.way")


def traverse(edges: DataFrame, start: str, direction: str = "dependencies", depth: int = 3, limit: int = 100) -> DataFrame:
    """(edge_id, source, target, depth, truncated): edges on simple paths from start, each with its least depth.

    One join per level; paths that reach a node over the same set of nodes are one state, since they go on
    alike. Deeper edges come last, so the walk ends at the level that has shown more than limit edges.
    """
    if direction not in ("dependencies", "dependents") or not 1 <= depth <= 8 or not 1 <= limit <= 500:
        raise ValueError("traversal out of bounds")
    return top_truncated(_walk(edges, start, direction, depth, limit), ["depth", "edge_id"], limit)


def _walk(edges: DataFrame, start: str, direction: str, depth: int, limit: int) -> DataFrame:
    from ..sources.storage import checkpointed

    near, far = ("source", "target") if direction == "dependencies" else ("target", "source")
    steps = edges.select("edge_id", F.col(near).alias("near"), F.col(far).alias("far"))
    level = steps.where((F.col("near") == start) & (F.col("far") != start)).select("edge_id", F.col("far").alias("at"), F.array(F.lit(start), F.col("far")).alias("seen"))
    levels = []
    for k in range(1, depth + 1):
        if k < depth:
            level = checkpointed(level)
        levels.append(level.select("edge_id", F.lit(k).cast("long").alias("depth")))
        if k == depth or reduce(DataFrame.unionByName, levels).select("edge_id").distinct().limit(limit + 1).count() > limit:
            break
        state = level.select("at", F.sort_array("seen").alias("seen")).distinct()
        met = state.join(steps, state["at"] == steps["near"]).where(~F.array_contains("seen", F.col("far")))
        level = met.select("edge_id", F.col("far").alias("at"), F.concat("seen", F.array("far")).alias("seen"))
    least = reduce(DataFrame.unionByName, levels).groupBy("edge_id").agg(F.min("depth").alias("depth"))
    return least.join(edges, "edge_id").select("edge_id", "source", "target", "depth")


def impact(edges: DataFrame, target: str, direction: str = "both", depth: int = 3, most: int = 100, kinds: list[str] | None = None) -> DataFrame:
    """(direction, stable_id, depth, via_edge_id, direct, truncated): the nodes reached, each over its shallowest edge."""
    if direction not in ("both", "dependencies", "dependents") or not 1 <= most <= 500:
        raise ValueError("impact out of bounds")
    parts = []
    for way in ("dependencies", "dependents") if direction == "both" else (direction,):
        walked = traverse(edges, target, way, depth, most)
        parts.append(walked.select(F.lit(way).alias("direction"), F.col("target" if way == "dependencies" else "source").alias("stable_id"), "depth", "edge_id", "truncated"))
    found = reduce(DataFrame.unionByName, parts)
    if kinds:
        found = found.join(edges.where(F.col("edge_kind").isin(kinds)).select("edge_id"), "edge_id", "left_semi")
    best = found.groupBy("direction", "stable_id").agg(F.min(F.struct("depth", "edge_id")).alias("b"), F.max("truncated").alias("truncated"))
    return best.select("direction", "stable_id", "b.depth", F.col("b.edge_id").alias("via_edge_id"), (F.col("b.depth") == 1).alias("direct"), "truncated").orderBy("depth", "stable_id").limit(most)


def public_surface(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """(stable_id): reached nodes that declare a public symbol."""
    public = symbols.where(F.lower("visibility") == "public").select(F.col("node_id").alias("stable_id"))
    return reached.select("stable_id").distinct().join(public, "stable_id", "left_semi")


#: risk -> the prefix of the edge kinds that carry it
RISKS = {"configuration_contract": "configuration_", "message_contract": "message_", "service_registration": "di_"}


def impact_risks(reached: DataFrame, edges: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(risk): rules over what impact has reached."""
    kinds = reached.join(edges, reached["via_edge_id"] == edges["edge_id"]).select("edge_kind", "truncated", "direction", "stable_id")
    told = kinds.agg(F.countDistinct("direction", "stable_id").alias("n"), F.max("truncated").alias("cut"), *[F.max(F.startswith("edge_kind", F.lit(p))).alias(k) for k, p in RISKS.items()])
    if symbols is not None:
        told = told.crossJoin(F.broadcast(public_surface(reached, symbols).agg(F.count("*").alias("public"))))  # one row each
    else:
        told = told.withColumn("public", F.lit(0))
    names = F.array(F.when(F.col("public") > 0, "public_api"), F.when(F.col("n") >= 50, "high_blast_radius"), *[F.when(F.col(k), k) for k in RISKS], F.when(F.col("cut"), "incomplete_analysis"))
    return told.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("risk"))


def shortest_path(edges: DataFrame, start: str, end: str, longest: int | None = None) -> DataFrame:
    """(path_length, path): fewest edges from start to end, ties by the ids of the nodes on the way; no row without a path.

    Breadth first: each level holds each newly reached node once, with its first path, and is
    checkpointed; the search ends when end is reached or nothing new is, or at a length that is asked for.
    """
    from ..sources.storage import checkpointed

    steps = edges.select(F.col("source").alias("at"), "target").distinct()
    level = reached = edges.sparkSession.createDataFrame([(start, [start])], "at string, path array<string>")
    while longest is None or longest > 0:
        longest = None if longest is None else longest - 1
        after = level.join(steps, "at").select(F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path")).groupBy("at").agg(F.min("path").alias("path"))
        level = checkpointed(after.join(reached.select("at"), "at", "left_anti"))
        reached = reached.unionByName(level)
        if level.agg(F.count("*").alias("n"), F.max(F.col("at") == end).alias("hit")).where("n = 0 OR hit").count():
            break
    return level.where(F.col("at") == end).select((F.size("path") - 1).cast("long").alias("path_length"), F.array_join("path", ">").alias("path"))


def reached_levels(edges: DataFrame, start: str, depth: int, direction: str = "dependents") -> DataFrame:
    """(stable_id, depth): breadth first without paths; each node at its least depth, start at 0. Levels are written, each once."""
    from ..sources.storage import checkpointed

    near, far = ("source", "target") if direction == "dependencies" else ("target", "source")
    # repeats are left in: what a level meets is made distinct, and that is less
    steps = edges.select(F.col(near).alias("stable_id"), F.col(far).alias("far"))
    reached = edges.sparkSession.createDataFrame([(start, 0)], "stable_id string, depth long")
    front = reached
    for k in range(1, depth + 1):
        front = front.join(steps, "stable_id").select(F.col("far").alias("stable_id")).distinct().join(reached.select("stable_id"), "stable_id", "left_anti").withColumn("depth", F.lit(k).cast("long"))
        front = checkpointed(front)
        reached = reached.unionByName(front)
    return reached


def downstream_impact(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 3, most: int = 1000) -> DataFrame:
    """(module, node_count): what depends on start, up to most nodes, by module."""
    reached = reached_levels(edges, start, depth).where("depth > 0").orderBy("depth", "stable_id").limit(most)
    return reached.join(nodes, "stable_id").groupBy(module_of().alias("module")).agg(F.count("*").alias("node_count"))


def module_of(path: str = "file_path", kind: str = "node_kind", provider: str = "provider") -> Column:
    """Features/x or the first two segments; nodes without path are external, generated files their provider's."""
    p = F.col(path)
    parts = F.split(p, "/")
    return (
        F.when(p.isNull(), "References/External")
        .when(F.contains(p, F.lit(".g.")) | F.contains(p, F.lit("/obj/")), F.concat(F.lit("Generated/"), F.col(provider)))
        .when(F.size(parts) > 1, F.concat_ws("/", F.slice(parts, 1, 2)))
        .otherwise(p)
    )


def module_scene(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_module, target_module, edge_count) between different modules."""
    mods = nodes.select("stable_id", module_of().alias("module"))
    a, b = mods.toDF("source", "source_module"), mods.toDF("target", "target_module")
    return edges.join(a, "source").join(b, "target").where("source_module != target_module").groupBy("source_module", "target_module").agg(F.count("*").alias("edge_count"))


DETAIL = ["item", "id", "other", "direction", "nodes", "internal", "external", "incoming", "outgoing", "connections"]


def module_detail(nodes: DataFrame, edges: DataFrame, module: str, connected: bool = False) -> DataFrame:
    """One module's files and what they are connected to, as rows of DETAIL; what an item doesn't have is null.

    file: its nodes, ends of edges to other files of the module (internal), edges that leave it (external). internal_connection: edges from a
    file to another. directory_connection: edges between a file and another module, by direction; connected_directory: these by
    module. remote_file: a file of another module with its nodes that are met; cross_connection: edges between a file and one
    of those. connected leaves the files with edges that leave the module, and the connections among them.
    """
    from ..sources.storage import checkpointed

    file = F.coalesce(F.concat(F.lit("file:"), "file_path"), F.concat(F.lit("node:"), "stable_id"))
    placed = nodes.select("stable_id", module_of().alias("module"), file.alias("file"), F.coalesce("file_path", "stable_id").alias("told"))
    a, b = placed.toDF("source", "source_module", "source_file", "source_told"), placed.toDF("target", "target_module", "target_file", "target_told")
    ends = checkpointed(edges.select("source", "target").join(a, "source").join(b, "target").where((F.col("source_module") == module) | (F.col("target_module") == module)))
    inner = ends.where((F.col("source_module") == F.col("target_module")) & (F.col("source_file") != F.col("target_file")))
    out = F.col("source_module") == module
    either = lambda x, y: F.when(out, F.col(x)).otherwise(F.col(y))
    cross = ends.where("source_module != target_module").select(
        either("source_file", "target_file").alias("file"), either("target_module", "source_module").alias("directory"), either("target", "source").alias("node"),
        either("target_told", "source_told").alias("told"), F.when(out, "outgoing").otherwise("incoming").alias("direction"),
    ).withColumn("remote", F.concat(F.lit("remote:"), "directory", F.lit(":"), "told"))
    each = inner.groupBy("source_file", "target_file").agg(F.count("*").alias("connections"))
    touched = each.select(F.explode(F.array("source_file", "target_file")).alias("file"), "connections").groupBy("file").agg(F.sum("connections").alias("internal"))
    left = cross.groupBy("file").agg(F.count("*").alias("external"))
    files = placed.where(F.col("module") == module).groupBy("file").agg(F.count("*").alias("nodes")).join(touched, "file", "left").join(left, "file", "left").fillna(0, ["internal", "external"])
    if connected:
        files = files.where("external > 0")
        for end in ("source_file", "target_file"):
            each = each.join(files.select(F.col("file").alias(end)), end, "left_semi")
    ways = [F.count_if(F.col("direction") == w).alias(w) for w in ("incoming", "outgoing")]
    kinds = {"id": "string", "other": "string", "direction": "string"}

    def rows(df: DataFrame, item: str, **has: str) -> DataFrame:
        return df.select(F.lit(item).alias("item"), *[(F.col(has[c]) if c in has else F.lit(None)).cast(kinds.get(c, "long")).alias(c) for c in DETAIL[1:]])

    parts = [
        rows(files, "file", id="file", nodes="nodes", internal="internal", external="external"),
        rows(each, "internal_connection", id="source_file", other="target_file", connections="connections"),
        rows(cross.groupBy("file", "directory", "direction").agg(F.count("*").alias("n")), "directory_connection", id="file", other="directory", direction="direction", connections="n"),
        rows(cross.groupBy("directory").agg(*ways, F.count("*").alias("n")), "connected_directory", id="directory", incoming="incoming", outgoing="outgoing", connections="n"),
        rows(cross.groupBy("remote", "directory").agg(*ways, F.countDistinct("node").alias("nodes"), F.count("*").alias("n")), "remote_file", id="remote", other="directory", nodes="nodes", incoming="incoming", outgoing="outgoing", connections="n"),
        rows(cross.groupBy("file", "remote", "direction").agg(F.count("*").alias("n")), "cross_connection", id="file", other="remote", direction="direction", connections="n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def explore_neighbourhood(nodes: DataFrame, edges: DataFrame, focus: str | None = None, most: int = 72, per_node: int = 18) -> DataFrame:
    """(item, id, name, step, source, target): undirected breadth first from focus or the hub, each node giving its best edges, until most nodes are in.

    Nodes have the step at which they came; edges are those looked at on the way between nodes that are in. The queue's order
    matters, so it is walked on the driver: at most 120 nodes and 18 edges for each, one bounded read per level.
    """
    if not 1 <= most <= 120:
        raise ValueError("maximum nodes out of bounds")
    ways = [edges.select("edge_id", "confidence", "source", "target", F.col(a).alias("at"), F.col(b).alias("other")) for a, b in (("source", "target"), ("target", "source"))]
    both = ways[0].unionByName(ways[1].where("source != target"))
    focus = focus or hub_node(nodes, edges).first()["stable_id"]
    order, queue, met = {focus: 0}, [focus], {}
    while queue and len(order) < most:
        best = Window.partitionBy("at").orderBy(F.desc("confidence"), "edge_id")
        rows = both.where(F.col("at").isin(queue)).withColumn("k", F.row_number().over(best)).where(F.col("k") <= per_node).select("at", "k", "other", "edge_id", "source", "target").collect()
        near: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: r["k"]):
            near.setdefault(r["at"], []).append(r)
        after = []
        for at in queue:
            if len(order) >= most:
                break
            for r in near.get(at, []):
                if r["other"] not in order:
                    if len(order) >= most:
                        continue
                    order[r["other"]] = len(order)
                    after.append(r["other"])
                met[r["edge_id"]] = (r["source"], r["target"])
        queue = after
    spark = nodes.sparkSession
    steps = nodes.join(F.broadcast(spark.createDataFrame(list(order.items()), "stable_id string, step long")), "stable_id")
    none = F.lit(None).cast("string")
    found = steps.select(F.lit("node").alias("item"), F.col("stable_id").alias("id"), F.col("display_name").alias("name"), "step", none.alias("source"), none.alias("target"))
    links = spark.createDataFrame([(e, *ends) for e, ends in met.items()], "id string, source string, target string")
    for end in ("source", "target"):
        links = links.join(steps.select(F.col("stable_id").alias(end)), end, "left_semi")
    return found.unionByName(links.select(F.lit("edge").alias("item"), "id", none.alias("name"), F.lit(None).cast("long").alias("step"), "source", "target"))


def modules_by_directory(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(directory(F.col("file_path")).alias("directory")).agg(F.count("*").alias("node_count"))

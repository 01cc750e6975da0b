"""Record stores: runs, decisions, findings, clusters, summaries, and pages over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edge_id, page


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, state, events): the latest state of each run by its event log; a run that has succeeded stays so."""
    final = F.when(F.bool_or(F.col("state") == "succeeded"), F.lit("succeeded")).otherwise(F.max_by("state", F.struct("occurred_at", "event_id")))
    return events.groupBy("run_id").agg(final.alias("state"), F.count("*").alias("events"))


def decision_page(decisions: DataFrame, targets: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """(decision_id, total, targets): a page of decisions, newest first, then their targets in order."""
    parents = page(decisions, [F.desc("occurred_at"), F.desc("decision_id")], limit, offset, 50)
    own = targets.groupBy("decision_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target_ordinal", "target"))), lambda t: t["target"]), ",").alias("targets"))
    return parents.join(own, "decision_id", "left").select("decision_id", "total", F.coalesce("targets", F.lit("")).alias("targets"))


def decisions_about(targets: DataFrame, target: str) -> DataFrame:
    """(decision_id, target_ordinal, target): all targets of the decisions that name one."""
    return targets.join(targets.where(F.col("target") == target).select("decision_id").distinct(), "decision_id", "left_semi").select("decision_id", "target_ordinal", "target")


def canonical_pair(left: Column, right: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.least(left, right), F.greatest(left, right)), 256)


def record_observations(observed: DataFrame) -> DataFrame:
    """(pair_id, left_id, right_id, revision, score): one observation per unordered pair and revision, the first by time."""
    rows = observed.select(canonical_pair(F.col("left_id"), F.col("right_id")).alias("pair_id"), F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), "revision", "observed_at", "score")
    return rows.groupBy("pair_id", "a", "b", "revision").agg(F.min_by("score", F.struct("observed_at", "score")).alias("score")).select("pair_id", F.col("a").alias("left_id"), F.col("b").alias("right_id"), "revision", "score")


def observation_page(observations: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(observations, ["revision", "pair_id"], limit, offset)


def findings_about(observations: DataFrame, node: str) -> DataFrame:
    return observations.where((F.col("left_id") == node) | (F.col("right_id") == node)).select("pair_id").distinct()


def latest_clusters(memberships: DataFrame, clusters: DataFrame) -> DataFrame:
    """(stable_id, cluster_id, label) of the latest revision."""
    last = memberships.agg(F.max("revision").alias("revision"))
    return memberships.join(F.broadcast(last), "revision").join(clusters, ["revision", "cluster_id"]).select("stable_id", "cluster_id", "label")


def member_page(memberships: DataFrame, cluster_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(memberships.where(F.col("cluster_id") == cluster_id), ["member_ordinal", "stable_id"], limit, offset)


def cluster_at(members: DataFrame, requested: int | None, active: int) -> DataFrame:
    """(stable_id, cluster_id, stale, historical): members at a revision; stale if the latest kept revision isn't the active one."""
    r = active if requested is None else requested
    last = members.agg(F.max("revision").alias("latest"))
    return members.where(F.col("revision") == r).crossJoin(F.broadcast(last)).select("stable_id", "cluster_id", (F.col("latest") != active).alias("stale"), F.lit(r != active).alias("historical"))


def map_semantics(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """(edge_identity, source, target, edge_kind): relations of kinds contains, defines, references, calls and inherits between known symbols, once each."""
    known = symbols.select("stable_id")
    kinds = relations.where(F.col("edge_kind").isin("contains", "defines", "references", "calls", "inherits") & (F.col("source") != F.col("target")))
    both = kinds.join(known.withColumnRenamed("stable_id", "source"), "source", "left_semi").join(known.withColumnRenamed("stable_id", "target"), "target", "left_semi")
    return both.select(edge_id(F.col("source"), F.col("target"), F.col("edge_kind"), F.lit(None).cast("string")).alias("edge_identity"), "source", "target", "edge_kind").distinct()


NAMESPACES, TYPES = ("namespace", "semantic_namespace"), ("class", "interface", "struct", "record", "enum", "delegate")
GENERATED = r"(?i)(^|/)(generated|obj)(/|$)|\.(g|generated|designer)\.cs$"


def important_nodes(nodes: DataFrame, symbols: DataFrame, modules: list[str] = (), include_generated: bool = False) -> DataFrame:
    """(item, kind, stable_id, display_name, reason, sources): what summaries are worth, and what is excluded as generated.

    Targets are the directories above source files, configured modules that hold any, namespaces, and nodes with a public symbol: public
    types by their kind, else public APIs, named by their first symbol. sources counts the paths that speak for a target.
    """
    path = F.translate("file_path", "\\", "/")
    there = nodes.where(F.btrim(F.coalesce("file_path", F.lit(""))) != "").withColumn("generated", path.rlike(GENERATED) & F.lit(not include_generated))
    files = there.select("file_path", "generated").distinct()
    kept = files.where("NOT generated")
    parts = F.filter(F.split("file_path", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    told = lambda df, kind, stable_id, name, reason: df.select(F.lit(kind).alias("kind"), stable_id.alias("stable_id"), name.alias("display_name"), F.lit(reason).alias("reason"), "file_path")
    dirs = kept.where(F.size(parts) > 1).select("file_path", F.explode(above).alias("d"))
    out = told(dirs, "Directory", F.concat(F.lit("directory:"), "d"), F.col("d"), "DirectoryContainsSource")
    for m in sorted({m.strip().strip("/").replace("\\", "/") for m in modules}):
        within = kept.where((F.col("file_path") == m) | F.startswith("file_path", F.lit(m + "/")))
        out = out.unionByName(told(within, "Module", F.lit(f"module:{m}"), F.lit(m), "ConfiguredModule"))
    spaces = there.where(F.lower("node_kind").isin(*NAMESPACES))
    out = out.unionByName(told(spaces.where("NOT generated"), "Namespace", F.col("stable_id"), F.col("display_name"), "NamespaceDeclaration"))
    public = symbols.where(F.lower("visibility") == "public").select("symbol_id", F.col("node_id").alias("stable_id"), "fully_qualified_name")
    open_ = public.join(there.select("stable_id", "node_kind", "file_path", "generated"), "stable_id")
    is_type = F.col("node_kind").isin(*TYPES) | (F.lower("node_kind") == "semantic_type")
    named = open_.where("NOT generated").groupBy("stable_id", "node_kind", "file_path").agg(F.min(F.struct("symbol_id", "fully_qualified_name")).alias("s"))
    for kind, mine in (("PublicType", is_type), ("PublicApi", ~is_type)):
        out = out.unionByName(told(named.where(mine), kind, F.col("stable_id"), F.col("s.fully_qualified_name"), f"{kind}Declaration"))
    targets = out.groupBy("kind", "stable_id", "display_name", "reason").agg(F.countDistinct("file_path").alias("sources"))
    none = F.lit(None).cast("long").alias("sources")
    gone = files.where("generated").select(F.concat(F.lit("file:"), "file_path").alias("stable_id"), F.col("file_path").alias("display_name"))
    gone = gone.unionByName(spaces.where("generated").select("stable_id", "display_name"))
    gone = gone.unionByName(open_.where("generated").select(F.col("symbol_id").alias("stable_id"), F.col("fully_qualified_name").alias("display_name"))).dropDuplicates(["stable_id"])
    excluded = gone.select(F.lit("excluded").alias("item"), F.lit(None).cast("string").alias("kind"), "stable_id", "display_name", F.lit("generated-source").alias("reason"), none)
    return targets.select(F.lit("target").alias("item"), "kind", "stable_id", "display_name", "reason", "sources").unionByName(excluded)


def post_edit_reuse(scored: DataFrame, most: int = 3) -> DataFrame:
    """(source_id, candidate_id, score): each edited node's best candidate in another file, .6 or more, the best of all."""
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "candidate_id")
    best = scored.where("source_path != candidate_path AND score >= 0.6").withColumn("k", F.row_number().over(w)).where("k = 1")
    return best.orderBy(F.desc("score"), "source_id").limit(most).select("source_id", "candidate_id", "score")


def regeneration_queue(requests: DataFrame, in_flight: DataFrame) -> DataFrame:
    """(target, position): stale targets once each, in order of their first request, without those in flight.

    Targets are dealt out in ranges of their order and numbered within a range, from the sum of the ranges before: one
    row a range is all that comes together.
    """
    from ..sources.storage import checkpointed

    first = requests.groupBy("target").agg(F.min("requested_at").alias("t")).join(in_flight.select("target"), "target", "left_anti")
    ranged = checkpointed(first.repartitionByRange("t", "target").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    ahead = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("t", "target"))
    return ranged.withColumn("k", within).join(ahead, "range").select("target", (F.col("ahead") + F.col("k")).cast("long").alias("position"))


def numbered(rows: DataFrame, order: list[str], name: str, per: list[str] | None = None) -> DataFrame:
    """rows with a column name: their number in an order, from 1, within groups (per) if there are any.

    Rows are dealt out in ranges of their groups and order, so that a group of most rows is no single task; what comes together is a
    row for each group in each range.
    """
    from ..sources.storage import checkpointed

    per = per or []
    ranged = checkpointed(rows.repartitionByRange(*per, *order).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy(*per, "range").agg(F.count("*").alias("n_before"))
    ahead = sizes.withColumn("ahead", F.sum("n_before").over(Window.partitionBy(*per).orderBy("range")) - F.col("n_before")).drop("n_before")
    within = F.row_number().over(Window.partitionBy(*per, "range").orderBy(*order))
    return ranged.withColumn("k", within).join(ahead, [*per, "range"]).withColumn(name, (F.col("ahead") + F.col("k")).cast("long")).drop("range", "k", "ahead")


def emitted_edges(sites: DataFrame) -> DataFrame:
    """(edge_identity, source, target, confidence): only matched sites give edges, with the confidence of their evidence."""
    tier = F.when(F.col("evidence") == "semantic", 1.0).when(F.col("evidence") == "explicit_syntax", 0.8).when(F.col("evidence") == "literal", 0.65).otherwise(0.4)
    rows = sites.where("state = 'matched'").withColumn("confidence", tier)
    return rows.groupBy("source", "target", "edge_kind", "join_key").agg(F.max("confidence").alias("confidence")).select(edge_id(F.col("source"), F.col("target"), F.col("edge_kind"), F.col("join_key")).alias("edge_identity"), "source", "target", "confidence")


def exception_notes(exceptions: DataFrame) -> DataFrame:
    """(finding_key, rationale, line, text): the lines of the list of exceptions, in order of both, a row each with its number."""
    rows = numbered(exceptions.select("finding_key", "rationale"), ["finding_key", "rationale"], "line")
    return rows.select("finding_key", "rationale", "line", F.concat(F.lit("- "), "finding_key", F.lit(": "), "rationale").alias("text"))


def asymmetric_touches(pairs: DataFrame) -> DataFrame:
    """(batch_id, a, b): co-touches that lack their counterpart."""
    back = pairs.select("batch_id", F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(back, ["batch_id", "a", "b"], "left_anti")

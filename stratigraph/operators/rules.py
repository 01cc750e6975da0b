"""Layer rules: membership, violations, cycles, findings, baselines, exceptions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..llm.storage import Scratch
from ..sources.storage import parts_of

#: name -> (include globs, layers it may depend on)
Layers = dict[str, tuple[list[str], list[str]]]


def matches_any(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def scope_filter(files: DataFrame, include: list[str], exclude: list[str], ignore: list[str] = (), state_dir: str = ".state") -> DataFrame:
    """(path, reason): the first rule that decides; of ignore rules the last that matches, ! takes back."""
    p = F.col("path")
    segment = lambda s: p.rlike(f"(^|/){s}(/|$)")
    ignored = F.lit(False)
    for rule in ignore:
        negated, glob = rule.startswith("!"), rule.lstrip("!")
        ignored = F.when(p.rlike(glob_regex(glob)), F.lit(not negated)).otherwise(ignored)
    reason = (
        F.when(segment(r"\.git"), "git").when(segment(state_dir.replace(".", r"\.")), "state").when(segment("bin") | segment("obj"), "build_output")
        .when(ignored, "ignored").when(F.lit(bool(include)) & ~matches_any(p, include), "not_included").when(matches_any(p, exclude), "excluded").otherwise("included")
    )
    return files.select("path", reason.alias("reason"))


def layer_membership(nodes: DataFrame, layers: Layers) -> DataFrame:
    """(stable_id, state, layers, layer): the layers whose globs match a node's path, as one regular expression a layer."""
    names = F.array(*[F.when(matches_any(F.col("file_path"), layers[n][0]), F.lit(n)) for n in sorted(layers)])
    got = nodes.select("stable_id", "file_path", F.filter(names, lambda x: x.isNotNull()).alias("found"))
    state = F.when(F.col("file_path").isNull(), "NotApplicable").when(F.size("found") == 0, "Unassigned").when(F.size("found") == 1, "Assigned").otherwise("Ambiguous")
    return got.select("stable_id", state.alias("state"), F.when(F.col("file_path").isNull(), "").otherwise(F.array_join("found", ",")).alias("layers"), F.when(F.size("found") == 1, F.col("found")[0]).alias("layer"))


def hard_edges(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.where((F.col("confidence") == 1.0) & F.col("edge_kind").isin(kinds))


def layer_violations(nodes: DataFrame, edges: DataFrame, layers: Layers, kinds: list[str], membership: DataFrame | None = None) -> DataFrame:
    """(edge_id, source_layer, target_layer): hard edges between assigned nodes of layers that may not depend so.

    membership, if it is at hand, saves matching the paths again. Assigned nodes and hard edges are written once and meet in
    parts of the size of their files.
    """
    spark, scratch = nodes.sparkSession, Scratch(nodes.sparkSession, "violations")
    own = scratch.keep((layer_membership(nodes, layers) if membership is None else membership).where("state = 'Assigned'").select("stable_id", "layer"), "own")
    hard = scratch.keep(hard_edges(edges, kinds).select("edge_id", "source", "target"), "hard")
    parts = max(parts_of(spark, scratch.path(n)) for n in ("own", "hard"))
    a, b = own.toDF("source", "source_layer").repartition(parts, "source"), own.toDF("target", "target_layer").repartition(parts, "target")
    allowed = F.lit(False)
    for name, (_, may) in layers.items():
        allowed = allowed | ((F.col("source_layer") == name) & F.col("target_layer").isin(may or [""]))
    ends = hard.repartition(parts, "source").join(a, "source").repartition(parts, "target").join(b, "target")
    return ends.where((F.col("source_layer") != F.col("target_layer")) & ~allowed).select("edge_id", "source", "target", "source_layer", "target_layer")


def layer_coverage(nodes: DataFrame, layers: Layers, membership: DataFrame | None = None) -> DataFrame:
    return (layer_membership(nodes, layers) if membership is None else membership).where("state IN ('Unassigned', 'Ambiguous')").select("stable_id", "state", "layers")


def enforcement_reach(nodes: DataFrame, edges: DataFrame, layers: Layers, kinds: list[str]) -> DataFrame:
    counts = edges.agg(F.count("*").alias("total_edges"), F.count_if((F.col("confidence") == 1.0) & F.col("edge_kind").isin(kinds)).alias("eligible_edges"), F.array_join(F.sort_array(F.collect_set("edge_kind")), ",").alias("observed_kinds"))
    filled = layer_membership(nodes, layers).where("state = 'Assigned'").agg(F.countDistinct("layer").alias("populated_layers"))
    return counts.crossJoin(filled).withColumn("configured_kinds", F.lit(",".join(sorted(kinds)))).withColumn("unenforceable", F.lit(len(layers) >= 2) & (F.col("eligible_edges") == 0))


def findings(violations: DataFrame, coverage: DataFrame, cycles: DataFrame | None = None, unenforceable: DataFrame | None = None) -> DataFrame:
    """(finding_key, kind, target): one row a key, the least target."""
    out = violations.select(F.concat_ws("|", F.lit("layer"), "source_layer", "target_layer", "edge_id").alias("finding_key"), F.lit("layer_violation").alias("kind"), F.col("edge_id").alias("target"))
    out = out.unionByName(coverage.select(F.concat_ws("|", F.lit("coverage"), "state", "stable_id").alias("finding_key"), F.lit("coverage").alias("kind"), F.col("stable_id").alias("target")))
    if cycles is not None:
        out = out.unionByName(cycles.select(F.concat_ws("|", F.lit("cycle"), "edges").alias("finding_key"), F.lit("cycle").alias("kind"), F.col("edges").alias("target")))
    if unenforceable is not None:
        out = out.unionByName(unenforceable.where("unenforceable").select(F.lit("reach|unenforceable").alias("finding_key"), F.lit("reach").alias("kind"), F.col("configured_kinds").alias("target")))
    return out.groupBy("finding_key").agg(F.min("kind").alias("kind"), F.min("target").alias("target"))


def rule_fingerprint(layers: Layers, kinds: list[str]) -> str:
    told = {"enforcement": sorted(kinds), "layers": [{"include": sorted(i), "may_depend_on": sorted(m), "name": n} for n, (i, m) in sorted(layers.items())]}
    return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def compare_baseline(now: DataFrame, baseline: DataFrame | None, fingerprint: str | None = None, baseline_fingerprint: str | None = None) -> DataFrame:
    """(finding_key, status): Introduced, Legacy or Resolved; without a fitting baseline all are Introduced."""
    if baseline is None or fingerprint != baseline_fingerprint:
        return now.select("finding_key", F.lit("Introduced").alias("status"))
    a, b = now.select("finding_key", F.lit(1).alias("now")), baseline.select("finding_key", F.lit(1).alias("then"))
    return a.join(b, "finding_key", "full").select("finding_key", F.when(F.col("then").isNull(), "Introduced").when(F.col("now").isNull(), "Resolved").otherwise("Legacy").alias("status"))


def apply_exceptions(compared: DataFrame, exceptions: DataFrame, now: Column) -> DataFrame:
    """(finding_key, status, exception_id, exception_state): the newest exception of a key counts; an expired one doesn't excuse."""
    newest = exceptions.groupBy("finding_key").agg(F.max(F.struct("created_at", "exception_id", "review_at", "expires_at")).alias("e"))
    both = compared.join(newest, "finding_key", "full")
    expired, due = F.col("e.expires_at") <= now, F.col("e.review_at") <= now
    state = F.when(F.col("e").isNull(), None).when(F.col("status").isNull() | (F.col("status") == "Resolved"), "Unused").when(expired, "Expired").when(due, "ReviewDue").otherwise("Active")
    both = both.withColumn("exception_state", state)
    status = F.when((F.col("status") == "Introduced") & F.col("exception_state").isin("Active", "ReviewDue"), "Excepted").otherwise(F.col("status"))
    return both.select("finding_key", status.alias("status"), F.col("e.exception_id").alias("exception_id"), "exception_state")


def sarif_results(classified: DataFrame) -> DataFrame:
    """(rule_id, level, baseline_state, finding_key) rows of a SARIF report."""
    kind = F.substring_index("finding_key", "|", 1)
    rule = F.when(kind == "layer", "001").when(kind == "cycle", "002").when(kind == "coverage", "003").otherwise("004")
    s = F.col("status")
    return classified.where(s.isNotNull()).select(
        rule.alias("rule_id"), F.when(s == "Introduced", "error").when(s == "Legacy", "warning").when(s == "Resolved", "note").otherwise("none").alias("level"),
        F.when(s == "Introduced", "new").when(s == "Resolved", "absent").otherwise("unchanged").alias("baseline_state"), "finding_key",
    )


def sarif_document(classified: DataFrame) -> DataFrame:
    """(json): one SARIF 2.1.0 result object per row, for a text sink."""
    rows = sarif_results(classified)
    return rows.select(F.to_json(F.struct(F.concat(F.lit("RULE"), "rule_id").alias("ruleId"), "level", F.col("baseline_state").alias("baselineState"), F.struct(F.col("finding_key").alias("text")).alias("message"))).alias("json"))


def violation_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count_if(F.col("status") == "Introduced").alias("introduced"), F.count_if(F.col("status") == "Legacy").alias("legacy"))


def module_rules(nodes: DataFrame, edges: DataFrame, layers: Layers, kinds: list[str]) -> DataFrame:
    """(stable_id, state, layer, violation_count, edge_id): a row for each violation that touches a node, one without edge_id for the others."""
    from ..sources.storage import checkpointed

    member = checkpointed(layer_membership(nodes, layers))
    broken = checkpointed(layer_violations(nodes, edges, layers, kinds, member).select(F.explode(F.array("source", "target")).alias("stable_id"), "edge_id"))
    counts = broken.groupBy("stable_id").agg(F.count("*").alias("violation_count"))
    rows = member.join(counts, "stable_id", "left").join(broken, "stable_id", "left")
    return rows.select("stable_id", "state", "layer", F.coalesce("violation_count", F.lit(0)).alias("violation_count"), "edge_id")


def fact_problems(nodes: DataFrame, edges: DataFrame, symbols: DataFrame | None = None, fingerprints: DataFrame | None = None) -> DataFrame:
    """(fact, id, problem): repeated ids, blanks, bad JSON, confidences out of 0..1, bad line ranges, missing ends and owners.

    Only columns that a table has are looked at. What a row tells by itself is found in one pass over its table.
    """
    out = []

    def bad(df: DataFrame, kind: str, key: str, wrong: Column, name: str) -> None:
        out.append(df.where(wrong).select(F.lit(kind).alias("fact"), F.col(key).alias("id"), F.lit(name).alias("problem")))

    tables = [(nodes, "node", "stable_id"), (edges, "edge", "edge_id")]
    if symbols is not None:
        tables.append((symbols, "symbol", "symbol_id"))
    if fingerprints is not None:
        named = F.concat_ws("|", "symbol_id", "fingerprint_kind")
        tables.append((fingerprints.withColumn("fingerprint_id", named), "fingerprint", "fingerprint_id"))
    for df, kind, key in tables:
        own = []
        bad(df.groupBy(key).agg(F.count("*").alias("n")), kind, key, F.col("n") > 1, "repeated")
        for c in (key, "node_kind", "edge_kind", "canonical_key", "provider", "content_hash", "fully_qualified_name", "visibility", "normalized_signature", "signature_hash", "fingerprint_kind", "fingerprint_hash"):
            if c in df.columns:
                own.append(F.when(F.btrim(F.coalesce(c, F.lit(""))) == "", "blank" if c == key else f"blank_{c}"))
        for c in ("evidence_json", "parameter_metadata_json", "return_metadata_json", "normalized_members_json"):
            if c in df.columns:
                own.append(F.when(F.try_parse_json(F.col(c)).isNull(), f"json_{c}"))
        if "confidence" in df.columns:
            own.append(F.when(F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence"))
        if "start_line" in df.columns:
            a, b = F.col("start_line"), F.col("end_line")
            own.append(F.when((a.isNull() != b.isNull()) | F.coalesce((a <= 0) | (b <= 0) | (a > b), F.lit(False)), "line_range"))
        out.append(df.select(F.lit(kind).alias("fact"), F.col(key).alias("id"), F.explode(F.array_compact(F.array(*own))).alias("problem")))
    ends = [(edges, "edge", "edge_id", c, nodes, "stable_id", f"missing_{c}") for c in ("source", "target")]
    if symbols is not None:
        ends.append((symbols, "symbol", "symbol_id", "node_id", nodes, "stable_id", "missing_node"))
    if fingerprints is not None and symbols is not None:
        ends.append((tables[-1][0], "fingerprint", "fingerprint_id", "symbol_id", symbols, "symbol_id", "missing_symbol"))
    for df, kind, key, c, owners, owner, name in ends:
        bad(df.join(owners.select(F.col(owner).alias(c)), c, "left_anti"), kind, key, F.lit(True), name)
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found


def once_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")

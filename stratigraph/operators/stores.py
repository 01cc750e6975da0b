"""Append-only stores: records that are inserted once, their lists and pages, and views over several of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import page


def record_once(offered: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first offer of each key: what a store keeps if later ones of the same key change nothing."""
    rest = [c for c in offered.columns if c not in (*keys, *order)]
    first = offered.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return first.select(*keys, "m.*")


def summary_list(versions: DataFrame, summary: str) -> DataFrame:
    return versions.where(F.col("summary_id") == summary).orderBy("version_number")


def summary_page(versions: DataFrame, summary: str, limit: int = 20, offset: int = 0) -> DataFrame:
    return page(versions.where(F.col("summary_id") == summary), ["version_number"], limit, offset, 50)


def health_record(offered: DataFrame, components: DataFrame, decisions: DataFrame) -> DataFrame:
    """(revision, calculation_version, score, components, decision_ids): one snapshot per revision and calculation, its parts in order."""
    kept = record_once(offered, ["revision", "calculation_version"], ["recorded_at", "snapshot_id"])
    line = lambda c: F.concat_ws("=", c["component_key"], c["value"].cast("string"))
    parts = components.groupBy("snapshot_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("component_key", "value"))), line), ",").alias("components"))
    told = decisions.groupBy("snapshot_id").agg(F.array_join(F.sort_array(F.collect_set("decision_id")), ",").alias("decision_ids"))
    out = kept.join(parts, "snapshot_id", "left").join(told, "snapshot_id", "left")
    return out.select("revision", "calculation_version", "snapshot_id", "score", F.coalesce("components", F.lit("")).alias("components"), F.coalesce("decision_ids", F.lit("")).alias("decision_ids"))


def health_component_page(components: DataFrame, snapshot: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(components.where(F.col("snapshot_id") == snapshot), ["component_key"], limit, offset)


def cluster_store(offered: DataFrame) -> DataFrame:
    """One set of similarity clusters per revision, algorithm, version and hash, the first offered."""
    return record_once(offered, ["revision", "algorithm", "version", "hash"], ["created_at", "set_id"])


def cluster_sets_at(stored: DataFrame, revision: int | None = None) -> DataFrame:
    """The last set of a revision, or of all."""
    rows = stored if revision is None else stored.where(F.col("revision") == revision)
    return rows.orderBy(F.desc("created_at"), F.desc("set_id")).limit(1)


def record_decisions(offered: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, events): decisions with ordered targets, and the session event that each one writes with itself."""
    kept = record_once(offered, ["decision_id"], ["occurred_at"])
    told = targets.groupBy("decision_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target_ordinal", "target"))), lambda t: t["target"]), ",").alias("targets"))
    decisions = kept.join(told, "decision_id", "left").withColumn("targets", F.coalesce("targets", F.lit("")))
    events = decisions.select("session_id", F.lit("decision_recorded").alias("event_type"), "occurred_at", F.col("decision_id").alias("payload"))
    return decisions, events


def decision_list(decisions: DataFrame, session: str) -> DataFrame:
    return decisions.where(F.col("session_id") == session).orderBy("occurred_at", "decision_id")


def finding_resolutions(findings: DataFrame, links: DataFrame, decisions: DataFrame) -> DataFrame:
    """(finding_id, decision_id, resolution): findings with the decisions that resolution links tie to them."""
    return findings.select("finding_id").join(links, "finding_id").join(decisions.select("decision_id", "resolution"), "decision_id").select("finding_id", "decision_id", "resolution")


def member_identities(members: DataFrame, identities: DataFrame) -> DataFrame:
    """(cluster_id, stable_id, first_seen, last_seen, gone): similarity members with the identity of their node."""
    last = identities.agg(F.max("last_seen").alias("latest"))
    both = members.join(identities, "stable_id").crossJoin(F.broadcast(last))  # one row
    return both.select("cluster_id", "stable_id", "first_seen", "last_seen", (F.col("last_seen") < F.col("latest")).alias("gone"))


def inspection(observations: DataFrame, nodes: DataFrame, signals: DataFrame, decisions: DataFrame) -> DataFrame:
    """(finding_id, left_name, right_name, signals, decisions, advice): both sides of each finding with its evidence and history.

    A finding whose targets the revision no longer has is left out.
    """
    name = lambda side: nodes.select(F.col("stable_id").alias(f"{side}_id"), F.col("display_name").alias(f"{side}_name"))
    told = signals.groupBy("finding_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "score"))), lambda s: F.concat_ws(":", s["kind"], s["score"].cast("string"))), ",").alias("signals"))
    history = decisions.groupBy("finding_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("occurred_at", "decision_id")), asc=False), lambda d: d["decision_id"].cast("string")), ",").alias("decisions"),
        (F.max_by("resolution", F.struct("occurred_at", "decision_id")) == "ignored").alias("ignored"),
    )
    both = observations.join(name("left"), "left_id").join(name("right"), "right_id").join(told, "finding_id", "left").join(history, "finding_id", "left")
    return both.select("finding_id", "left_name", "right_name", F.coalesce("signals", F.lit("")).alias("signals"), F.coalesce("decisions", F.lit("")).alias("decisions"), F.when(F.col("ignored"), "review_ignored").otherwise("decide").alias("advice"))


def doctor_counts(checks: DataFrame) -> DataFrame:
    """(healthy, warnings, errors, state) of (check, severity) rows."""
    counts = checks.agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("ok", "healthy"), ("warning", "warnings"), ("error", "errors"))])
    return counts.withColumn("state", F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning").otherwise("ok"))


def preflight(decided: DataFrame, violations: DataFrame) -> DataFrame:
    """(candidates, reuse, violations, blocked): what a planned change is told, counts only, as its session event keeps it."""
    a = decided.agg(F.count("*").alias("candidates"), F.count_if(F.col("decision") == "Reuse").alias("reuse"))
    return a.crossJoin(violations.agg(F.count("*").alias("violations"))).withColumn("blocked", F.col("violations") > 0)


def layer_conventions(layers: dict[str, tuple[list[str], list[str]]], membership: DataFrame) -> DataFrame:
    """(ordinal, layer, text, nodes): a line for each configured layer, by name, and how many nodes it alone holds."""
    rows = [(k, n, f"- {n}: {', '.join(i)} may depend on {', '.join(m) or 'nothing'}") for k, (n, (i, m)) in enumerate(sorted(layers.items()))]
    told = membership.sparkSession.createDataFrame(rows, "ordinal long, layer string, text string")
    counts = membership.where("state = 'Assigned'").groupBy("layer").agg(F.count("*").alias("nodes"))
    return told.join(counts, "layer", "left").select("ordinal", "layer", "text", F.coalesce("nodes", F.lit(0)).alias("nodes"))

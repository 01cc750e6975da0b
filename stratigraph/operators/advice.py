"""Placement, health, planning and record-keeping operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import directory, file_name, r6, r6e
from ..llm.storage import Scratch
from ..sources.storage import checkpointed, parts_of
from .graph import explain_resolve


def cochange(baskets: DataFrame, minimum: int = 2, maximum_commits: int = 1000) -> DataFrame:
    """(left_path, right_path, commits, score): unordered pairs of paths that commits share; the score's divisor is the requested cap."""
    b = baskets.select("commit_id", "path").distinct()
    pairs = b.toDF("commit_id", "left_path").join(b.toDF("commit_id", "right_path"), "commit_id").where("left_path < right_path")
    got = pairs.groupBy("left_path", "right_path").agg(F.count("*").alias("commits")).where(F.col("commits") >= minimum)
    return got.withColumn("score", r6e(F.col("commits") / F.lit(maximum_commits)))


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, inside, boundary, cohesion): confidence of edges within a community against those that leave it."""
    a, b = members.toDF("source", "sc"), members.toDF("target", "tc")
    ends = edges.join(a, "source").join(b, "target").withColumn("w", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    sides = ends.select("w", F.explode(F.array_distinct(F.array("sc", "tc"))).alias("community"), (F.col("sc") == F.col("tc")).alias("inner_edge"))
    got = sides.groupBy("community").agg(F.sum(F.when(F.col("inner_edge"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum(F.when(~F.col("inner_edge"), F.col("w")).otherwise(0.0)).alias("boundary"))
    total = F.col("inside") + F.col("boundary")
    return got.select("community", r6("inside").alias("inside"), r6("boundary").alias("boundary"), F.when(total > 0, r6(F.col("inside") / total)).otherwise(0.0).alias("cohesion"))


def placement_overlap(dependencies: DataFrame) -> DataFrame:
    """dependencies (subject, cluster, confidence) -> (subject, cluster, score, gap, abstained): the cluster with most of a subject's confidence.

    Abstains below .5 or if the second is within .15.
    """
    each = dependencies.groupBy("subject", "cluster").agg(F.sum("confidence").alias("c"))
    total = Window.partitionBy("subject")
    scored = each.withColumn("score", r6(F.col("c") / F.sum("c").over(total)))
    order = total.orderBy(F.desc("score"), "cluster")
    best = scored.withColumn("k", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("score").over(order), F.lit(0.0))).where("k = 1")
    gap = r6(F.col("score") - F.col("next"))
    return best.select("subject", "cluster", "score", gap.alias("gap"), ((F.col("score") < 0.5) | (gap < 0.15)).alias("abstained"))


def split_or_append(modules: DataFrame) -> DataFrame:
    """(module, advice) from members, cohesion, fan_out and whether a name is given."""
    create = (F.col("members") >= 24) & (F.col("cohesion") <= 0.45) & (F.col("fan_out") >= 12) & F.col("named")
    return modules.select("module", F.when(create, "CreateNewFile").when((F.col("members") < 24) & (F.col("cohesion") > 0.45), "Append").otherwise("Abstain").alias("advice"))


def sibling_naming(types: DataFrame) -> DataFrame:
    """(directory, suffix, siblings): directories whose types, three or more, are named as their files and share one suffix."""
    t = types.select(directory(F.col("file_path")).alias("directory"), F.col("name"), F.regexp_extract(file_name(F.col("file_path")), r"^([^.]*)", 1).alias("stem"), F.regexp_extract("name", r"^\p{Lu}?[^\p{Lu}]*(\p{Lu}.*)$", 1).alias("suffix"))
    got = t.groupBy("directory").agg(F.count("*").alias("siblings"), F.countDistinct(F.when(F.col("suffix") != "", F.col("suffix"))).alias("n"), F.max("suffix").alias("suffix"), F.every(F.col("stem") == F.col("name")).alias("same"))
    return got.where("siblings >= 3 AND n = 1 AND same").select("directory", "suffix", "siblings")


def documentation_debt(nodes: DataFrame, revision: int, stale: int = 5) -> DataFrame:
    """(stable_id, age, eligible, stale, max_age): a row for each stale node of (stable_id, eligible, ai, last_revision), with the totals."""
    rows = nodes.where("eligible AND ai").withColumn("age", F.lit(revision) - F.col("last_revision"))
    old = F.col("age") >= stale
    totals = rows.agg(F.count("*").alias("eligible"), F.count_if(old).alias("stale"), F.max("age").alias("max_age"))
    return rows.where(old).select("stable_id", "age").crossJoin(F.broadcast(totals))  # one row


def health_score(inputs: DataFrame) -> DataFrame:
    """(introduced, legacy, duplicates, documentation, decisions) -> architecture, duplicate and overall score of each row."""
    arch = F.least(F.lit(1.0), (F.col("introduced") + F.col("legacy")) / 10)
    dup = F.least(F.lit(1.0), F.col("duplicates") / 10)
    lost = r6e(arch * 0.4) + r6e(dup * 0.2) + r6e(F.col("documentation") * 0.2) + r6e(F.col("decisions") * 0.2)
    score = F.round(100 * (1 - lost), 2)
    return inputs.withColumn("architecture_raw", arch).withColumn("duplicate_raw", dup).withColumn("score", F.when(F.col("introduced") > 0, F.least(score, F.lit(49.0))).otherwise(score))


def unified_advisories(parts: DataFrame, most: int = 10) -> DataFrame:
    """The most confident advisories (kind, target, confidence)."""
    return parts.orderBy(F.desc("confidence"), "kind", "target").limit(most)


def directory_rollup(summaries: DataFrame) -> DataFrame:
    """(directory, n, place, path, id, text): fresh summaries strictly below each directory, a row each, with their number and place by path and id.

    Paths alone are counted and placed; texts travel once, to the places of their row.
    """
    from ..sources.storage import checkpointed
    from .records import numbered

    fresh = checkpointed(summaries.where("state = 'Fresh'").select("path", "id", "text").withColumn("row", F.monotonically_increasing_id()))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    every = fresh.where(F.size(parts) > 1).select("row", "path", "id", F.explode(above).alias("directory"))
    counts = every.groupBy("directory").agg(F.count("*").alias("n"))
    placed = numbered(every, ["path", "id"], "place", ["directory"]).join(counts, "directory").select("row", "directory", "n", "place")
    return fresh.join(placed, "row").select("directory", "n", "place", "path", "id", "text")


def changelog(changes: DataFrame) -> DataFrame:
    """(session_id, text): a line per changed target, in order."""
    line = lambda s: F.concat(F.lit("- "), s["diff"], F.lit(" (summary "), s["version"].cast("string"), F.lit("; target "), s["target"], F.lit(")"))
    return changes.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "version", "diff"))), line), "\n").alias("text"))


def session_context(paths: DataFrame, most: int = 8, longest: int = 2000) -> DataFrame:
    """(session_id, paths): the first distinct paths of each session, as text of bounded length."""
    first = paths.groupBy("session_id", "path").agg(F.min("sequence_number").alias("k"))
    rank = first.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("k", "path"))).where(F.col("r") <= most)
    return rank.groupBy("session_id").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "path"))), lambda s: s["path"]), ","), 1, longest).alias("paths"))


def touched_batches(touches: DataFrame) -> DataFrame:
    """(session_id, target, ordinal, co_touched): order of first touch, and the others of the session."""
    first = touches.groupBy("session_id", "target").agg(F.min("sequence_number").alias("k"))
    own = first.withColumn("ordinal", F.row_number().over(Window.partitionBy("session_id").orderBy("k", "target")).cast("long"))
    count = own.groupBy("session_id").agg(F.max("ordinal").alias("n"))
    return own.join(count, "session_id").select("session_id", "target", "ordinal", F.array_join(F.filter(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: i != F.col("ordinal")), ",").alias("co_touched"))


def governed(requests: DataFrame, most_requests: int, most_tokens: int) -> DataFrame:
    """(session_id, request_id, allowed): running sums over a run's requests in order against quotas; repeats of a request are one."""
    once = requests.groupBy("session_id", "request_id").agg(F.min("sequence_number").alias("k"), F.max("tokens").alias("tokens"))
    w = Window.partitionBy("session_id").orderBy("k", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return once.select("session_id", "request_id", ((F.count("*").over(w) <= most_requests) & (F.sum("tokens").over(w) <= most_tokens)).alias("allowed"))


def summary_chain(appended: DataFrame) -> DataFrame:
    """(summary_id, version_id, version_number, supersedes, latest)."""
    w = Window.partitionBy("summary_id").orderBy("created_at", "version_id")
    return appended.select("summary_id", "version_id", F.row_number().over(w).cast("long").alias("version_number"), F.lag("version_id").over(w).alias("supersedes"), F.lead("version_id").over(w).isNull().alias("latest"))


def failure_work(events: DataFrame) -> DataFrame:
    """(work_id, state, next_attempt): open work by its latest event, in order of the next attempt."""
    last = events.groupBy("work_id").agg(F.max(F.struct("ordinal", "state", "next_attempt", "created_at")).alias("m"))
    return last.select("work_id", "m.state", F.coalesce("m.next_attempt", "m.created_at").alias("next_attempt")).where("state != 'completed'")


def token_budget(chunks: DataFrame, most: int) -> DataFrame:
    """(chunks, tokens): of the first chunks by id up to a clamped count, about four characters a token."""
    cut = max(1, min(2048, most))
    return chunks.orderBy("id").limit(cut).agg(F.count("*").alias("chunks"), F.sum(F.floor((F.length("text") + 3) / 4)).cast("long").alias("tokens"))


def resolve_unique(sites: DataFrame, types: DataFrame) -> DataFrame:
    """(site_id, name, stable_id, diagnostic): names that exactly one type has resolve; others say why not."""
    named = types.groupBy("name").agg(F.count("*").alias("n"), F.min("stable_id").alias("stable_id"))
    got = sites.join(named, "name", "left")
    return got.select("site_id", "name", F.when(F.col("n") == 1, F.col("stable_id")).alias("stable_id"), F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").alias("diagnostic"))


def message_edges(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(source, target, message, diagnostic): every producer with every consumer of its message type; without one a diagnostic.

    Producers come by ranges of messages, as many as shuffles have parts: rows of a message follow each other, and its consumers repeat
    in the same order, which files store in little space.
    """
    p, c = producers.select(F.col("stable_id").alias("source"), "message").distinct(), consumers.select(F.col("stable_id").alias("target"), "message").distinct()
    p = p.repartitionByRange(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "message", "source")
    return p.join(c, "message", "left").select("source", "target", "message", F.when(F.col("target").isNull(), "no_consumer").alias("diagnostic"))


def configuration_key(key: Column) -> Column:
    """a__b and a:b as a:b with trimmed segments; null if a segment is empty, . or .."""
    parts = F.transform(F.split(F.replace(key, F.lit("__"), F.lit(":")), ":"), lambda p: F.btrim(p))
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.when(~bad, F.array_join(parts, ":"))


def configuration_edges(reads: DataFrame, definitions: DataFrame) -> DataFrame:
    """(key, reads, definitions, diagnostic): reads and definitions that meet at a key."""
    keyed = lambda df, n: df.select(configuration_key(F.col("key")).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias(n))
    both = keyed(reads, "reads").join(keyed(definitions, "definitions"), "key", "full").fillna(0)
    return both.withColumn("diagnostic", F.when(F.col("definitions") == 0, "missing_definition").when(F.col("reads") == 0, "unused_definition"))


def queue_topology(publishes: DataFrame, routes: DataFrame, consumes: DataFrame) -> DataFrame:
    """(source, target, edge_kind): source to exchange, exchange to queue, queue to source."""
    part = lambda df, a, b, k: df.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(k).alias("edge_kind"))
    return part(publishes, "source", "exchange", "queue_publish").unionByName(part(routes, "exchange", "queue", "queue_route")).unionByName(part(consumes, "queue", "source", "queue_consume")).distinct()


def _by_turn(both: DataFrame, turns: DataFrame, parts: int) -> list[DataFrame]:
    """The edges (x, y, w) of the nodes x of each turn, dealt out and sorted by y, as a round's join with the labels of y needs them.

    They are written without adaptive plans, of which a checkpoint doesn't tell how they lie, so that each round would deal them out again.
    """
    conf, told = both.sparkSession.conf, both.join(turns, "x")
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [checkpointed(told.where(F.col("turn") == t).select("x", "y", "w").repartition(parts, "y").sortWithinPartitions("y")) for t in (0, 1)]
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def _moves(both: list[DataFrame], degree: DataFrame, total: float, rounds: int, scratch: Scratch) -> DataFrame:
    """(x, c): communities after rounds of local moves by modularity gain, each node in its own at first.

    both (x, y, w) comes by the turn of x and lies by y. A round reads the edges of the nodes whose turn it is and deals them out once, by x.
    Labels are written and read again, with the size of their files: a checkpoint keeps Spark's estimate of its
    joins, a product of sizes, which over rounds on rounds gets more digits than it can be multiplied with.
    """
    label = degree.select("x", F.col("x").alias("c"), "k", "turn")
    still = 0
    for r in range(rounds):
        size = label.groupBy("c").agg(F.sum("k").alias("ck"), F.count("*").alias("n"))
        known = label.join(size, "c")
        there = known.select(F.col("x").alias("y"), "c", "ck", "n")
        to = both[r % 2].join(there, "y").repartition("x").groupBy("x", "c", "ck", "n").agg(F.sum("w").alias("kin"))
        own = known.where(F.col("turn") == r % 2).select("x", "k", F.col("c").alias("own"), F.col("ck").alias("own_ck"), F.col("n").alias("own_n"))
        rest = F.col("ck") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = to.join(own, "x").where("NOT (own_n = 1 AND n = 1 AND c > own)").withColumn("gain", F.round(F.col("kin") - F.col("k") * rest / total, 9))
        # by x alone, as the join has left them
        best = gain.groupBy("x").agg(F.first("k").alias("k"), F.first("own_ck").alias("own_ck"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("kept"), F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("m"))
        # a community without neighbours of the node is not among them
        stay = F.coalesce("kept", F.round(-F.col("k") * (F.col("own_ck") - F.col("k")) / total, 9))
        moves = best.where(-F.col("m.g") > stay).select("x", F.col("m.c").alias("to"))
        new = label.join(moves, "x", "left").select("x", F.coalesce("to", "c").alias("c"), "k", "turn", F.col("to").isNotNull().alias("moved"))
        label = scratch.keep(new, f"label{r}")
        scratch.drop(f"label{r - 1}")
        still = 0 if label.where("moved").limit(1).count() else still + 1
        label = label.drop("moved")
        if still == 2:  # neither half of the nodes moves any more
            break
    return label.select("x", "c")


def _numbered(names: DataFrame) -> DataFrame:
    """(name, x): long numbers in the order of the names, by ranges of them; not consecutive."""
    return names.repartitionByRange("name").sortWithinPartitions("name").withColumn("x", F.monotonically_increasing_id())


def _weights(edges: DataFrame) -> DataFrame:
    """(a, b, w): undirected, parallel edges summed by their weight (1 without such a column), no self-loops."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return edges.where("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), weight.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def louvain(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 8, levels: int = 8) -> DataFrame:
    """(stable_id, community): the least member names a community; nodes (stable_id) without edges are their own.

    In even rounds nodes of even hashes move, in odd rounds the others, and of two nodes on their own only
    that with the greater name joins the other, so neighbours don't swap; a move goes to the community
    with the greatest gain, ties to the smallest name, and only for a gain. Then
    communities become the nodes of the next level, until none of them joins another.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    w = scratch.keep(_weights(edges), "weights")
    named = scratch.keep(_numbered(w.select(F.explode(F.array("a", "b")).alias("name")).distinct()), "names")
    number = lambda end: named.select(F.col("name").alias(end), F.col("x").alias(f"{end}_x"))
    pairs = scratch.keep(w.join(number("a"), "a").join(number("b"), "b").select("a_x", "b_x", "w"), "pairs")
    both = pairs.select(F.col("a_x").alias("x"), F.col("b_x").alias("y"), "w").union(pairs.select("b_x", "a_x", "w"))
    turns = named.select("x", F.pmod(F.xxhash64("name"), F.lit(2)).alias("turn"))
    degree = scratch.keep(both.groupBy("x").agg(F.sum("w").alias("k")).join(turns, "x"), "degree")
    # not fewer parts than the session has, or Spark deals them out again
    parts = lambda name: max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), parts_of(scratch.spark, scratch.path(name)))
    halves = _by_turn(both, turns, parts("pairs"))
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    members = degree.select(F.col("x").alias("member"), F.col("x").alias("community"))
    count = degree.count()
    for level in range(levels):
        label = scratch.keep(_moves(halves, degree, total, rounds, scratch), f"level{level}")
        members = scratch.keep(members.join(label.select(F.col("x").alias("community"), "c"), "community").select("member", F.col("c").alias("community")), f"members{level}")
        left = label.select("c").distinct().count()
        if left == count:
            break
        count = left
        a, b = label.toDF("x", "cx"), label.toDF("y", "cy")
        turns = degree.select("x", "turn")
        degree = scratch.keep(degree.join(label, "x").groupBy(F.col("c").alias("x")).agg(F.sum("k").alias("k")).join(turns, "x"), f"degree{level}")
        both = halves[0].union(halves[1]).join(a, "x").join(b, "y").where("cx != cy").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("w").alias("w"))
        halves = _by_turn(scratch.keep(both, f"pairs{level}"), turns, parts(f"pairs{level}"))
    least = members.groupBy("community").agg(F.min("member").alias("least")).join(named.select(F.col("x").alias("least"), F.col("name")), "least")
    found = members.join(least, "community").join(named.select(F.col("x").alias("member"), F.col("name").alias("stable_id")), "member").select("stable_id", F.col("name").alias("community"))
    if nodes is not None:
        alone = nodes.select("stable_id").distinct().join(found, "stable_id", "left_anti")
        found = found.unionByName(alone.withColumn("community", F.col("stable_id")))
    return found


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """Of a partition, by the same weights as louvain."""
    w = _weights(edges)
    m = w.agg(F.sum("w")).first()[0] or 1.0
    a, b = members.toDF("a", "ca"), members.toDF("b", "cb")
    inside = (w.join(a, "a").join(b, "b").where("ca = cb").agg(F.sum("w")).first()[0] or 0.0) / m
    deg = w.select(F.explode(F.array("a", "b")).alias("stable_id"), "w").join(members, "stable_id").groupBy("community").agg(F.sum("w").alias("d"))
    return inside - (deg.agg(F.sum((F.col("d") / (2 * m)) ** 2)).first()[0] or 0)


_QUESTIONS = ((re.compile(r"^\s*what\s+(?:breaks\s+if\s+i\s+delete|uses)\s+(.+?)\??\s*$", re.I), "dependents"), (re.compile(r"^\s*what\s+does\s+(.+?)\s+use\??\s*$", re.I), "dependencies"))


def map_question(text: str) -> tuple[str, str, int] | None:
    """(node, direction, depth 3) of the three phrasings; None is unsupported."""
    for pattern, direction in _QUESTIONS:
        if m := pattern.match(text):
            return m[1], direction, 3
    return None


CHECKPOINTS = ("baseline", "impact", "public_surface", "change", "verify", "record")


def safe_refactor(targets: DataFrame) -> DataFrame:
    """(target, ordinal, checkpoint): the six checkpoints of each target, in order."""
    return targets.select("target", F.posexplode(F.lit(list(CHECKPOINTS))).alias("k", "checkpoint")).select("target", (F.col("k") + 1).cast("long").alias("ordinal"), "checkpoint")


EXPLAINED = "section string, kind string, place long, detail string, provenance string"


def explain_architecture(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, decisions: DataFrame, versions: DataFrame, lookup: str, depth: int = 3) -> DataFrame:
    """(section, kind, place, detail, provenance): what is known of the node that a text names, from persisted facts alone.

    The node is found by id, else by path, else by part of its name. Facts are its declaration, source and provider, its first 40 edges and
    20 symbols by id; then the decisions on it by time, its last versions, and what is not known. No node gives no rows.
    """
    if not lookup.strip() or len(lookup) > 320 or not 0 <= depth <= 20:
        raise ValueError("lookup or history depth out of bounds")
    found = explain_resolve(nodes, lookup).first()  # one row
    spark = nodes.sparkSession
    if found is None:
        return spark.createDataFrame([], EXPLAINED)
    target = found["stable_id"]
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")

    def first(df: DataFrame, order: list, most: int, section: str, kind: str, detail: Column, provenance: str) -> DataFrame:
        some = df.orderBy(*order).limit(most)
        return some.select(F.lit(section).alias("section"), F.lit(kind).alias("kind"), F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*order)).cast("long").alias("place"), detail.alias("detail"), F.lit(provenance).alias("provenance"))

    own = nodes.where(F.col("stable_id") == target)
    line = F.coalesce(F.col("start_line").cast("string"), F.lit("?")) if "start_line" in nodes.columns else F.lit("?")
    key = F.col("canonical_key") if "canonical_key" in nodes.columns else F.col("stable_id")
    source = F.when(F.col("file_path").isNull(), "No persisted source path is available.").otherwise(F.concat(F.lit("Defined at "), "file_path", F.lit(":"), line, F.lit(".")))
    out = first(own, ["stable_id"], 1, "facts", "declaration", F.concat("node_kind", F.lit(" '"), "display_name", F.lit("' ("), key, F.lit(").")), "graph_nodes")
    out = out.unionByName(first(own, ["stable_id"], 1, "facts", "source", source, "graph_nodes"))
    out = out.unionByName(first(own, ["stable_id"], 1, "facts", "provider", F.concat(F.lit("Provider '"), "provider", F.lit("' reported confidence "), number("confidence"), F.lit(".")), "graph_nodes"))
    near = edges.where((F.col("source") == target) | (F.col("target") == target))
    told = F.when(F.col("source") == target, F.concat(F.lit("Depends on "), "target")).otherwise(F.concat(F.lit("Is depended on by "), "source"))
    out = out.unionByName(first(near, ["edge_id"], 40, "facts", "dependency", F.concat(told, F.lit(" through "), "edge_kind", F.lit(".")), "graph_edges"))
    surface = F.concat("visibility", F.lit(" symbol "), "fully_qualified_name", F.lit(" ("), "normalized_signature", F.lit(")."))
    out = out.unionByName(first(symbols.where(F.col("node_id") == target), ["symbol_id"], 20, "facts", "public_surface", surface, "graph_symbols"))
    mine = decisions.where(F.col("target") == target)
    out = out.unionByName(first(mine, ["occurred_at", "decision_id"], 2**31 - 1, "decisions", "decision", F.concat_ws(" ", "decision_id", "resolution", "note"), "architecture_decisions"))
    was = versions.where(F.col("stable_id") == target)
    span = F.concat(F.lit("Present from revision "), F.col("valid_from").cast("string"), F.when(F.col("valid_to").isNull(), "").otherwise(F.concat(F.lit(" through "), F.col("valid_to").cast("string"))), F.lit("."))
    recent = was.orderBy(F.desc("valid_from")).limit(max(depth, 1))
    place = F.row_number().over(Window.partitionBy("stable_id").orderBy(F.desc("valid_from"))).cast("long")
    past = recent.select(F.lit("history").alias("section"), F.when(F.col("valid_to").isNull(), "active").otherwise("historical").alias("kind"), place.alias("place"), span.alias("detail"), F.coalesce("file_path", F.lit("graph_node_versions")).alias("provenance"))
    past = past.where(F.lit(depth > 0))
    none = lambda df, text, k: df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("unknown").alias("section"), F.lit("unknown").alias("kind"), F.lit(k).cast("long").alias("place"), F.lit(text).alias("detail"), F.lit("none").alias("provenance"))
    out = out.unionByName(past).unionByName(none(past, "No bounded historical revision evidence is available for this node.", 1))
    return out.unionByName(none(mine, "No architecture decisions target this graph node.", 2))


def map_questions(questions: DataFrame, text: str) -> DataFrame:
    """questions with (node, direction, depth): the three phrasings as expressions; null is unsupported."""
    into = F.regexp_extract(text, r"(?i)^\s*what\s+(?:breaks\s+if\s+i\s+delete|uses)\s+(.+?)\??\s*$", 1)
    out = F.regexp_extract(text, r"(?i)^\s*what\s+does\s+(.+?)\s+use\??\s*$", 1)
    node = F.when(into != "", into).when(out != "", out)
    return questions.withColumn("node", node).withColumn("direction", F.when(into != "", "dependents").when(out != "", "dependencies")).withColumn("depth", F.when(node.isNotNull(), 3))

"""Similarity and duplicate evidence: hybrid scores, clusters, signatures, bands, vectors, clones, findings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions.spans import block_of, every_level, span_blocks, span_level
from ..functions.text import directory, extension, jaccard, name_tokens, r6, r6e, tokens
from ..llm.storage import Scratch
from ..sources.storage import checkpointed, parts_of

#: bytes of nodes' or symbols' files for one part, whose rows become words
NODE_BYTES = 1 << 20
#: evidence weights: symbol, signature, dependency neighbourhood, file context, embedding, module context
WEIGHTS = {"symbol": 0.25, "signature": 0.25, "neighbourhood": 0.15, "file": 0.15, "embedding": 0.10, "module": 0.10}


def similarity_facts(nodes: DataFrame, edges: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """(stable_id, words, path_words, file_path, layer, sig_words, outs, ins): what hybrid scores compare, once per node.

    sig_words are those of a node's first symbol, null without one. Nodes and symbols meet in parts of the size of their files, as
    they are; words are made of what has met.
    """
    rows = nodes.select("stable_id", "display_name", "file_path", *(["layer"] if "layer" in nodes.columns else [F.lit(None).cast("string").alias("layer")]))
    signature = F.lit(None).cast("array<string>")
    if symbols is not None:
        spark, scratch = nodes.sparkSession, Scratch(nodes.sparkSession, "similarity-facts")
        told = F.concat_ws(" ", "fully_qualified_name", "normalized_signature", "return_metadata_json", "parameter_metadata_json")
        sides = scratch.keep(rows, "nodes"), scratch.keep(symbols.select(F.col("node_id").alias("stable_id"), "symbol_id", told.alias("told")), "symbols")
        # not fewer than the session's number, or Spark deals them out again for the next join
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), *[parts_of(spark, scratch.path(n), NODE_BYTES) for n in ("nodes", "symbols")])
        rows, said = (df.repartition(parts, "stable_id") for df in sides)
        rows = rows.join(said.groupBy("stable_id").agg(F.min(F.struct("symbol_id", "told")).alias("s")), "stable_id", "left")
        signature = F.when(F.col("s").isNotNull(), tokens(F.col("s.told")))
    facts = rows.select("stable_id", tokens(F.concat_ws(" ", "display_name", "stable_id")).alias("words"), tokens(F.coalesce("file_path", F.lit(""))).alias("path_words"), "file_path", "layer", signature.alias("sig_words"))
    none = F.array().cast("array<string>")
    if edges is None:
        return facts.withColumn("outs", none).withColumn("ins", none)
    outs = edges.groupBy(F.col("source").alias("stable_id")).agg(F.collect_set("target").alias("outs"))
    ins = edges.groupBy(F.col("target").alias("stable_id")).agg(F.collect_set("source").alias("ins"))
    return facts.join(outs, "stable_id", "left").join(ins, "stable_id", "left").withColumn("outs", F.coalesce("outs", none)).withColumn("ins", F.coalesce("ins", none))


def hybrid_scores(pairs: DataFrame) -> DataFrame:
    """Scores of pairs of similarity_facts rows a and b (structs): symbol, signature, neighbourhood, file and module evidence.

    An evidence that is not available takes no share of the weights; evidence and contributions are rounded. Neighbourhoods are
    compared by the rows' sets, or are a column shared_ends of the pairs.
    """
    a, b = F.col("a"), F.col("b")
    both_layers = a["layer"].isNotNull() & b["layer"].isNotNull()
    both_paths = (F.btrim(F.coalesce(a["file_path"], F.lit(""))) != "") & (F.btrim(F.coalesce(b["file_path"], F.lit(""))) != "")
    file = 0.5 * jaccard(a["path_words"], b["path_words"]) + F.when(directory(a["file_path"]) == directory(b["file_path"]), 0.3).otherwise(0.0) + F.when(extension(a["file_path"]) == extension(b["file_path"]), 0.2).otherwise(0.0)
    evidence = {
        "symbol": jaccard(a["words"], b["words"]),
        "signature": F.when(b["sig_words"].isNotNull(), jaccard(F.coalesce(a["sig_words"], a["words"]), b["sig_words"])),
        "neighbourhood": F.col("shared_ends") if "shared_ends" in pairs.columns else (jaccard(a["outs"], b["outs"]) + jaccard(a["ins"], b["ins"])) / 2,
        "file": F.when(both_paths, file),
        "module": F.when(both_layers, F.when(a["layer"] == b["layer"], 1.0).otherwise(0.0)),
    }
    # a row's evidence is made once, below the generator: what comes after reads numbers, and no filter takes the words to itself
    once = pairs.withColumn("evidence", F.array(F.struct(*[r6(c).alias(n) for n, c in evidence.items()])))
    raw = once.select(*pairs.columns, F.explode("evidence").alias("evidence")).select(*pairs.columns, "evidence.*")
    total, score, support = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in evidence:
        total = total + F.when(F.col(n).isNotNull(), F.lit(WEIGHTS[n])).otherwise(0.0)
    raw = raw.withColumn("total", total)
    for n in evidence:
        score = score + F.coalesce(r6(F.col(n) * WEIGHTS[n] / F.col("total")), F.lit(0.0))
        support = support + F.when(F.col(n) > 0, 1).otherwise(0)
    raw = raw.withColumn("score", r6(score)).withColumn("support", support.cast("long")).drop("total")
    confidence = F.when((F.col("score") >= 0.7) & (F.col("support") >= 3), "High").when((F.col("score") >= 0.4) & (F.col("support") >= 2), "Medium").otherwise("Low")
    return raw.where("score > 0").withColumn("confidence", confidence)


def shared_ends(edges: DataFrame, source: str) -> DataFrame:
    """(stable_id, shared_ends): the mean of the Jaccard similarities of targets and of sources with those of one node.

    Only the node's own ends are matched, by a semi-join, and what is kept of a node are two counts each way: no set is built.
    Both the ends and the nodes that share them are written first, so that their joins know their size; only the links of these
    nodes are counted.
    """
    scratch, parts = Scratch(edges.sparkSession, "shared-ends"), []
    for near, far in (("source", "target"), ("target", "source")):
        links = edges.select(F.col(near).alias("stable_id"), F.col(far).alias("end"))
        own = scratch.keep(links.where(F.col("stable_id") == source).select("end").distinct(), f"own-{near}")
        size = own.agg(F.count("*").alias("size"))
        both = scratch.keep(links.join(own, "end", "left_semi").distinct().groupBy("stable_id").agg(F.count("*").alias("common")), f"common-{near}")
        each = links.join(both, "stable_id", "left_semi").distinct().groupBy("stable_id").agg(F.count("*").alias("n")).join(both, "stable_id").crossJoin(F.broadcast(size))  # one row
        parts.append(each.select("stable_id", (F.col("common") / (F.col("n") + F.col("size") - F.col("common"))).alias("share")))
    return parts[0].unionByName(parts[1]).groupBy("stable_id").agg((F.sum("share") / 2).alias("shared_ends"))


def find_similar(facts: DataFrame, source: str, limit: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(candidate_id, score, confidence, support): the best candidates for one node, which is one broadcast row.

    With edges their ends are compared as shared_ends has them; facts then come without edges.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit out of bounds")
    one = facts.where(F.col("stable_id") == source).select(F.struct("*").alias("a")).limit(1)
    others = facts.where(F.col("stable_id") != source)
    shared = []
    if edges is not None:  # by the column that the facts are dealt out by
        others, shared = others.join(shared_ends(edges, source), "stable_id", "left"), [F.coalesce("shared_ends", F.lit(0.0)).alias("shared_ends")]
    pairs = others.select(F.struct(*facts.columns).alias("b"), *shared).crossJoin(F.broadcast(one))
    level = F.when(F.col("confidence") == "High", 2).when(F.col("confidence") == "Medium", 1).otherwise(0)
    best = hybrid_scores(pairs).select(F.col("b.stable_id").alias("candidate_id"), "score", "confidence", "support").orderBy(F.desc("score"), F.desc(level), "candidate_id").limit(limit)
    return Scratch(facts.sparkSession, "similar").keep(best, "best")  # a few rows, read more than once


def blend_embeddings(scored: DataFrame, cosines: DataFrame) -> DataFrame:
    """Scores blended three to one with a cosine where there is one."""
    return scored.join(cosines, "candidate_id", "left").withColumn("score", F.when(F.col("cosine").isNotNull(), r6e(0.75 * F.col("score") + 0.25 * F.col("cosine"))).otherwise(F.col("score"))).drop("cosine")


def similarity_pairs(facts: DataFrame, threshold: float = 0.6, pool: int = 500, per_seed: int = 50) -> DataFrame:
    """(left_id, right_id, score): pairs of the first pool nodes by id, of each seed's best per_seed, with two kinds of evidence.

    The feature compares the whole pool with itself: pool rows, which are broadcast, so the rest is one map.
    """
    if not 1 <= pool <= 500:
        raise ValueError("pool out of bounds")
    generated = F.contains(F.lower("file_path"), F.lit(".g.")) | F.contains(F.lower("file_path"), F.lit("/obj/"))
    first = facts.where(~F.coalesce(generated, F.lit(False))).orderBy("stable_id").limit(pool).select(F.struct("*").alias("f"))
    wide = first.toDF("a").repartition(facts.sparkSession.sparkContext.defaultParallelism, "a")
    pairs = wide.crossJoin(F.broadcast(first.toDF("b"))).where("a.stable_id != b.stable_id")
    seed = Window.partitionBy("seed").orderBy(F.desc("score"), "other")
    scored = hybrid_scores(pairs).where("support >= 2").select(F.col("a.stable_id").alias("seed"), F.col("b.stable_id").alias("other"), "score")
    best = scored.withColumn("k", F.row_number().over(seed)).where(F.col("k") <= per_seed)
    return best.where(f"seed < other AND score >= {threshold}").select(F.col("seed").alias("left_id"), F.col("other").alias("right_id"), "score")


def clusters(pairs: DataFrame) -> DataFrame:
    """(stable_id, cluster_id, member_score): connected components of scored pairs by least labels; a member's mean edge score."""
    both = checkpointed(pairs.select(F.col("left_id").alias("x"), F.col("right_id").alias("y"), "score").union(pairs.select("right_id", "left_id", "score")))
    label = both.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("c"))
    while True:
        label = checkpointed(label)
        near = both.join(label.select(F.col("x").alias("y"), "c"), "y").select("x", "c")
        new = label.union(near).groupBy("x").agg(F.min("c").alias("c"))
        new = new.join(label.select(F.col("x").alias("c"), F.col("c").alias("cc")), "c", "left").select("x", F.least("c", F.coalesce("cc", "c")).alias("c"))  # labels jump to their label's label
        new = checkpointed(new)
        moved = new.join(label.withColumnRenamed("c", "old"), "x").where("c != old").limit(1).count()
        label = new
        if not moved:
            break
    score = both.groupBy("x").agg(r6e(F.avg("score")).alias("member_score"))
    return label.join(score, "x").select(F.col("x").alias("stable_id"), F.col("c").alias("cluster_id"), "member_score")


def signature_similarity(pairs: DataFrame) -> DataFrame:
    """pairs of (left, right) structs (symbol_id, name, parameter_types, return_type, arity) with score and its four parts."""
    a, b = F.col("left"), F.col("right")
    one_if = lambda c: F.when(c, 1.0).otherwise(0.0)
    returns, arity = one_if(a["return_type"].eqNullSafe(b["return_type"])), one_if(a["arity"] == b["arity"])
    name = name_similarity(a["name"], b["name"], 1.0)
    scored = pairs.select("*", parameter_score(a["parameter_types"], b["parameter_types"]).alias("params"), returns.alias("returns"), arity.alias("arity_score"), name.alias("name_score"))
    return scored.withColumn("score", signature_score(F.col("params"), F.col("returns"), F.col("arity_score"), F.col("name_score")))


def parameter_score(a: Column, b: Column) -> Column:
    """The share of places with equal types; two empty lists are equal."""
    longest = F.greatest(F.size(a), F.size(b))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when(longest == 0, 1.0).otherwise(F.coalesce(equal, F.lit(0)) / longest)


def signature_score(params: Column, returns: Column, arity: Column, name: Column) -> Column:
    return r6(0.35 * params + 0.20 * returns + 0.15 * arity + 0.30 * name)


#: signatures of one side that a group of pairs compares
SIGNATURE_BLOCK = 2048


def signature_pairs(items: DataFrame) -> DataFrame:
    """(left_id, right_id, score): all pairs of different symbol_ids of items (symbol_id, name, parameter_types, return_type, arity).

    Items are cut into blocks of about SIGNATURE_BLOCK by the hash of their ids, and each two blocks are one group. Those of a block
    with one name and parameters are one row; each two rows are compared once, and have the four scores that their items' equal or
    different return types and arities give. Pairs are made last and never dealt out.
    """
    items = items.where("symbol_id IS NOT NULL")
    blocks = max(1, -(-items.count() // SIGNATURE_BLOCK))
    own = F.pmod(F.xxhash64("symbol_id"), F.lit(blocks)).cast("int").alias("own")
    rows = items.groupBy(own, "name", "parameter_types").agg(F.collect_list(F.struct("symbol_id", "return_type", "arity")).alias("items"))
    rows = checkpointed(rows.withColumn("words", name_tokens(F.col("name"))))
    one = F.struct("name", "words", "parameter_types", "items")
    left = rows.select(F.col("own").alias("x"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("y"), one.alias("a"))
    right = rows.select(F.explode(F.sequence(F.lit(0), "own")).alias("x"), F.col("own").alias("y"), one.alias("b"))
    met = spread(left, "x", "y").join(spread(right, "x", "y").hint("merge"), ["x", "y"])
    a, b = F.col("a"), F.col("b")
    alike = parameter_score(a["parameter_types"], b["parameter_types"]), name_similarity(a["name"], b["name"], 1.0, (a["words"], b["words"]))
    met = met.select("x", "y", "a.items", F.col("b.items").alias("others"), *[c.alias(n) for c, n in zip(alike, ("params", "names"), strict=True)])
    scores = F.array(*[signature_score(F.col("params"), F.lit(r), F.lit(a), F.col("names")) for r in (0.0, 1.0) for a in (0.0, 1.0)])
    met = met.select("x", "y", "items", "others", scores.alias("scores"))
    pairs = met.select("x", "y", "scores", "others", F.explode("items").alias("a")).select("x", "y", "scores", "a", F.explode("others").alias("b"))
    x, y = a["symbol_id"], b["symbol_id"]
    which = F.when(a["return_type"].eqNullSafe(b["return_type"]), 2).otherwise(0) + F.when(a["arity"] == b["arity"], 1).otherwise(0)
    pairs = pairs.where((F.col("x") < F.col("y")) | (x < y))  # within a block each two rows meet both ways
    return pairs.select(F.least(x, y).alias("left_id"), F.greatest(x, y).alias("right_id"), F.get("scores", which).alias("score"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """As many tasks as shuffles have, also where the rows are few: what is done with each of them is what costs."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def profile_pairs(items: DataFrame, within: list[str], key: str, alike: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(left, right, score): all pairs of different keys of items of one group (within), scored once for each pair of profiles.

    Items that agree in within and alike have one profile. score adds a column score to pairs of structs a and b of these
    columns, and may leave pairs out; it has to be symmetric. Items meet the scores by their profiles' numbers.
    """
    profile = [*within, *alike]
    known = checkpointed(items.select(*profile).distinct().withColumn("profile", F.monotonically_increasing_id()))
    a, b = (known.select(*within, F.struct("profile", *profile).alias(n)) for n in "ab")
    scored = score(spread(a, *within).join(b.hint("merge"), within).where("a.profile <= b.profile"))
    scored = checkpointed(scored.select(F.col("a.profile").alias("p"), F.col("b.profile").alias("q"), "score"))
    told = known.toDF(*[f"_{c}" for c in known.columns])
    held = items.join(told, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in profile]))
    held = checkpointed(held.select(F.col(key).alias("key"), F.col("_profile").alias("profile")))
    met = spread(scored.join(held.toDF("x", "p"), "p"), "q").join(held.toDF("y", "q").hint("merge"), "q").where("x < y OR (p != q AND x != y)")
    return met.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "score")


def name_similarity(a: Column, b: Column, empty: float = 0.0, words: tuple[Column, Column] | None = None) -> Column:
    """.6 of the tokens' Jaccard and .4 of the edit similarity of the upper-case names; words are their tokens, if made before."""
    x, y = F.upper(a), F.upper(b)
    longest = F.greatest(F.length(x), F.length(y))
    edit = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)
    return 0.6 * jaccard(*(words or (name_tokens(a), name_tokens(b))), empty) + 0.4 * edit


def named_alike(pairs: DataFrame, meaning: Column, a: Column, b: Column, semantic: float = 0.8, naming: float = 0.45) -> DataFrame:
    """The pairs that mean and sound the same, with name_score."""
    return pairs.where(meaning >= semantic).withColumn("name_score", r6(name_similarity(a, b))).where(F.col("name_score") >= naming)


def naming_advisories(pairs: DataFrame, semantic: float = 0.8, naming: float = 0.45) -> DataFrame:
    """(left_id, right_id, name_score) of pairs (left_id, left_name, right_id, right_name, semantic) that mean and sound the same."""
    rows = named_alike(pairs, F.col("semantic"), F.col("left_name"), F.col("right_name"), semantic, naming)
    return rows.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "name_score")


#: signal kind -> score from which it counts
THRESHOLDS = {"structural": 0.70, "signature": 0.75, "semantic": 0.80}


def aggregate_signals(signals: DataFrame) -> DataFrame:
    """(left_id, right_id, qualified, likely, confidence): two kinds of evidence over their thresholds make a pair likely."""
    least = F.lit(2.0)
    for kind, t in THRESHOLDS.items():
        least = F.when(F.col("kind") == kind, t).otherwise(least)
    ok = F.col("score") >= least
    pairs = signals.groupBy(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    got = pairs.agg(F.count_if(ok).alias("qualified"), F.sum(F.when(ok, F.col("score"))).alias("s"))
    return got.select("left_id", "right_id", "qualified", (F.col("qualified") >= 2).alias("likely"), F.coalesce(r6(F.col("s") / F.col("qualified")), F.lit(0.0)).alias("confidence"))


def decision_feedback(decisions: DataFrame) -> DataFrame:
    """(finding_id, suppressed, adjustment): the latest decision suppresses if it ignores; the adjustment is the mean of all."""
    value = F.when(F.col("resolution") == "accepted", 0.05).when(F.col("resolution") == "ignored", -0.10).otherwise(-0.03)
    return decisions.groupBy("finding_id").agg((F.max_by("resolution", F.struct("occurred_at", "decision_id")) == "ignored").alias("suppressed"), r6(F.avg(value)).alias("adjustment"))


def partition_bands(candidates: DataFrame) -> DataFrame:
    """(language, complexity_band, size_band, method_id, n_members): the methods of bands of two or more that are not mere data shapes."""
    c, n = F.col("cyclomatic_complexity"), F.col("logical_line_count")
    rows = candidates.where("NOT is_data_shape").select(
        "method_id", F.lower(F.btrim("language")).alias("language"), F.when(c <= 1, "1").when(c <= 3, "2-3").when(c <= 8, "4-8").otherwise("9+").alias("complexity_band"), F.when(n <= 10, "small").when(n <= 30, "medium").otherwise("large").alias("size_band")
    )
    band = ["language", "complexity_band", "size_band"]
    sizes = rows.groupBy(*band).agg(F.count("*").alias("n_members")).where("n_members >= 2")
    return rows.join(sizes, band).select(*band, "method_id", "n_members")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: vectors of one side that a group of pairs compares
BAND_BLOCK = 1024


def band_cosine(vectors: DataFrame) -> DataFrame:
    """(band, left_id, right_id, cosine, z): all pairs of a band, that is the feature; z by the band's mean and population deviation.

    A band is cut into blocks of about BAND_BLOCK vectors by the hash of their ids, and each two of its blocks are one group. A
    band's statistics are sums that the groups make of their pairs; the pairs are made again behind them, which costs less than to keep them.
    """
    rows = vectors.select("band", "id", "embedding").where("id IS NOT NULL")
    blocks = rows.groupBy("band").agg(F.ceil(F.count("*") / F.lit(BAND_BLOCK)).cast("int").alias("blocks"))
    dealt = checkpointed(rows.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("band", "id")}
    parts = _pairs_of_blocks(dealt).applyInArrow(_pair_sums, f"band {kinds['band']}, n long, m double, s double")
    parts = checkpointed(parts)
    # a row a band; means are taken from the least one, so that equal cosines deviate by nothing
    least = parts.groupBy("band").agg(F.min("m").alias("base"))
    mean = parts.join(least, "band").groupBy("band", "base").agg((F.col("base") + F.sum(F.col("n") * (F.col("m") - F.col("base"))) / F.sum("n")).alias("mean"))
    bands = parts.join(mean, "band").groupBy("band", "mean").agg(F.sqrt(F.sum(F.col("s") + F.col("n") * (F.col("m") - F.col("mean")) ** 2) / F.sum("n")).alias("deviation"))
    told = _pairs_of_blocks(dealt.join(bands, "band", "left"))
    return told.applyInArrow(_scored_pairs, f"band {kinds['band']}, left_id {kinds['id']}, right_id {kinds['id']}, cosine double, z double")


def _pairs_of_blocks(dealt: DataFrame) -> GroupedData:
    """Each vector in all pairs of its block with the blocks of its band."""
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    return spread(each, "band", "x", "y").groupBy("band", "x", "y")


def _compared(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, places of left and right ids, cosines) of a group's pairs; nan where a vector is null or has no direction."""
    rows = rows.sort_by("id").combine_chunks()
    ids, own = rows["id"].combine_chunks(), rows["own"].to_numpy()
    rank = pc.rank(ids, tiebreaker="dense").to_numpy()
    vectors = rows["embedding"].to_pylist() if rows["embedding"].null_count else None
    if vectors is None:
        flat, size = pc.list_flatten(rows["embedding"]), pc.unique(pc.list_value_length(rows["embedding"]))
        if len(size) > 1 or flat.null_count:
            raise ValueError("vectors of a band differ in length or hold nulls")
        v = flat.to_numpy().astype(np.float64).reshape(len(rows), -1)
    else:
        size = max((len(x) for x in vectors if x is not None), default=1)
        v = np.array([[np.nan] * size if x is None else x for x in vectors], np.float64)
    norm = np.sqrt((v * v).sum(1))
    a, b = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    with np.errstate(all="ignore"):
        c = v[a] @ v[b].T / (norm[a, None] * norm[None, b])
    low, high = np.minimum(a[:, None], b[None, :]), np.maximum(a[:, None], b[None, :])
    kept = rank[low] != rank[high]
    if rows["x"][0] == rows["y"][0]:
        kept &= a[:, None] < b[None, :]
    elif own.min() == own.max():  # the other block is empty
        kept[:] = False
    c = c[kept] * 1e6
    return ids, low[kept], high[kept], np.trunc(c + np.copysign(0.5, c)) / 1e6


def _pair_sums(rows: pa.Table) -> pa.Table:
    c = _compared(rows)[3]
    c = c[~np.isnan(c)]
    some = c[: min(1, len(c))]
    m = some + (c - c[:1]).sum() / max(1, len(c))
    return pa.table({"band": rows["band"].combine_chunks().take(pa.array(np.zeros(len(some), np.int64))), "n": pa.array([len(c)] * len(some), pa.int64()), "m": pa.array(m, pa.float64()), "s": pa.array([((c - x) ** 2).sum() for x in m], pa.float64())})


def _scored_pairs(rows: pa.Table) -> pa.Table:
    ids, low, high, c = _compared(rows)
    mean, deviation = rows["mean"][0].as_py(), rows["deviation"][0].as_py()
    z = (c - mean) / deviation if deviation else np.zeros(len(c))
    told = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
    return pa.table({"band": pa.repeat(rows["band"][0], len(c)), "left_id": ids.take(pa.array(low)), "right_id": ids.take(pa.array(high)), "cosine": told(c), "z": told(z)})


def projection_sign(bit: int, index: int) -> int:
    """The fixed pseudo-random sign of a projection's component."""
    s = ((bit + 1) * 747796405 + (index + 1) * 2891336453) & 0xFFFFFFFF
    s ^= s >> 16
    s = (s * 2246822519) & 0xFFFFFFFF
    return -1 if s % 2 == 0 else 1


def fingerprints(vectors: DataFrame, dimension: int, bits: int = 64) -> DataFrame:
    """(id, fp): one bit per random-sign projection, set where the projection is not negative."""
    out = F.lit(0).cast("long")
    matrix = F.array(*[F.array(*[F.lit(float(projection_sign(b, i))) for i in range(dimension)]) for b in range(bits)])
    signs = F.transform(matrix, lambda row: F.aggregate(F.zip_with("embedding", row, lambda x, s: x.cast("double") * s), F.lit(0.0), lambda a, x: a + x) >= 0)
    out = F.aggregate(F.transform(signs, lambda s, k: F.when(s, F.expr("1L")).otherwise(F.expr("0L"))), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))
    return vectors.select("id", out.alias("fp"))


def embedding_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy(F.size("embedding").cast("long").alias("dimension")).agg(F.count("*").alias("n"))


def cache_plan(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(content_hash, cached): which chunks have a vector already."""
    have = cache.select("content_hash", F.lit(True).alias("c")).distinct()
    return wanted.select("content_hash").distinct().join(have, "content_hash", "left").select("content_hash", F.coalesce("c", F.lit(False)).alias("cached"))


def narrowest_container(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(range_id, stable_id, state): the narrowest node of a file that holds a line range; equal spans are ambiguous.

    Nodes of one span are one row with their number and least id. A span is listed in the two blocks at most
    that it reaches into at the level whose blocks are as long as it is; ranges look in the block where they
    start, once a level. So the join is on (file, level, block) and no row is listed more than that.
    """
    spans = nodes.groupBy("file_path", "node_start", "node_end").agg(F.count("*").alias("nodes"), F.min("stable_id").alias("id"))
    spans = spans.withColumn("level", span_level(F.col("node_start"), F.col("node_end")))
    listed = spans.withColumn("block", F.explode(span_blocks(F.col("node_start"), F.col("node_end"), F.col("level"))))
    looked = ranges.withColumn("level", every_level()).withColumn("block", block_of(F.col("start_line"), F.col("level")))
    held = looked.join(listed.hint("merge"), ["file_path", "level", "block"]).where("node_start <= start_line AND node_end >= end_line")
    lengths = held.groupBy("range_id", (F.col("node_end") - F.col("node_start")).alias("span")).agg(F.sum("nodes").alias("n"), F.min("id").alias("id"))
    best = lengths.groupBy("range_id").agg(F.min(F.struct("span", "n", "id")).alias("m"))
    out = ranges.select("range_id").join(best, "range_id", "left")
    return out.select("range_id", F.when(F.col("m.n") == 1, F.col("m.id")).alias("stable_id"), F.when(F.col("m").isNull(), "unmapped").when(F.col("m.n") > 1, "ambiguous").otherwise("mapped").alias("state"))


def map_clones(clones: DataFrame, nodes: DataFrame) -> DataFrame:
    """(left_id, right_id, pair_id, exclusion): clone ranges as pairs of executable symbols, or why not."""
    sides = clones.select("clone_id", F.posexplode(F.array("first", "second")).alias("side", "r")).select(F.concat_ws("#", "clone_id", "side").alias("range_id"), "clone_id", "side", F.col("r.path").alias("file_path"), F.col("r.start_line").alias("start_line"), F.col("r.end_line").alias("end_line"))
    mapped = narrowest_container(sides, nodes).join(sides.select("range_id", "clone_id", "side", "file_path"), "range_id")
    a = mapped.where("side = 0").select("clone_id", F.col("stable_id").alias("x"), F.col("state").alias("s1"), F.col("file_path").alias("p1"))
    b = mapped.where("side = 1").select("clone_id", F.col("stable_id").alias("y"), F.col("state").alias("s2"), F.col("file_path").alias("p2"))
    generated = lambda p: p.rlike(r"(?i)(^|/)(generated|obj)/|\.(g|generated|designer)\.cs$")
    why = F.when(generated(F.col("p1")) | generated(F.col("p2")), "generated").when((F.col("s1") == "ambiguous") | (F.col("s2") == "ambiguous"), "ambiguous").when((F.col("s1") == "unmapped") | (F.col("s2") == "unmapped"), "unmapped").when(F.col("x") == F.col("y"), "same_symbol")
    left, right = F.least("x", "y"), F.greatest("x", "y")
    return a.join(b, "clone_id").select("clone_id", left.alias("left_id"), right.alias("right_id"), F.sha2(F.concat_ws("\x1f", left, right), 256).alias("pair_id"), why.alias("exclusion"))


def evaluate_detection(cases: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and false positive rate of (expected, actual) booleans."""
    e, a = F.col("expected"), F.col("actual")
    c = cases.agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"), F.count_if(~e & ~a).alias("tn"))
    share = lambda x, y: F.when(F.col(x) + F.col(y) > 0, F.col(x) / (F.col(x) + F.col(y))).otherwise(0.0)
    return c.select("*", r6(share("tp", "fp")).alias("precision"), r6(share("tp", "fn")).alias("recall"), r6(share("fp", "tn")).alias("false_positive_rate"))


def lifecycle_changes(desired: DataFrame, events: DataFrame, revision: int) -> DataFrame:
    """(finding_id, state): states that differ from the latest one as of a revision."""
    now = events.where(F.col("revision") <= revision).groupBy("finding_id").agg(F.max_by("state", F.struct("revision", "event_id")).alias("was"))
    return desired.join(now, "finding_id", "left").where(~F.col("state").eqNullSafe(F.col("was"))).select("finding_id", "state")


#: what to look at before acting on a decision
REUSE_CHECKS = {"Reuse": "get_dependents,check_violation", "Extend": "get_dependents,get_module_rules,check_violation", "DoNotReuse": "get_dependents,check_violation", "InsufficientEvidence": "find_similar,get_dependents"}


def explain_reuse(candidates: DataFrame, nodes: DataFrame, symbols: DataFrame, proposed: str | None, intent: str = "") -> DataFrame:
    """(candidate_id, supporting, differentiating, decision, checks): whether a proposal should reuse each candidate.

    The proposal is a node, an intent in words, or both. Names, persisted signatures, public visibility and directories decide. A
    candidate, or a named proposal, that is no node gives the factor candidate_missing or proposal_missing and no checks.
    """
    key = F.col("canonical_key") if "canonical_key" in nodes.columns else F.col("stable_id")

    def facts(chosen: DataFrame, theirs: DataFrame) -> DataFrame:
        first = theirs.groupBy(F.col("node_id").alias("stable_id")).agg(F.min(F.struct("symbol_id", "normalized_signature", "visibility")).alias("s"))
        return chosen.select("stable_id", "display_name", "file_path", key.alias("key")).join(first, "stable_id", "left")

    asked = candidates.select(F.col("candidate_id").alias("stable_id"))
    # one row also where there is no such node
    own = F.first(F.struct(F.lit(True).alias("there"), F.col("display_name").alias("own_name"), F.col("file_path").alias("own_path"), F.col("s").alias("own")))
    one = facts(nodes.where(F.col("stable_id") == (proposed or "")), symbols.where(F.col("node_id") == (proposed or ""))).agg(own.alias("p")).select("p.*")
    # a few candidates don't make all nodes and symbols meet
    there = facts(nodes.join(asked, "stable_id", "left_semi"), symbols.join(asked.withColumnRenamed("stable_id", "node_id"), "node_id", "left_semi")).withColumn("known", F.lit(True))
    rows = asked.join(there, "stable_id", "left").crossJoin(F.broadcast(one))
    known, named = F.col("known").isNotNull(), F.col("there").isNotNull()
    usable = known & (named if proposed is not None else F.lit(True))
    names = jaccard(tokens(F.concat_ws(" ", F.lit(intent), "own_name")), tokens(F.concat_ws(" ", "display_name", "key"))) > 0
    comparable = F.col("s").isNotNull() & F.col("own").isNotNull()
    same = comparable & (F.col("s.normalized_signature") == F.col("own.normalized_signature"))
    together = named & F.coalesce((F.btrim("own_path") != "") & (F.btrim("file_path") != "") & (directory(F.col("own_path")) == directory(F.col("file_path"))), F.lit(False))
    apart = named & ~together & ~F.col("own_path").eqNullSafe(F.col("file_path"))
    public = (F.lower("s.visibility") == "public") & (F.lower("own.visibility") == "public")
    decision = (
        F.when(~usable, "InsufficientEvidence")
        .when(F.coalesce(public, F.lit(False)) & comparable & ~same, "DoNotReuse")
        .when(same & (names.cast("int") + together.cast("int") >= 1), "Reuse")
        .when(names & comparable & ~same, "Extend")
        .otherwise("InsufficientEvidence")
    )
    told = lambda *parts: F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in parts]), lambda x: x.isNotNull()), ",")
    checks = F.lit("")
    for name, what in REUSE_CHECKS.items():
        checks = F.when(F.col("usable") & (F.col("decision") == name), what).otherwise(checks)
    return rows.select(
        F.col("stable_id").alias("candidate_id"),
        told(("symbol_overlap", usable & names), ("public_signature_match", usable & same), ("file_ownership_overlap", usable & together)).alias("supporting"),
        told(("candidate_missing", ~known), ("proposal_missing", known & ~usable), ("public_signature_mismatch", usable & comparable & ~same), ("file_ownership_difference", usable & apart)).alias("differentiating"),
        decision.alias("decision"), usable.alias("usable"),
    ).withColumn("checks", checks).drop("usable")

"""Blended similarity, placement feedback, questions, fingerprints of rules, the active revision."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advice, clones, rules, similarity
from ..registry import query
from ..sources import storage
from ..sources.versioned import VersionStore
from .rule_queries import HARD, LAYERS
from .similarity_queries import DOC_FACTS, SCORE, hybrid_sql

TOP = DOC_FACTS + ", raw AS (SELECT b.stable_id AS candidate_id, " + hybrid_sql("a", "b") + " FROM facts b, (SELECT * FROM facts WHERE stable_id = 'd:1') a WHERE b.stable_id != 'd:1')" + SCORE + """,
 top AS (SELECT candidate_id, score, support FROM done WHERE score > 0 ORDER BY score DESC, CASE WHEN score >= 0.7 AND support >= 3 THEN 2
 WHEN score >= 0.4 AND support >= 2 THEN 1 ELSE 0 END DESC, candidate_id LIMIT 50),
 cs AS (SELECT concat('d:', b.vec_id) AS candidate_id, list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS c
 FROM vecs a, vecs b WHERE a.vec_id = 1)"""


@query("doc_nodes vecs", TOP + " SELECT candidate_id, CASE WHEN c IS NULL THEN score ELSE round_even(0.75::DOUBLE * score + 0.25::DOUBLE * c, 6) END AS score FROM top LEFT JOIN cs USING (candidate_id)")
def find_similar(doc_nodes: DataFrame, vecs: DataFrame) -> DataFrame:
    best = similarity.find_similar(similarity.similarity_facts(doc_nodes), "d:1", 50)
    one = vecs.where("vec_id = 1").select(F.col("embedding").alias("e"))
    cosines = vecs.crossJoin(F.broadcast(one)).select(F.concat(F.lit("d:"), "vec_id").alias("candidate_id"), similarity.cosine(F.col("embedding"), F.col("e")).alias("cosine"))
    return similarity.blend_embeddings(best, cosines).select("candidate_id", "score")


PLACED = "SELECT concat('c', user_id % 80) AS finding_id, event_id AS decision_id, CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'ignored' ELSE 'modified' END AS resolution, ts AS occurred_at FROM {events}"


@query("", " SELECT finding_id, max_by(resolution, (occurred_at, decision_id)) = 'ignored' AS suppressed FROM placed GROUP BY 1", placed=PLACED)
def placement_feedback(placed: DataFrame) -> DataFrame:
    return similarity.decision_feedback(placed).select("finding_id", "suppressed")


ASKED = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('What breaks if I delete ', c_name, '?') WHEN 1 THEN concat('what uses ', c_name) WHEN 2 THEN concat('What does ', c_name, ' use') ELSE c_name END AS question, c_name FROM {customer}"


@query("", " SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS node, CASE WHEN c_custkey % 4 < 2 THEN 'dependents' WHEN c_custkey % 4 = 2 THEN 'dependencies' END AS direction FROM asked", asked=ASKED)
def nl_query(asked: DataFrame) -> DataFrame:
    return advice.map_questions(asked, "question").select("c_custkey", "node", "direction")


@query("snaps", f" SELECT max(revision) AS revision, count(*) FILTER (revision = (SELECT max(revision) FROM snaps)) AS node_count, '{rules.rule_fingerprint(LAYERS, HARD)}' AS rule_fingerprint FROM snaps")
def scan_active_revision(snaps: DataFrame) -> DataFrame:
    """The last two snapshots are committed in order; the last manifest names the active one, whose nodes are read."""
    spark = snaps.sparkSession
    store = VersionStore(spark, f"{storage.checkpoint_folder(spark)}/revisions-{uuid.uuid4().hex[:12]}", buckets=4)
    last = [r["revision"] for r in snaps.select("revision").distinct().orderBy(F.desc("revision")).limit(2).collect()]
    for r in reversed(last):
        store.commit({"nodes": snaps.where(F.col("revision") == r).drop("revision")}, f"run {r}", revision=r)
    count = store.snapshot("nodes").agg(F.lit(store.active_revision()).cast("long").alias("revision"), F.count("*").alias("node_count"))
    return count.withColumn("rule_fingerprint", F.lit(rules.rule_fingerprint(LAYERS, HARD)))


@query("", """, t AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM docs),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM t)),
 h AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s HAVING count(*) > 1) SELECT first_id AS left_id, doc_id AS right_id, count(*) AS shared FROM g
 JOIN h USING (s) WHERE doc_id != first_id GROUP BY 1, 2""", docs="SELECT doc_id, text FROM {documents}")
def clone_detect(docs: DataFrame) -> DataFrame:
    """(left_id, right_id, shared): 50-token windows that documents share, each with their first holder."""
    return clones.token_clones(docs, 50)


RANGES = r""", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM docs),
 w AS (SELECT doc_id, line, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y != '') AS ts FROM l),
 t AS (SELECT doc_id, list(tok ORDER BY line, k) AS ws, list(line ORDER BY line, k) AS ls FROM (SELECT doc_id, line, unnest(ts) AS tok, unnest(range(len(ts))) AS k
 FROM w) GROUP BY doc_id),
 g AS (SELECT doc_id AS path, pl, array_to_string(ws[pl + 1:pl + 50], ' ') AS s, ls[pl + 1] AS a, ls[pl + 50] AS b FROM (SELECT *, unnest(range(len(ws) - 49)) AS pl
 FROM t WHERE len(ws) >= 50)),
 o AS (SELECT s, min({'path': path, 'pl': pl, 'a': a, 'b': b}) AS own FROM g GROUP BY s HAVING count(*) > 1),
 m AS (SELECT g.*, own, g.pl - own.pl AS diagonal FROM g JOIN o USING (s) WHERE g.path != own.path OR g.pl - own.pl >= 50),
 i AS (SELECT *, pl - row_number() OVER (PARTITION BY own.path, path, diagonal ORDER BY pl) AS island FROM m),
 r AS (SELECT own.path AS p1, path AS p2, diagonal, count(*) AS n, min(pl) AS pl, min(a) AS a2, max(b) AS b2, min(own.a) AS a1, max(own.b) AS b1 FROM i
 GROUP BY own.path, path, diagonal, island)
"""


@query("", RANGES + """ SELECT sha256(concat_ws(chr(31), p1, p2, pl - diagonal, pl)) AS clone_id, CAST(p1 AS VARCHAR) AS first_path, a1 AS first_start, b1 AS first_end, CAST(p2 AS VARCHAR) AS second_path, a2 AS second_start, b2 AS second_end,
 n + 49 AS tokens, least(b2 - a2, b1 - a1) + 1 AS lines FROM r WHERE least(b2 - a2, b1 - a1) >= 2""", docs="SELECT doc_id, text FROM {documents}")
def clone_ranges(docs: DataFrame) -> DataFrame:
    """Equal ranges of 50 tokens and three lines or more, each with its first holder."""
    found = clones.clone_ranges(docs.withColumnRenamed("doc_id", "path"), 50, 2)
    side = lambda s: [F.col(f"{s}.{a}").alias(f"{s}_{b}") for a, b in (("path", "path"), ("start_line", "start"), ("end_line", "end"))]
    return found.select("clone_id", *side("first"), *side("second"), "tokens", "lines")


@query("", None, docs="SELECT doc_id, text FROM {documents}")
def clone_symbols(docs: DataFrame) -> DataFrame:
    """The ranges found, as pairs of the symbols that hold them: every document is one symbol, its first half another."""
    found = clones.clone_ranges(docs.withColumnRenamed("doc_id", "path"), 50, 2)
    size = F.size(F.split("text", "\n", -1))
    whole = docs.select(F.concat(F.lit("m:"), "doc_id").alias("stable_id"), F.col("doc_id").cast("string").alias("file_path"), F.lit(1).alias("node_start"), size.alias("node_end"))
    half = docs.select(F.concat(F.lit("h:"), "doc_id").alias("stable_id"), F.col("doc_id").cast("string").alias("file_path"), F.lit(1).alias("node_start"), F.floor(size / 2).cast("int").alias("node_end")).where("node_end >= 1")
    kept = storage.checkpointed(found.select("clone_id", "first", "second"))  # read more than once
    return similarity.map_clones(kept, whole.unionByName(half))

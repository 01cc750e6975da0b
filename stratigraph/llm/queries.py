"""Queries op1 to op13 over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, mixing, quality
from .cross_polytope import nearest
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .ngram_join import jaccard_components
from .passages import repeated_passages
from .piece_bpe import encode_documents
from .token_counts import token_counts
from .vector_codes import compressed
from .warc import archive_and_read
from .whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files are on this cluster; they are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoting = spark.sql("SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(quoting)
    return chat.digests(chat.format_chats(rows))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")), quality.POLICIES["v1"])
    base = quality.POLICIES["base"].mask
    return rows.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"(fail_bits & {base}) != 0 AS base_failed", "kept", "n_lines", "n_upper", "fail_bits")


@query
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, and what it alone rejects, from the ledger's bits."""
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents")), quality.POLICIES["v1"])


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents")).drop("fp")


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(_table(spark, sf_dir, "embeddings"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"))


LEDGER = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x != '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM s)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
hit AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_upper FROM s LEFT JOIN hit USING (rid)),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 16 * n_words)::INT + 32 * (100 * n_upper > 60 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
"""
ORACLES["op8_quality_rules"] = LEDGER + "SELECT *, (fail_bits & 3) != 0 AS base_failed, fail_bits = 0 AS kept FROM b"

ORACLES["quality_ablations"] = LEDGER + """, r AS (SELECT unnest(['few_words', 'repeated_words', 'symbols', 'duplicate_lines', 'word_length', 'shouting']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT 'v1' AS policy, rule, count(*) FILTER ((fail_bits & bit) != 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only FROM b, r GROUP BY rule
"""

ORACLES["op4_source_mixing"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '')) AS BIGINT) AS size, source IS NULL AS no_source, coalesce(source, '') AS source_key,
 md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS place FROM documents),
q AS (SELECT *, CAST(sum(size) OVER (PARTITION BY no_source, source_key ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM d),
s AS (SELECT no_source, source_key, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM d GROUP BY 1, 2),
t AS (SELECT *, 2.0::DOUBLE * source_size / weight AS used_up, CAST(1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
 / sum(weight) OVER (ORDER BY source_size / weight, no_source, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS time FROM s),
c AS (SELECT *, max(CASE WHEN time <= used_up THEN time END) OVER () AS cut FROM t),
l AS (SELECT rid, q.doc_id, size, source_size, weight, cut, e, unnest([0, 1]) AS lap FROM q JOIN c USING (no_source, source_key)),
g AS (SELECT *, e - size + lap * source_size AS begins, (e + lap * source_size) / weight AS finish FROM l)
SELECT doc_id, size, source_size, coalesce(least(weight * cut, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target,
 CAST(sum(CASE WHEN cut IS NULL OR finish <= cut THEN size WHEN begins / weight < cut THEN greatest(0, least(size, CAST(floor(cut * weight) AS BIGINT) - begins)) ELSE 0 END) AS BIGINT) AS taken, e / weight AS virtual_finish
FROM g GROUP BY rid, doc_id, size, source_size, weight, cut, e
"""

ORACLES["op6_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(r, '(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|TURN\])', '\1\\\2\3', 'g') AS er, regexp_replace(x, '(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|TURN\])', '\1\\\2\3', 'g') AS ex, row_number() OVER o AS k, lag(r) OVER o AS before, lead(r) OVER o AS behind FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(r, chr(10), x, chr(10)), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(x, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(sum(CASE WHEN before = r THEN 6 ELSE 9 + length(er) + 7 END + length(ex) + CASE WHEN behind = r THEN 0 ELSE 4 END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

ORACLES["op11_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(text, '')) AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, t, i, ls[i] AS x, trim(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS k FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT k AS lost FROM (SELECT DISTINCT k, doc_id, t FROM l WHERE k != '') GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(lost) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (lost IS NULL), '')) AS kept_sha256 FROM l LEFT JOIN f ON k = lost GROUP BY rid, doc_id
"""


def _lloyd_sql(rounds: int = 4, entries: int = 256) -> str:
    """Every part against every entry, round by round."""
    near = "min({{'d': list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w), 'i': entry}})"
    sql = """
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 4) + 1:(part + 1) * (len(x) // 4)] AS v FROM (SELECT r, x, unnest(range(4)) AS part FROM e)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS w FROM p WHERE r <= {entries})"""
    for k in range(rounds + 1):
        sql += f""",
a{k} AS MATERIALIZED (SELECT r, part, v, {near.replace("{{", "{").replace("}}", "}")} AS m FROM p JOIN c{k} USING (part) GROUP BY r, part, v)"""
        if k < rounds:
            sql += f""",
n{k} AS (SELECT part, entry, list(floor(s / n) ORDER BY j) AS u FROM (SELECT part, m.i AS entry, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT part, m, v, unnest(range(1, len(v) + 1)) AS j FROM a{k}) GROUP BY ALL) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u, w) AS w FROM c{k} LEFT JOIN n{k} USING (part, entry))"""
    return sql.replace("{entries}", str(entries)) + f""",
o AS (SELECT r, string_agg(lower(lpad(to_hex(m.i), 2, '0')), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(w) AS y, unnest(range(len(w))) AS j FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN e USING (r), h
"""


ORACLES["op12_vector_code_compression"] = _lloyd_sql()

"""The driver's tables as fact tables of the engine.

Each projection is one SELECT that Spark and DuckDB both run, so a query and its oracle start from the
same rows; {name} stands for a table.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from .sources.storage import PART_BYTES, parts_of

NODES = """
SELECT concat('r:', r_regionkey) AS stable_id, 'region' AS node_kind, r_name AS display_name, concat('src/', r_name, '/region.cs') AS file_path, 'geo' AS provider, CAST(1.0 AS DOUBLE) AS confidence FROM {region}
UNION ALL SELECT concat('n:', n_nationkey), 'nation', n_name, concat('src/', r_name, '/', n_name, '/nation.cs'), 'geo', CAST(1.0 AS DOUBLE) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('c:', c_custkey), 'customer', c_name, concat('src/', r_name, '/', n_name, '/customer.cs'), 'crm', CAST(0.8 AS DOUBLE) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('s:', s_suppkey), 'supplier', s_name, concat('src/', r_name, '/', n_name, '/supplier.cs'), 'crm', CAST(0.8 AS DOUBLE) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('p:', p_partkey), 'part', p_name, concat('Features/parts/', replace(p_brand, '#', ''), '/part.cs'), 'crm', CAST(0.65 AS DOUBLE) FROM {part}
UNION ALL SELECT concat('o:', o_orderkey), 'order', concat('Order#', o_orderkey), concat('Features/orders/', o_orderstatus, '/order.g.cs'), 'erp', CAST(0.4 AS DOUBLE) FROM {orders}
"""

EDGES = """
SELECT concat(edge_kind, ':', source, '>', target) AS edge_id, source, target, edge_kind, confidence FROM (
SELECT concat('n:', n_nationkey) AS source, concat('r:', n_regionkey) AS target, 'contains' AS edge_kind, CAST(1.0 AS DOUBLE) AS confidence FROM {nation}
UNION ALL SELECT concat('c:', c_custkey), concat('n:', c_nationkey), 'references', CAST(1.0 AS DOUBLE) FROM {customer}
UNION ALL SELECT concat('s:', s_suppkey), concat('n:', s_nationkey), 'references', CAST(1.0 AS DOUBLE) FROM {supplier}
UNION ALL SELECT concat('o:', o_orderkey), concat('c:', o_custkey), 'references', CAST(1.0 AS DOUBLE) FROM {orders}
UNION ALL SELECT concat('o:', l_orderkey), concat('p:', l_partkey), 'calls', CAST(1.0 AS DOUBLE) - max(l_discount) FROM {lineitem} GROUP BY l_orderkey, l_partkey
UNION ALL SELECT concat('o:', l_orderkey), concat('s:', l_suppkey), 'supplied_by', CAST(1.0 AS DOUBLE) - max(l_discount) FROM {lineitem} GROUP BY l_orderkey, l_suppkey
) AS e
"""

#: a cyclic graph of all pairs: parts and suppliers share their numbers as modules
MODULE_EDGES = """
SELECT DISTINCT concat('m', lpad(CAST(l_partkey AS VARCHAR(9)), 9, '0'), '>m', lpad(CAST(l_suppkey AS VARCHAR(9)), 9, '0')) AS edge_id,
concat('m', lpad(CAST(l_partkey AS VARCHAR(9)), 9, '0')) AS source, concat('m', lpad(CAST(l_suppkey AS VARCHAR(9)), 9, '0')) AS target
FROM {lineitem}
"""

#: what the nodes of parts and suppliers declare
SYMBOLS = """
SELECT concat('sym:p', p_partkey) AS symbol_id, concat('p:', p_partkey) AS node_id, concat('Parts.', replace(p_name, ' ', '.')) AS fully_qualified_name, CASE p_size % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'public' ELSE 'internal' END AS visibility,
concat(p_type, '(', p_size, ')') AS normalized_signature, concat('[', p_size, ']') AS parameter_metadata_json, concat('"', p_brand, '"') AS return_metadata_json, md5(p_type) AS signature_hash FROM {part}
UNION ALL SELECT concat('sym:s', s_suppkey), concat('s:', s_suppkey), concat('Suppliers.', replace(s_name, '#', '.')), CASE WHEN s_nationkey % 2 = 0 THEN 'public' ELSE 'private' END,
concat('Supply(', s_nationkey, ')'), concat('[', s_nationkey, ']'), '"void"', md5(CAST(s_nationkey AS VARCHAR(9))) FROM {supplier}
"""

#: revision = day; a node is a user's kind of event; its content is how many there were up to a granularity
SNAPSHOTS = """
SELECT CAST(day(ts) AS BIGINT) AS revision, concat('u', user_id, ':', event_type) AS stable_id, event_type AS node_kind,
concat('users/', user_id % 10, '/', event_type, '.cs') AS file_path, CAST(count(*) AS VARCHAR(20)) AS content_hash
FROM {events} GROUP BY day(ts), user_id, event_type
"""

SESSION_EVENTS = """
SELECT concat('s', user_id) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence_number, event_type, ts AS occurred_at, event_id, value FROM {events}
"""

BASKETS = "SELECT DISTINCT l_orderkey AS commit_id, concat('p', l_partkey % 300) AS path FROM {lineitem}"

DOC_NODES = """
SELECT concat('d:', doc_id) AS stable_id, concat(source, ' ', lang, ' ', n_chars, '_', doc_id % 100) AS display_name, concat('docs/', lang, '/', source, '.md') AS file_path, lang AS layer FROM {documents}
"""

VECTORS = "SELECT vec_id, concat('v', lpad(CAST(vec_id AS VARCHAR(20)), 9, '0')) AS id, embedding, concat('b', label) AS band FROM {embeddings}"

PAGE_PATHS = "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM {pages}"


#: what a projection groups by keys that hold one column: the table comes dealt out by that column, so a group is made where its rows are
DEALT = {EDGES: {"lineitem": "l_orderkey"}}


def tables_of(sql: str) -> list[str]:
    return sorted({f for _, f, _, _ in string.Formatter().parse(sql) if f})


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A projection, or any SQL over {tables}, as a DataFrame."""
    return spark.sql(sql, **{t: _table(spark, f"{sf_dir}/{t}.parquet", DEALT.get(sql, {}).get(t)) for t in tables_of(sql)})


def _table(spark: SparkSession, path: str, key: str | None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if key is None else rows.repartition(parts_of(spark, path, PART_BYTES), key)


def plain(sql: str) -> str:
    """The same for an engine where the tables have their own names."""
    return sql.format(**{t: t for t in tables_of(sql)})

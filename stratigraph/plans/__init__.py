"""Composite queries, registered by importing their modules."""

from . import advice_queries, graph_queries, history_queries, more_queries, record_queries, rule_queries, similarity_queries, store_queries, stream_queries, version_queries  # noqa: F401

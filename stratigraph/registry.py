"""Queries of the graph engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import projections as p

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: name in SQL -> projection
FACTS = {"nodes": p.NODES, "edges": p.EDGES, "mods": p.MODULE_EDGES, "syms": p.SYMBOLS, "snaps": p.SNAPSHOTS, "sess": p.SESSION_EVENTS, "baskets": p.BASKETS, "doc_nodes": p.DOC_NODES, "vecs": p.VECTORS, "page_paths": p.PAGE_PATHS}


def query(facts: str, sql: str | None = None, **selects: str):
    """Registers f(projections...) under its name; facts names the projections, selects adds others by name.

    sql, if given, starts from the same projections as common table expressions.
    """
    names = facts.split()

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[p.project(spark, sf_dir, FACTS[n]) for n in names], **{n: p.project(spark, sf_dir, s) for n, s in selects.items()})

        QUERIES[f.__name__] = run
        if sql:
            given = [(n, p.plain(FACTS[n])) for n in names] + [(n, p.plain(s)) for n, s in selects.items()]
            ORACLES[f.__name__] = "WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" for n, s in given) + sql  # noqa: S608
        return f

    return add

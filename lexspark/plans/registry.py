"""All queries of the core library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.plans import alerts, contact, dating, drift, edges, graph, learning, quality, records, references, relations, resolve, scalars, sources, store, streams, wikitext

FLAGSHIP = "text_dating"
_MODULES = (dating, records, scalars, alerts, resolve, contact, drift, edges, graph, store, sources, wikitext, relations, quality, streams, learning, references)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

"""The engine's registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import answers, memory, messages, names, outputs, relations, retrieval, scalars, search, streams

_MODULES = (retrieval, search, answers, relations, scalars, outputs, names, memory, streams, messages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

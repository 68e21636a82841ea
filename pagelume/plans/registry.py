"""Registered queries: name -> function of (spark, sf_dir), and name -> SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brand_queries, cell_queries, page_queries, registry_queries, table_queries

_MODULES = (page_queries, cell_queries, registry_queries, table_queries, brand_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}

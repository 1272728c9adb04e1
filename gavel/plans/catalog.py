"""The named query catalogue: Spark callables and their DuckDB oracle SQL.

Each area module exports ``QUERIES`` (name -> callable(spark, sf_dir)) and
``ORACLE`` (name -> DuckDB SQL); names without an oracle are rows-only.
"""

from __future__ import annotations

import importlib

AREAS = ["q_governance", "q_analytics", "q_tasks", "q_text", "q_more", "q_sources", "q_streaming"]


def _load():
    queries, oracle = {}, {}
    for area in AREAS:
        mod = importlib.import_module(f"gavel.plans.{area}")
        queries.update(mod.QUERIES)
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]

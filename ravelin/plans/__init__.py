"""Query plans over the driver's tables."""

from __future__ import annotations


def _load() -> None:
    from . import feature_queries, frame_queries, join_queries, model_queries, record_queries, stat_queries, window_queries  # noqa: F401


def all_queries() -> dict:
    from .catalogue import QUERIES

    _load()
    return QUERIES


def all_sql() -> dict:
    from .catalogue import SQL

    _load()
    return SQL

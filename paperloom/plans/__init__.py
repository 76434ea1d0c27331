"""Registered queries of the library, by area."""

from __future__ import annotations

from . import charts, dedup, gates, joins, media, reports, search, streams, structure, text
from ._registry import ORACLE, QUERIES

__all__ = ["charts", "dedup", "gates", "joins", "media", "reports", "search", "streams", "structure", "text"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)

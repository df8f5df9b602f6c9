"""All named queries of the engine."""

from __future__ import annotations

from . import audits, events, further, index, more, reports, rules, scores, texts  # noqa: F401
from .registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

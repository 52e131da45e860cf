"""Named queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib

FAMILIES = [
    "flagship", "url_queries", "html_queries", "company_queries", "contact_queries", "text_queries",
    "quality_queries", "dedup_queries", "join_queries", "report_queries",
    "ranking_queries", "vector_queries", "source_queries", "stream_queries",
]


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"webrec.plans.{name}")


def all_queries():
    _load()
    from webrec.plans.registry import QUERIES

    return dict(QUERIES)


def all_oracles():
    _load()
    from webrec.plans.registry import ORACLES

    return dict(ORACLES)

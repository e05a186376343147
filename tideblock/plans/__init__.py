"""Views over the given tables and the catalogue of registered queries."""

from __future__ import annotations

from tideblock.plans.catalog import QUERIES, Query


def all_queries() -> dict[str, Query]:
    from tideblock.plans import log_queries, market_queries, research_queries, run_queries, stream_queries  # noqa: F401

    return QUERIES

"""All registered queries and oracles."""

from __future__ import annotations

from kinsight.plans import attribution_queries, clustering_queries, governance_queries, graph_queries, member_queries, profile_queries, quality_queries, registry, session_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracles():
    return dict(registry.ORACLES)

"""Every registered query, with its SQL counterpart where there is one."""

from __future__ import annotations

from sluiceway.catalog.base import REGISTRY, Query, Tables


def load_all() -> dict[str, Query]:
    from sluiceway.catalog import checks, gate_queries, ingest, mart_queries, metric_queries, run_queries, text_queries, transforms  # noqa: F401

    return dict(REGISTRY)


__all__ = ["Query", "Tables", "load_all"]

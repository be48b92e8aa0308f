"""All named queries in one place."""

from __future__ import annotations

from voxtide.plans import catalog_ingest, catalog_labels, catalog_search, catalog_text  # noqa: F401
from voxtide.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""The registered queries of the reference's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from weftline.plans import catalog_pages, catalog_search, catalog_urls
from weftline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog_pages", "catalog_search", "catalog_urls"]

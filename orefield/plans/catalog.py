"""All queries of the library outside the training-data operators."""

from __future__ import annotations

from orefield.plans import chemistry, documents, fulltext, operations, relational, safety, search, services  # noqa: F401
from orefield.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""All registered queries."""

from __future__ import annotations

from outlay.plans import (  # noqa: F401
    q_events,
    q_explore,
    q_health,
    q_normalize,
    q_readers,
    q_resolve,
    q_spend,
    q_store,
)
from outlay.plans.catalog import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

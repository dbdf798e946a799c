"""Every query of the dataflow operators with its SQL twin."""

from __future__ import annotations

from millrace.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

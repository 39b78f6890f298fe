"""Names of the queries, and the SQL that gives the same rows."""

from __future__ import annotations

from telemill.plans import catalogue


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict:
    return dict(catalogue.ORACLES)

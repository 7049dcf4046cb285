"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from cohortvox.plans import case_queries, cohort_queries, report_queries, text_queries

_MODULES = (cohort_queries, text_queries, report_queries, case_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}

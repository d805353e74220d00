"""All queries and their SQL."""

from __future__ import annotations

from strataform.plans import chains, checks, lineage, problems, reference, rules


def queries() -> dict:
    return problems.QUERIES | reference.QUERIES | checks.QUERIES | chains.QUERIES | lineage.QUERIES | rules.QUERIES


def oracle_sql() -> dict[str, str]:
    return problems.SQL | reference.SQL | checks.SQL | chains.SQL | lineage.SQL | rules.SQL

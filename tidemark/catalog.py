"""All queries over the register operators, and their SQL."""

from __future__ import annotations

from tidemark.plans import base, feeds, records, registers, rules, texts, views, workflow  # noqa: F401  the plans register themselves


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)

"""All registered queries."""

from __future__ import annotations

from plinth.plans import catalogs, files, gates, inputs, jobs, planning, registry, slides, tables, textual  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return {name: registry.expand(sql) for name, sql in registry.ORACLES.items()}

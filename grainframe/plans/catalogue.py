"""Every query on the reference's operators by name, with the SQL it is held against."""

from __future__ import annotations

from grainframe.plans import audit, banks, measures, overlap, selection, signals, statistics, study

_ALL = overlap.QUERIES | statistics.QUERIES | study.QUERIES | audit.QUERIES | banks.QUERIES | signals.QUERIES | measures.QUERIES | selection.QUERIES


def queries():
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}

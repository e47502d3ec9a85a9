"""Every query of the engine by name, and its SQL."""

from __future__ import annotations

from . import content, dynamic, era, formats, rcedtg, records, reports, selection

MODULES = (era, dynamic, rcedtg, content, selection, reports, records, formats)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}

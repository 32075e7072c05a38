"""Registered queries and their SQL."""

from __future__ import annotations

from callweave.plans import calls, conformed, filtered, guided, routing, search, texts

_MODULES = (calls, texts, search, conformed, filtered, routing, guided)


def _merged(tables: list[dict]) -> dict:
    out: dict = {}
    for table in tables:
        if again := out.keys() & table:
            raise ValueError(f"registered twice: {sorted(again)}")
        out |= table
    return out


QUERIES = _merged([m.QUERIES for m in _MODULES])
ORACLE_SQL = _merged([m.ORACLE_SQL for m in _MODULES])

"""SQL twins of the registered queries, written for DuckDB."""

from __future__ import annotations


def all_oracles() -> dict[str, str]:
    from oracles import edits, events, graph, reader, text, work

    out: dict[str, str] = {}
    for module in (text, graph, events, work, edits, reader):
        out.update(module.ORACLES)
    return out

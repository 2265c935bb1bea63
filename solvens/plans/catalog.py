"""All registered queries and checks in one place."""

from __future__ import annotations

from solvens.plans import evaluation, ingest, learning, reports, statements, streams

MODULES = [ingest, statements, evaluation, reports, learning, streams]


def all_queries() -> dict:
    out: dict = {}
    for module in MODULES:
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out


def all_checks() -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(module.ORACLES)
    return out

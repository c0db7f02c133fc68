"""All registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
AREAS = ["reads", "parsing", "search", "mutations", "stored", "feed", "enrichment", "anime", "streams", "keyspace", "wire", "lists", "scalars", "status"]


def query(sql: str | None = None, with_: str = ""):
    """Registers a function (spark, sf_dir) -> DataFrame; sql is its twin, with_ names derived views that the twin reads."""

    def put(f):
        from driftnet.sources.derived import ctes

        QUERIES[f.__name__] = f
        if sql is not None:
            names = with_.split()
            head = f"WITH {ctes(*names)}" if names else ""
            body = sql.lstrip()
            if head and body.upper().startswith("WITH RECURSIVE "):
                head, body = head.replace("WITH", "WITH RECURSIVE", 1) + ", ", body[15:]
            elif head and body.upper().startswith("WITH "):
                head, body = head + ", ", body[5:]
            ORACLES[f.__name__] = f"{head} {body}"
        return f

    return put


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"driftnet.plans.{area}")


def queries() -> dict[str, Callable]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)

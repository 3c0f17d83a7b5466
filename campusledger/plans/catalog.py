"""Registry of named queries: the Spark plan and, where SQL can state it, the
equivalent SQL text run by an independent engine (DuckDB) as an oracle.

Each Spark query takes ``(spark, sf_dir)``, derives the six record tables from
the parquet tables in ``sf_dir`` and runs one operator over the whole tables.
Oracle SQL starts from the same view definitions (``WITH`` blocks are added
for the record tables the query names).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from campusledger.sources.tables import FIXTURE_SQL, RECORD_TABLES, fixture_tables, render

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None, same_as: str | None = None):
    """Decorator: ``fn(t)`` receives the dict of record tables. ``same_as`` names a
    registered query with the same rows, whose SQL is the oracle of this one too."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixture_tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = with_views(oracle)
        elif same_as is not None:
            ORACLE[name] = ORACLE[same_as]
        return fn
    return deco


_IDENTITY = {t: t for t in ("customer", "orders", "events", "supplier")}


def with_views(body: str) -> str:
    """Prefix ``body`` with the record-table views it references."""
    used = [t for t in RECORD_TABLES if re.search(rf"\b{t}\b", body)]
    ctes = [f"{t} AS ({render(FIXTURE_SQL[t], _IDENTITY, 'timestamp')})" for t in used]
    body = body.strip()
    if not ctes:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body


def load_all() -> None:
    """Import every module that registers queries."""
    from campusledger.plans import (queries_changes, queries_core, queries_layout,  # noqa: F401
                                    queries_ordered, queries_records, queries_repairs)

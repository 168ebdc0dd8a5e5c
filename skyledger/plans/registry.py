"""Registration of queries together with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skyledger.plans import fixtures

# Text and prerequisites of every derived table, in the order they can be defined.
_TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "catalog": (fixtures.CATALOG, ()),
    "pending": (fixtures.PENDING, ("catalog",)),
    "href_updates": (fixtures.HREF_UPDATES, ("catalog",)),
    "points": (fixtures.POINTS, ()),
    "centers": (fixtures.CENTERS, ()),
    "outlines": (fixtures.outline_edges_sql(), ("centers",)),
    "viewports": (fixtures.VIEWPORTS, ()),
    "status_events": (fixtures.STATUS_EVENTS, ()),
    "raster_meta": (fixtures.RASTER_META, ()),
    "upload_meta": (fixtures.UPLOAD_META, ()),
    "pixels": (fixtures.PIXELS_DUCKDB, ()),
}

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}


def check_sql(body: str, uses: tuple[str, ...], ctes: str = "", recursive: bool = False) -> str:
    """``body`` with the derived tables it uses, and further ``ctes``, in front."""
    wanted: set[str] = set()
    for name in uses:
        wanted |= {name, *_TABLES[name][1]}
    parts = [f"{name} AS ({text.strip()})" for name, (text, _) in _TABLES.items() if name in wanted]
    if ctes:
        parts.append(ctes.strip())
    if not parts:
        return body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


def query(
    name: str, sql: str | None = None, uses: tuple[str, ...] = (), ctes: str = "", recursive: bool = False
) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        assert name not in QUERIES, name
        QUERIES[name] = Query(run, None if sql is None else check_sql(sql, uses, ctes, recursive))
        return run

    return register

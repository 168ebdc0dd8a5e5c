"""Run a registered query and its checking SQL and compare them as bags of rows."""

from __future__ import annotations

import datetime as dt
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def bag(rows, order) -> Counter:
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """``None`` when equal, otherwise what differs."""
    found = run(spark, sf_dir)
    names = found.columns
    ours = [tuple(row) for row in found.collect()]
    cursor = con.execute(sql)
    wanted_names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(wanted_names):
        return f"columns {sorted(names)} != {sorted(wanted_names)}"
    left = bag(ours, sorted(range(len(names)), key=names.__getitem__))
    right = bag(theirs, sorted(range(len(names)), key=wanted_names.__getitem__))
    if left == right:
        kinds = {n: type(v).__name__ for n, v in zip(names, ours[0])} if ours else {}
        other = {n: type(v).__name__ for n, v in zip(wanted_names, theirs[0])} if theirs else {}
        if any(kinds[n] != other[n] and "NoneType" not in (kinds[n], other[n]) for n in kinds):
            return f"types {kinds} != {other}"
        return None
    only_left, only_right = list((left - right))[:2], list((right - left))[:2]
    return f"{len(ours)} vs {len(theirs)} rows; {sum((left - right).values())} differ\n  ours   {only_left}\n  theirs {only_right}"

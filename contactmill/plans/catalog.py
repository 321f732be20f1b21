"""Catalogue of runnable queries: a name, a DataFrame builder and, where SQL can say it, the SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` where ``tables`` loads the parquet tables of one directory."""
    from contactmill.plans.derived import Tables

    def wrap(fn):
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql)
        return fn

    return wrap

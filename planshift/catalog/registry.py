"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its own name; ``covers`` lists the operator ids it shows."""

    def add(build: Build) -> Build:
        if build.__name__ in ENTRIES:
            raise ValueError(f"query {build.__name__} is registered twice")
        ENTRIES[build.__name__] = Entry(build, sql, tuple(covers.split()))
        return build

    return add

"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often the body, or a lambda in it, refers to it."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def free_prefix(columns: list[str], prefix: str) -> str:
    """The prefix, lengthened until no column begins with it: names of one's own beside any columns."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix

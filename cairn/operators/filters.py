"""Predicates of list requests. Each returns a column, so that filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.errors import InvalidArgument

ACTIVE, TERMINAL = (1, 2, 3), (4, 5, 6, 7)


def equals(**wanted) -> Column:
    """Equality with each value that is given."""
    found = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            found = found & (F.col(name) == value)
    return found


def in_scope(scope: str | None = None, state: int | None = None, column: str = "state") -> Column:
    """An explicit state goes before the scope; a state outside the scope is a contradiction."""
    members = {"active": ACTIVE, "terminal": TERMINAL, None: ACTIVE + TERMINAL}.get(scope)
    if members is None:
        raise InvalidArgument(f"unknown scope {scope}")
    if state is None:
        return F.col(column).isin(*members) if scope else F.lit(True)
    if state not in members:
        raise InvalidArgument("state and scope contradict")
    return F.col(column) == state


def in_time(column: str, start: int | None = None, end: int | None = None) -> Column:
    """Both ends belong to the range."""
    if start is not None and end is not None and start > end:
        raise InvalidArgument("the range ends before it begins")
    found = F.lit(True)
    if start is not None:
        found = found & (F.col(column) >= start)
    if end is not None:
        found = found & (F.col(column) <= end)
    return found


def at_least(column: str, value: int | None) -> Column:
    return F.lit(True) if value is None else F.col(column) >= value


def due(now: int | Column, enabled: str = "enabled", next_run: str = "next_run_ms") -> Column:
    return F.col(enabled) & F.col(next_run).isNotNull() & (F.col(next_run) <= now)


def look_back(column: str, now: int, hours: int) -> Column:
    return in_time(column, now - hours * 3_600_000, now)

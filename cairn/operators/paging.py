"""Ordered, filtered pages. A page is a top-k: Spark keeps k rows of each partition and never sorts the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.errors import Conflict, InvalidArgument

MAX_PAGE, DEFAULT_PAGE = 100, 50


def page_size(asked: int | None) -> int:
    size = DEFAULT_PAGE if asked is None else asked
    if not 1 <= size <= MAX_PAGE:
        raise InvalidArgument(f"a page has 1 to {MAX_PAGE} rows")
    return size


def after(created: str, row_id: str, place: tuple | None) -> Column:
    """Rows behind a place in the order (created descending, id ascending)."""
    if place is None:
        return F.lit(True)
    c, i = place
    return (F.col(created) < c) | ((F.col(created) == c) & (F.col(row_id) > i))


def newest_first(df: DataFrame, created: str, row_id: str, size: int | None = None, place: tuple | None = None) -> DataFrame:
    """One page in the order (created descending, id ascending), with has_more from a row beyond the page."""
    n = page_size(size)
    found = df.where(after(created, row_id, place)).orderBy(F.desc(created), F.asc(row_id)).limit(n + 1)
    return _with_more(found, [F.desc(created), F.asc(row_id)], n)


def by_key(df: DataFrame, key: str, size: int | None = None, after_key=None) -> DataFrame:
    """One page in the order of a key, starting behind a key."""
    n = page_size(size)
    found = df if after_key is None else df.where(F.col(key) > after_key)
    return _with_more(found.orderBy(key).limit(n + 1), [F.asc(key)], n)


def _with_more(found: DataFrame, order: list[Column], n: int) -> DataFrame:
    # at most n + 1 rows are left, so that one task for the window is enough
    whole = Window.orderBy(*order)
    marked = found.withColumns({"nth": F.row_number().over(whole), "has_more": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > n})
    return marked.where(F.col("nth") <= n).drop("nth")


def by_offset(df: DataFrame, group: list[str], order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset .. offset+size-1 of each group."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("nth", nth).where((F.col("nth") > offset) & (F.col("nth") <= offset + size))


def within_bytes(page: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest beginning of each ordered page whose encoded rows fit a budget."""
    total = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return page.withColumn("encoded_upto", total).where(F.col("encoded_upto") <= budget)


def drain(fetch: Callable[[str | None], tuple[list, str | None]], most: int = 10_000) -> list:
    """All rows of a paged request: pages are asked for until there is no token. Keys have to rise and tokens to advance."""
    rows: list = []
    token = None
    for _ in range(most):
        page, new = fetch(token)
        if rows and page and page[0] <= rows[-1]:
            raise Conflict("pages overlap")
        rows += page
        if new is None:
            return rows
        if new == token:
            raise Conflict("the page token doesn't advance")
        token = new
    raise Conflict("too many pages")

"""Bounds from a bounded sample cut a total order into cells; pages are read through them or after the last row seen.

An order is a dict of columns and ``asc`` or ``desc``. As in Spark's orderings, null is smaller than every value.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Rows that bounds are chosen from: those with the smallest hashes, so that a repeated run chooses the same.
SAMPLE = 4096


def sort_keys(order: dict[str, str]) -> list[Column]:
    return [F.desc(c) if way == "desc" else F.asc(c) for c, way in order.items()]


def _beyond(c: str, way: str, value, or_at: bool = False) -> Column:
    """Whether column ``c`` alone puts a row after ``value`` (or at it)."""
    col = F.col(c)
    if value is None:
        return (F.lit(or_at) | col.isNotNull()) if way == "asc" else (col.isNull() if or_at else F.lit(False))
    past = (col >= value if or_at else col > value) if way == "asc" else (col <= value if or_at else col < value) | col.isNull()
    return F.coalesce(past, F.lit(False))


def after(order: dict[str, str], row: Row) -> Column:
    """Whether a row comes after ``row``."""
    hit = F.lit(False)
    for c, way in reversed(order.items()):
        hit = _beyond(c, way, row[c]) | (F.col(c).eqNullSafe(F.lit(row[c])) & hit)
    return hit


def before(order: dict[str, str], row: Row) -> Column:
    """Whether a row comes before ``row``."""
    return after({c: "asc" if way == "desc" else "desc" for c, way in order.items()}, row)


def _first_column(order: dict[str, str], row: Row, way: int) -> Column:
    """What the order's first column says about rows from ``row`` on (``way`` 1) or up to it (-1); it reaches the scan."""
    c, given = next(iter(order.items()))
    turned = given if way == 1 else "asc" if given == "desc" else "desc"
    col, value = F.col(c), row[c]
    if value is None:
        return F.lit(True) if turned == "asc" else col.isNull()
    return col >= value if turned == "asc" else (col <= value) | col.isNull()


def sampled_bounds(keys: DataFrame, order: dict[str, str], cells: int) -> list[Row]:
    """At most ``cells`` - 1 distinct rows, in order, that cut ``keys`` into parts of about equal size."""
    some = keys.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLE).distinct().orderBy(*sort_keys(order)).collect()
    places = {i * len(some) // cells for i in range(1, cells)} - {0}
    return [some[i] for i in sorted(places) if i < len(some)]


def cell_of(bounds: list, is_before: Callable[[object], Column]) -> Column:
    """How many of ``bounds`` a row is not before: a binary search written as one expression."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(is_before(bounds[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def page_after(df: DataFrame, order: dict[str, str], last: Row, size: int = 1000) -> DataFrame:
    """The page that follows the row ``last``. No earlier row is sorted, and of later ones each task keeps ``size``."""
    return df.where(_first_column(order, last, 1) & after(order, last)).orderBy(*sort_keys(order)).limit(size)


class Pages:
    """Pages of ``df`` in a total order, by number. One pass for a sample and one for the number of rows of each cell are made
    at the start; a page then reads and sorts only the cells that it lies in. Rows must not change meanwhile. An empty table
    has no pages; rows equal in the whole order follow each other in no certain order."""

    def __init__(self, df: DataFrame, order: dict[str, str], cells: int = 64):
        self.df, self.order = df, order
        self.bounds = sampled_bounds(df, order, cells)
        counts = dict(df.groupBy(cell_of(self.bounds, lambda b: before(order, b)).alias("cell")).count().collect())
        self.starts = [0, *accumulate(counts.get(i, 0) for i in range(len(self.bounds) + 1))]

    @property
    def rows(self) -> int:
        return self.starts[-1]

    def page(self, number: int, size: int = 1000) -> DataFrame:
        """Page ``number`` (from 1)."""
        skip = (number - 1) * size
        if skip >= self.rows:
            return self.df.where(F.lit(False))
        # the last cell that begins at or before a row holds it, as empty cells begin where the next one does
        first = bisect_right(self.starts, skip) - 1
        last = bisect_right(self.starts, min(skip + size, self.rows) - 1) - 1
        part = self.df
        if first > 0:
            low = self.bounds[first - 1]
            part = part.where(_first_column(self.order, low, 1) & ~before(self.order, low))
        if last < len(self.bounds):
            high = self.bounds[last]
            part = part.where(_first_column(self.order, high, -1) & before(self.order, high))
        return part.orderBy(*sort_keys(self.order)).offset(skip - self.starts[first]).limit(size)

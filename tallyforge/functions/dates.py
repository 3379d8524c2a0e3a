"""Dates and times of log lines: naive local times, TIMESTAMP_NTZ throughout."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text form of a line's time; single-digit months and days are accepted.
LINE_FORMAT = "yyyy-M-d H:m:s"


def as_time(value: Column, is_text: bool = False) -> Column:
    return F.try_to_timestamp(value, F.lit(LINE_FORMAT)).cast("timestamp_ntz") if is_text else value.cast("timestamp_ntz")


def truncate_to_hour(value: Column, is_text: bool = False) -> Column:
    """Text that is no time gives null."""
    return F.date_trunc("HOUR", as_time(value, is_text)).cast("timestamp_ntz")


def minute_second_key(value: Column, is_text: bool = False) -> Column:
    return F.date_format(as_time(value, is_text), "mm:ss")


def parse_date(text: Column, fmt: str = "yyyy-M-d") -> Column:
    """Null where the text does not follow ``fmt``."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def format_date(date: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(date, fmt)


def _date(value: str | dt.date | None) -> dt.date | None:
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    except (TypeError, ValueError):
        return None


def date_range(start=None, end=None, days_back: int | None = None, today: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """``days_back`` decides if given and not 0; one bound gives seven days; none gives the last seven. Invalid text is absent."""
    today, week = today or dt.date.today(), dt.timedelta(days=7)
    if days_back:
        return today - dt.timedelta(days=days_back), today
    first, last = _date(start), _date(end)
    if first is None and last is None:
        last = today
    return first or last - week, last or first + week


def filter_dates(df: DataFrame, col: str, start=None, end=None, days_back: int | None = None, today: dt.date | None = None) -> DataFrame:
    """Literal bounds, so that they reach the scan."""
    first, last = date_range(start, end, days_back, today)
    return df.where(F.col(col).between(F.lit(first), F.lit(last)))


def day_spine(collections: DataFrame, start: dt.date, end: dt.date, day_col: str = "date") -> DataFrame:
    """Every collection with every day; a reversed range is empty."""
    days = F.sequence(F.lit(start), F.lit(end)) if start <= end else F.array().cast("array<date>")
    return collections.select("*", F.explode(days).alias(day_col))

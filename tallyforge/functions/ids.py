"""Identifiers of sessions, item accesses, metric documents and stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def _text(value: Column | str, absent: str) -> Column:
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(absent))


def session_id(client_name, client_version, ip, ts: Column, unit: str = "hour") -> Column:
    """Client, address and clock hour (or day). Absent parts print as ``None``."""
    parts = [_text(x, "None") for x in (client_name, client_version, ip)]
    parts.append(F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("None")))
    if unit == "hour":
        parts.append(F.coalesce(F.date_format(ts, "HH"), F.lit("None")))
    elif unit != "day":
        raise ValueError(f"no such session unit: {unit}")
    return F.concat_ws(SEPARATOR, *parts)


def item_access_id(collection, issn, pid_v2, pid_v3, pid_generic, session, country, language, media_format, content_type) -> Column:
    """Absent parts are empty."""
    return F.concat_ws(SEPARATOR, *[_text(x, "") for x in (collection, issn, pid_v2, pid_v3, pid_generic, session, country, language, media_format, content_type)])


def document_id(collection, issn, pid_v2, pid_v3, pid_generic, language, country, day) -> Column:
    return F.concat_ws(SEPARATOR, *[_text(x, "") for x in (collection, issn, pid_v2, pid_v3, pid_generic, language, country, day)])


def store_name(prefix, collection, date) -> Column:
    """``prefix_collection_year``; an empty or absent part is an error."""
    parts = [_text(prefix, ""), _text(collection, ""), F.element_at(F.split(_text(date, ""), "-"), 1)]
    whole = F.concat_ws("_", *parts)
    empty = parts[0].eqNullSafe("") | parts[1].eqNullSafe("") | parts[2].eqNullSafe("")
    return F.when(empty, F.raise_error(F.lit("a store name needs prefix, collection and date"))).otherwise(whole)


def canonical_pid(pid_v3, pid_v2, pid_generic) -> Column:
    """First that is not empty, else empty."""
    return F.coalesce(*[F.nullif(_text(x, ""), F.lit("")) for x in (pid_v3, pid_v2, pid_generic)], F.lit(""))


def display_label(collection, issn, pid) -> Column:
    return F.concat_ws(" - ", *[_text(x, "None") for x in (collection, issn, pid)])

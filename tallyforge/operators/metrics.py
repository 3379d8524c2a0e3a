"""Access metrics: double-click filter, totals and uniques, metric documents.

A session is a client on a clock hour (or day). Clicks are first merged to one for each second, which bounds the rows of
a session and item that meet in a window by the seconds of the session, whatever a robot does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids

SESSION = ("client_name", "client_version", "ip_address")
ITEM = ("collection", "issn", "pid_v2", "pid_v3", "pid_generic")
DIMENSIONS = (*ITEM, "media_language", "country_code", "date")
COUNTERS = ("total_requests", "total_investigations", "unique_requests", "unique_investigations")
ATTRIBUTES = ("year_of_publication", "journal_main_title", "journal_subject_area_capes", "journal_subject_area_wos", "journal_acronym", "journal_publisher_name")


@dataclass(frozen=True)
class Rules:
    """``per``: what counts once in a session, an item in a language (``item``) or each format and content type (``access``)."""

    gap_seconds: int = 30
    session_unit: str = "hour"
    request_types: tuple[str, ...] = ("full_text",)
    per: str = "item"


def _session_start(unit: str) -> Column:
    return F.date_trunc(unit.upper(), "local_datetime").cast("timestamp_ntz")


def click_keys(hits: DataFrame, rules: Rules) -> tuple[DataFrame, list[str]]:
    if rules.per not in ("item", "access"):
        raise ValueError(f"no such unit of uniques: {rules.per}")
    more = ("media_format", "content_type") if rules.per == "access" else ()
    names = [*SESSION, "session_start", *ITEM, "country_code", "media_language", *more]
    absent = {c: F.coalesce(F.col(c), F.lit("")) for c in (*ITEM, "country_code", "media_language")}
    hits = hits.withColumns(absent | {"session_start": _session_start(rules.session_unit), "second": F.date_trunc("SECOND", "local_datetime").cast("timestamp_ntz")})
    return hits, names


def kept_clicks(hits: DataFrame, rules: Rules = Rules(), seq: str = "seq") -> DataFrame:
    """One row per second of a session and item: n_clicks, is_request and kept (no later click within the gap).

    Of clicks in one second the last by ``seq`` counts. ``first``: (time, seq, attributes) of the first.
    """
    hits, keys = click_keys(hits, rules)
    attributes = [F.col(c) for c in ATTRIBUTES if c in hits.columns]
    seconds = hits.groupBy(*keys, "second").agg(
        F.count("*").alias("n_clicks"),
        F.max_by(F.col("content_type").isin(*rules.request_types), seq).alias("is_request"),
        F.min(F.struct(F.col("local_datetime"), F.col(seq), *attributes)).alias("first"),
    )
    after = F.lead("second").over(W.partitionBy(*keys).orderBy("second"))
    gap = F.timestamp_diff("SECOND", F.col("second"), after)
    return seconds.withColumn("kept", F.coalesce(gap > rules.gap_seconds, F.lit(True)))


def item_accesses(hits: DataFrame, rules: Rules = Rules(), seq: str = "seq") -> DataFrame:
    """One row per session and item with the four counters and the first attributes; no shuffle beyond ``kept_clicks``."""
    _, keys = click_keys(hits, rules)
    kept_request = F.col("kept") & F.col("is_request")
    return kept_clicks(hits, rules, seq).groupBy(*keys).agg(
        F.count_if(kept_request).alias("total_requests"),
        F.count_if("kept").alias("total_investigations"),
        F.max(kept_request.cast("long")).alias("unique_requests"),
        F.lit(1).cast("long").alias("unique_investigations"),
        F.sum("n_clicks").alias("n_clicks"),
        F.min("first").alias("first"),
    )


def click_histogram(hits: DataFrame, rules: Rules = Rules(per="access"), seq: str = "seq") -> DataFrame:
    """Clicks per ``MM:SS`` of each item access, as a map, and the first attributes."""
    _, keys = click_keys(hits, rules)
    seconds = kept_clicks(hits, rules, seq).withColumn("key", F.date_format("second", "mm:ss"))
    by_key = seconds.groupBy(*keys, "key").agg(F.sum("n_clicks").alias("n"), F.min("first").alias("first"))
    return by_key.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("clicks"), F.min("first").alias("first"))


def metric_documents(hits: DataFrame, rules: Rules = Rules(), seq: str = "seq") -> DataFrame:
    """Counters per document, language, country and day, with the ids of the documents."""
    accesses = item_accesses(hits, rules, seq).withColumn("date", F.to_date("session_start"))
    attributes = [c for c in ATTRIBUTES if c in hits.columns]
    out = accesses.groupBy(*DIMENSIONS).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.min("first").alias("first"))
    return out.select(
        ids.document_id("collection", "issn", "pid_v2", "pid_v3", "pid_generic", "media_language", "country_code", "date").alias("id"),
        ids.canonical_pid("pid_v3", "pid_v2", "pid_generic").alias("pid"),
        *DIMENSIONS,
        *[F.col(f"first.{c}").alias(c) for c in attributes],
        *COUNTERS,
    )


def rollup(documents: DataFrame, dims: list[str], kind: str = "group") -> DataFrame:
    """Sums of the counters by ``dims``: ``group``, ``rollup`` or ``cube``. Uniques are sums of those of each session."""
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTERS]
    if kind == "group":
        return documents.groupBy(*dims).agg(*sums)
    return getattr(documents, kind)(*dims).agg(F.grouping_id().alias("level"), *sums)


def rollup_by_member(documents: DataFrame, member_col: str, dims: list[str], separator: str = ",") -> DataFrame:
    """As ``rollup``, each document counted under every member of a separated list (a journal's subject areas)."""
    members = F.explode(F.filter(F.transform(F.split(member_col, separator), lambda x: F.trim(x)), lambda x: x != ""))
    return rollup(documents.withColumn(member_col, members), [member_col, *dims])


def top_items(documents: DataFrame, per: list[str], item: list[str], counter: str = "total_requests", n: int = 100) -> DataFrame:
    """The ``n`` items with the largest counter in each group; ties in the order of ``item``."""
    sums = documents.groupBy(*per, *item).agg(F.sum(counter).cast("long").alias(counter))
    rank = F.row_number().over(W.partitionBy(*per).orderBy(F.desc(counter), *item))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)

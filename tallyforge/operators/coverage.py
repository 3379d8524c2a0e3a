"""Coverage of collections and days by log files; summaries and validation of files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_spine
from .filters import found_files
from .joins import expected_files


def found_per_day(files: DataFrame) -> DataFrame:
    """``collection, date, found, processed`` of files that count as found."""
    return found_files(files).groupBy("collection", "date").agg(F.count("*").alias("found"), F.count_if(F.col("status") == "PRO").alias("processed"))


def coverage(collections: DataFrame, start: dt.date, end: dt.date, files: DataFrame, settings: DataFrame) -> DataFrame:
    """Every collection and day with found and expected files, status (``MIS``, ``EXT``, ``OK``; null without one expected
    quantity), and whether all found files are processed."""
    days = expected_files(day_spine(collections.select("collection"), start, end), settings)
    out = days.join(found_per_day(files), ["collection", "date"], "left").fillna(0, ["found", "processed"])
    status = F.when(F.col("found") < F.col("expected"), "MIS").when(F.col("found") > F.col("expected"), "EXT").when(F.col("found") == F.col("expected"), "OK")
    return out.select(
        "collection", "date", F.year("date").alias("year"), F.month("date").alias("month"), "found", "expected", "n_settings",
        status.alias("status"), ((F.col("found") > 0) & (F.col("processed") == F.col("found"))).alias("is_complete"),
    )


def coverage_report(days: DataFrame) -> DataFrame:
    by = days.groupBy("collection").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("MIS", "missing"), ("EXT", "extra"), ("OK", "ok"))], F.count_if(F.col("status").isNull()).alias("undefined"))
    return by.withColumn("needs_review", (F.col("missing") > 0) | (F.col("extra") > 0) | (F.col("undefined") > 0))


def parse_summary(lines: DataFrame, file_col: str = "file", reason_col: str = "reject_reason", seq: str = "seq") -> DataFrame:
    """Lines, good lines, last line and rejects by reason (a map) of each file."""
    by = lines.groupBy(file_col, reason_col).agg(F.count("*").alias("n"), F.max(seq).alias("last"))
    rejects = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(reason_col).isNotNull(), F.struct(reason_col, "n")))))
    good = F.sum(F.when(F.col(reason_col).isNull(), F.col("n")).otherwise(0))
    return by.groupBy(file_col).agg(F.sum("n").alias("lines"), good.alias("good"), F.max("last").alias("last_line"), rejects.alias("rejects"))


def validate_files(lines: DataFrame, fraction: float = 0.1, min_share: float = 0.5, days_delta: int = 5, file_col: str = "file", seq: str = "seq", named_date: str | None = None) -> DataFrame:
    """Per file, from a sample of its lines by hash: share of good lines, probable date (most frequent, ties to the earlier)
    and status ``QUE`` or ``INV``. With ``named_date`` the probable date must be near the date in the file's name.

    ``fraction`` is the feature: 1.0 takes every line. A file without a line in the sample is judged by all of its lines.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws("|", file_col, F.col(seq).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    in_sample = number % 1_000_000 < int(fraction * 1_000_000)
    names = [file_col, *([named_date] if named_date else [])]
    by = lines.groupBy(*names, F.to_date("local_datetime").alias("d"), in_sample.alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("reject_reason").isNull()).alias("good"))
    top = F.max(F.when(F.col("d").isNotNull(), F.struct("good", (-F.unix_date("d")).alias("m"), "d"))).alias("top")
    each = by.groupBy(*names, "s").agg(F.sum("n").alias("sampled"), (F.sum("good") / F.sum("n")).alias("share"), top).withColumn("probable_date", F.col("top.d")).drop("top")
    # the sample; all lines where it has none
    out = each.groupBy(*names).agg(F.max_by(F.struct("sampled", "share", "probable_date"), "s").alias("r")).select(*names, "r.*")
    good = (F.col("share") >= min_share) & F.col("probable_date").isNotNull()
    if named_date:
        good = good & (F.col(named_date).isNull() | (F.abs(F.date_diff("probable_date", named_date)) <= days_delta))
    return out.withColumn("status", F.when(good, "QUE").otherwise("INV"))


def reopened_days(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(collection, date) whose set of file hashes differs from the one that the store was computed from."""
    now = files.groupBy("collection", "date").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    then = manifest.select("collection", "date", F.array_sort("hashes").alias("computed"))
    return now.join(then, ["collection", "date"], "left").where(~F.col("hashes").eqNullSafe(F.col("computed"))).select("collection", "date", "hashes")

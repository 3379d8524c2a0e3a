"""Raw log lines to metric documents and dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import loglines
from ..operators import checks, coverage, filters, joins, ranges
from ..operators.store import MetricStore
from ..operators.metrics import ATTRIBUTES, Rules, metric_documents


@dataclass
class Catalogue:
    """``articles``: pid_v2, pid_v3, pid_generic; ``journals``: issn, issns and the journal columns; ``ranges``: address ranges."""

    articles: DataFrame
    journals: DataFrame
    robots: DataFrame
    ranges: DataFrame
    rules: DataFrame
    directories: DataFrame


def parsed_lines(lines: DataFrame, files: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Good lines of known files without robots, with country, translator and ``seq`` (time, address and a hash decide)."""
    placed = joins.file_translator(files.select("collection", F.col("file").alias("path")).distinct(), catalogue.directories)
    good = loglines.parse(lines).where("reject_reason is null")
    good = filters.without_robots(good, catalogue.robots)
    good = good.join(placed.withColumnRenamed("path", "file"), "file")
    good = ranges.ip_country(good, catalogue.ranges)
    return good.withColumn("seq", F.xxhash64("url", "value"))


def checked_items(urls: DataFrame, catalogue: Catalogue, codes: dict[str, str], check_catalogue: bool = True) -> DataFrame:
    """Distinct (translator, url) with standardized data, journal titles, is_valid, code and message. Catalogue lookups are
    made here, once for each item, so that lines are moved by their address alone."""
    data = checks.item_access_data(joins.url_item(urls, catalogue.rules), F.lit(None).cast("string"), codes).drop("collection")
    titles = [c for c in ATTRIBUTES if c in catalogue.journals.columns]
    data = data.drop(*titles).join(catalogue.journals.select("issn", *titles).dropDuplicates(["issn"]), "issn", "left")
    known = checks.known_pids(catalogue.articles) if check_catalogue else None
    issns = checks.known_issns(catalogue.journals) if check_catalogue else None
    return checks.check_access(data, known, issns)


def item_accesses(lines: DataFrame, files: DataFrame, catalogue: Catalogue, codes: dict[str, str], check_catalogue: bool = True) -> DataFrame:
    """Every parsed line with its item data, is_valid, code and message."""
    parsed = parsed_lines(lines, files, catalogue)
    checked = parsed.join(checked_items(parsed, catalogue, codes, check_catalogue), ["translator", "url"], "left")
    no_item = F.col("code").isNull()
    return checked.withColumns({
        "is_valid": F.coalesce("is_valid", F.lit(False)),
        "code": F.when(no_item, "no_item").when(F.col("code") == "missing_fields", "no_data").otherwise(F.col("code")),
        "message": F.when(no_item, "The address names no item.").otherwise(F.col("message")),
    })


def run(lines: DataFrame, files: DataFrame, catalogue: Catalogue, codes: dict[str, str], rules: Rules = Rules(), at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(metric documents, dead letters).

    With a path ``at`` (in a folder that the cluster shares) the checked accesses are written there, good and bad ones apart,
    and both outputs are read from it, so that lines are parsed, filtered and looked up once. Without it both are lazy and
    each parses the lines.
    """
    checked = item_accesses(lines, files, catalogue, codes)
    if at is not None:
        checked.write.mode("overwrite").partitionBy("is_valid").parquet(at)
        checked = lines.sparkSession.read.schema(checked.schema).parquet(at)
    documents = metric_documents(checked.where("is_valid"), rules)
    letters = checks.dead_letters(checked, ["file", "url", "local_datetime", "ip_address"], ["collection", "issn", "pid_v2", "pid_v3", "pid_generic", "media_language", "media_format", "content_type"])
    return documents, letters


def recompute_days(store: MetricStore, documents: DataFrame, days: DataFrame) -> None:
    """Replaces whole days by what all of their files give: running again changes nothing."""
    store.replace_days(documents.join(days.select("collection", "date").distinct(), ["collection", "date"], "left_semi"), days)


def days_to_compute(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return coverage.reopened_days(filters.found_files(files), manifest)

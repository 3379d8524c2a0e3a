"""Joins of accesses, files and catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .literals import first_contained
from .store import first_per_key


def hash_of(df: DataFrame) -> Column:
    """A hash of the texts, numbers and times of a row."""
    return F.xxhash64(*[c for c, kind in df.dtypes if kind in ("string", "bigint", "timestamp_ntz")])


def flag_known(df: DataFrame, col: str | Column, known: DataFrame, known_col: str, name: str, spread: Column | None = None) -> DataFrame:
    """``df`` with ``name``: whether ``col`` occurs in the distinct ``known_col``; a null does not.

    Texts meet by their hash, then by themselves: codes of one kind share their first letters, which makes them slow to sort.
    Nulls get hashes by ``spread`` (by the other columns without it), so that they do not meet in one task.
    """
    df = df.withColumn("__code", F.col(col) if isinstance(col, str) else col)
    right = known.select(F.col(known_col).alias("__known"))
    on = F.col("__code") == F.col("__known")
    if df.schema["__code"].dataType == right.schema["__known"].dataType == T.StringType():
        df = df.withColumn("__hash", F.when(F.col("__code").isNull(), hash_of(df) if spread is None else spread).otherwise(F.xxhash64("__code")))
        right = right.withColumn("__its_hash", F.xxhash64("__known"))
        on = (F.col("__hash") == F.col("__its_hash")) & on
    return df.join(right, on, "left").withColumn(name, F.col("__known").isNotNull()).drop("__code", "__hash", "__known", "__its_hash")


def article_journal(articles: DataFrame, journals: DataFrame, codes: str = "codes", rule: str = "last") -> DataFrame:
    """``articles`` with ``journal_id`` by issn: ``last`` looks up the last code alone, ``any`` takes the first code that
    matches. Among journals that share an issn the smallest id counts. One equi-join, no OR."""
    issns = journals.select("journal_id", F.explode("issns").alias("__issn")).where("__issn <> ''").groupBy("__issn").agg(F.min("journal_id").alias("journal_id"))
    if rule == "last":
        key = F.try_element_at(F.col(codes), F.lit(-1))
        return articles.withColumn("__code", key).join(issns, F.col("__code") == F.col("__issn"), "left").drop("__code", "__issn")
    each = articles.select("article_id", F.posexplode(codes).alias("__at", "__code")).join(issns, F.col("__code") == F.col("__issn"))
    found = each.groupBy("article_id").agg(F.min_by("journal_id", "__at").alias("journal_id"))
    return articles.join(found, "article_id", "left")


def document_journal(documents: DataFrame, journals: DataFrame) -> DataFrame:
    """``documents`` with ``journal_id`` and ``n_matches`` by (collection, acronym); several matches give no journal."""
    by = journals.groupBy("collection", "acronym").agg(F.min("journal_id").alias("journal_id"), F.count("*").alias("n_matches"))
    out = documents.join(by, ["collection", "acronym"], "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return out.withColumn("journal_id", F.when(F.col("n_matches") == 1, F.col("journal_id")))


def file_translator(files: DataFrame, directories: DataFrame) -> DataFrame:
    """``files`` with ``translator``: of the directories of the collection that the path contains, the first configured that
    has a translator. A file without one gets null.

    The first row of each directory of a collection is read to the driver, as they are a settings table; each distinct path is
    tried once against all of them by one automaton, which keeps the first row that counts.
    """
    d = directories.where("coalesce(translator, '') <> ''").select("collection", "directory", "position", "translator").where("collection is not null and directory is not null")
    first = first_per_key(d, ["collection", "directory"], ["position"]).orderBy("position", "directory").select("collection", "directory", "translator").collect()
    found = first_contained(files.select("collection", "path").distinct(), [tuple(r) for r in first]).withColumnRenamed("value", "translator")
    return files.join(found, ["collection", "path"], "left")


def url_item(urls: DataFrame, rules: DataFrame, registry: dict[str, str] | None = None) -> DataFrame:
    """Distinct (translator, url) with the fields that the first matching rule extracts.

    ``rules``: translator, priority, pattern and one template column for each field of ``FIELDS``; ``$1`` to ``$9`` stand
    for the groups of the pattern. The rules of a translator are few; each address is tested once, however often it occurs.
    """
    names = F.lower("translator")
    if registry:
        names = F.coalesce(*[F.when(names == k.lower(), F.lit(v)) for k, v in registry.items()])
    u = urls.select("translator", "url").distinct().withColumn("__set", names)
    r = rules.select(F.lower("translator").alias("__set"), "priority", "pattern", *FIELDS)
    hits = first_per_key(u.join(r, "__set").where(F.rlike("url", F.col("pattern"))), ["translator", "url"], ["priority", "pattern"])
    # the matched part alone is replaced by the template, so that what surrounds it is not copied
    part = F.regexp_substr("url", F.col("pattern"))
    fields = [F.nullif(F.regexp_replace(part, F.col("pattern"), F.col(f)), F.lit("")).alias(f) for f in FIELDS]
    return hits.select("translator", "url", *fields)


FIELDS = ("issn", "pid_v2", "pid_v3", "pid_generic", "media_language", "media_format", "content_type", "year_of_publication")


def expected_files(days: DataFrame, settings: DataFrame) -> DataFrame:
    """``days`` with expected (the quantity of the interval that holds the day) and n_settings; none or several give null."""
    s = settings.select("collection", "quantity", F.col("start_date").alias("__from"), F.col("end_date").alias("__until"))
    inside = (F.col("__from") <= F.col("date")) & (F.col("__until").isNull() | (F.col("__until") >= F.col("date")))
    hits = days.select("collection", "date").distinct().join(s, "collection").where(inside)
    by = hits.groupBy("collection", "date").agg(F.count("*").alias("n_settings"), F.max("quantity").alias("expected"))
    out = days.join(by, ["collection", "date"], "left").withColumn("n_settings", F.coalesce("n_settings", F.lit(0)))
    return out.withColumn("expected", F.when(F.col("n_settings") == 1, F.col("expected")))


def add_collection(df: DataFrame, collections: DataFrame) -> DataFrame:
    """Many-to-one: the acronym of ``collection_id``."""
    return df.join(collections.select("collection_id", F.col("acronym").alias("collection")), "collection_id", "left")


def settings_directories(settings: DataFrame, directories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settings with the directory of their (collection, path); and those without one."""
    d = directories.select("collection", "path", "directory_id").distinct()
    return settings.join(d, ["collection", "path"]), settings.join(d, ["collection", "path"], "left_anti")

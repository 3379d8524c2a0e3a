"""The test tables as inputs of the operators; each adapter has the same rows in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = dt.date(2024, 1, 1), dt.date(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(number: Column) -> Column:
    """The IPv4 address of a number."""
    return F.concat_ws(".", *[(F.shiftright(number, s) % 256).cast("string") for s in (24, 16, 8, 0)])


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parsed log lines whose codes are not standardized yet."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_id").alias("seq"), k.alias("k"), u.alias("user_id"),
        F.element_at(F.array(F.lit("aaa"), F.lit("bbb"), F.lit("ccc")), (u % 3 + 1).cast("int")).alias("collection"),
        F.format_string("10.0.%d.%d", F.floor(u / 256), u % 256).alias("ip_address"),
        F.concat(F.lit("client"), (u % 4).cast("string")).alias("client_name"),
        F.lit("1.0").alias("client_version"),
        F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("local_datetime"),
        F.format_string("0000-000%d", k % 5).alias("issn"),
        F.format_string("s0000-000%d%013d", k % 5, k % 5).alias("pid_v2"),
        F.element_at(F.array(F.lit("en-US"), F.lit("pt-BR"), F.lit("esp"), F.lit("")), k % 4 + 1).alias("media_language"),
        F.when(F.col("event_id") % 2 == 0, "html").otherwise("pdf").alias("media_format"),
        F.when(F.col("event_type").isin("click", "purchase"), "full_text").when(F.col("event_type") == "view", "abstract").when(F.col("event_type") == "signup", "other").otherwise("undefined").alias("content_type"),
        F.when(u % 2 == 0, "BR").otherwise("CL").alias("country_code"),
        (F.lit(1400) + k * 10).cast("string").alias("year_of_publication"),
    )


RAW_HITS_SQL = """raw_hits AS (
  SELECT event_id, event_id AS seq, k, user_id,
         ['aaa', 'bbb', 'ccc'][user_id % 3 + 1] AS collection,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip_address,
         'client' || (user_id % 4) AS client_name, '1.0' AS client_version,
         date_trunc('second', ts)::TIMESTAMP AS local_datetime,
         '0000-000' || (k % 5) AS issn,
         's0000-000' || (k % 5) || lpad((k % 5)::VARCHAR, 13, '0') AS pid_v2,
         ['en-US', 'pt-BR', 'esp', ''][k % 4 + 1] AS media_language,
         CASE WHEN event_id % 2 = 0 THEN 'html' ELSE 'pdf' END AS media_format,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'full_text' WHEN event_type = 'view' THEN 'abstract'
              WHEN event_type = 'signup' THEN 'other' ELSE 'undefined' END AS content_type,
         CASE WHEN user_id % 2 = 0 THEN 'BR' ELSE 'CL' END AS country_code,
         (1400 + k * 10)::VARCHAR AS year_of_publication
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k FROM events))"""

STANDARD_SQL = """std AS (
  SELECT * REPLACE (
    CASE WHEN lower(pid_v2) LIKE 's%' AND length(pid_v2) >= 23 THEN upper(pid_v2[1]) || pid_v2[2:23] ELSE '' END AS pid_v2,
    CASE split_part(media_language, '-', 1) WHEN 'en' THEN 'en' WHEN 'pt' THEN 'pt' WHEN 'esp' THEN 'es' ELSE 'un' END AS media_language,
    CASE WHEN year_of_publication::INTEGER BETWEEN 1500 AND 2100 THEN year_of_publication ELSE '' END AS year_of_publication),
    '' AS pid_v3, '' AS pid_generic
  FROM raw_hits)"""


def catalogue(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles and journals of the standardized hits but one in five."""
    some = hits.where("k % 5 < 4")
    return some.select("pid_v2", "pid_v3", "pid_generic").distinct(), some.select(F.array("issn", F.lit("")).alias("issns")).distinct()


STATUS = ("CRE", "QUE", "PRO", "PRO", "ERR", "PAR", "INV")


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each seventh of the users and day of events."""
    u, day = (F.col("user_id") % 7).cast("int"), F.to_date("ts")
    rows = table(spark, sf_dir, "events").select(u.alias("u"), day.alias("date")).distinct()
    name = F.concat(F.lit("/logs/"), F.element_at(F.array(F.lit("aaa"), F.lit("bbb"), F.lit("ccc")), F.col("u") % 3 + 1), F.lit("/node"), F.col("u").cast("string"), F.lit("/"), F.col("date").cast("string"), F.lit(".log"))
    status = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("u") + F.dayofmonth("date")) % 7 + 1)
    return rows.select(F.md5(name.cast("binary")).alias("hash"), name.alias("path"), F.element_at(F.split(name, "/"), 3).alias("collection"), "date", F.col("date").alias("probable_date"), F.date_add("date", F.col("u")).cast("timestamp_ntz").alias("modified"), status.alias("status"))


LOG_FILES_SQL = """log_files AS (
  SELECT md5(path) AS hash, path, split_part(path, '/', 3) AS collection, date, date AS probable_date,
         (date + u)::TIMESTAMP AS modified, ['CRE', 'QUE', 'PRO', 'PRO', 'ERR', 'PAR', 'INV'][(u + day(date)) % 7 + 1] AS status
  FROM (SELECT *, '/logs/' || ['aaa', 'bbb', 'ccc'][u % 3 + 1] || '/node' || u || '/' || date || '.log' AS path
        FROM (SELECT DISTINCT (user_id % 7)::INTEGER AS u, ts::DATE AS date FROM events)))"""


def settings(spark: SparkSession) -> DataFrame:
    """Expected files: one interval that is open, two that overlap, one collection without."""
    rows = [("aaa", 2, dt.date(2024, 1, 1), None), ("bbb", 2, dt.date(2024, 1, 1), dt.date(2024, 1, 10)), ("bbb", 1, dt.date(2024, 1, 8), None)]
    return spark.createDataFrame(rows, "collection string, quantity int, start_date date, end_date date")


SETTINGS_SQL = """settings(collection, quantity, start_date, end_date) AS (
  VALUES ('aaa', 2, DATE '2024-01-01', NULL::DATE), ('bbb', 2, DATE '2024-01-01', DATE '2024-01-10'), ('bbb', 1, DATE '2024-01-08', NULL))"""

COLLECTIONS = ("aaa", "bbb", "ccc")


def collections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(COLLECTIONS)], "collection_id int, collection string")


def url_rules(spark: SparkSession) -> DataFrame:
    """Example rules over the page addresses: section pages of two kinds of site."""
    rows = [
        ("classic", 1, r"^https?://([a-z0-9.]+)\.example\.com/([a-z]{2})/([0-9]+).*$", "", "", "", "$1/$3", "$2", "html", "full_text", ""),
        ("classic", 2, r"^https?://([a-z0-9.]+)\.example\.com/.*$", "", "", "", "$1", "", "html", "other", ""),
        ("modern", 1, r"^https?://[^/]+/([a-z]{2})/([0-9]+).*$", "", "", "", "$2", "$1", "html", "abstract", ""),
    ]
    return spark.createDataFrame(rows, "translator string, priority int, pattern string, issn string, pid_v2 string, pid_v3 string, pid_generic string, media_language string, media_format string, content_type string, year_of_publication string")

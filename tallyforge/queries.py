"""Registered queries over the test tables and their SQL for DuckDB."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from . import file_queries
from .functions import dates, ids
from .functions import standardize as S
from .operators import checks, coverage, filters, grams, joins, ordered, quality, ranges, store, metrics
from .sources import dumps
from .streaming import ingest as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(file_queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(file_queries.ORACLE_SQL)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Item accesses


def standardized(spark: SparkSession, d: str) -> DataFrame:
    hits = A.raw_hits(spark, d)
    return checks.item_access_data(hits, F.col("collection"), S.language_codes(spark))


def checked(spark: SparkSession, d: str) -> DataFrame:
    hits = standardized(spark, d)
    articles, journals = A.catalogue(hits)
    return checks.check_distinct(hits, checks.known_pids(articles), checks.known_issns(journals))


CHECKED_SQL = f"""{A.RAW_HITS_SQL}, {A.STANDARD_SQL},
checked AS (
  SELECT *, CASE WHEN content_type = 'undefined' THEN 'missing_fields' WHEN k % 5 = 4 THEN 'invalid_issn' ELSE 'valid' END AS code FROM std)"""

KEYS = "client_name, client_version, ip_address, session_start, collection, issn, pid_v2, country_code, media_language"


def _metrics_sql(gap: int, unit: str, more: str = "") -> str:
    keys = KEYS + more
    return f"""
WITH {CHECKED_SQL},
clicks AS (
  SELECT *, date_trunc('{unit}', local_datetime) AS session_start,
         content_type = 'full_text' AS is_request FROM checked WHERE code = 'valid'),
ordered AS (
  SELECT *, lead(local_datetime) OVER (PARTITION BY {keys} ORDER BY local_datetime, seq) AS later FROM clicks),
kept AS (SELECT *, later IS NULL OR date_diff('second', local_datetime, later) > {gap} AS kept FROM ordered),
accesses AS (
  SELECT {keys}, count(*) FILTER (kept AND is_request) AS tr, count(*) FILTER (kept) AS ti,
         max((kept AND is_request)::INTEGER) AS ur, min_by(year_of_publication, {{'a': local_datetime, 'b': seq}}) AS yop,
         min({{'a': local_datetime, 'b': seq}}) AS first
  FROM kept GROUP BY ALL)
SELECT concat_ws('|', collection, issn, pid_v2, '', '', media_language, country_code, session_start::DATE::VARCHAR) AS id,
       pid_v2 AS pid, collection, issn, pid_v2, '' AS pid_v3, '' AS pid_generic, media_language, country_code,
       session_start::DATE AS date, min_by(yop, first) AS year_of_publication,
       sum(tr)::BIGINT AS total_requests, sum(ti)::BIGINT AS total_investigations, sum(ur)::BIGINT AS unique_requests,
       count(*)::BIGINT AS unique_investigations
FROM accesses GROUP BY collection, issn, pid_v2, media_language, country_code, session_start::DATE
"""


def _documents(spark: SparkSession, d: str, rules: metrics.Rules = metrics.Rules()) -> DataFrame:
    hits = checked(spark, d).where("is_valid")
    return metrics.metric_documents(hits, rules).drop(*[c for c in metrics.ATTRIBUTES if c != "year_of_publication"])


@query(_metrics_sql(30, "hour"))
def metric_documents(spark, d):
    return _documents(spark, d)


@query(_metrics_sql(600, "day"))
def metric_documents_long_gap(spark, d):
    return _documents(spark, d, metrics.Rules(gap_seconds=600, session_unit="day"))


@query(_metrics_sql(600, "day", ", media_format, content_type"))
def metric_documents_per_access(spark, d):
    return _documents(spark, d, metrics.Rules(gap_seconds=600, session_unit="day", per="access"))


DOCUMENTS_SQL = _metrics_sql(30, "hour").strip()
DOCUMENTS_CTE = f"WITH docs AS ({DOCUMENTS_SQL})"


@query(f"""
WITH {CHECKED_SQL}
SELECT {KEYS}, media_format, content_type, strftime(local_datetime, '%M:%S') AS minute_second, count(*) AS n
FROM (SELECT *, date_trunc('day', local_datetime) AS session_start FROM checked WHERE code = 'valid') GROUP BY ALL
""")
def click_histogram(spark, d):
    rules = metrics.Rules(session_unit="day", per="access")
    out = metrics.click_histogram(checked(spark, d).where("is_valid"), rules)
    return out.select(*KEYS.split(", "), "media_format", "content_type", F.explode("clicks").alias("minute_second", "n"))


@query(f"WITH {CHECKED_SQL} SELECT event_id, code = 'valid' AS is_valid, code FROM checked")
def access_validity(spark, d):
    return checked(spark, d).select("event_id", "is_valid", "code")


@query(f"""
WITH {CHECKED_SQL}
SELECT 'JOU' AS error_type, 'Unknown issn: ' || issn AS message, event_id,
       '0000-000' || (k % 5) AS issn, pid_v2 FROM checked WHERE code = 'invalid_issn'
""")
def dead_letters(spark, d):
    out = checks.dead_letters(checked(spark, d), ["event_id", "ip_address"], ["issn", "pid_v2"])
    return out.select("error_type", "message", F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), F.get_json_object("data", "$.issn").alias("issn"), F.get_json_object("data", "$.pid_v2").alias("pid_v2"))


@query(f"""
WITH {A.RAW_HITS_SQL}, {A.STANDARD_SQL}
SELECT event_id, k % 5 < 4 AS pid_known, k % 5 < 4 AS issn_known FROM std
""")
def known_codes(spark, d):
    hits = standardized(spark, d)
    articles, journals = A.catalogue(hits)
    out = joins.flag_known(hits, "pid_v2", checks.known_pids(articles), "pid", "pid_known")
    return joins.flag_known(out, "issn", checks.known_issns(journals), "issn", "issn_known").select("event_id", "pid_known", "issn_known")


@query(f"""
WITH {A.RAW_HITS_SQL}, {A.STANDARD_SQL}
SELECT DISTINCT pid_v2 AS code FROM std WHERE k % 5 < 4 UNION SELECT DISTINCT issn FROM std WHERE k % 5 < 4
""")
def code_sets(spark, d):
    articles, journals = A.catalogue(standardized(spark, d))
    return checks.known_pids(articles).select(F.col("pid").alias("code")).union(checks.known_issns(journals))


@query("""
WITH hits AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END AS generic,
         CASE WHEN l_linenumber = 5 THEN 'undefined' ELSE 'full_text' END AS content_type FROM lineitem),
known AS (
  SELECT h.*, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40) AS issn_known,
         EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F') AS pid_known,
         EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = generic AND s_nationkey < 20) AS generic_known FROM hits h)
SELECT l_orderkey, l_linenumber, issn_known, pid_known,
       CASE WHEN content_type = 'undefined' THEN 'missing_fields' WHEN NOT issn_known THEN 'invalid_issn' WHEN NOT pid_known THEN 'invalid_pid_v2'
            WHEN generic IS NOT NULL AND NOT generic_known THEN 'invalid_pid_generic' ELSE 'valid' END AS code
FROM known
""")
def catalogue_lookups(spark, d):
    """Lines looked up in a catalogue of about as many articles as there are orders, and journals as there are parts. Nearly
    every line has its own set of codes, so the lines themselves are checked."""

    def digits(number, n):
        text = number.cast("string")
        return F.lpad(text, F.greatest(F.length(text), F.lit(n)), F.lit("0"))

    def issn(key):
        return F.concat(digits(F.floor(F.col(key) / 10000), 4), F.lit("-"), digits(F.col(key) % 10000, 4))

    def pid(key):
        return F.concat(F.lit("S0000-0000"), digits(F.col(key), 13))

    def generic(key):
        return F.concat(F.lit("10.1/"), F.col(key).cast("string"))

    hits = A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", issn("l_partkey").alias("issn"), pid("l_orderkey").alias("pid_v2"), F.lit("").alias("pid_v3"),
        F.when(F.col("l_linenumber") % 3 == 0, generic("l_suppkey")).alias("pid_generic"), F.lit("html").alias("media_format"),
        F.when(F.col("l_linenumber") == 5, "undefined").otherwise("full_text").alias("content_type"),
    )
    empty = F.lit("")
    articles = A.table(spark, d, "orders").where("o_orderstatus <> 'F'").select(pid("o_orderkey").alias("pid_v2"), empty.alias("pid_v3"), empty.alias("pid_generic"))
    articles = articles.union(A.table(spark, d, "supplier").where("s_nationkey < 20").select(empty, empty, generic("s_suppkey")))
    journals = A.table(spark, d, "part").where("p_size <= 40").select(F.array(issn("p_partkey"), empty).alias("issns"))
    out = checks.check_access(hits, checks.known_pids(articles), checks.known_issns(journals), {"issn": "issn_known", "pid_v2": "pid_known"})
    return out.select("l_orderkey", "l_linenumber", "issn_known", "pid_known", "code")


# Scalar functions


@query(f"""
WITH {A.RAW_HITS_SQL}
SELECT event_id,
  concat_ws('|', client_name, client_version, ip_address, strftime(local_datetime, '%Y-%m-%d'), strftime(local_datetime, '%H')) AS session_id,
  concat_ws('|', collection, issn, pid_v2, '', '', client_name, client_version, ip_address, strftime(local_datetime, '%Y-%m-%d'), strftime(local_datetime, '%H'), country_code, media_language, media_format, content_type) AS access_id,
  'metrics_' || collection || '_' || year(local_datetime) AS store, collection || ' - ' || issn || ' - ' || pid_v2 AS label,
  pid_v2 AS pid
FROM raw_hits
""")
def identifiers(spark, d):
    none = F.lit(None).cast("string")
    session = ids.session_id("client_name", "client_version", "ip_address", F.col("local_datetime"))
    return A.raw_hits(spark, d).select(
        "event_id",
        session.alias("session_id"),
        ids.item_access_id("collection", "issn", "pid_v2", none, none, session, "country_code", "media_language", "media_format", "content_type").alias("access_id"),
        ids.store_name(F.lit("metrics"), "collection", F.to_date("local_datetime")).alias("store"),
        ids.display_label("collection", "issn", "pid_v2").alias("label"),
        ids.canonical_pid(none, "pid_v2", F.lit("x")).alias("pid"),
    )


@query("""
SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS hour, strftime(ts, '%M:%S') AS minute_second,
       date_trunc('hour', date_trunc('second', ts))::TIMESTAMP AS hour_of_text,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts::DATE END AS parsed, strftime(ts, '%Y-%m-%d') AS formatted
FROM events
""")
def times(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    day = F.when(F.col("event_id") % 3 == 0, "2024-13-45").otherwise(F.date_format("ts", "yyyy-M-d"))
    return A.table(spark, d, "events").select(
        "event_id", dates.truncate_to_hour(F.col("ts")).alias("hour"), dates.minute_second_key(F.col("ts")).alias("minute_second"),
        dates.truncate_to_hour(text, is_text=True).alias("hour_of_text"), dates.parse_date(day).alias("parsed"), dates.format_date(F.to_date("ts")).alias("formatted"),
    )


@query("""
WITH t AS (
  SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 22, '0') AS n, o_orderkey % 4 AS m FROM orders),
v AS (
  SELECT *, CASE m WHEN 0 THEN 's' WHEN 1 THEN 'S' WHEN 2 THEN 'x' ELSE '' END || n || CASE WHEN m = 1 THEN 'tail' ELSE '' END AS pid,
         CASE m WHEN 0 THEN 'https://doi.org/10.1590/s0102-' || n WHEN 1 THEN 'doi:10.1590/S0102-' || n WHEN 2 THEN ' no doi ' || n ELSE '' END AS generic,
         CASE m WHEN 0 THEN '2020-2023' WHEN 1 THEN '1499' WHEN 2 THEN '(2023)' ELSE (1500 + o_orderkey % 700)::VARCHAR END AS year FROM t)
SELECT o_orderkey,
  CASE WHEN m IN (0, 1) THEN 'S' || n ELSE '' END AS pid_v2, CASE WHEN length(pid) >= 23 THEN pid[1:23] ELSE '' END AS pid_v3,
  CASE WHEN m IN (0, 1) THEN '10.1590/S0102-' || n END AS doi,
  CASE WHEN m IN (0, 1) THEN '10.1590/S0102-' || n WHEN m = 2 THEN 'NO DOI ' || n ELSE '' END AS pid_generic,
  CASE m WHEN 0 THEN '2020' WHEN 3 THEN CASE WHEN year::INTEGER <= 2100 THEN year ELSE '' END ELSE '' END AS std_year
FROM v
""")
def standardized_codes(spark, d):
    m, n = F.col("o_orderkey") % 4, F.lpad(F.col("o_orderkey").cast("string"), 22, "0")
    pid = F.concat(F.when(m == 0, "s").when(m == 1, "S").when(m == 2, "x").otherwise(""), n, F.when(m == 1, "tail").otherwise(""))
    generic = F.when(m == 0, F.concat(F.lit("https://doi.org/10.1590/s0102-"), n)).when(m == 1, F.concat(F.lit("doi:10.1590/S0102-"), n)).when(m == 2, F.concat(F.lit(" no doi "), n)).otherwise("")
    year = F.when(m == 0, "2020-2023").when(m == 1, "1499").when(m == 2, "(2023)").otherwise((F.lit(1500) + F.col("o_orderkey") % 700).cast("string"))
    return A.table(spark, d, "orders").select("o_orderkey", S.std_pid_v2(pid).alias("pid_v2"), S.std_pid_v3(pid).alias("pid_v3"), S.std_doi(generic).alias("doi"), S.std_pid_generic(generic).alias("pid_generic"), S.std_year(year).alias("std_year"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'un' WHEN 4 THEN 'es' ELSE lang END AS language,
       CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN lang WHEN 3 THEN '' ELSE 'esp' END AS iso
FROM documents
""")
def languages(spark, d):
    m, lang = F.col("doc_id") % 5, F.col("lang")
    raw = F.when(m == 0, lang).when(m == 1, F.concat(lang, F.lit("-BR"))).when(m == 2, F.concat(lang, F.lit("_x"))).when(m == 3, "").otherwise("esp")
    codes = S.language_codes(spark)
    return A.table(spark, d, "documents").select("doc_id", S.std_language(raw, codes).alias("language"), S.language_iso(raw, codes).alias("iso"))


@query("SELECT doc_id, ['he', 'id', 'yi', 'ro', 'jv', 'he'][doc_id % 6 + 1] AS language FROM documents")
def renewed_languages(spark, d):
    """Codes that are no longer in use."""
    raw = F.element_at(F.array(*map(F.lit, ("iw", "in-ID", "JI", "mo_MD", "jw", "heb"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return A.table(spark, d, "documents").select("doc_id", S.std_language(raw, S.language_codes(spark)).alias("language"))


@query("""
SELECT p_partkey, trim(regexp_replace('  ' || p_name || '   ' || p_type, '\\s+', ' ', 'g')) AS squeezed,
       list_filter(list_transform(string_split(replace(p_name || ' , ' || p_brand || '|' || p_type, '|', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS names,
       CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE '' END AS preprint, '2024' AS year,
       CASE p_partkey % 3 WHEN 0 THEN 'by' WHEN 1 THEN 'by-nc-sa' END AS license_type,
       CASE p_partkey % 3 WHEN 0 THEN '4.0' END AS license_version
FROM part
""")
def cleaned_texts(spark, d):
    k = F.col("p_partkey").cast("string")
    url = F.when(F.col("p_partkey") % 3 == 0, "https://x.org/licenses/BY/4.0/").when(F.col("p_partkey") % 3 == 1, "https://x.org/by-nc-sa/v4/").otherwise("https://x.org/none")
    lic = S.license_parts(url)
    oai = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("oai:x:preprint/"), k)).otherwise(F.concat(F.lit("oai:x:"), k))
    return A.table(spark, d, "part").select(
        "p_partkey", S.squeeze_spaces(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type")).alias("squeezed"),
        S.split_names(F.concat("p_name", F.lit(" , "), "p_brand", F.lit("|"), "p_type")).alias("names"),
        S.preprint_id(oai).alias("preprint"), S.year_prefix(F.lit("2024-05-06")).alias("year"), lic["type"].alias("license_type"), lic["version"].alias("license_version"),
    )


@query(f"""
WITH {A.RAW_HITS_SQL}
SELECT event_id, 167772160 + (user_id // 256) * 256 + user_id % 256 AS number,
       CASE WHEN user_id // 256 = 0 AND user_id % 256 < 128 THEN 'AA' WHEN user_id // 256 = 0 THEN 'BB' WHEN user_id // 256 BETWEEN 2 AND 3 THEN 'CC' END AS country
FROM raw_hits
""")
def ip_countries(spark, d):
    base = 10 << 24
    rows = [(base, base + 127, "AA"), (base, base + 255, "BB"), (base + 512, base + 1023, "CC"), (base + (1 << 20), base + (9 << 20), "DD")]
    hits = A.raw_hits(spark, d).withColumn("ip_address", A.address(F.lit(base) + F.col("user_id")))
    out = ranges.ip_country(hits, spark.createDataFrame(rows, "start long, end long, country string"))
    return out.select("event_id", S.ip_to_number(F.col("ip_address")).alias("number"), F.col("country_code").alias("country"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))


# Filters


@query("SELECT page_id FROM pages WHERE url IS NULL OR NOT regexp_matches(url, '(?i)blog\\.|spam|/en/2.*$|nn') AND NOT contains(url, 'EN')")
def without_robots(spark, d):
    """Patterns with groups, a reference to a group and a flag are each read by themselves."""
    robots = spark.createDataFrame([("(B)log\\.",), ("spam",), ("/en/2.*$",), (r"(n)\1",), ("(?-i)EN",)], "pattern string")
    return filters.without_robots(A.table(spark, d, "pages"), robots, "url").select("page_id")


@query(f"WITH {A.LOG_FILES_SQL} SELECT hash, status FROM log_files WHERE status IN ('QUE', 'ERR', 'PRO') AND probable_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def work_selection(spark, d):
    return filters.select_work(A.log_files(spark, d), dt.date(2024, 1, 5), dt.date(2024, 1, 20), replace=True).select("hash", "status")


@query(f"WITH {A.LOG_FILES_SQL} SELECT hash FROM log_files WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-15' AND modified::DATE BETWEEN DATE '2024-01-09' AND DATE '2024-01-14'")
def date_windows(spark, d):
    files = dates.filter_dates(A.log_files(spark, d), "date", "2024-01-08", "not a date")
    return filters.visible_files(files, dt.date(2024, 1, 9), dt.date(2024, 1, 14)).select("hash")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def facets(spark, d):
    rows = filters.facet_filter(A.table(spark, d, "orders"), o_orderstatus="O", o_orderpriority="1-URGENT")
    return filters.metadata(rows, ["o_orderkey", "o_totalprice"])


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'theresh') OR contains(lower(role), 'system')")
def text_search(spark, d):
    out = filters.search(A.table(spark, d, "conversations"), "ThereSh", ["text"]).unionByName(filters.search(A.table(spark, d, "conversations"), "SYSTEM", ["role"]))
    return out.select("conv_id", "turn").distinct()


@query("SELECT event_id FROM events WHERE NOT (event_type LIKE '%click%' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20')")
def event_retention(spark, d):
    return filters.retain_events(A.table(spark, d, "events"), type_contains="CLICK", start=dt.datetime(2024, 1, 10), end=dt.datetime(2024, 1, 20), created="ts").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def publication_windows(spark, d):
    rows = A.table(spark, d, "orders").withColumn("published", F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")))
    return filters.publication_window(rows, dt.date(1995, 1, 1), dt.date(1996, 12, 31)).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10 OFFSET 10")
def paging(spark, d):
    rows = A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return filters.page(rows, [F.desc("c_acctbal"), F.desc("c_custkey")], 2, 10).select("c_custkey", "c_name")


@query("""
SELECT 'newest' AS kind, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, o_orderkey::VARCHAR AS id FROM orders
UNION ALL SELECT 'name', row_number() OVER (ORDER BY c_mktsegment, c_custkey), c_custkey::VARCHAR FROM customer
""")
def orderings(spark, d):
    """Places of all rows in both orders."""

    def placed(df: DataFrame, kind: str, key: str) -> DataFrame:
        # the parts of a sorted table follow each other: a row's place is its number in its part after the rows of the parts before.
        # They are written once, as a sort that runs again samples anew and may cut its parts elsewhere
        parts = df.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("id"))
        path = file_queries.scratch(spark, kind)
        parts.write.parquet(path)
        written = spark.read.schema(parts.schema).parquet(path)
        sizes = dict(written.groupBy("part").count().collect())
        starts = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0)))
        before = spark.createDataFrame([*starts.items()], "part int, before long")
        place = F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1) + 1
        return written.join(F.broadcast(before), "part").select(F.lit(kind).alias("kind"), place.alias("place"), "id")

    newest = filters.newest_first(A.table(spark, d, "orders"), "o_orderdate", "o_orderkey")
    named = filters.by_name(A.table(spark, d, "customer"), "c_mktsegment", "c_custkey")
    return placed(newest, "newest", "o_orderkey").union(placed(named, "name", "c_custkey"))


@query("SELECT source, arg_min(lang, CASE lang WHEN 'de' THEN 0 WHEN 'es' THEN 2 WHEN 'en' THEN 3 ELSE 4 END) AS lang FROM documents GROUP BY source")
def preferred_languages(spark, d):
    return filters.preferred_language(A.table(spark, d, "documents"), ["source"], "lang", "de").select("source", "lang")


# Joins


@query(r"""
WITH u AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN 'Classic' WHEN 1 THEN 'OPAC' ELSE 'unknown' END AS translator, url FROM pages),
p AS (SELECT *, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/([0-9]+).*$', ['l', 'n']) AS c FROM u WHERE translator = 'OPAC')
SELECT translator, url, c.n AS pid_generic, c.l AS media_language FROM p WHERE c.n <> ''
""")
def registered_url_items(spark, d):
    """Names in a registry stand for rule sets; an unknown name gives none."""
    k = F.col("page_id") % 3
    urls = A.table(spark, d, "pages").select(F.when(k == 0, "Classic").when(k == 1, "OPAC").otherwise("unknown").alias("translator"), "url")
    return joins.url_item(urls, A.url_rules(spark), {"opac": "modern", "preprints": "classic"}).select("translator", "url", "pid_generic", "media_language")


@query("""
SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'ZA' WHEN user_id % 5 = 1 AND user_id % 256 < 128 THEN 'BR' WHEN user_id % 5 = 1 THEN 'LA' WHEN user_id % 5 = 2 THEN 'XX' END AS country
FROM events
""")
def ipv6_countries(spark, d):
    """IPv6 addresses in all ways of writing, in nested ranges of very different width, beside IPv4 ones."""
    u, k = F.col("user_id"), F.col("user_id") % 5
    low = F.lower(F.hex(u % 256))
    ip = F.when(k == 0, F.concat(F.lit("2C0F:0:"), low, F.lit("::1"))).when(k == 1, F.concat(F.lit("2804:14c:0:0:0:0:0:"), low)).when(k == 2, F.format_string("10.1.%d.%d", F.floor(u / 256) % 256, u % 256)).when(k == 3, F.concat(F.lit("3fff::"), low)).otherwise("no:address")
    v6 = [("2c00::", "2c0f:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "ZA"), ("2800::", "28ff:ffff::ffff", "LA"), ("2804:14c::", "2804:14c::7f", "BR"), ("::1", "::ff", "YY")]
    v4 = spark.createDataFrame([((10 << 24) + (1 << 16), (10 << 24) + (2 << 16) - 1, "XX")], "start long, end long, country string")
    out = ranges.ip_country(A.table(spark, d, "events").withColumn("ip_address", ip), v4, ranges_v6=spark.createDataFrame(v6, "start string, end string, country string"))
    return out.select("event_id", F.col("country_code").alias("country"))


def _journals(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("journal_id"), F.array((F.col("s_suppkey") * 3).cast("string"), (F.col("s_suppkey") * 5).cast("string"), F.lit("")).alias("issns"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return A.table(spark, d, "orders").select(k.alias("article_id"), F.array((k % 101).cast("string"), (k % 97).cast("string"), (k % 89).cast("string")).alias("codes"))


ISSNS_SQL = """issns AS (
  SELECT code, min(s_suppkey) AS journal_id FROM (SELECT s_suppkey, unnest([s_suppkey * 3, s_suppkey * 5]) AS code FROM supplier) GROUP BY code)"""


@query(f"WITH {ISSNS_SQL} SELECT o_orderkey AS article_id, journal_id FROM orders LEFT JOIN issns ON code = o_orderkey % 89")
def article_journal_last(spark, d):
    return joins.article_journal(_articles(spark, d), _journals(spark, d)).select("article_id", "journal_id")


@query(f"""
WITH {ISSNS_SQL}
SELECT o_orderkey AS article_id, coalesce(a.journal_id, b.journal_id, c.journal_id) AS journal_id FROM orders
LEFT JOIN issns a ON a.code = o_orderkey % 101 LEFT JOIN issns b ON b.code = o_orderkey % 97 LEFT JOIN issns c ON c.code = o_orderkey % 89
""")
def article_journal_any(spark, d):
    return joins.article_journal(_articles(spark, d), _journals(spark, d), rule="any").select("article_id", "journal_id")


@query("""
SELECT c_custkey, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN j END AS journal_id FROM customer
LEFT JOIN (SELECT s_nationkey, s_suppkey % 3 AS m, min(s_suppkey) AS j, count(*) AS n FROM supplier GROUP BY ALL)
  ON s_nationkey = c_nationkey AND m = c_custkey % 3
""")
def document_journal(spark, d):
    documents = A.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("collection"), (F.col("c_custkey") % 3).alias("acronym"))
    journals = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("journal_id"), F.col("s_nationkey").alias("collection"), (F.col("s_suppkey") % 3).alias("acronym"))
    return joins.document_journal(documents, journals).select("c_custkey", "n_matches", "journal_id")


@query(f"""
WITH {A.LOG_FILES_SQL}
SELECT hash, CASE WHEN collection = 'aaa' THEN CASE WHEN path LIKE '%/node3/%' THEN 'modern' ELSE 'classic' END
                  WHEN collection = 'bbb' AND path LIKE '%/node1/%' THEN 'preprints' END AS translator FROM log_files
""")
def file_translators(spark, d):
    rows = [("aaa", "/logs/", 0, None), ("bbb", "/node", 0, ""), ("aaa", "/node3/", 1, "modern"), ("aaa", "/logs/", 2, "classic"), ("bbb", "/node1/", 1, "preprints"), ("bbb", "/node1", 2, "other"), ("ccc", "/nowhere/", 1, "classic")]
    directories = spark.createDataFrame(rows, "collection string, directory string, position int, translator string")
    return joins.file_translator(A.log_files(spark, d), directories).select("hash", "translator")


@query(r"""
WITH u AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'Classic' ELSE 'MODERN' END AS translator, url FROM pages),
p AS (
  SELECT *, regexp_extract(url, '^https?://([a-z0-9.]+)\.example\.com/([a-z]{2})/([0-9]+).*$', ['s', 'l', 'n']) AS a,
         regexp_extract(url, '^https?://([a-z0-9.]+)\.example\.com/.*$', 1) AS b,
         regexp_extract(url, '^https?://[^/]+/([a-z]{2})/([0-9]+).*$', ['l', 'n']) AS c FROM u)
SELECT translator, url, a.s || '/' || a.n AS pid_generic, a.l AS media_language, 'full_text' AS content_type FROM p WHERE translator = 'Classic' AND a.n <> ''
UNION ALL SELECT translator, url, b, NULL, 'other' FROM p WHERE translator = 'Classic' AND a.n = '' AND b <> ''
UNION ALL SELECT translator, url, c.n, c.l, 'abstract' FROM p WHERE translator = 'MODERN' AND c.n <> ''
""")
def url_items(spark, d):
    urls = A.table(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, "Classic").otherwise("MODERN").alias("translator"), "url")
    return joins.url_item(urls, A.url_rules(spark)).select("translator", "url", "pid_generic", "media_language", "content_type")


@query("SELECT n.n_nationkey, r.r_name AS collection FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def collection_acronyms(spark, d):
    nations = A.table(spark, d, "nation").withColumnRenamed("n_regionkey", "collection_id")
    regions = A.table(spark, d, "region").select(F.col("r_regionkey").alias("collection_id"), F.col("r_name").alias("acronym"))
    return joins.add_collection(nations, regions).select("n_nationkey", "collection")


@query(f"WITH {A.LOG_FILES_SQL} SELECT hash, collection = 'aaa' AS has_directory FROM log_files")
def settings_directories(spark, d):
    files = A.log_files(spark, d)
    directories = files.where("collection = 'aaa'").select("collection", "path", F.col("hash").alias("directory_id"))
    good, rest = joins.settings_directories(files, directories)
    return good.select("hash", F.lit(True).alias("has_directory")).union(rest.select("hash", F.lit(False)))


# Coverage

COVERAGE_SQL = f"""{A.LOG_FILES_SQL}, {A.SETTINGS_SQL},
days AS (SELECT c.collection, d::DATE AS date FROM (VALUES ('aaa'), ('bbb'), ('ccc')) c(collection), range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) t(d)),
wanted AS (SELECT d.collection, d.date, count(s.quantity) AS n_settings, max(s.quantity) AS q FROM days d LEFT JOIN settings s
  ON s.collection = d.collection AND s.start_date <= d.date AND (s.end_date IS NULL OR s.end_date >= d.date) GROUP BY ALL),
found AS (SELECT collection, date, count(*) AS found, count(*) FILTER (status = 'PRO') AS processed FROM log_files WHERE status NOT IN ('CRE', 'INV') GROUP BY ALL),
coverage AS (
  SELECT w.collection, w.date, year(w.date)::INTEGER AS year, month(w.date)::INTEGER AS month, coalesce(f.found, 0) AS found,
         CASE WHEN n_settings = 1 THEN q END AS expected, n_settings,
         coalesce(f.found, 0) > 0 AND f.found = f.processed AS is_complete
  FROM wanted w LEFT JOIN found f ON f.collection = w.collection AND f.date = w.date),
statused AS (SELECT *, CASE WHEN found < expected THEN 'MIS' WHEN found > expected THEN 'EXT' WHEN found = expected THEN 'OK' END AS status FROM coverage)"""


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage(A.collections(spark), A.START, A.END, A.log_files(spark, d), A.settings(spark))


@query(f"WITH {COVERAGE_SQL} SELECT collection, date, year, month, found, expected, n_settings, status, coalesce(is_complete, false) AS is_complete FROM statused")
def coverage_days(spark, d):
    return _coverage(spark, d)


@query(f"""
WITH {COVERAGE_SQL}
SELECT collection, count(*) FILTER (status = 'MIS') AS missing, count(*) FILTER (status = 'EXT') AS extra, count(*) FILTER (status = 'OK') AS ok,
       count(*) FILTER (status IS NULL) AS undefined, count(*) FILTER (status IS NULL OR status <> 'OK') > 0 AS needs_review
FROM statused GROUP BY collection
""")
def coverage_report(spark, d):
    return coverage.coverage_report(_coverage(spark, d))


LINES_SQL = f"""{CHECKED_SQL}, lines AS (
  SELECT collection || '-' || (user_id % 7) || '-' || local_datetime::DATE AS file, event_id AS seq, local_datetime, CASE WHEN code <> 'valid' THEN code END AS reason FROM checked)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat_ws("-", "collection", (F.col("user_id") % 7).cast("string"), F.to_date("local_datetime"))
    return checked(spark, d).select(file.alias("file"), "seq", "local_datetime", F.when(F.col("code") != "valid", F.col("code")).alias("reject_reason"))


@query(f"""
WITH {LINES_SQL}
SELECT file, count(*) AS lines, count(*) FILTER (reason IS NULL) AS good, max(seq) AS last_line,
       count(*) FILTER (reason = 'missing_fields') AS missing_fields, count(*) FILTER (reason = 'invalid_issn') AS invalid_issn
FROM lines GROUP BY file
""")
def parse_summaries(spark, d):
    out = coverage.parse_summary(_lines(spark, d))
    rejects = [F.coalesce(F.try_element_at("rejects", F.lit(r)), F.lit(0).cast("long")).alias(r) for r in ("missing_fields", "invalid_issn")]
    return out.select("file", "lines", "good", "last_line", *rejects)


@query(f"""
WITH {LINES_SQL}
SELECT file, count(*) AS sampled, (count(*) FILTER (reason IS NULL))::DOUBLE / count(*) AS share, local_datetime::DATE AS probable_date,
       CASE WHEN 2 * count(*) FILTER (reason IS NULL) >= count(*) THEN 'QUE' ELSE 'INV' END AS status
FROM lines GROUP BY file, local_datetime::DATE
""")
def file_validation(spark, d):
    return coverage.validate_files(_lines(spark, d), fraction=1.0)


@query(f"""
WITH {LINES_SQL}, numbered AS (
  SELECT *, ('0x' || substr(md5(file || '|' || seq), 1, 8))::BIGINT % 1000000 < 300000 AS s FROM lines),
judged AS (SELECT * FROM numbered n WHERE s OR NOT EXISTS (SELECT 1 FROM numbered m WHERE m.file = n.file AND m.s))
SELECT file, count(*) AS sampled, (count(*) FILTER (reason IS NULL))::DOUBLE / count(*) AS share, max(local_datetime::DATE) AS probable_date,
       CASE WHEN 2 * count(*) FILTER (reason IS NULL) >= count(*) THEN 'QUE' ELSE 'INV' END AS status
FROM judged GROUP BY file
""")
def sampled_validation(spark, d):
    """Three in ten lines; files without a line among them are judged by all."""
    return coverage.validate_files(_lines(spark, d), fraction=0.3)


# Store and merges


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hits = checked(spark, d).where("is_valid")
    return tuple(metrics.metric_documents(hits.where(F.col("event_id") % 2 == i)).drop(*metrics.ATTRIBUTES) for i in (0, 1))


def _half_sql(i: int) -> str:
    return _metrics_sql(30, "hour").replace("FROM checked WHERE code = 'valid'", f"FROM checked WHERE code = 'valid' AND event_id % 2 = {i}").strip()


@query(f"""
WITH a AS ({_half_sql(0)}), b AS ({_half_sql(1)}), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT id, sum(total_requests)::BIGINT AS total_requests, sum(total_investigations)::BIGINT AS total_investigations,
       sum(unique_requests)::BIGINT AS unique_requests, sum(unique_investigations)::BIGINT AS unique_investigations FROM u GROUP BY id
""")
def accumulate_merge(spark, d):
    return store.merge_metrics(*_halves(spark, d)).select("id", *metrics.COUNTERS)


@query(f"""
WITH a AS ({_half_sql(0)}), b AS ({_half_sql(1)})
SELECT id, total_investigations FROM b UNION ALL SELECT id, total_investigations FROM a WHERE id NOT IN (SELECT id FROM b)
""")
def bulk_put(spark, d):
    return store.last_write_wins(*_halves(spark, d)).select("id", "total_investigations")


@query("""
WITH a AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'NEW' END AS c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey,
  CASE WHEN b.c_custkey IS NOT NULL AND a.c_custkey IS NOT NULL THEN b.c_name ELSE coalesce(a.c_name, b.c_name) END AS c_name,
  CASE WHEN b.c_custkey IS NULL THEN a.c_mktsegment WHEN a.c_custkey IS NULL THEN b.c_mktsegment ELSE coalesce(nullif(b.c_mktsegment, ''), a.c_mktsegment) END AS c_mktsegment,
  coalesce(a.c_acctbal, b.c_acctbal) AS c_acctbal
FROM a FULL JOIN b ON a.c_custkey = b.c_custkey
""")
def upserts(spark, d):
    rows = A.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    new = rows.where("c_custkey % 4 <> 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("NEW").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return store.upsert(rows.where("c_custkey % 3 <> 0"), new, ["c_custkey"], ["c_name", "c_mktsegment"], keep_old_if_blank=("c_mktsegment",))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE lower(c_name) END AS c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 <> 0")
def insert_only(spark, d):
    rows = A.table(spark, d, "customer").select("c_custkey", "c_name")
    return store.insert_only(rows.where("c_custkey % 3 <> 0"), rows.where("c_custkey % 4 <> 0").withColumn("c_name", F.lower("c_name")), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus IN ('F', 'O') AND l_linenumber IN (1, 2))")
def delete_by_terms(spark, d):
    return store.delete_where(A.table(spark, d, "lineitem"), {"l_returnflag": "R", "l_linestatus": ["F", "O"], "l_linenumber": [1, 2]}).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS kept FROM orders")
def delete_and_get_by_ids(spark, d):
    orders = A.table(spark, d, "orders")
    gone = A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    kept = store.delete_ids(orders, gone, "o_custkey").select("o_orderkey", F.lit(True).alias("kept"))
    return kept.union(store.get_ids(orders, gone, "o_custkey").select("o_orderkey", F.lit(False)))


@query("""
SELECT o_custkey, o_orderkey, n AS n_matches FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r = 1
""")
def first_and_matches(spark, d):
    rows = store.with_match_count(A.table(spark, d, "orders"), ["o_custkey"])
    return store.first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "n_matches")


@query("SELECT o_custkey, arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_snapshots(spark, d):
    return store.latest(A.table(spark, d, "orders"), "o_orderdate", "o_orderkey", ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("""
SELECT p_partkey, CASE WHEN n > 1 THEN 'several matches' ELSE 'p_type is longer than 20' END AS reason
FROM (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part) WHERE n > 1 OR length(p_type) > 20
""")
def load_conflicts(spark, d):
    return store.load_conflicts(A.table(spark, d, "part"), ["p_name", "p_brand"], {"p_type": 20}).select("p_partkey", "reason")


@query("""
SELECT 'article' AS source, o_orderkey AS id, NULL AS issn FROM orders UNION ALL SELECT 'document', c_custkey, NULL FROM customer
UNION ALL SELECT 'preprint', s_suppkey, '0000-0000' FROM supplier UNION ALL SELECT 'dataset', p_partkey, NULL FROM part
""")
def catalogue_union(spark, d):
    parts = [A.table(spark, d, t).select(F.col(k).alias("id")) for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return dumps.union_sources(*parts).select("source", "id", "issn")


@query(f"""
WITH {A.LOG_FILES_SQL}, now AS (SELECT collection, date, list_sort(list(hash)) AS h FROM log_files WHERE status NOT IN ('CRE', 'INV') GROUP BY ALL),
old AS (SELECT collection, date, list_sort(list(hash)) AS h FROM log_files WHERE status = 'PRO' GROUP BY ALL)
SELECT n.collection, n.date, n.h AS hashes FROM now n LEFT JOIN old o ON o.collection = n.collection AND o.date = n.date WHERE n.h IS DISTINCT FROM o.h
""")
def reopened_days(spark, d):
    files = A.log_files(spark, d)
    manifest = files.where("status = 'PRO'").groupBy("collection", "date").agg(F.collect_set("hash").alias("hashes"))
    return coverage.reopened_days(filters.found_files(files), manifest)


# Rollups


@query(f"""{DOCUMENTS_CTE}
SELECT collection, issn, country_code, grouping_id(collection, issn, country_code) AS level, sum(total_requests)::BIGINT AS total_requests,
       sum(total_investigations)::BIGINT AS total_investigations, sum(unique_requests)::BIGINT AS unique_requests, sum(unique_investigations)::BIGINT AS unique_investigations
FROM docs GROUP BY CUBE (collection, issn, country_code)
""")
def metrics_cube(spark, d):
    return metrics.rollup(_documents(spark, d), ["collection", "issn", "country_code"], "cube")


@query(f"""{DOCUMENTS_CTE}
SELECT area, collection, sum(total_requests)::BIGINT AS total_requests, sum(total_investigations)::BIGINT AS total_investigations,
       sum(unique_requests)::BIGINT AS unique_requests, sum(unique_investigations)::BIGINT AS unique_investigations
FROM (SELECT *, unnest(['area' || issn[9:9], 'all']) AS area FROM docs) GROUP BY area, collection
""")
def metrics_by_subject(spark, d):
    documents = _documents(spark, d).withColumn("area", F.concat(F.lit("area"), F.substring("issn", 9, 1), F.lit(" , all")))
    return metrics.rollup_by_member(documents, "area", ["collection"])


@query(f"""{DOCUMENTS_CTE}, s AS (SELECT collection, date, pid, sum(total_requests)::BIGINT AS total_requests FROM docs GROUP BY ALL)
SELECT collection, date, pid, total_requests, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY collection, date ORDER BY total_requests DESC, pid) AS rank FROM s) WHERE rank <= 2
""")
def top_documents(spark, d):
    return metrics.top_items(_documents(spark, d), ["collection", "date"], ["pid"], n=2)


# Table checks


@query("""
SELECT 'missing value' AS message, doc_id::VARCHAR AS row_id, 'text' AS "column" FROM documents WHERE coalesce(text, '') = ''
UNION ALL SELECT 'too short', doc_id::VARCHAR, 'text' FROM documents WHERE text <> '' AND length(text) < 100
UNION ALL SELECT 'too long', doc_id::VARCHAR, 'text' FROM documents WHERE length(text) > 5000
UNION ALL SELECT 'pattern does not match', doc_id::VARCHAR, 'source' FROM documents WHERE source <> '' AND NOT regexp_matches(source, '^(src1)')
UNION ALL SELECT 'not an integer', doc_id::VARCHAR, 'lang' FROM documents WHERE lang <> ''
UNION ALL SELECT 'not a boolean', doc_id::VARCHAR, 'n_chars' FROM documents WHERE n_chars IS NOT NULL AND n_chars NOT IN (0, 1)
UNION ALL SELECT 'not a date', doc_id::VARCHAR, 'source' FROM documents WHERE source <> ''
UNION ALL SELECT 'missing column', NULL, 'absent'
""")
def table_checks(spark, d):
    rules = [
        quality.Rule("text", value_required=True, min_length=100, max_length=5000), quality.Rule("source", pattern="src1"), quality.Rule("source", kind="date"),
        quality.Rule("lang", kind="integer"), quality.Rule("n_chars", kind="bool"), quality.Rule("n_chars", kind="float"), quality.Rule("absent"),
    ]
    return quality.check_table(A.table(spark, d, "documents"), rules, "doc_id")


DATE_FORMS = (
    "MM/dd/yyyy", "M/d/yy", "yyyy-MM-dd", "yyyy/MM/dd", "MMM d, yyyy", "MMM. d yyyy", "d MMM., yyyy", "d MMMM yyyy", "yyyy", "MMM, yyyy", "MMM.-yyyy", "MMMM yyyy", "EEE MMM d, yyyy",
    "'2020-13-'dd", "d'/'d'/x'", "'Febuary 'd yyyy",
)
TIME_FORMS = ("MM/dd/yy HHmm", "yyyy/MM/dd hh:mm a", "MMM. d, yyyy HH:mm:ss", "d MMMM yyyy HHmm", "yyyy", "EEE MMM d HH:mm:ss yyyy", "MM/dd/yyyy 'at' HHmm", "yyyy-MM-dd HH'h'")


@query(f"""
SELECT 'not a date' AS message, o_orderkey::VARCHAR AS row_id, 'day' AS "column" FROM orders WHERE o_orderkey % {len(DATE_FORMS)} >= 13
UNION ALL SELECT 'not a date and time', o_orderkey::VARCHAR, 'time' FROM orders WHERE o_orderkey % {len(TIME_FORMS)} >= 6
""")
def date_forms(spark, d):
    """Dates and times written in many ways, some of which are none."""
    k = F.col("o_orderkey")

    def written(forms: tuple[str, ...]):
        return F.coalesce(*[F.when(k % len(forms) == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)])

    rows = A.table(spark, d, "orders").select("o_orderkey", written(DATE_FORMS).alias("day"), written(TIME_FORMS).alias("time"))
    return quality.check_table(rows, [quality.Rule("day", kind="date"), quality.Rule("time", kind="datetime")], "o_orderkey")


@query("""
SELECT 'extra column' AS message, NULL::VARCHAR AS row_id, x AS "column" FROM (VALUES ('LANG'), ('n_chars')) t(x)
UNION ALL SELECT 'missing value', doc_id::VARCHAR, 'source' FROM documents WHERE coalesce(source, '') = ''
UNION ALL SELECT 'too short', doc_id::VARCHAR, 'text' FROM documents WHERE text <> '' AND length(text) < 40
""")
def extra_columns(spark, d):
    rules = [quality.Rule("doc_id"), quality.Rule("text", min_length=40), quality.Rule("source", value_required=True)]
    return quality.check_table(A.table(spark, d, "documents").withColumnRenamed("lang", "LANG"), rules, "doc_id", extra_allowed=False)


@query("""
SELECT "column", message, count(*) AS n FROM (
  SELECT 'text' AS "column", 'too short' AS message FROM documents WHERE text <> '' AND length(text) < 100
  UNION ALL SELECT 'lang', 'not an integer' FROM documents WHERE lang <> '') GROUP BY ALL
""")
def error_counts(spark, d):
    return quality.count_errors(quality.check_table(A.table(spark, d, "documents"), [quality.Rule("text", min_length=100), quality.Rule("lang", kind="integer")], "doc_id"))


# Streams


@query("SELECT event_id, user_id, event_type FROM events")
def stream_ingest(spark, d):
    out = file_queries.scratch(spark, "ingest")
    stream = streams.stream_table(spark, f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    streams.ingest(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query(f"""
WITH {A.RAW_HITS_SQL}
SELECT date_trunc('hour', local_datetime)::TIMESTAMP AS hour, ip_address, issn, count(*) AS n_clicks, min(local_datetime) AS first, max(local_datetime) AS last
FROM raw_hits GROUP BY date_trunc('hour', local_datetime), client_name, ip_address, collection, issn, pid_v2
""")
def stream_sessions(spark, d):
    out = file_queries.scratch(spark, "sessions")
    hits = A.raw_hits(spark, d).withColumns({"pid_v3": F.lit(""), "pid_generic": F.lit("")})
    hits.select("local_datetime", *metrics.SESSION, *metrics.ITEM).write.parquet(f"{out}/hits")
    sessions = streams.hourly_sessions(streams.stream_table(spark, f"{out}/hits"), "3650 days")
    running = sessions.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint")
    running = running.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows")).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(sessions.schema).parquet(f"{out}/rows").select("hour", "ip_address", "issn", "n_clicks", "first", "last")


@query(f"""
WITH {A.RAW_HITS_SQL}, marks AS (SELECT max(local_datetime) FILTER (event_id % 2 = 0) - INTERVAL 6 HOUR AS first, max(local_datetime) - INTERVAL 6 HOUR AS last FROM raw_hits),
timed AS (SELECT *, date_trunc('hour', local_datetime) + INTERVAL 1 HOUR AS closes FROM raw_hits)
SELECT (closes - INTERVAL 1 HOUR)::TIMESTAMP AS hour, ip_address, issn, count(*) AS n_clicks, min(local_datetime) AS first, max(local_datetime) AS last
FROM timed, marks WHERE closes <= marks.last AND (event_id % 2 = 0 OR closes > marks.first)
GROUP BY closes, client_name, ip_address, collection, issn, pid_v2
""")
def stream_late_sessions(spark, d):
    """Closed hours only; half of the hits come after the hours that they belong to were closed and are left out."""
    out = file_queries.scratch(spark, "late")
    hits = A.raw_hits(spark, d).withColumns({"pid_v3": F.lit(""), "pid_generic": F.lit("")})
    for part in (0, 1):
        hits.where(F.col("event_id") % 2 == part).select("local_datetime", *metrics.SESSION, *metrics.ITEM).write.mode("append").parquet(f"{out}/hits")
        sessions = streams.hourly_sessions(streams.stream_table(spark, f"{out}/hits"), "6 hours")
        streams.ingest(sessions, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(sessions.schema).parquet(f"{out}/rows").select("hour", "ip_address", "issn", "n_clicks", "first", "last")


@query(f"""
WITH {CHECKED_SQL}, clicks AS (SELECT *, date_trunc('hour', local_datetime) AS session_start FROM checked WHERE code = 'valid'),
ordered AS (SELECT *, lead(local_datetime) OVER (PARTITION BY {KEYS} ORDER BY local_datetime, seq) AS later FROM clicks)
SELECT ip_address, collection, issn, local_datetime AS second, count(*) AS n_clicks, bool_or(later IS NULL OR date_diff('second', local_datetime, later) > 30) AS kept
FROM ordered GROUP BY {KEYS}, local_datetime
""")
def stream_closed_hours(spark, d):
    """The double-click filter over hits that arrive by closed hours, some hours in each batch."""
    out = file_queries.scratch(spark, "hours")
    hits = checked(spark, d).where("is_valid")
    for part in (0, 1):
        hits.where(F.hour("local_datetime") % 2 == part).write.mode("append").parquet(f"{out}/hits")
        stream = streams.stream_table(spark, f"{out}/hits")
        streams.for_each_batch(stream, lambda df, n, part=part: metrics.kept_clicks(df).write.mode("overwrite").parquet(f"{out}/kept/part={part}/batch={n}"), f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/kept/part=*/batch=*").select("ip_address", "collection", "issn", "second", "n_clicks", "kept")


@query(_metrics_sql(30, "hour"))
def stream_merge(spark, d):
    out = file_queries.scratch(spark, "merge")
    target = store.MetricStore(spark, f"{out}/store")
    hits = checked(spark, d).where("is_valid")
    for part in (0, 1):  # two batches of one stream, each with rows of the same days
        hits.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{out}/hits")
        stream = streams.stream_table(spark, f"{out}/hits")
        streams.merge_into_store(stream, f"{out}/raw", target, f"{out}/checkpoint", metrics.metric_documents).awaitTermination()
    return target.read().select(*_documents(spark, d).columns)


@query(f"""
WITH {CHECKED_SQL}, clicks AS (SELECT *, date_trunc('hour', local_datetime) AS session_start FROM checked WHERE code = 'valid'),
ordered AS (SELECT *, lead(local_datetime) OVER w AS later FROM clicks WINDOW w AS (PARTITION BY {KEYS} ORDER BY local_datetime, seq)),
runs AS (
  SELECT *, sum((later IS NULL OR date_diff('second', local_datetime, later) > 30)::INTEGER) OVER (PARTITION BY {KEYS} ORDER BY local_datetime, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run
  FROM ordered)
SELECT ip_address, collection, issn, max(local_datetime) AS second, count(*) AS n_clicks, arg_max(content_type = 'full_text', {{'a': local_datetime, 'b': seq}}) AS is_request
FROM runs GROUP BY {KEYS}, coalesce(run, 0)
""")
def stream_double_clicks(spark, d):
    """Hits up to ten days out of order in five batches, so that most runs come in several; then late ones, which are dropped,
    and one far ahead, which closes all runs."""
    out = file_queries.scratch(spark, "clicks")
    hits = checked(spark, d).where("is_valid")
    arrival = F.date_add(F.to_date("local_datetime"), (F.col("event_id") * 7919 % 10).cast("int"))
    batch = F.least(F.floor(F.datediff(arrival, F.lit(A.START)) / 8), F.lit(4))
    columns = [*metrics.SESSION, *metrics.ITEM, "country_code", "media_language", "local_datetime", "content_type", "seq"]
    for n in range(6):
        some = hits.where(batch == n) if n < 5 else hits.where(batch == 0).limit(100)
        if n == 4:
            some = some.union(hits.limit(1).withColumns({"ip_address": F.lit("end"), "local_datetime": F.lit("2099-01-01 00:00:00").cast("timestamp_ntz")}))
        some.select(*columns).write.mode("append").parquet(f"{out}/hits")
        clicks = streams.stream_kept_clicks(streams.stream_table(spark, f"{out}/hits"), delay="11 days")
        streams.ingest(clicks, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(clicks.schema).parquet(f"{out}/rows").select("ip_address", "collection", "issn", "second", "n_clicks", "is_request")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 7000 NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def many_robot_patterns(spark, d):
    """Thousands of patterns, of another dialect or without a literal among them, and some that cannot be compiled."""
    k = F.col("p_partkey").cast("string")
    parts = A.table(spark, d, "part").where("p_partkey % 3 = 0")
    plain = parts.select(F.concat(F.lit("CLIENT"), k, F.lit(";")).alias("pattern"))
    odd = parts.select(F.explode(F.array(F.concat(F.lit("(?P<name>none)"), k, F.lit("(?P=name)")), F.when(F.col("p_partkey") % 60 == 0, F.concat(F.lit("*nothing"), k)), F.concat(F.lit(r"^x\d+ client"), k))).alias("pattern"))
    robots = plain.union(odd).union(spark.createDataFrame([("[",), ("(never|ever) here",), (None,)], "pattern string"))
    lines = A.table(spark, d, "orders").select("o_orderkey", F.format_string("Mozilla/5.0 client%d; U", F.col("o_custkey") % 7000).alias("user_agent"))
    return filters.without_robots(lines, robots).select("o_orderkey")


@query("""
WITH files AS (SELECT o_orderkey, 'c' || (o_orderkey % 3) AS collection, '/data/logs' || (o_orderkey % 97) || '/srv' || (o_custkey % 89) || '/' || o_orderkey || '.log' AS path FROM orders),
directories AS (
  SELECT 'c' || (s_suppkey % 2) AS collection, CASE s_suppkey % 3 WHEN 0 THEN 'ogs' || (s_suppkey % 97) WHEN 1 THEN '/srv' || (s_suppkey % 89) || '/' ELSE '' END AS directory,
         CASE WHEN s_suppkey % 3 = 2 THEN 1000000 ELSE s_suppkey END AS position, CASE WHEN s_suppkey % 7 > 0 THEN 't' || s_suppkey % 11 END AS translator
  FROM supplier WHERE s_suppkey % 3 < 2 OR s_suppkey = 2)
SELECT o_orderkey, arg_min(translator, {'a': position, 'b': directory}) AS translator
FROM files f LEFT JOIN directories d ON f.collection = d.collection AND contains(f.path, d.directory) AND coalesce(d.translator, '') <> '' GROUP BY o_orderkey
""")
def overlapping_directories(spark, d):
    """Directories that begin inside a folder name, lie in each other, or are empty."""
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    files = A.table(spark, d, "orders").select(k, F.format_string("c%d", k % 3).alias("collection"), F.format_string("/data/logs%d/srv%d/%d.log", k % 97, F.col("o_custkey") % 89, k).alias("path"))
    name = F.when(s % 3 == 0, F.format_string("ogs%d", s % 97)).when(s % 3 == 1, F.format_string("/srv%d/", s % 89)).otherwise("")
    rows = A.table(spark, d, "supplier").where("s_suppkey % 3 < 2 OR s_suppkey = 2")
    directories = rows.select(F.format_string("c%d", s % 2).alias("collection"), name.alias("directory"), F.when(s % 3 == 2, 1000000).otherwise(s).alias("position"), F.when(s % 7 > 0, F.format_string("t%d", s % 11)).alias("translator"))
    return joins.file_translator(files, directories).select("o_orderkey", "translator")


# Ranges, pages, searches and gets that read their share


@query("""
WITH r(s, e, country) AS (SELECT 167772160 + (o_orderkey * 7919) % 16384, 167772160 + (o_orderkey * 7919) % 16384 + CASE WHEN o_orderkey % 50 = 0 THEN 4000000 ELSE (o_orderkey * 31) % 700 END, substr(o_orderpriority, 1, 1) FROM orders
          UNION ALL SELECT 0, 4294967295, 'W'),
hits AS (SELECT ip, country, row_number() OVER (PARTITION BY ip ORDER BY e - s, s, country) AS n FROM (SELECT DISTINCT 167772160 + c_custkey * 3 AS ip FROM customer), r WHERE ip BETWEEN s AND e)
SELECT c_custkey, country FROM customer JOIN hits ON ip = 167772160 + c_custkey * 3 AND n = 1 UNION ALL SELECT -c_custkey, 'W' FROM customer
""")
def overlapping_ranges(spark, d):
    """Thousands of ranges that nest and overlap, very wide ones among them and one over all addresses; the same over IPv6."""
    first, key = 10 << 24, F.col("o_orderkey")
    start = F.lit(first) + key * 7919 % 16384
    end = start + F.when(key % 50 == 0, 4000000).otherwise(key * 31 % 700)
    v4 = A.table(spark, d, "orders").select(start.alias("start"), end.alias("end"), F.substring("o_orderpriority", 1, 1).alias("country"))
    v4 = v4.union(spark.createDataFrame([(0, (1 << 32) - 1, "W")], v4.schema))
    v6 = spark.createDataFrame([("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "W"), ("fe80::", "fe80::ffff", "X")], "start string, end string, country string")
    n = F.lit(first) + F.col("c_custkey") * 3
    customers = A.table(spark, d, "customer")
    rows = customers.select("c_custkey", A.address(n).alias("ip_address")).union(customers.select(-F.col("c_custkey"), F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("c_custkey") % 65536)))))
    return ranges.ip_country(rows, v4, ranges_v6=v6).select("c_custkey", F.col("country_code").alias("country"))


@query("""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT 'first' AS kind, o_orderkey FROM p WHERE place < 100
UNION ALL SELECT 'middle', o_orderkey FROM p WHERE place // 100 = n // 200
UNION ALL SELECT 'next', o_orderkey FROM p WHERE place // 100 = n // 200 + 1
UNION ALL SELECT 'last', o_orderkey FROM p WHERE place // 100 = (n - 1) // 100
""")
def deep_pages(spark, d):
    """Pages of orders by a column of five values, then date and key: by number from range bounds, the one after a page from
    that page's last row."""
    order = {"o_orderpriority": "desc", "o_orderdate": "asc", "o_orderkey": "asc"}
    rows = A.table(spark, d, "orders").select(*order)
    pages = ordered.Pages(rows, order)
    middle = pages.page(pages.rows // 200 + 1, 100)
    found = {"first": pages.page(1, 100), "middle": middle, "last": pages.page(-(-pages.rows // 100), 100), "none": pages.page(pages.rows, 100)}
    found["next"] = ordered.page_after(rows, order, middle.collect()[-1], 100)
    parts = [df.select(F.lit(kind).alias("kind"), "o_orderkey") for kind, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


SEARCHES = ("ThereSh", "you", "ed a", "is", "assistant xyz")


@query(" UNION ALL ".join(f"SELECT '{q}' AS query, conv_id, turn FROM conversations WHERE contains(lower(text), lower('{q}')) OR contains(lower(role), lower('{q}'))" for q in SEARCHES))
def indexed_search(spark, d):
    """An index of half the turns, the others added later and sent twice; queries of every kind."""
    rows = A.table(spark, d, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    index = grams.GramIndex(spark, file_queries.scratch(spark, "grams"), "id", ["text", "role"])
    for load in (0, 1, 1):
        index.add(rows.where(F.coalesce(F.col("turn") % 2, F.lit(0)) == load), f"half {load}")
    parts = [index.search(rows, q).select(F.lit(q).alias("query"), "conv_id", "turn") for q in SEARCHES]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query("""
WITH docs AS (SELECT o_orderkey, o_custkey, 'c' || (o_custkey % 3) || '|||||' || o_orderkey || '||' || o_orderdate::DATE AS id FROM orders)
SELECT kind, id, o_orderkey AS total_requests FROM docs, (VALUES ('named'), ('joined')) k(kind)
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 3)
""")
def stored_documents_by_id(spark, d):
    """Documents of a store by their ids, with unknown, null and repeated ones: through the scan, and by a join."""
    orders = A.table(spark, d, "orders").withColumns({"collection": F.concat(F.lit("c"), F.col("o_custkey") % 3), "date": F.to_date("o_orderdate")})
    name = ids.document_id("collection", F.lit(""), F.lit(""), F.lit(""), F.lit(""), "o_orderkey", F.lit(""), "date")
    target = store.MetricStore(spark, file_queries.scratch(spark, "store"), "id string, collection string, date date, total_requests long")
    target.put(orders.select(name.alias("id"), "collection", "date", F.col("o_orderkey").alias("total_requests")))
    some = A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_nationkey < 3").select(F.col("c_custkey").alias("o_custkey"))
    asked = orders.join(some, "o_custkey", "left_semi").select(name.alias("id"))
    asked = asked.union(asked).union(spark.createDataFrame([("c1||||||none|2020-01-01",), (None,)], "id string"))
    named = target.get(asked, named=True)
    joined = store.get_ids(target.read(), asked)
    return named.select(F.lit("named").alias("kind"), "id", "total_requests").union(joined.select(F.lit("joined"), "id", "total_requests"))

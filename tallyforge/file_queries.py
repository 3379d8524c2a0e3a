"""Registered queries that pass the test tables through files: what a reader, store or stream gives back is compared."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import tarfile
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import loglines
from .functions import standardize as S
from .operators import quality, store
from .sources import dumps, logs, tables, tail
from .streaming import ingest as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares; a temporary one where the master is this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def as_text(df: DataFrame, name: str, **options) -> str:
    """The path of ``df`` (one text column) as files of lines."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).text(path)
    return path


@query("""
SELECT 'h' || (user_id % 5) AS ip_address, CASE WHEN event_id % 97 <> 0 THEN date_trunc('second', ts)::TIMESTAMP END AS local_datetime, '/item/' || event_id AS url,
       CASE user_id % 3 WHEN 0 THEN 'Firefox' WHEN 1 THEN 'curl' END AS client_name, CASE user_id % 3 WHEN 0 THEN '120.0' WHEN 1 THEN '8.1' END AS client_version,
       CASE WHEN event_id % 97 = 0 THEN 'TIM' WHEN event_type = 'error' THEN 'STA' END AS reject_reason
FROM events
""")
def raw_log_lines(spark, d):
    time = F.when(F.col("event_id") % 97 == 0, "never").otherwise(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"))
    agent = F.when(F.col("user_id") % 3 == 0, "Mozilla/5.0 Firefox/120.0").when(F.col("user_id") % 3 == 1, "curl/8.1").otherwise("-")
    line = F.format_string('h%d - - [%s +0000] "GET /item/%d HTTP/1.1" %s 10 "-" "%s"', F.col("user_id") % 5, time, F.col("event_id"), F.when(F.col("event_type") == "error", "404").otherwise("200"), agent)
    path = as_text(A.table(spark, d, "events").select(line), "logs", compression="gzip")
    parsed = loglines.parse(logs.read_logs(spark, path))
    return parsed.select("ip_address", "local_datetime", "url", "client_name", "client_version", "reject_reason")


@query("""
WITH l AS (SELECT (event_id // 1000)::INTEGER AS part, event_id || '|' || user_id || chr(10) AS s, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS a,
                  row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id DESC) AS b FROM events)
SELECT part, sum(strlen(s))::BIGINT AS length,
       md5(string_agg(s, '' ORDER BY a) FILTER (a <= 25) || sum(strlen(s))::BIGINT || string_agg(s, '' ORDER BY a) FILTER (b <= 25)) AS hash
FROM l GROUP BY part
""")
def file_fingerprints(spark, d):
    rows = A.table(spark, d, "events").select(F.floor(F.col("event_id") / 1000).cast("int").alias("part"), "event_id", F.concat_ws("|", "event_id", "user_id").alias("value"))
    path = scratch(spark, "files")
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    known = logs.list_files(spark, path, (".txt",)).select("path")
    files = logs.fingerprint(spark, path).join(known, "path", "left_semi")
    return files.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), "length", "hash")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def tsv_tables(spark, d):
    path = scratch(spark, "tsv")
    A.table(spark, d, "part").select("p_partkey", "p_name", "p_brand").write.option("sep", "\t").option("header", True).csv(path)
    return tables.read_tsv(spark, path)


@query("""
SELECT 'S' || o_orderkey AS code, 'c' || (o_orderkey % 3) AS collection, [o_orderstatus, o_orderpriority] AS code_title, strftime(o_orderdate, '%Y-%m-%d') AS publication_date
FROM orders
""")
def article_pages(spark, d):
    item = F.struct(
        F.concat(F.lit("S"), "o_orderkey").alias("code"), F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("collection"),
        F.array("o_orderstatus", "o_orderpriority").alias("code_title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
    )
    pages = A.table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("page")).agg(F.collect_list(item).alias("objects"))
    path = scratch(spark, "pages")
    pages.select("page", F.to_json(F.struct("objects")).alias("value")).repartition("page").write.partitionBy("page").text(path)  # a page a file
    return dumps.read_article_pages(spark, f"{path}/*/*.txt").select("code", "collection", "code_title", "publication_date")


@query("SELECT 'k' || c_custkey AS key, 'v' || c_custkey AS pid_v3, '2021' AS publication_year FROM customer")
def document_pages(spark, d):
    value = F.struct(F.concat(F.lit("v"), "c_custkey").alias("pid_v3"), F.lit("2021-02-03").alias("publication_date"))
    entries = A.table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 500).alias("page"), F.struct(F.concat(F.lit("k"), "c_custkey").alias("k"), value.alias("v")).alias("e"))
    pages = entries.groupBy("page").agg(F.map_from_entries(F.collect_list("e")).alias("documents"))
    path = scratch(spark, "documents")
    pages.select("page", F.to_json(F.struct("documents")).alias("value")).repartition("page").write.partitionBy("page").text(path)  # a page a file
    return dumps.read_document_pages(spark, f"{path}/*/*.txt").select("key", "pid_v3", "publication_year")


@query("SELECT s_suppkey::VARCHAR AS pid_generic, 'pt' AS default_language, '2020' AS publication_year FROM supplier WHERE s_suppkey % 2 = 0")
def oai_records(spark, d):
    k = F.col("s_suppkey")
    record = F.format_string("<record><identifier>%s%d</identifier><language>pt</language><language>en</language><date>2020-05-06</date></record>", F.when(k % 2 == 0, "oai:x:preprint/").otherwise("oai:none:"), k)
    rows = A.table(spark, d, "supplier").select(F.floor(k / 500).alias("page"), record.alias("r")).groupBy("page").agg(F.concat(F.lit("<records>"), F.array_join(F.collect_list("r"), ""), F.lit("</records>")).alias("value"))
    path = scratch(spark, "oai")
    rows.repartition("page").write.partitionBy("page").text(path)
    return dumps.read_oai_records(spark, f"{path}/*/*.txt").select("pid_generic", "default_language", "publication_year")


@query("""
SELECT '10.1234/O' || o.o_orderkey AS dataset_doi, o.o_custkey AS container_id, o.o_orderkey || '-' || l.l_linenumber AS file_id
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
WHERE c.c_mktsegment <> 'BUILDING' AND o.o_orderkey % 2 = 0 AND (o.o_orderkey % 3 = 0 OR o.o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1996-12-31')
""")
def dataset_tree(spark, d):
    k = F.col("o_orderkey")
    containers = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") == "BUILDING", "other").otherwise(dumps.CONTAINER).alias("type"))
    doi = F.when(k % 2 == 0, F.concat(F.lit("doi:10.1234/o"), k)).otherwise("none")
    datasets = A.table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("container_id"), F.lit("dataset").alias("type"), doi.alias("doi"), F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published"))
    files = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dataset_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("file_id"))
    return dumps.read_dataset_tree(containers, datasets, files, dt.date(1994, 1, 1), dt.date(1996, 12, 31)).select("dataset_doi", "container_id", "file_id")


@query("""
SELECT l_orderkey::VARCHAR AS dataset_doi, (l_linenumber % 3)::VARCHAR AS file_id, max(l_partkey::VARCHAR) AS url FROM lineitem GROUP BY ALL
""")
def file_maps(spark, d):
    files = A.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("dataset_doi"), (F.col("l_linenumber") % 3).cast("string").alias("file_id"), F.col("l_partkey").cast("string").alias("file_url"), F.lit("n").alias("file_name"), F.lit("p").alias("file_persistent_id"))
    return dumps.file_maps(files).select("dataset_doi", F.explode("files").alias("file_id", "f")).select("dataset_doi", "file_id", F.col("f.url").alias("url"))


@query("""
SELECT s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN [s_suppkey::VARCHAR] ELSE [s_suppkey::VARCHAR, 'p' || s_suppkey] END AS issns, []::VARCHAR[] AS subject_areas FROM supplier
""")
def journal_dumps(spark, d):
    k = F.col("s_suppkey").cast("string")
    rows = A.table(spark, d, "supplier").select(F.lit("c").alias("collection"), F.col("s_name").alias("title"), k.alias("issn"), k.alias("electronic_issn"), F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit("p"), k)).alias("print_issn"))
    # a file holds a list of journals, so that the number of files is a small share of theirs
    pages = rows.groupBy(F.floor(F.col("issn").cast("long") / 500).alias("page")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    path = scratch(spark, "journals")
    pages.repartition("page").select("value").write.option("maxRecordsPerFile", 1).text(path)  # a page a file
    return dumps.read_journals(spark, f"{path}/*.txt").select("title", "issns", "subject_areas")


@query("SELECT n_name AS acron3, 'en' AS language, lower(n_name) AS name FROM nation UNION ALL SELECT n_name, 'pt', n_name || '-pt' FROM nation")
def collection_dumps(spark, d):
    rows = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("acron"), F.create_map(F.lit("en"), F.lower("n_name"), F.lit("pt"), F.concat("n_name", F.lit("-pt"))).alias("name"))
    path = scratch(spark, "collections")
    rows.write.partitionBy("n_nationkey").json(path)
    return dumps.read_collections(spark, f"{path}/*/*.json")[1]


@query("""
SELECT event_type AS pattern, max(ts)::DATE AS last_changed FROM events WHERE event_id % 2 = 0 OR event_type <> 'error' GROUP BY event_type
""")
def robot_lists(spark, d):
    e = A.table(spark, d, "events")
    by = e.where("event_id % 2 = 0 or event_type <> 'error'").groupBy("event_type", F.col("event_id") % 2).agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_changed"))
    rows = by.select(F.col("event_type").alias("pattern"), "last_changed").unionByName(e.select(F.lit("undated").alias("pattern"), F.lit(None).cast("string").alias("last_changed")).distinct())
    path = scratch(spark, "robots")
    rows.withColumn("f", F.monotonically_increasing_id()).write.partitionBy("f").json(path)
    return tables.read_robots(spark, f"{path}/*/*.json")


@query("SELECT 167772160 + user_id AS start, 167772160 + user_id AS \"end\", 'u' || (user_id % 9) AS country FROM (SELECT DISTINCT user_id FROM events)")
def ip_range_files(spark, d):
    ip = A.address(F.lit(10 << 24) + F.col("user_id"))
    rows = A.table(spark, d, "events").select("user_id").distinct().select(ip.alias("first"), ip.alias("last"), F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("country"))
    path = scratch(spark, "ranges")
    rows.write.option("header", True).csv(path)
    return tables.read_ip_ranges(spark, path)


@query("""
SELECT n_name AS collection, 'files_per_day' AS part, (n_nationkey % 3)::VARCHAR AS value FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT n_name, 'emails', 'a' || n_nationkey || '@x.org' FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT n_name, 'emails', 'b@x.org' FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT n_name, 'directories', '/logs/' || n_nationkey FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT n_name, 'translators', 'classic' FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT n_name, 'validation', '0.1' FROM nation WHERE n_regionkey <> 0
""")
def settings_tables(spark, d):
    nation = A.table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    wide = nation.select(
        F.col("n_name").alias("acronym"), F.lit("d").alias("directory_name"), F.concat(F.lit("/logs/"), k).alias("path"), (F.col("n_nationkey") % 3).cast("string").alias("quantity"),
        F.lit("2024-01-01").alias("start_date"), F.lit("").alias("end_date"), F.concat(F.lit("a"), k, F.lit("@x.org; b@x.org")).alias("e_mail"),
        F.lit("classic").alias("translator_class"), F.lit("0.1").alias("sample_size"), F.lit("2048").alias("buffer_size"),
    )
    got = tables.load_settings(wide, nation.where("n_regionkey <> 0").select(F.col("n_name").alias("collection")))
    values = {"files_per_day": "quantity", "emails": "e_mail", "directories": "path", "translators": "translator_class", "validation": "sample_size"}
    parts = [got[p].select("collection", F.lit(p).alias("part"), F.col(c).cast("string").alias("value")) for p, c in values.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['CE=' || c_name] WHEN 1 THEN ['=' || c_name, '=' || c_mktsegment]
  WHEN 2 THEN ['SP='] ELSE ['=SP / ' || c_name || ' / ' || c_mktsegment] END AS places
FROM customer
""")
def codes_and_names(spark, d):
    m = F.col("c_custkey") % 4
    text = F.when(m == 0, F.concat("c_name", F.lit(" / CE"))).when(m == 1, F.concat("c_name", F.lit(", "), "c_mktsegment")).when(m == 2, "SP").otherwise(F.concat(F.lit("SP / "), "c_name", F.lit(" / "), "c_mktsegment"))
    flat = F.transform(S.split_codes_and_names(text), lambda p: F.concat_ws("=", F.coalesce(p["code"], F.lit("")), F.coalesce(p["name"], F.lit(""))))
    return A.table(spark, d, "customer").select("c_custkey", flat.alias("places"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus AS pid_v3, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT 'S' || o_orderkey AS pid_v2, CASE WHEN o_orderkey % 3 <> 2 THEN pid_v3 ELSE '' END AS pid_v3,
       CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN day WHEN o_orderkey % 3 = 1 THEN 'new' WHEN o_orderkey % 3 = 2 THEN day WHEN o_orderkey % 2 = 0 THEN '' ELSE 'new' END AS publication_date
FROM o
""")
def document_merges(spark, d):
    k = F.col("o_orderkey")
    rows = A.table(spark, d, "orders").select(k, F.lit("c").alias("collection"), F.lit("i").alias("issn"), F.concat(F.lit("S"), k).alias("pid_v2"), F.col("o_orderstatus").alias("pid_v3"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), F.lit("2000").alias("publication_year"), F.lit("en").alias("default_language"))
    old = rows.where(k % 3 != 0).withColumn("pid_v3", F.lit("")).drop("o_orderkey")
    new = rows.where(k % 3 != 2).withColumn("publication_date", F.when(k % 2 == 0, "").otherwise("new")).drop("o_orderkey")
    return dumps.merge_documents(old, new).select("pid_v2", "pid_v3", "publication_date")


@query(r"""
SELECT doc_id, CASE WHEN n < 3 THEN 'fewer values than columns' ELSE 'more values than columns' END AS message, count(*) AS n_lines
FROM (SELECT doc_id, len(string_split(regexp_replace(l, '"[^"]*"', '', 'g'), ',')) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE NOT regexp_full_match(l, '[\s\x0b\x{85}\p{Z}]*'))
WHERE n <> 3 GROUP BY ALL
""")
def row_widths(spark, d):
    """Lines of wrong width of every document, quoted separators and all."""
    lines = A.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("value"))
    return quality.check_widths(lines, 3).groupBy("doc_id", "message").agg(F.count("*").alias("n_lines"))


@query(r"""
SELECT doc_id, line, CASE WHEN n < 3 THEN 'fewer values than columns' ELSE 'more values than columns' END AS message
FROM (SELECT doc_id, line, len(string_split(regexp_replace(l, '"[^"]*"', '', 'g'), ',')) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
      WHERE NOT regexp_full_match(l, '[\s\x0b\x{85}\p{Z}]*'))
WHERE n <> 3
""")
def all_row_widths(spark, d):
    """Every line of every text, one by one."""
    lines = A.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "value"))
    return quality.check_widths(lines.withColumn("line", (F.col("at") + 1).cast("long")), 3).select("doc_id", "line", "message")


@query("SELECT 'not an integer' AS message, min(doc_id)::VARCHAR AS row_id, 'lang' AS \"column\" FROM documents WHERE lang <> ''")
def first_error(spark, d):
    return quality.check_table(A.table(spark, d, "documents"), [quality.Rule("lang", kind="integer")], "doc_id", first_only=True)


@query("""
SELECT event_id, event_type || CASE WHEN ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' THEN '-again' ELSE '' END AS kind FROM events
WHERE NOT (ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' AND event_type = 'error') AND NOT (user_id % 3 = 2)
""")
def replaced_days(spark, d):
    """All days stored, three of them replaced (some rows gone), twice; then a whole collection dropped."""
    day = F.to_date("ts")
    rows = A.table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("collection"), day.alias("date"), F.col("event_type").alias("kind"))
    target = store.MetricStore(spark, scratch(spark, "store"))
    target.write(rows)
    again = rows.where("date between '2024-01-05' and '2024-01-07'")
    for _ in range(2):
        target.replace_days(again.where("kind <> 'error'").withColumn("kind", F.concat("kind", F.lit("-again"))), again)
    target.drop("c2", 2024)
    return target.read().select("event_id", "kind")


@query("SELECT event_id FROM events WHERE user_id % 3 <> 1 AND NOT (user_id % 3 = 0 AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-06')")
def emptied_days(spark, d):
    """Days whose new result is empty: all of one collection, and two days of another."""
    rows = A.table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("collection"), F.to_date("ts").alias("date"))
    target = store.MetricStore(spark, scratch(spark, "store"))
    target.write(rows)
    target.replace_days(rows.where("false"), rows.where("collection = 'c1' OR collection = 'c0' AND date BETWEEN '2024-01-05' AND '2024-01-06'"))
    return target.read().select("event_id")


@query("""
WITH rows AS (SELECT 'n/' || c_nationkey AS collection, 2020 + c_custkey % 3 AS year FROM customer),
have AS (SELECT collection, year, count(*) AS n FROM rows GROUP BY ALL)
SELECT collection, year::INTEGER AS year, n FROM have WHERE year <> 2022 UNION ALL SELECT DISTINCT collection, 2030, 0 FROM have
""")
def store_partitions(spark, d):
    """A store of fixed columns: partitions made before their first row, twice; rows written; a year dropped."""
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("n/"), "c_nationkey").alias("collection"), F.make_date(F.lit(2020) + (F.col("c_custkey") % 3).cast("int"), F.lit(1), F.lit(1)).alias("date"))
    target = store.MetricStore(spark, scratch(spark, "store"), "id string, collection string, date date, total_requests long")
    names = [r[0] for r in rows.select("collection").distinct().collect()]
    made = [[target.create(c, 2030) for c in names] for _ in range(2)]
    target.write(rows)
    for c in names:
        target.drop(c, 2022)
    if made != [[True] * len(names), [False] * len(names)]:
        raise AssertionError("a partition is made once")
    parts = spark.createDataFrame(target.partitions(), "collection string, year int")
    have = target.read().where("total_requests is null").groupBy("collection", "year").agg(F.count("*").alias("n"))
    return parts.join(have, ["collection", "year"], "left").select("collection", "year", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, NULL::VARCHAR AS absent, 'part-' || p_brand || '.csv' AS member FROM part")
def tsv_archives(spark, d):
    """Archives with one member for each brand, and a file that is no table."""

    def archive(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for brand in sorted({*table.column("p_brand").to_pylist()}):
                text = io.StringIO()
                rows = csv.writer(text, delimiter="\t", lineterminator="\n")
                rows.writerow(["p_name", "p_brand", "p_partkey"])
                rows.writerows([[r["p_name"], brand, r["p_partkey"]] for r in table.to_pylist() if r["p_brand"] == brand])
                for name, raw in ((f"part-{brand}.csv", text.getvalue().encode()), (f"{brand}.txt", b"no table")):
                    member = tarfile.TarInfo(name)
                    member.size = len(raw)
                    tar.addfile(member, io.BytesIO(raw))
        return pa.table({"path": ["x.tar.gz"], "content": pa.array([out.getvalue()], pa.binary())})

    rows = A.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.floor(F.col("p_partkey") / 1000).alias("__archive"))
    files = rows.groupBy("__archive").applyInArrow(archive, "path string, content binary")
    return tables.unpack_archives(files, ["p_partkey", "p_name", "p_brand", "absent"])


@query("""
SELECT sha256(n_name || chr(10)) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'known' ELSE 'new' END AS state FROM nation
""")
def geo_snapshots(spark, d):
    """Snapshots by the hash of their content; those that are known stay as they are."""
    path = scratch(spark, "snapshots")
    A.table(spark, d, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    found = tables.snapshot_id(spark, f"{path}/*/*.txt").withColumn("key", F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int"))
    known = found.where("key % 2 = 0").select("id", F.lit("known").alias("state"))
    return store.insert_only(known, found.select("id", F.lit("new").alias("state")), ["id"])


@query("SELECT event_id, event_type = 'error' AS archived FROM events")
def archived_events(spark, d):
    path = scratch(spark, "archive")
    events = A.table(spark, d, "events")
    rest = store.archive(events, F.col("event_type") == "error", path)
    return rest.select("event_id", F.lit(False).alias("archived")).union(spark.read.schema("event_id long").json(path).select("event_id", F.lit(True)))


@query("SELECT c_name, c_mktsegment FROM customer")
def exported_tables(spark, d):
    path = scratch(spark, "export")
    store.export_table(A.table(spark, d, "customer"), ["c_name", "c_mktsegment"], path)
    return spark.read.csv(path, header=True)


@query(f"WITH {A.LOG_FILES_SQL} SELECT DISTINCT hash FROM log_files")
def stream_distinct_files(spark, d):
    out = scratch(spark, "files")
    files = A.log_files(spark, d).withColumn("modified", F.col("modified").cast("timestamp"))
    files.union(files).write.parquet(f"{out}/in")
    stream = streams.distinct_files(streams.stream_table(spark, f"{out}/in"), "3650 days").select("hash")
    streams.ingest(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


CATALOGUE_SQL = """rows AS (SELECT o_orderkey AS k, 'c' || (o_orderkey % 5) AS collection, 'g' || o_orderkey AS pid, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
old AS (SELECT * FROM rows WHERE k % 3 <> 0), new AS (SELECT k, collection, pid, 'new' AS day FROM rows WHERE k % 3 <> 2)"""


def _catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows and loaded ones, which overlap; each loaded row comes twice."""
    k = F.col("o_orderkey")
    rows = A.table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("collection"), F.concat(F.lit("g"), k).alias("pid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    new = rows.where("k % 3 <> 2").withColumn("day", F.lit("new"))
    return rows.where("k % 3 <> 0"), new.union(new)


@query(f"""
WITH {CATALOGUE_SQL}
SELECT coalesce(o.pid, n.pid) AS pid_v2, f.force, CASE WHEN o.pid IS NULL OR f.force AND n.pid IS NOT NULL THEN n.day ELSE o.day END AS publication_date
FROM old o FULL JOIN new n ON o.pid = n.pid AND o.collection = n.collection, (VALUES (true), (false)) f(force)
""")
def article_merges(spark, d):
    def articles(rows: DataFrame) -> DataFrame:
        more = {c: F.lit(None).cast("string") for c in ("processing_date", "publication_year", "default_language")} | {c: F.array("k") for c in ("files", "text_langs")}
        return rows.withColumns(more).select("collection", F.lit("i").alias("issn"), F.col("pid").alias("pid_v2"), F.col("day").alias("publication_date"), *more)

    old, new = map(articles, _catalogue(spark, d))
    parts = [dumps.merge_articles(old, new, force=x).select("pid_v2", F.lit(x).alias("force"), "publication_date") for x in (True, False)]
    return parts[0].union(parts[1])


MERGED_SQL = f"WITH {CATALOGUE_SQL} SELECT coalesce(o.pid, n.pid) AS pid, coalesce(n.day, o.day) AS day FROM old o FULL JOIN new n ON o.pid = n.pid AND o.collection = n.collection"


@query(f"{MERGED_SQL} WHERE coalesce(o.k, n.k) % 7 <> 0 OR o.k IS NOT NULL AND o.k % 7 <> 0")
def preprint_merges(spark, d):
    """Loaded records without an identifier are left out."""
    old, new = (x.withColumnRenamed("pid", "pid_generic") for x in _catalogue(spark, d))
    new = new.withColumn("pid_generic", F.when(F.col("k") % 7 == 0, "").otherwise(F.col("pid_generic")))
    return dumps.merge_preprints(old.where("k % 7 <> 0"), new).select(F.col("pid_generic").alias("pid"), "day")


@query(MERGED_SQL)
def dataset_merges(spark, d):
    old, new = (x.withColumnRenamed("pid", "pid_generic") for x in _catalogue(spark, d))
    return dumps.merge_datasets(old, new).select(F.col("pid_generic").alias("pid"), "day")


@query(MERGED_SQL)
def journal_merges(spark, d):
    old, new = (x.withColumnRenamed("pid", "issn") for x in _catalogue(spark, d))
    return dumps.merge_journals(old, new).select(F.col("issn").alias("pid"), "day")


@query("SELECT 'bot' || (o_orderkey % 1000) AS pattern, max(o_orderdate)::DATE AS last_changed FROM orders GROUP BY 1")
def robot_merges(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("bot"), (F.col("o_orderkey") % 1000).cast("string")).alias("pattern"), F.to_date("o_orderdate").alias("last_changed"))
    return dumps.merge_robots(rows.where("o_orderkey % 2 = 0").select("pattern", "last_changed"), rows.where("o_orderkey % 2 <> 0").drop("o_orderkey"))


@query("""
WITH new AS (SELECT c_custkey // 4 AS k, c_custkey AS n, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE c_mktsegment END AS segment, c_name AS name FROM customer),
old AS (SELECT DISTINCT k FROM new WHERE k % 3 = 0), g AS (
  SELECT k, max(n) AS n, arg_max(segment, n) FILTER (segment <> '') AS segment, arg_min(name, n) AS name FROM new GROUP BY k)
SELECT g.k, g.n, coalesce(g.segment, CASE WHEN old.k IS NULL THEN '' ELSE 'old' END) AS segment, CASE WHEN old.k IS NULL THEN g.name ELSE 'old' END AS name
FROM g LEFT JOIN old ON old.k = g.k
""")
def repeated_upserts(spark, d):
    """Several rows of one key in a load, taken one after the other."""
    c = F.col("c_custkey")
    new = A.table(spark, d, "customer").select(F.floor(c / 4).alias("k"), c.alias("n"), F.when(c % 4 == 3, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_name").alias("name"))
    old = new.where("k % 3 = 0").select("k", F.lit(-1).cast("long").alias("n"), F.lit("old").alias("segment"), F.lit("old").alias("name")).distinct()
    return store.upsert(old, new, ["k"], ["n", "segment"], keep_old_if_blank=("segment",), order=("n",))


@query("""
WITH days AS (SELECT user_id, ts::DATE AS date, count(*) AS n FROM events GROUP BY ALL)
SELECT 'u' || (user_id % 50) || '-' || date AS id, nullif('c' || (user_id % 4), 'c3') AS collection, sum(n * CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS total_requests
FROM days GROUP BY user_id % 50, user_id % 4, date
""")
def retried_loads(spark, d):
    """Loads with several rows of an id and without a collection: all rows, then half of them again as another load, and both
    sent again under their identifiers, which counts nothing."""
    u, day = F.col("user_id"), F.to_date("ts")
    rows = A.table(spark, d, "events").groupBy("user_id", day.alias("date")).agg(F.count("*").alias("total_requests"))
    collection = F.when(u % 4 < 3, F.format_string("c%d", u % 4))
    loads = rows.select("user_id", F.format_string("u%d-%s", u % 50, F.col("date").cast("string")).alias("id"), collection.alias("collection"), "date", "total_requests")
    # an id belongs to one collection
    loads = loads.withColumn("id", F.concat_ws("/", "id", F.coalesce("collection", F.lit("none"))))
    target = store.MetricStore(spark, scratch(spark, "store"), "id string, collection string, date date, total_requests long")
    for _ in range(2):
        target.accumulate(loads.drop("user_id"), "all")
        target.accumulate(loads.where("user_id % 2 = 0").drop("user_id"), "even")
    return target.read().select(F.substring_index("id", "/", 1).alias("id"), "collection", "total_requests")


@query("SELECT event_id, user_id FROM events")
def appended_logs(spark, d):
    """Files that grow between runs of one stream, each time in the middle of a line; a last line without its end waits."""
    from pyarrow import fs

    root = scratch(spark, "growing")
    lines = A.table(spark, d, "events").select(F.floor(F.col("event_id") / 1000).cast("long").alias("part"), "event_id", F.concat_ws("|", "event_id", "user_id").alias("line"))

    def put(share: float):
        def write(table: pa.Table) -> pa.Table:
            table = table.sort_by("event_id")
            whole = ("\n".join(table.column("line").to_pylist()) + "\nincomplete").encode()
            system, path = fs.FileSystem.from_uri(re.sub(r"^(file:)?/(?!/)", "file:///", root))
            system.create_dir(path)
            with system.open_output_stream(f"{path}/{table.column('part')[0]}.log") as out:
                out.write(whole[: int(share * len(whole))])
            return table.select(["part"]).slice(0, 1)

        return write

    out = scratch(spark, "lines")
    for share in (0.37, 0.37, 0.81, 1.0):
        lines.groupBy("part").applyInArrow(put(share), "part long").write.format("noop").mode("overwrite").save()
        stream = tail.stream_tail(spark, root, bytes_each=5000)
        streams.ingest(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = F.split("value", r"\|").cast("array<long>")
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(rows[0].alias("event_id"), rows[1].alias("user_id"))

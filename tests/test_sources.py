import datetime as dt
import gzip
import hashlib
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import standardize as S
from tallyforge.operators import quality, store
from tallyforge.operators.quality import Rule
from tallyforge.operators.metrics import COUNTERS, Rules, metric_documents
from tallyforge.plans import metrics as plan
from tallyforge.sources import dumps, logs, tables, tail
from tallyforge.streaming import ingest


def line(ip, time, url, status=200, agent="Mozilla/5.0 Firefox/120.0"):
    return f'{ip} - - [{time} +0000] "GET {url} HTTP/1.1" {status} 10 "-" "{agent}"\n'


PID = ["S0102-6720202000010000" + str(i) for i in range(4)]
RAW = {
    "aaa/one.log": [
        line("10.0.0.1", "01/Jan/2024:10:00:00", f"/article/en/{PID[0]}"),
        line("10.0.0.1", "01/Jan/2024:10:00:20", f"/article/en/{PID[0]}"),
        line("10.0.0.1", "01/Jan/2024:10:05:00", f"/abstract/en/{PID[0]}"),
        line("10.0.0.2", "01/Jan/2024:11:00:00", f"/article/pt-BR/{PID[1]}"),
        line("10.0.0.2", "01/Jan/2024:11:00:00", f"/article/en/{PID[3]}"),
        line("10.0.0.3", "01/Jan/2024:12:00:00", f"/article/en/{PID[0]}", agent="GoogleBot/2.1"),
        line("10.0.0.4", "01/Jan/2024:12:00:00", f"/article/en/{PID[0]}", status=404),
        "garbage\n",
    ],
    "aaa/two.log.gz": [line("10.0.0.1", "01/Jan/2024:10:00:40", f"/article/en/{PID[0]}"), line("10.0.0.9", "02/Jan/2024:00:00:01", "/about"), line("77.0.0.1", "02/Jan/2024:00:00:01", f"/article/es/{PID[2]}")],
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    for name, lines in RAW.items():
        os.makedirs(path / "aaa", exist_ok=True)
        data = "".join(lines).encode()
        (path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    (path / "aaa" / "notes.txt").write_text("x")
    (path / "aaa" / "UPPER.LOG").write_text("x")
    return str(path)


def test_files_and_fingerprints(spark, root, tmp_path):
    names = {r.path.rsplit("/", 1)[-1] for r in logs.list_files(spark, root).collect()}
    assert names == {"one.log", "two.log.gz", "UPPER.LOG"}
    assert logs.list_files(spark, root, start=dt.date(2100, 1, 1)).count() == 0
    for n in (0, 10, 30, 60):
        (tmp_path / f"f{n}.log").write_text("".join(f"line {i}\n" for i in range(n)))
    (tmp_path / "open.log").write_text("x\n" * 70 + "no end")
    (tmp_path / "wide.log").write_text(("y" * 5000 + "\n") * 100)
    got = {r.path: r for r in logs.fingerprint(spark, str(tmp_path)).collect()}
    assert len(got) == 6
    for path, r in got.items():
        text = open(path.removeprefix("file:"), "rb").read()
        some = text.splitlines(keepends=True)
        assert r.hash == hashlib.md5(b"".join(some[:25]) + str(len(text)).encode() + b"".join(some[-25:])).hexdigest() and r.length == len(text)
    whole = {r.path: r.hash for r in logs.fingerprint_whole(spark, str(tmp_path)).collect()}
    assert len(whole) == 5 and all(got[p].hash == h for p, h in whole.items())


def test_a_large_file_is_read_at_its_ends_only(spark, tmp_path):
    line = b"line of a large file, one hundred bytes " + b"." * 59 + b"\n"
    with open(tmp_path / "large.log", "wb") as f:
        f.write(line * 30)
        f.truncate(3 << 30)  # a hole of 3 GB
        f.seek(0, 2)
        f.write(b"\n" + line * 30)
    (row,) = logs.fingerprint(spark, str(tmp_path)).collect()
    assert row.length == (3 << 30) + 3001 and row.bytes_read <= 4 * logs.BLOCK
    assert row.hash == hashlib.md5(line * 25 + str(row.length).encode() + line * 25).hexdigest()


@pytest.mark.parametrize("each", [1, 7, 64 << 20])
def test_ranges_of_a_file_give_each_line_once(tmp_path, each):
    text = b"one\n\ntwo\r\n" + b"long " * 30 + b"\nlast\nno end"
    (tmp_path / "f").write_bytes(text)
    with open(tmp_path / "f", "rb") as f:
        end = tail.line_end(f, 0, len(text))
        assert text[:end].endswith(b"last\n") and tail.line_end(f, end, len(text)) == end
        for start in (0, 4):
            found = [x for part in tail.ranges_of("f", start, end, each) for x in tail.lines_of(f, part)]
            assert [x for _, x in found] == [x.removesuffix(b"\r") for x in text[start:end].split(b"\n")[:-1]]
            assert all(text[p:].startswith(x) for p, x in found)


def test_short_ranges_share_tasks(tmp_path):
    """A thousand small files are some tasks, a long one is cut; every range is in one run and in its order."""
    ends = {f"f{i:04d}": 40 for i in range(1000)}
    reader = tail.TailReader({"path": str(tmp_path), "bytes": "10"})
    runs = reader.partitions({}, ends)
    assert len(runs) <= tail.TASKS + 1 and sum(len(r.parts) for r in runs) == 4000
    assert [p for r in runs for p in r.parts] == [p for f in ends for p in tail.ranges_of(f, 0, 40, 10)]
    assert len(tail.runs_of(tail.ranges_of("f", 0, 100 * tail.BYTES, tail.BYTES))) == 100 and tail.runs_of([]) == []
    for i in range(3):
        (tmp_path / f"{i}.log").write_bytes(b"a\nb\n" * 20)
    got = [x for run in reader.partitions({}, reader.latestOffset()) for b in reader.read(run) for x in b.column("value").to_pylist()]
    assert got == ["a", "b"] * 60


def test_lines_added_to_known_files_come_once(spark, tmp_path):
    src, out, check = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()

    def read():
        ingest.ingest(tail.stream_tail(spark, str(src), bytes_each=10), out, check).awaitTermination()
        return sorted((r.file.rsplit("/", 1)[-1], r.value) for r in spark.read.parquet(out).collect())

    (src / "a.log").write_text("one\ntw")
    (src / "other.txt").write_text("no\n")
    assert read() == [("a.log", "one")] and read() == [("a.log", "one")]
    with open(src / "a.log", "a") as f:
        f.write("o\nthree\nfo")
    (src / "b.log").write_text("")
    assert read() == [("a.log", "one"), ("a.log", "three"), ("a.log", "two")]
    (src / "b.log").write_text("later\n")
    (src / "a.log").write_text("new\n")  # shorter: another file under the old name
    assert read() == [("a.log", "new"), ("a.log", "one"), ("a.log", "three"), ("a.log", "two"), ("b.log", "later")]


@pytest.fixture(scope="module")
def catalogue(spark):
    rules = [("main", 1, r"^/(article)/([A-Za-z-]+)/(\w[\w-]+).*$", "0000-0001", "$3", "", "", "$2", "html", "full_text", "2020"), ("main", 2, r"^/abstract/([A-Za-z-]+)/(\w[\w-]+).*$", "0000-0001", "$2", "", "", "$1", "html", "abstract", "2020")]
    kind = "translator string, priority int, pattern string, issn string, pid_v2 string, pid_v3 string, pid_generic string, media_language string, media_format string, content_type string, year_of_publication string"
    return plan.Catalogue(
        articles=spark.createDataFrame([(p, "", "") for p in PID[:3]], "pid_v2 string, pid_v3 string, pid_generic string"),
        journals=spark.createDataFrame([("0000-0001", ["0000-0001"], "J One")], "issn string, issns array<string>, journal_main_title string"),
        robots=spark.createDataFrame([("bot",)], "pattern string"),
        ranges=spark.createDataFrame([(S_ip(10), S_ip(11) - 1, "BR")], "start long, end long, country string"),
        rules=spark.createDataFrame(rules, kind),
        directories=spark.createDataFrame([("aaa", "/aaa/", 1, "Main")], "collection string, directory string, position int, translator string"),
    )


def S_ip(first):
    return first << 24


def run_plan(spark, root, catalogue, at=None):
    lines = logs.read_logs(spark, [f"{root}/aaa/one.log", f"{root}/aaa/two.log.gz"])
    files = lines.select("file").distinct().withColumn("collection", F.lit("aaa"))
    return plan.run(lines, files, catalogue, S.language_codes(spark), at=at)


def test_raw_logs_to_the_store_twice(spark, root, catalogue, tmp_path):
    documents, letters = run_plan(spark, root, catalogue)
    got = {(r.pid, r.media_language, r.country_code, str(r.date)): tuple(r[c] for c in COUNTERS) for r in documents.collect()}
    assert got == {
        (PID[0], "en", "BR", "2024-01-01"): (1, 2, 1, 1),  # three clicks within the gap over two files, then an abstract
        (PID[1], "pt", "BR", "2024-01-01"): (1, 1, 1, 1),
        (PID[2], "es", "", "2024-01-02"): (1, 1, 1, 1),
    }
    assert {r.journal_main_title for r in documents.collect()} == {"J One"}
    assert sorted((r.error_type, json.loads(r.line)["url"]) for r in letters.collect()) == [("ART", f"/article/en/{PID[3]}"), ("URL", "/about")]
    again = run_plan(spark, root, catalogue, str(tmp_path / "checked"))
    for lazy, written in zip((documents, letters), again):
        assert sorted(map(str, lazy.collect())) == sorted(map(str, written.collect())) and "checked" in str(written.inputFiles())
    target = store.MetricStore(spark, str(tmp_path / "s"))
    for _ in range(2):
        plan.recompute_days(target, documents, documents)
        assert target.read().count() == 3 and target.read().agg(F.sum("total_investigations")).first()[0] == 4


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\té\n")
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "a.tsv")).collect()] == [("1", "é")]
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, text in (("one.csv", "x\ty\n2\tb\n"), ("two.csv", "y\nc\n"), ("skip.txt", "x\n9\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    got = sorted(map(tuple, tables.read_tsv_archive(spark, str(tmp_path / "b.tar.gz"), ["x", "y"]).collect()), key=str)
    assert got == [("2", "b", "one.csv"), (None, "c", "two.csv")]
    (tmp_path / "r.json").write_text(json.dumps([{"pattern": "bot", "last_changed": "2020-01-01"}, {"pattern": "bot", "last_changed": "2021-01-01"}, {"pattern": "x"}]))
    robots = tables.read_robots(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in robots.collect()] == [("bot", dt.date(2021, 1, 1))]
    assert dumps.merge_robots(robots, spark.createDataFrame([("bot", dt.date(2022, 1, 1))], robots.schema)).first().last_changed.year == 2022
    (tmp_path / "ip.csv").write_text("first,last,country\n10.0.0.0,10.0.0.255,BR\nx,y,ZZ\n")
    assert [tuple(r) for r in tables.read_ip_ranges(spark, str(tmp_path / "ip.csv")).collect()] == [(167772160, 167772415, "BR")]
    assert tables.snapshot_id(spark, str(tmp_path / "ip.csv")).first().id == hashlib.sha256((tmp_path / "ip.csv").read_bytes()).hexdigest()


def test_settings(spark):
    kind = "acronym string, directory_name string, path string, quantity string, start_date string, end_date string, e_mail string, translator_class string, sample_size string, buffer_size string"
    wide = spark.createDataFrame([("aaa", "n", "/p", "2", "2024-01-01", "", "a@x; b@x", "Main", "0.1", "2048"), ("zzz", "n", "/q", "1", "2024-01-01", None, "", None, None, None)], kind)
    got = tables.load_settings(wide, spark.createDataFrame([("aaa",)], "collection string"))
    assert {k: v.count() for k, v in got.items()} == {"directories": 1, "files_per_day": 1, "emails": 2, "validation": 1, "translators": 1}
    assert got["files_per_day"].first().end_date is None


def test_dumps(spark, tmp_path):
    def write(name, data):
        (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data))
        return str(tmp_path / name)

    pages = dumps.read_article_pages(spark, write("a.json", {"objects": [{"code": "S1", "code_title": ["1", "2"], "text_langs": ["en"]}, {"collection": "x"}]}))
    assert [(r.code, r.code_title) for r in pages.collect()] == [("S1", ["1", "2"])]
    documents = dumps.read_document_pages(spark, write("d.json", {"documents": {"k1": {"pid_v3": "v", "publication_date": "2020-05-01"}}, "pages": 1}))
    assert [(r.key, r.pid_v3, r.publication_year) for r in documents.collect()] == [("k1", "v", "2020")]
    xml = "<r><record><identifier>oai:x:preprint/7</identifier><language>pt</language><language>en</language><date>2021-02-03</date></record><record><identifier>none</identifier></record></r>"
    assert [tuple(r) for r in dumps.read_oai_records(spark, write("o.xml", xml)).collect()] == [("7", "pt", "2021-02-03", "2021")]
    journals = dumps.read_journals(spark, write("j.json", [{"collection": "x", "issn": "1", "print_issn": "1", "electronic_issn": None}]))
    row = journals.first()
    assert (row.title, row.publisher_name, row.issns) == ("", [], ["1"])
    rows, names = dumps.read_collections(spark, write("c.json", [{"acron": "aaa", "name": {"en": "A", "pt": "B"}}]))
    assert rows.first().acron3 == "aaa" and names.count() == 2


def test_dataset_tree_and_files(spark):
    containers = spark.createDataFrame([(1, "C", "dataverse"), (2, "D", "file")], "id int, title string, type string")
    datasets = spark.createDataFrame([(10, 1, "dataset", "doi:10.1234/AB", "2020-01-02"), (11, 1, "dataset", "no", None), (12, 1, "dataset", "10.1234/CD", None), (13, 1, "dataset", "10.1234/EF", "2010-01-01")], "id int, container_id int, type string, doi string, published string")
    files = spark.createDataFrame([(10, "f1", "n", "u1", "p"), (10, "f1", "m", "u2", "p"), (10, "f2", "n", "u", "p"), (12, "f3", "n", "u", "p"), (13, "f4", "n", "u", "p")], "dataset_id int, file_id string, file_name string, file_url string, file_persistent_id string")
    tree = dumps.read_dataset_tree(containers, datasets, files, dt.date(2019, 1, 1), dt.date(2021, 1, 1))
    assert {r.dataset_doi for r in tree.collect()} == {"10.1234/AB", "10.1234/CD"}
    maps = dumps.file_maps(tree)
    got = {r.dataset_doi: {k: v.name for k, v in r.files.items()} for r in maps.collect()}
    assert got == {"10.1234/AB": {"f1": "m", "f2": "n"}, "10.1234/CD": {"f3": "n"}}
    both = maps.withColumn("new", F.transform_values("files", lambda k, v: v.withField("name", F.lit("new")))).select(dumps.add_files("files", "new").alias("m"))
    assert all(v.name == "new" for r in both.collect() for v in r.m.values())


def test_catalogue_merges(spark):
    old = spark.createDataFrame([("x", "1", "p1", "", "2020-01-01", "2020", "en")], "collection string, issn string, pid_v2 string, pid_v3 string, publication_date string, publication_year string, default_language string")
    new = spark.createDataFrame([("x", "1", "p1", "v3", "", "", "pt"), ("x", "1", "p2", "w3", "2021-01-01", "2021", "")], old.schema)
    got = {r.pid_v2: r for r in dumps.merge_documents(old, new).collect()}
    assert (got["p1"].pid_v3, got["p1"].publication_date, got["p1"].default_language) == ("v3", "2020-01-01", "pt") and got["p2"].default_language == ""
    assert {r.publication_date for r in dumps.merge_articles(old, new).collect()} == {"2020-01-01", "2021-01-01"}
    assert {r.publication_date for r in dumps.merge_articles(old, new, force=True).collect()} == {"", "2021-01-01"}
    pre = spark.createDataFrame([("x", "7", "en"), ("x", "", "pt")], "collection string, pid_generic string, default_language string")
    assert dumps.merge_preprints(pre.limit(0), pre).count() == 1 and dumps.merge_datasets(pre, pre).count() == 2
    assert dumps.merge_journals(old, new.limit(1).select("collection", "issn")).count() == 1
    assert dumps.rename_keys(old, {"issn": "code", "absent": "y"}).columns[1] == "code"


def test_table_checks(spark):
    df = spark.createDataFrame([("1", "abc", "7", "1.5", "Yes", "2024-02-30"), ("2", "", "x", "z", "maybe", "3 Jan 2024"), ("3", "abcdef", " 8 ", "1e3", "", "Wed Jan 3 2024")], "id string, s string, i string, f string, b string, d string")
    rules = [Rule("s", value_required=True, max_length=5, pattern="a"), Rule("i", "integer"), Rule("f", "float"), Rule("b", "bool"), Rule("d", "date"), Rule("gone")]
    got = {(r.row_id, r.column, r.message) for r in quality.check_table(df, rules, "id", extra_allowed=False).collect()}
    assert got == {
        (None, "gone", "missing column"), (None, "id", "extra column"), ("1", "d", "not a date"), ("2", "s", "missing value"), ("2", "i", "not an integer"),
        ("2", "f", "not a number"), ("2", "b", "not a boolean"), ("3", "s", "too long"),
    }
    assert [tuple(r) for r in quality.check_table(df, rules[:5], "id", first_only=True).collect()] == [("not a date", "1", "d")]
    assert quality.check_columns(df, [Rule("S"), Rule("ID")], ignore_case=True) == []
    times = spark.createDataFrame([("1", "2024-01-02 10:20:30"), ("2", "2024-01-02T10:20"), ("3", "noon")], "id string, t string")
    assert [r.row_id for r in quality.check_table(times, [Rule("t", "datetime")], "id").collect()] == ["3"]
    lines = spark.createDataFrame([("a,b,c",), ('"x,y",b,c',), ("a,b",), ("a,b,c,d",), ("  ",)], "value string")
    assert sorted((r.value, r.message[:5]) for r in quality.check_widths(lines, 3).collect()) == [("a,b", "fewer"), ("a,b,c,d", "more ")]


def test_streams(spark, root, catalogue, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.log").write_text("one\ntwo\n")
    for _ in range(2):
        ingest.ingest(ingest.stream_logs(spark, str(src), 1), out, check).awaitTermination()
        assert spark.read.parquet(out).count() == 2
    (src / "b.log").write_text("three\n")
    ingest.ingest(ingest.stream_logs(spark, str(src)), out, check).awaitTermination()
    assert {r.value for r in spark.read.parquet(out).collect()} == {"one", "two", "three"}
    files = spark.createDataFrame([("h1", dt.datetime(2024, 1, 1)), ("h1", dt.datetime(2024, 1, 2)), ("h2", dt.datetime(2024, 1, 1))], "hash string, modified timestamp")
    files.write.parquet(str(tmp_path / "files"))
    ingest.ingest(ingest.distinct_files(ingest.stream_table(spark, str(tmp_path / "files"))), str(tmp_path / "u"), str(tmp_path / "uc")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_streamed_double_clicks(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    seconds = [0, 30, 60, 91, 3590, 3610, 3641, 5000, 5000, 5001]
    rows = [("c", "1", "ip", "aaa", "i", "p", "", "", "en", "html", "full_text" if n % 2 else "abstract", "BR", start + dt.timedelta(seconds=s, milliseconds=500 * (n % 2)), n) for n, s in enumerate(seconds)]
    kind = ", ".join(f"{c} string" for c in "client_name client_version ip_address collection issn pid_v2 pid_v3 pid_generic media_language media_format content_type country_code".split()) + ", local_datetime timestamp_ntz, seq long"
    end = [(*r[:2], "end", *r[3:12], start + dt.timedelta(days=1), 99) for r in rows[:1]]
    for some in (rows[1::2], rows[0::2], end, rows[:1]):  # the last one is late
        spark.createDataFrame(some, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "hits"))
        stream = ingest.stream_kept_clicks(ingest.stream_table(spark, str(tmp_path / "hits")), delay="2 hours")
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {((r.second - start).total_seconds(), r.n_clicks, r.is_request) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(60, 3, False), (91, 1, True), (3590, 1, False), (3610, 1, True), (3641, 1, False), (5001, 3, True)}
    documents = metric_documents(spark.createDataFrame(rows, kind), Rules()).agg(F.sum("total_investigations"), F.sum("total_requests")).first()
    assert tuple(documents) == (6, 3)


def test_widths_of_later_lines_and_of_quoted_separators(spark, tmp_path):
    from tallyforge import queries

    spark.createDataFrame([(1, 'a,b,c\nx\n\n"a,b",c,d'), (2, 'say "x,y"'), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["all_row_widths"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.line, r.message) for r in got} == {(1, 2, "fewer values than columns"), (2, 1, "fewer values than columns")}

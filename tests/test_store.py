import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import coverage, filters, joins, literals, ranges, store
from tallyforge.operators.metrics import COUNTERS

KIND = "id string, collection string, date date, total_requests long, total_investigations long, unique_requests long, unique_investigations long"
DAY = dt.date(2024, 1, 1)


@pytest.fixture
def target(spark, tmp_path):
    return store.MetricStore(spark, str(tmp_path / "metrics"))


def docs(spark, *rows):
    return spark.createDataFrame([(i, c, d, n, n, n, n) for i, c, d, n in rows], KIND)


def content(target):
    return sorted((r.id, r.total_requests) for r in target.read().collect())


def test_store_writes(spark, target):
    assert target.read() is None
    target.put(docs(spark, ("a", "x", DAY, 1), ("b", "y", DAY, 2)))
    target.put(docs(spark, ("a", "x", DAY, 5), ("c", "x", DAY, 3)))
    assert content(target) == [("a", 5), ("b", 2), ("c", 3)]
    target.accumulate(docs(spark, ("a", "x", DAY, 1), ("d", "z", DAY, 9)))
    assert content(target) == [("a", 6), ("b", 2), ("c", 3), ("d", 9)]
    target.drop("x", 2024)
    assert content(target) == [("b", 2), ("d", 9)]
    target.drop("nowhere", 2024)


def test_replacing_days_is_idempotent(spark, target):
    target.put(docs(spark, ("a", "x", DAY, 1), ("b", "x", DAY + dt.timedelta(1), 2), ("old", "x", DAY, 7)))
    for _ in range(2):
        target.replace_days(docs(spark, ("a", "x", DAY, 4)))
        assert content(target) == [("a", 4), ("b", 2)]
    target.replace_days(docs(spark).limit(0), docs(spark, ("?", "x", DAY, 0)))
    assert content(target) == [("b", 2)]


def test_a_day_without_rows_is_emptied(spark, target):
    target.put(docs(spark, ("a", "x/y", DAY, 1), ("b", "z", DAY, 2)))
    target.replace_days(docs(spark).limit(0), docs(spark, ("?", "x/y", DAY, 0)))
    assert content(target) == [("b", 2)] and target.partitions() == [("z", 2024)]


def test_store_of_fixed_columns(spark, tmp_path):
    target = store.MetricStore(spark, str(tmp_path / "s"), store.DOCUMENT)
    assert target.read().count() == 0 and target.create("x", 2024) and not target.create("x", 2024)
    assert target.read().count() == 0 and target.partitions() == [("x", 2024)]
    target.put(docs(spark, ("a", "x", DAY, 1)))
    target.accumulate(docs(spark, ("a", "x", DAY, 1)))
    row = target.read().first()
    assert (row.id, row.total_requests, row.journal_acronym, row.year) == ("a", 2, None, 2024)
    with pytest.raises(ValueError):
        target.write(docs(spark, ("a", "x", DAY, 1)).withColumn("other", F.lit(1)))


def test_merge_keeps_one_sided_counters(spark):
    a = docs(spark, ("a", "x", DAY, 1), ("b", "x", DAY, 2))
    b = docs(spark, ("a", "x", DAY, 10)).withColumn("unique_requests", F.lit(None).cast("long"))
    got = {r.id: tuple(r[c] for c in COUNTERS) for r in store.merge_metrics(a, b).collect()}
    assert got == {"a": (11, 11, 1, 11), "b": (2, 2, 2, 2)}


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "", "z"), (3, "c", None)], "k int, v string, w string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], keep_old_if_blank=("v",)).collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    assert sorted(map(tuple, store.upsert(old, new, ["k"], force=False).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    assert sorted(map(tuple, store.insert_only(old, new.union(new), ["k"]).collect()), key=str) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]


def test_repeated_keys_of_a_load(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "x", 1), (1, "", 2), (2, "p", 1), (2, "q", 2)], "k int, v string, n int")
    for _ in range(2):
        got = store.upsert(old, new, ["k"], ["v"], keep_old_if_blank=("v",), order=("n",))
        assert sorted(map(tuple, got.collect())) == [(1, "x", 0), (2, "q", 1)]
        old = got
    assert sorted(map(tuple, store.upsert(old.limit(0), new, ["k"], force=False, order=("n",)).collect())) == [(1, "x", 1), (2, "p", 1)]


def test_robot_patterns_are_read_one_by_one(spark):
    lines = spark.createDataFrame([("zz bot",), ("ab",), ("q EN",), ("q en",), ("a#b",), (None,)], "user_agent string")
    robots = spark.createDataFrame([("(a)b",), (r"(z)\1",), ("(?-i)EN",), (r"\Qa#b",)], "pattern string")
    assert {r[0] for r in filters.without_robots(lines, robots).collect()} == {"q en", None}


def test_directories_without_translator_are_skipped(spark):
    files = spark.createDataFrame([("c", "/a/b/f"), ("c", "/z")], "collection string, path string")
    directories = spark.createDataFrame([("c", "/a/", 1, None), ("c", "/a/b/", 2, "modern"), ("c", "/", 3, "")], "collection string, directory string, position int, translator string")
    assert {(r.path, r.translator) for r in joins.file_translator(files, directories).collect()} == {("/a/b/f", "modern"), ("/z", None)}


def test_deletes_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, t string")
    assert [r.id for r in store.delete_where(df, {"t": ["a", "c"]}).orderBy("id").collect()] == [2, 3]
    assert store.delete_where(df, {}).count() == 3
    assert [r.id for r in store.delete_ids(df, spark.createDataFrame([(3,), (9,)], "id int")).orderBy("id").collect()] == [1, 2]


def test_archive_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert [r.id for r in store.archive(df, F.col("id") == 1, str(tmp_path / "j")).collect()] == [2]
    assert spark.read.json(str(tmp_path / "j")).first().t == "a"
    store.export_table(df, ["t"], str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["t"]


def test_many_robot_patterns(spark):
    lines = spark.createDataFrame([("GoogleBot/1",), ("Firefox",), (None,)], "user_agent string")
    robots = spark.createDataFrame([("bot",), ("spider",)], "pattern string")
    assert sorted(map(str, (r[0] for r in filters.without_robots(lines, robots).collect()))) == ["Firefox", "None"]
    assert filters.without_robots(lines, robots.limit(0)).count() == 3


def test_small_filters(spark):
    df = spark.createDataFrame([(1, "click", dt.date(2024, 1, 1), ["Ab"], {"k": "v"}), (2, None, None, None, None)], "id int, event_type string, created date, l array<string>, m map<string,string>")
    assert filters.search(df, "aB", ["l"]).count() == filters.search(df, "V", ["m"]).count() == 1
    assert filters.retain_events(df, delete_all=True).count() == 0
    assert [r.id for r in filters.retain_events(df, type_contains="CLI").collect()] == [2]
    assert [r.id for r in filters.publication_window(df, dt.date(2025, 1, 1), dt.date(2025, 1, 2), "created").collect()] == [2]
    assert [r.id for r in filters.newest_first(df, "created", "id").collect()] == [1, 2]
    assert [r.id for r in filters.page(df, ["id"], 2, 1).collect()] == [2]
    assert store.latest(df, "created", "id").first().id == 1


def test_expected_files_and_status(spark):
    settings = spark.createDataFrame([("a", 2, dt.date(2024, 1, 1), dt.date(2024, 1, 2)), ("a", 1, dt.date(2024, 1, 2), None)], "collection string, quantity int, start_date date, end_date date")
    files = spark.createDataFrame([("a", dt.date(2024, 1, 1), "PRO"), ("a", dt.date(2024, 1, 1), "PRO"), ("a", dt.date(2024, 1, 3), "QUE"), ("a", dt.date(2024, 1, 3), "PRO")], "collection string, date date, status string")
    got = coverage.coverage(settings.select("collection").distinct(), dt.date(2024, 1, 1), dt.date(2024, 1, 4), files, settings).orderBy("date").collect()
    assert [(r.expected, r.n_settings, r.status, r.is_complete) for r in got] == [(2, 1, "OK", True), (None, 2, None, False), (1, 1, "EXT", False), (1, 1, "MIS", False)]


def test_address_ranges(spark):
    df = spark.createDataFrame([("10.0.0.5",), ("10.1.2.3",), ("11.0.0.0",), ("bad",), (None,)], "ip_address string")
    known = spark.createDataFrame([(167772160, 167772415, "AA"), (167772160, 184549375, "BB"), (5, 1, "CC")], "start long, end long, country string")
    got = {r.ip_address: r.country_code for r in ranges.ip_country(df, known).collect()}
    assert got == {"10.0.0.5": "AA", "10.1.2.3": "BB", "11.0.0.0": None, "bad": None, None: None}


def test_late_file_reopens_its_day(spark):
    files = spark.createDataFrame([("a", DAY, "h1"), ("a", DAY, "h2"), ("b", DAY, "h3")], "collection string, date date, hash string")
    manifest = spark.createDataFrame([("a", DAY, ["h1"]), ("b", DAY, ["h3"])], "collection string, date date, hashes array<string>")
    assert [(r.collection, r.hashes) for r in coverage.reopened_days(files, manifest).collect()] == [("a", ["h1", "h2"])]


def test_validation_uses_the_name(spark):
    lines = spark.createDataFrame([("f", i, dt.datetime(2024, 1, 1, i % 24), None if i % 3 else "LIN", dt.date(2024, 1, d)) for d in (1, 20) for i in range(30)], "file string, seq long, local_datetime timestamp_ntz, reject_reason string, named date")
    got = {r.named.day: r.status for r in coverage.validate_files(lines, 1.0, named_date="named").collect()}
    assert got == {1: "QUE", 20: "INV"}


def test_patterns_that_cannot_be_compiled_are_named(spark):
    robots = spark.createDataFrame([("(?P<x>spi)der(?P=x)",), ("*crawler",), ("[",), ("bot",), (None,)], "pattern string")
    good, bad = filters.robot_patterns(robots)
    assert good == [r"(?<x>spi)der\k<x>", "bot"] and set(bad) == {"*crawler", "["}
    lines = spark.createDataFrame([("a Bot",), ("spiderSPI",), ("spider",), ("*crawler [",), (None,)], "user_agent string")
    assert {r[0] for r in filters.without_robots(lines, robots).collect()} == {"spider", "*crawler [", None}


@pytest.mark.parametrize(
    "pattern, literal",
    [("Goo[bB]ot/2\\.1", "ot/2.1"), ("a?bc+d", "bc"), ("x{12}yy", "yy"), ("(ab)?cd", "cd"), ("a|b", ""), (r"\x41bcd", ""), (r"\bfoo\d", "foo"), ("[^]a]spider", "spider"), ("[a[b]]cd", ""), ("(?x)a b", ""), ("abc*", "ab"), ("", "")],
)
def test_the_literal_of_a_pattern(pattern, literal):
    assert literals.required_literal(pattern) == literal


@pytest.mark.parametrize(
    "pattern, literal",
    [(r"(?<n>none)12\k<n>", "none12"), ("(never|ever) here", " here"), ("(?:ab)+cd", "ab"), ("a(b(c)?d)e", "ab"), ("x(ab|c)?yz", "yz"), ("a)b", ""), ("(?=ab)c", ""), ("(a", "")],
)
def test_the_literal_of_a_pattern_with_groups(pattern, literal):
    assert literals.required_literal(pattern) == literal


def test_a_path_leaves_its_task_once(spark):
    """However many rows name a directory, the first that has a translator counts, and only one row a directory is read."""
    found = literals.first_contained(spark.createDataFrame([("x", "/a/b"), ("y", "/a/b"), ("x", "/"), (None, "/a"), ("x", None)], "g string, t string"), [("x", "b", "1"), ("x", "/a", "2"), ("y", "/a", "3"), ("x", "/a", "4"), ("y", "b", "5")])
    assert sorted(map(tuple, found.collect())) == [("x", "/a/b", "1"), ("y", "/a/b", "3")]
    assert literals.first_contained(spark.createDataFrame([("x", "t")], "g string, t string"), [("x", "", "1")]).first().value == "1"
    rows = spark.range(5000).selectExpr("'x' collection", "concat('/d', id % 3) directory", "int(-id) position", "if(id > 4990, '', concat('t', id)) translator")
    files = spark.createDataFrame([("x", "/d1/f"), ("x", "/d0/d2")], "collection string, path string")
    out = joins.file_translator(files, rows)
    assert {r.path: r.translator for r in out.collect()} == {"/d1/f": "t4990", "/d0/d2": "t4989"}


@pytest.mark.parametrize("most", [0, 100_000])
def test_patterns_stay_on_the_cluster(spark, monkeypatch, most):
    """No pattern reaches the driver, and patterns of one form each meet the agents of their own literal only."""
    monkeypatch.setattr(filters, "robot_patterns", None)
    monkeypatch.setattr(filters, "BROADCAST", most)
    agents = ["Client7; x", "client8;", "none5none", "none5", "UND\u00c9", "z" * 70 + "y", "", "q1q", None]
    lines = spark.createDataFrame([(x,) for x in agents], "user_agent string")
    robots = spark.range(3000).selectExpr("explode(array(concat('client', id * 7, ';'), concat('(?P<n>none)', id, '(?P=n)'), concat('*', id))) pattern")
    robots = robots.union(spark.createDataFrame([("und\u00e9",), ("Z{70}Y",), ("Z" * 70 + "x",), (r"q\dq|w",), (None,)], "pattern string"))
    kept = [r[0] for r in filters.without_robots(lines, robots).collect()]
    assert sorted(kept, key=str) == sorted(["client8;", "none5", "UND\u00c9", "", None], key=str)


def test_every_contained_literal_is_found(spark):
    rows = spark.createDataFrame([("abcabd",), ("",), ("\u00c4BC",), (None,)], "t string")
    wanted = [("ab", 1), ("bc", 2), ("abc", 3), ("", 4), ("ab", 5), ("\u00e4", 6)]
    found = {(r.text, r.id) for r in literals.containing(rows, wanted).collect()}
    assert found == {(t, i) for t in ("abcabd", "", "\u00c4BC") for x, i in wanted if x in t}
    assert {r.id for r in literals.containing(rows, wanted, fold=True).where("text = '\u00c4BC'").collect()} == {2, 4}
    assert literals.containing(rows, []).count() == 0


def test_rows_without_a_collection_or_date_are_kept(spark, target):
    target.put(docs(spark, ("n", None, DAY, 1), ("e", "", DAY, 2), ("d", "x", None, 3)))
    target.put(docs(spark, ("n2", None, DAY, 4), ("d", "x", None, 5)))
    assert content(target) == [("d", 5), ("e", 2), ("n", 1), ("n2", 4)]
    target.accumulate(docs(spark, ("n", None, DAY, 10)))
    assert content(target) == [("d", 5), ("e", 2), ("n", 11), ("n2", 4)]
    target.replace_days(docs(spark).limit(0), docs(spark, ("?", "", DAY, 0)))
    assert content(target) == [("d", 5)]


def test_repeated_ids_in_a_load(spark, target):
    for expected in ([("a", 2)], [("a", 7)]):
        target.put(docs(spark, ("a", "x", DAY, 1), ("a", "x", DAY, expected[0][1])))
        assert content(target) == expected
    target.accumulate(docs(spark, ("a", "x", DAY, 1), ("a", "x", DAY, 2), ("b", "x", DAY, 3), ("b", "x", DAY, 3)))
    assert content(target) == [("a", 10), ("b", 6)]


def test_a_load_counts_once(spark, target):
    load = docs(spark, ("a", "x", DAY, 1))
    assert target.accumulate(load, "one") and not target.accumulate(load, "one") and target.accumulate(load, "two")
    assert content(target) == [("a", 2)] and target.loaded("one") and not target.loaded("three")


@pytest.mark.parametrize("step", ["_commit", "_apply", "write", "drop"])
def test_a_crash_is_finished_or_undone(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "metrics")
    target = store.MetricStore(spark, path)
    target.put(docs(spark, ("a", "x", DAY, 1), ("b", "y", DAY, 1)))

    def crash(*_):
        raise RuntimeError("crash")

    day_y = docs(spark, ("?", "x", DAY, 0), ("?", "y", DAY, 0))
    with monkeypatch.context() as m:
        m.setattr(store.MetricStore, step, crash)
        with pytest.raises(RuntimeError):
            target.replace_days(docs(spark, ("c", "x", DAY, 5)), day_y, "load")
    again = store.MetricStore(spark, path, patience=0)
    again.recover()
    done = step != "_commit"
    assert again.loaded("load") == done and content(again) == ([("c", 5)] if done else [("a", 1), ("b", 1)])
    assert again.replace_days(docs(spark, ("c", "x", DAY, 5)), day_y, "load") != done
    assert content(again) == [("c", 5)]


def test_of_two_writers_one_merges_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "metrics")
    first, second = store.MetricStore(spark, path), store.MetricStore(spark, path)
    first.put(docs(spark, ("a", "x", DAY, 1)))
    commit, tries = store.MetricStore._commit, []

    def slow(self, staged, number):
        tries.append(number)
        if len(tries) == 1:
            second.accumulate(docs(spark, ("a", "x", DAY, 10)), "theirs")
        return commit(self, staged, number)

    monkeypatch.setattr(store.MetricStore, "_commit", slow)
    first.accumulate(docs(spark, ("a", "x", DAY, 100)), "mine")
    assert content(first) == [("a", 111)] and tries == [2, 2, 3]


def test_an_empty_load(spark, target):
    target.put(docs(spark).limit(0))
    assert target.read() is None
    target.put(docs(spark, ("a", "x", DAY, 1)))
    target.accumulate(docs(spark).limit(0))
    assert content(target) == [("a", 1)]

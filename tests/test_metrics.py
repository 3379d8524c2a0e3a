import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import checks, joins, metrics
from tallyforge.operators.metrics import Rules

BASE = dict(client_name="c", client_version="1", ip_address="10.0.0.1", collection="aaa", issn="1234-5678", pid_v2="p", pid_v3="", pid_generic="", media_language="en", media_format="html", content_type="full_text", country_code="BR")
KIND = ", ".join(f"{c} string" for c in BASE) + ", local_datetime timestamp_ntz, seq long"


def hits(spark, *rows):
    start = dt.datetime(2024, 1, 1, 10)
    data = [tuple((BASE | more).values()) + (start + dt.timedelta(seconds=s), i) for i, (s, more) in enumerate(rows)]
    return spark.createDataFrame(data, KIND)


def counters(df, rules=Rules()):
    rows = metrics.metric_documents(df, rules).agg(*[F.sum(c).alias(c) for c in metrics.COUNTERS]).first()
    return tuple(rows)


def test_double_click_chain(spark):
    df = hits(spark, (0, {}), (20, {}), (40, {}), (100, {}))
    kept = metrics.kept_clicks(df).where("kept").orderBy("second").collect()
    assert [r.second.second + 60 * r.second.minute for r in kept] == [40, 100]
    assert counters(df) == (2, 2, 1, 1)


@pytest.mark.parametrize("gap, kept", [(30, 1), (31, 2)])
def test_gap_edge(spark, gap, kept):
    assert counters(hits(spark, (0, {}), (gap, {})))[1] == kept


def test_hour_edge(spark):
    df = hits(spark, (3590, {}), (3605, {}))
    assert counters(df) == (2, 2, 2, 2)
    assert counters(df, Rules(session_unit="day")) == (1, 1, 1, 1)


def test_same_second(spark):
    df = hits(spark, (0, {"content_type": "abstract"}), (0, {}))
    assert counters(df) == (1, 1, 1, 1)  # the later one by seq counts
    assert metrics.kept_clicks(df).first().n_clicks == 2


def test_formats(spark):
    df = hits(spark, (0, {}), (60, {"media_format": "pdf"}))
    assert counters(df)[2:] == (1, 1) and counters(df, Rules(per="access"))[2:] == (2, 2)


def test_abstract_and_full_text(spark):
    assert counters(hits(spark, (0, {"content_type": "abstract"}), (60, {}))) == (1, 2, 1, 1)


def test_separator_in_a_value_and_null_country(spark):
    df = hits(spark, (0, {"client_name": "a|b"}), (60, {"country_code": None}))
    out = metrics.metric_documents(df).collect()
    assert {r.country_code for r in out} == {"BR", ""} and all(r.total_investigations == 1 for r in out)


def test_splitting_the_input_changes_nothing(spark):
    df = hits(spark, *[(s, {"client_name": f"c{s % 3}"}) for s in range(0, 4000, 17)])
    assert counters(df) == counters(df.repartition(7)) and counters(df)[0] <= counters(df)[1]


def test_first_attributes(spark):
    df = hits(spark, (50, {}), (0, {}), (100, {})).withColumn("journal_acronym", F.concat(F.lit("j"), F.col("seq")))
    assert metrics.metric_documents(df).first().journal_acronym == "j1"
    assert metrics.click_histogram(df).first().clicks == {"00:00": 1, "00:50": 1, "01:40": 1}


CASES = [
    ({}, True), ({"issn": ""}, False), ({"media_format": "undefined"}, False), ({"content_type": "undefined"}, False), ({"pid_v2": "", "pid_v3": ""}, False),
    ({"media_format": "html"}, True), ({"content_type": "abstract"}, True), ({"pid_v2": None, "pid_v3": None, "pid_generic": "DOI:10.48331/DATA.JLMAIY"}, True), ({"issn": None}, False),
]


@pytest.mark.parametrize("change, good", CASES)
def test_validity(spark, change, good):
    df = hits(spark, (0, {"pid_v2": "S0102-67202020000100001", "pid_v3": "jGJccQ7bFdbz6wy3nfXGVdv"} | change))
    row = checks.check_access(df).first()
    assert row.is_valid is good and row.code == ("valid" if good else "missing_fields")


def test_catalogue_codes(spark):
    df = hits(spark, (0, {}), (1, {"issn": "x"}), (2, {"pid_v3": "q"}), (3, {"pid_v2": "", "pid_generic": "g"}))
    known = spark.createDataFrame([("p", "", None), ("", "z", "g")], "pid_v2 string, pid_v3 string, pid_generic string")
    journals = spark.createDataFrame([(["1234-5678", ""],)], "issns array<string>")
    got = checks.check_access(df, checks.known_pids(known), checks.known_issns(journals)).orderBy("seq").collect()
    assert [r.code for r in got] == ["valid", "invalid_issn", "invalid_pid_v3", "valid"]
    assert checks.check_distinct(df, checks.known_pids(known), checks.known_issns(journals)).orderBy("seq").collect() == got
    nulls = df.withColumns({"issn": F.lit(None).cast("string"), "pid_v3": F.lit(None).cast("string")})
    assert [r.code for r in checks.check_distinct(nulls, checks.known_pids(known)).collect()] == ["missing_fields"] * 4
    letters = checks.dead_letters(spark.createDataFrame(got, checks.check_access(df).schema), ["seq"], ["issn"]).collect()
    assert sorted(r.error_type for r in letters) == ["ART", "JOU"]


def test_codes_found_are_flagged(spark):
    """By both checks as by the single lookup; codes that are not given are not found."""
    df = hits(spark, (0, {}), (1, {"issn": "x"}), (2, {"pid_v2": "q"}), (3, {"pid_v2": "", "pid_generic": "g"}), (4, {"issn": None, "pid_v2": None}))
    known = checks.known_pids(spark.createDataFrame([("p", "", "g")], "pid_v2 string, pid_v3 string, pid_generic string"))
    issns = checks.known_issns(spark.createDataFrame([(["1234-5678", ""],)], "issns array<string>"))
    flags = {"issn": "issn_known", "pid_v2": "pid_known", "pid_generic": "generic_known"}
    wanted = [(True, True, False), (False, True, False), (True, False, False), (True, False, True), (False, False, False)]
    for check in (checks.check_access, checks.check_distinct):
        assert [tuple(r) for r in check(df, known, issns, flags).orderBy("seq").select(*flags.values()).collect()] == wanted
    alone = joins.flag_known(joins.flag_known(df, "issn", issns, "issn", "a"), "pid_v2", known, "pid", "b")
    assert [(r.a, r.b) for r in alone.orderBy("seq").collect()] == [w[:2] for w in wanted]


def test_numbers_are_flagged(spark):
    out = joins.flag_known(spark.createDataFrame([(1,), (2,), (None,)], "n int"), "n", spark.createDataFrame([(2,), (3,)], "k long"), "k", "found")
    assert {r.n: r.found for r in out.collect()} == {1: False, 2: True, None: False}


def test_lines_are_moved_once_for_each_code(spark):
    """Lines with codes of their own, looked up in a catalogue that is not sent to every task: three kinds of codes, three moves."""
    from tallyforge import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.QUERIES["catalogue_lookups"](spark, "/root/testdata/sf0.001")
        lines = df.count()
        assert 0 < moved(df) < 3 * lines + 3 * 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved(df):
    """Rows that the shuffles of ``df`` wrote."""
    df.collect()
    waiting, found = [df._jdf.queryExecution().executedPlan()], {}
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        elif name == "ShuffleExchangeExec":
            found[node.id()] = node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return sum(found.values())


def test_null_record_gives_null_fields(spark):
    df = spark.createDataFrame([(None,), ({"issn": "1"},)], "item struct<issn: string>")
    out = checks.item_access_data(df, F.lit("aaa"), {"en": "en"}, record="item").collect()
    assert out[0].collection is None and (out[1].collection, out[1].media_language, out[1].pid_v2) == ("aaa", "un", "")


def test_files_without_sampled_lines_are_validated(spark):
    from tallyforge.operators.coverage import validate_files

    rows = [(f"f{i}", 0, "2024-01-02 03:04:05", None) for i in range(30)]
    lines = spark.createDataFrame(rows, "file string, seq long, local_datetime string, reject_reason string")
    got = validate_files(lines).collect()
    assert {(r.file, r.sampled, r.status) for r in got} == {(f"f{i}", 1, "QUE") for i in range(30)}

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates, ids, loglines
from tallyforge.functions import standardize as S


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r[0] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").select("y").collect()]

    return run


def test_codes_and_names(apply):
    cases = {
        "Ceará / CE": [("CE", "Ceará")], "CE": [("CE", None)], "Ceará": [(None, "Ceará")],
        "Ceará / CE, São Paulo / SP": [("CE", "Ceará"), ("SP", "São Paulo")], "CE / SP": [("CE", None), ("SP", None)],
        "Ceará - São Paulo": [(None, "Ceará"), (None, "São Paulo")], "CE, Ceará, Bahia": [(None, "CE, Ceará, Bahia")], "  ": [], None: [],
    }
    assert [[tuple(p) for p in x] for x in apply(S.split_codes_and_names, list(cases))] == list(cases.values())


def test_names(apply):
    assert apply(S.split_names, ["Txto 1,    Texto 2,    Texto   3", "a|b||", "", None]) == [["Txto 1", "Texto 2", "Texto 3"], ["a", "b"], [], []]


def test_languages(spark, apply):
    codes = S.language_codes(spark)
    assert apply(lambda x: S.std_language(x, codes), ["en-US", "esp", "pt-BR", "spa", "en-GB", "EN", "", None, "qq", "zzzz"]) == ["en", "es", "pt", "es", "en", "en", "un", "un", "un", "un"]
    assert apply(lambda x: S.language_iso(x, codes), ["pt-BR", "en_US", "xx-YY", "", None]) == ["pt", "en", "", "", ""]


def test_pids(apply):
    v2, v3 = "S0102-67202020000100001", "jGJccQ7bFdbz6wy3nfXGVdv"
    assert apply(S.std_pid_v2, [v2, "s" + v2[1:], v2 + "xyz", v2[:22], "X" + v2[1:], "", None]) == [v2, v2, v2, "", "", "", ""]
    assert apply(S.std_pid_v3, [v3, v3 + "zz", "short", "", None]) == [v3, v3, "", "", ""]


def test_doi(apply):
    doi = "10.1590/S0102-67202020000100001"
    forms = [doi, *(p + doi for p in ("doi:", "http://doi.org/", "https://doi.org/", "doi:http://doi.org/", "doi:https://doi.org/"))]
    assert apply(S.std_doi, forms) == [doi] * 6
    assert apply(S.std_doi, ["10.1002/abc<d>", "none", "10.12345/abc def"]) == ["10.1002/ABC<D>", None, "10.12345/ABC"]
    assert apply(S.std_pid_generic, ["DOI:10.48331/SCIDATA.JLMAIY", " abc ", "", None]) == ["10.48331/SCIDATA.JLMAIY", "ABC", "", ""]


def test_years(apply):
    assert apply(S.std_year, ["2023", "2020-2023", "2020/2023", "Published in 2023", "invalid", "", None, "23", "(2023)", "1500", "2101"]) == ["2023", "2020", "2020", "", "", "", "", "", "", "1500", ""]
    assert apply(S.std_year, [2023], "int") == ["2023"]


def test_small_texts(apply):
    assert apply(S.squeeze_spaces, [" a\t b\n c ", "", None]) == ["a b c", "", None]
    assert apply(S.preprint_id, ["oai:x.org:preprint/123", "oai:x", "", None]) == ["123", "", "", ""]
    lic = [tuple(x) for x in apply(S.license_parts, ["http://creativecommons.org/licenses/BY-NC/4.0/", "x/by/abc", "none", "a/by/3/4"])]
    assert lic == [("by-nc", "4.0"), ("by", None), (None, None), ("by", "3")]


def test_addresses(apply):
    assert apply(S.ip_to_number, ["10.0.1.2", "255.255.255.255", "256.1.1.1", "1.2.3", "::1", "", None]) == [167772418, 4294967295, None, None, None, None, None]
    assert apply(S.ipv6_to_hex, ["2001:db8::1", "::", "1:2:3:4:5:6:7:8", "1.2.3.4", "1::2::3", "12345::"]) == ["20010db8000000000000000000000001", "0" * 32, "00010002000300040005000600070008", None, None, None]


def test_times(apply):
    t = dt.datetime(2023, 3, 15, 14, 30, 45)
    assert apply(dates.minute_second_key, [t], "timestamp_ntz") == ["30:45"]
    assert apply(dates.truncate_to_hour, [t], "timestamp_ntz") == [dt.datetime(2023, 3, 15, 14)]
    text = ["2023-03-15 14:30:45", "2023-3-5 4:3:2", "bad", None]
    assert apply(lambda x: dates.minute_second_key(x, True), text) == ["30:45", "03:02", None, None]
    assert apply(lambda x: dates.truncate_to_hour(x, True), text)[0] == dt.datetime(2023, 3, 15, 14)
    assert apply(dates.parse_date, ["2023-1-5", "2023-02-30", "x", None]) == [dt.date(2023, 1, 5), None, None, None]


def test_date_ranges():
    day, today = dt.date, dt.date(2025, 6, 15)
    assert dates.date_range("2023-01-01", "2023-01-31") == (day(2023, 1, 1), day(2023, 1, 31))
    assert dates.date_range("invalid", "2023-01-10") == (day(2023, 1, 3), day(2023, 1, 10))
    assert dates.date_range("2024-05-20", "invalid") == (day(2024, 5, 20), day(2024, 5, 27))
    assert dates.date_range(days_back=10, today=today) == (day(2025, 6, 5), today)
    assert dates.date_range(today=today) == (day(2025, 6, 8), today)
    assert dates.date_range(start="2025-02-01") == (day(2025, 2, 1), day(2025, 2, 8))
    assert dates.date_range(end="2025-02-08") == (day(2025, 2, 1), day(2025, 2, 8))
    assert dates.date_range(days_back=0, today=today) == (day(2025, 6, 8), today)


def test_day_spine(spark):
    c = spark.createDataFrame([("a",), ("b",)], "collection string")
    assert dates.day_spine(c, dt.date(2024, 1, 1), dt.date(2024, 1, 3)).count() == 6
    assert dates.day_spine(c, dt.date(2024, 1, 3), dt.date(2024, 1, 1)).count() == 0


def test_ids(spark):
    df = spark.createDataFrame([("c|x", None, "1.2.3.4", dt.datetime(2024, 1, 2, 3, 4, 5))], "n string, v string, ip string, t timestamp_ntz")
    assert df.select(ids.session_id("n", "v", "ip", F.col("t"))).first()[0] == "c|x|None|1.2.3.4|2024-01-02|03"
    assert df.select(ids.session_id("n", "v", "ip", F.col("t"), "day")).first()[0] == "c|x|None|1.2.3.4|2024-01-02"
    assert df.select(ids.store_name(F.lit("metrics"), F.lit("aaa"), F.to_date("t"))).first()[0] == "metrics_aaa_2024"
    with pytest.raises(Exception, match="a store name needs"):
        df.select(ids.store_name(F.lit("metrics"), F.lit(""), F.to_date("t"))).collect()
    assert df.select(ids.canonical_pid(F.lit(""), F.lit(None).cast("string"), F.lit(""))).first()[0] == ""


LINES = [
    '1.2.3.4 - - [15/Mar/2023:14:30:45 -0300] "GET /a?b=1 HTTP/1.1" 200 512 "-" "Mozilla/5.0 (X11) AppleWebKit/537 Chrome/120.0 Safari/537"',
    '1.2.3.4 - u [15/Mar/2023:14:30:46 -0300] "GET /b HTTP/1.1" 404 - "-" "curl/8.1"',
    '1.2.3.4 - - [15/Foo/2023:14:30:45 -0300] "GET /c HTTP/1.1" 200 1 "-" "-"',
    "garbage",
    "",
    '::1 - - [01/Jan/2024:00:00:00 +0000] "POST /d HTTP/1.1" 302 0',
]


def test_log_lines(spark):
    got = loglines.parse(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    assert [r.reject_reason for r in got] == [None, "STA", "TIM", "LIN", "LIN", None]
    assert got[0].local_datetime == dt.datetime(2023, 3, 15, 14, 30, 45) and (got[0].client_name, got[0].client_version) == ("Chrome", "120.0")
    assert got[1].client_name == "curl" and got[2].client_name is None and got[5].user_agent is None and got[5].ip_address == "::1"

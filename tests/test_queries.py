import pytest
from oracle import TABLES, assert_same, connect

from tallyforge import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, connection, name):
    assert_same(queries.QUERIES[name](spark, SF), connection, queries.ORACLE_SQL[name])


def test_entry_imports_without_the_optional_folders():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def many(connection, tmp_path_factory):
    """Tables with more users than 256 x 256, more orders than a sort's sample holds, and some thousands of suppliers."""
    at = tmp_path_factory.mktemp("many")
    more = {"orders": ("o_orderkey", 1500), "customer": ("c_custkey", 150), "supplier": ("s_suppkey", 10)}
    for t in TABLES:
        key, n = more.get(t, ("", 0))
        rows = f"SELECT {t}.* REPLACE ({key} + i * {n} AS {key}) FROM {t}, range(200) r(i)" if key else f"SELECT * FROM {t}"
        rows = "SELECT * REPLACE (user_id * 60000 + event_id AS user_id) FROM events" if t == "events" else rows
        connection.execute(f"COPY ({rows}) TO '{at}/{t}.parquet' (FORMAT parquet)")
    return str(at), connect(str(at))


@pytest.mark.parametrize("name", ["ip_countries", "ipv6_countries", "ip_range_files", "journal_dumps", "orderings"])
def test_query_matches_sql_on_more_keys(spark, many, name):
    assert_same(queries.QUERIES[name](spark, many[0]), many[1], queries.ORACLE_SQL[name])


def test_places_follow_one_run_of_the_sort(spark, many):
    """A sort that samples few rows and deals them otherwise each time it runs gives the same places."""
    settings = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "3", "spark.sql.exchange.reuse": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        assert_same(queries.QUERIES["orderings"](spark, many[0]), many[1], queries.ORACLE_SQL["orderings"])
    finally:
        for name in settings:
            spark.conf.unset(name)

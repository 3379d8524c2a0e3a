"""Ranges, pages, searches and gets against plain Python, and what they read."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import filters, grams, ordered, ranges, store


def test_ranges_of_every_kind(spark):
    rng = random.Random(5)
    top4, top6 = 2**32 - 1, 2**128 - 1

    def some(top, n):
        out = [(0, top, "all"), (7, 7, "one"), (9, 3, "reversed")]
        for i in range(n):
            start = rng.choice([rng.randrange(top), rng.randrange(4000)])
            out.append((start, min(top, start + rng.choice([0, 5, 300, 70000, top // 3, 2**64])), rng.choice([f"c{i % 7}", None])))
        return out

    v4, v6 = some(top4, 300), some(top6, 300)
    points = [("4", p) for s, e, _ in v4 for p in (s, e, e + 1) if 0 <= p <= top4] + [("6", p) for s, e, _ in v6 for p in (s, e, s - 1) if 0 <= p <= top6]
    points += [("4", rng.randrange(4000)) for _ in range(300)] + [("6", rng.randrange(4000)) for _ in range(300)]

    def text(kind, n):
        return str(ipaddress.IPv4Address(n)) if kind == "4" else rng.choice([str, lambda a: a.exploded.upper()])(ipaddress.IPv6Address(n))

    def best(kind, n):
        held = [(e - s, s, c is not None, c or "") for s, e, c in (v4 if kind == "4" else v6) if s <= n <= e]
        return (min(held)[3] or None) if held else None

    asked = {text(*p): best(*p) for p in set(points)}
    rows = spark.createDataFrame([(x,) for x in [*asked, *asked, "no:address", "", None]], "ip string")
    known6 = [(str(ipaddress.IPv6Address(s)), str(ipaddress.IPv6Address(e)), c) for s, e, c in v6]
    out = ranges.ip_country(rows, spark.createDataFrame(v4, "start long, end long, country string"), "ip", spark.createDataFrame(known6, "start string, end string, country string"))
    got = out.collect()
    assert len(got) == 2 * len(asked) + 3
    assert {r.ip: r.country_code for r in got} == asked | {"no:address": None, "": None, None: None}


def test_no_ranges_and_no_rows(spark):
    none = spark.createDataFrame([], "start long, end long, country string")
    rows = spark.createDataFrame([("10.0.0.1", "XX")], "ip_address string, country_code string")
    assert [r.country_code for r in ranges.ip_country(rows, none).collect()] == [None]
    assert ranges.ip_country(rows.limit(0), none).collect() == []


ORDERS = [{"a": "asc", "b": "desc", "id": "asc"}, {"a": "desc", "b": "asc", "id": "desc"}, {"id": "asc"}]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 2, 2]), rng.choice([None, 0.5, float("nan"), 7.0]), i) for i in range(500)] + [(None, None, None)]
    at = str(tmp_path_factory.mktemp("tied") / "t")
    spark.createDataFrame(rows, "a int, b double, id int").repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.mark.parametrize("order", ORDERS)
def test_pages_are_those_of_offset_and_limit(tied, order):
    whole = [r.id for r in tied.orderBy(*ordered.sort_keys(order)).collect()]
    pages = ordered.Pages(tied, order, cells=8)
    assert pages.rows == 501 and len(pages.bounds) == 7
    for number in (1, 2, 5, 8, 9, 50):
        assert [r.id for r in pages.page(number, 60).collect()] == whole[(number - 1) * 60 : number * 60]
    row = pages.page(1, 60).collect()[-1]
    for at in range(60, 540, 120):
        got = ordered.page_after(tied, order, row, 120).collect()
        assert [r.id for r in got] == whole[at : at + 120]
        row = got[-1] if got else row


def test_pages_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([], "a int, id int")
    assert ordered.Pages(none, {"a": "asc"}).page(1).collect() == []
    same = spark.createDataFrame([(1, 1)] * 20, "a int, id int")
    assert ordered.Pages(same, {"a": "desc"}).page(2, 15).count() == 5


def scanned(df):
    """Rows that the scans of ``df`` gave."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        elif name == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


def test_a_deep_page_reads_its_part(spark, tmp_path):
    spark.range(20000).withColumn("v", F.repeat(F.lit("x"), 50)).sort("id").write.option("parquet.block.size", 20000).parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    pages = ordered.Pages(rows, {"id": "asc"})
    assert [r.id for r in pages.page(190, 100).collect()] == list(range(18900, 19000))
    assert 0 < scanned(pages.page(190, 100)) < 4000
    assert "rangepartitioning" not in pages.page(190, 100)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("named", [False, True])
def test_get_reads_its_share_of_the_row_groups(spark, tmp_path, named):
    target = store.MetricStore(spark, str(tmp_path / "m"), "id string, collection string, date date, total_requests long", row_group_bytes=30000)
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 40).cast("int"))
    name = F.concat(F.lit("x|||||"), F.sha2(F.col("id").cast("string"), 256), F.lit("||"), day.cast("string"))
    docs = spark.range(40000).select(name.alias("id"), F.lit("x").alias("collection"), day.alias("date"), F.col("id").alias("total_requests"))
    target.put(docs.union(docs.limit(1).select(F.lit("y").alias("id"), F.lit(None).cast("string"), F.lit(None).cast("date"), F.lit(-1).cast("long"))))
    few = docs.where("total_requests % 1600 = 3").select("id")
    got = target.get(few.union(few).union(spark.createDataFrame([("none",), (None,)] if not named else [(None,)], "id string")), named)
    assert sorted(r.total_requests for r in got.collect()) == list(range(3, 40000, 1600))
    assert 0 < scanned(got) < 15000
    assert [r.total_requests for r in target.get(spark.createDataFrame([("y",)], "id string"), named).collect()] == [-1]
    assert target.get(few.limit(0)).count() == 0
    target.LISTED = 10
    assert target.get(few, named).count() == 25


def test_searches_are_those_of_the_scan(spark, tmp_path):
    texts = ["The Cat sat", "concatenate", "ca", "", None, "tca atc", "ÇÃO ção 🎉🎉🎉", "İstanbul", "x" * 5000 + "cat", "the the cat sat"]
    df = spark.createDataFrame([(i, x, [x or "", "Tag"]) for i, x in enumerate(texts)] + [(None, "a cat", [])], "id int, t string, l array<string>")
    index = grams.GramIndex(spark, str(tmp_path / "i"), "id", ["t", "l"])
    index.add(df.where("id < 4"), "one")
    for _ in range(2):
        index.add(df.where("id >= 4 or id is null"), "two")
    index.add(df.limit(0), "nothing")
    for query in ("cat", "THE CAT SAT", "ção 🎉🎉🎉", "🎉🎉🎉", "ca", "", "zzz", "catzzz", "tag", "i̇st", "atenate", "xxxcat"):
        assert sorted(map(str, index.search(df, query).collect())) == sorted(map(str, filters.search(df, query, ["t", "l"]).collect())), query
    assert index.candidates("ca") is None and index.candidates("concat").count() == 1


def test_lists_of_runs_are_those_of_every_text(monkeypatch):
    """Odd and long texts, cut into runs and parts of every length, have the pieces of plain Python; ids of one run are rising."""
    import pyarrow as pa

    rng = random.Random(9)
    texts = [["".join(rng.choice("ab\U0001f389\u00e7\u0000") for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 60]))) for _ in range(rng.choice([0, 1, 2, 3]))] for _ in range(200)]
    ids = [{"a": i // 3, "b": None if i % 7 == 0 else str(i)} for i in range(len(texts))]
    wanted = {(t[i : i + 3], str(key)) for key, several in zip(ids, texts) for t in several for i in range(len(t) - 2)}
    for letters in (1, 2, 5, 64, 1 << 20):
        monkeypatch.setattr(grams, "LETTERS", letters)
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 70]), pa.array(texts[i : i + 70], pa.list_(pa.string()))], names=["id", "texts"]) for i in range(0, 200, 70)]
        rows = [r for b in grams._lists(iter(batches)) for r in b.to_pylist()]
        assert {(r["piece"], str(key)) for r in rows for key in r["ids"]} == wanted, letters
    assert all(len(r["ids"]) == len({str(key) for key in r["ids"]}) for r in rows)


def test_pieces_are_not_moved_to_be_indexed(spark, tmp_path):
    """A file of one row group is dealt to all tasks as rows; the index keeps far fewer rows than there are pieces of texts."""
    at = str(tmp_path / "t")
    texts = spark.range(4000).select("id", F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(i)).cast("string"), 512) for i in range(3)]).alias("t"))
    texts.coalesce(1).write.parquet(at)
    index = grams.GramIndex(spark, str(tmp_path / "i"), "id", ["t"])
    index.add(spark.read.parquet(at), "all")
    lists = spark.read.parquet(f"{index.path}/lists")
    pieces = lists.selectExpr("sum(size(ids))").first()[0]
    assert pieces > 1_000_000 and lists.count() * 20 < pieces
    sizes = spark.read.parquet(f"{index.path}/sizes")
    assert sizes.selectExpr("sum(n)").first()[0] == pieces and sizes.count() == lists.select("piece").distinct().count()
    for part in lists.select(F.input_file_name()).distinct().collect():
        own = [r.piece for r in spark.read.parquet(part[0]).select("piece").collect()]
        assert own == sorted(own)


def test_a_line_of_pieces_is_that_of_every_point():
    """Random ranges of random ranks, one after the other, equal brute force; what can no longer count is not held."""
    import random

    import pyarrow as pa

    some = random.Random(5)
    for n in (0, 1, 3, 40, 300):
        rows = [(c, f"{a:03d}", f"{min(a + some.randrange(some.choice((2, 30, 200))), 99):03d}", f"{some.randrange(1000):04d}") for c in (1, 2) for a in (some.randrange(100) for _ in range(n))]
        rows = sorted((*r, r[3][-1] if r[3] > "0100" else None) for r in rows)
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7])], names=["cell", "key", "until", "rank", "value"]) for i in range(0, len(rows), 7)]
        pieces = [tuple(r.values()) for b in ranges._flatten(iter(batches)) for r in b.to_pylist()]
        assert pieces == sorted(pieces, key=lambda r: r[:3])
        for c in (1, 2):
            for k in (f"{x:03d}" for x in range(100)):
                holding = min(((r[3], r[4]) for r in rows if r[0] == c and r[1] <= k <= r[2]), default=(None, None), key=lambda r: r[0])
                assert next((p[3] for p in reversed(pieces) if p[0] == c and p[1:3] < (k, ranges.POINT)), None) == holding[1]


def test_ranges_that_cannot_count_are_not_held():
    """A hundred thousand ranges that all end at one place, each narrower than the one before: few bytes, whatever their number."""
    import tracemalloc

    import pyarrow as pa

    def batches(n):
        for i in range(0, n, 1000):
            keys = [f"{k:08d}" for k in range(i, i + 1000)]
            yield pa.RecordBatch.from_arrays([pa.array([0] * 1000), pa.array(keys), pa.array(["09999999"] * 1000), pa.array([f"{10**8 - int(k):09d}" for k in keys]), pa.array(["v"] * 1000)], names=["cell", "key", "until", "rank", "value"])

    tracemalloc.start()
    assert [r["value"] for b in ranges._flatten(batches(100_000)) for r in b.to_pylist()] == ["v", None]
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()

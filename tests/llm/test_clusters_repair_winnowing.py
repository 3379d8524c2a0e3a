"""Centroid clustering, conversation repair and winnowing against brute force and their SQL on odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from oracle import assert_same

from tallyforge.llm import centroids, repair, winnowing

NAN, INF = float("nan"), float("inf")


def in_duckdb(tmp_path, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    return c


# centroid clustering


def blobs(n=400, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(16, dim))
    return (middles[rng.integers(0, 16, n)] + 0.05 * rng.normal(size=(n, dim))).astype(np.float32).tolist()


def test_odd_vectors_match_sql(spark, tmp_path):
    rows = [(i, v, 7) for i, v in enumerate(blobs(60))]
    some = rows[0][1]
    rows += [(0, some, 7), (0, some, 7), (None, some, 7), (101, None, 7), (102, some[:63], 7), (103, [None, *some[1:]], 7), (104, [NAN, *some[1:]], 7), (105, [INF, *some[1:]], 7), (106, [0.0] * 64, 7), (107, [-1e-9] * 64, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int")
    assert_same(centroids.report(df), in_duckdb(tmp_path, embeddings=df), centroids.sql())
    few = spark.createDataFrame(rows[:5] + [(200 + i, [3e38] * 64, 7) for i in range(2)], df.schema)
    got = centroids.report(few).collect()
    assert len(got) == 7 and len({r.cluster for r in got}) == 6 and {r.inertia for r in got} == {0}
    assert centroids.report(df.limit(0)).collect() == []


def test_bounds_save_work_and_lose_nothing(spark):
    x = np.floor(64 * np.array(blobs(), np.float64)).astype(np.int64)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, x array<int>").repartition(3)
    states, history = centroids.cluster(vectors, 16, 6)
    got = {r.vec_id: r for r in states.collect()}
    for now, after in itertools.pairwise(history):
        nearest = ((x[:, None] - now) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(16):
            assert after[k].tolist() == ((x[nearest == k].sum(axis=0) // (nearest == k).sum()).tolist() if (nearest == k).any() else now[k].tolist())
    d = ((x[:, None] - history[-1]) ** 2).sum(axis=2)
    assert [got[i].cluster for i in range(len(x))] == d.argmin(axis=1).tolist() and [got[i].distance for i in range(len(x))] == d.min(axis=1).tolist()
    assert sum(r.evaluated for r in got.values()) < 0.5 * 7 * 16 * len(x)


def test_bounds_are_loosened_by_the_total_displacement():
    there_and_back = np.array([[[0]], [[50]], [[1]]])
    assert centroids.displacements(there_and_back)[0, 0] == pytest.approx(1, rel=1e-6)


# conversation repair


def edits_of(symbols):
    """(cost, audit) of the cheapest edits, all of them tried."""
    best = None
    slots = ["", "I", "II"]
    for letters in itertools.product("KRD", repeat=len(symbols)):
        if any(x in "bd" and e != "D" for x, e in zip(symbols, letters)):
            continue
        for more in itertools.product(slots, repeat=len(symbols) + 1):
            audit = more[0] + "".join(e + i for e, i in zip(letters, more[1:]))
            cost = sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (x.isupper() and e != "D") for x, e in zip(symbols, letters)) + 5 * sum(map(len, more))
            if best is not None and (cost, audit) >= best:
                continue
            own = iter(zip(symbols, letters))
            options = [""]
            for e in audit:
                x, e = (None, e) if e == "I" else next(own)
                roles = ["u", "a"] if e in "IR" else [x.lower()] if e == "K" else [""]
                options = [o + r for o in options for r in roles]
            if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                best = cost, audit
    return best


def test_cheapest_edits_by_trying_all():
    matrices, rng = repair.rule_matrices([]), random.Random(2)
    for n in range(5):
        for _ in range(12):
            symbols = "".join(rng.choices("bdsuaoSUAO", k=n))
            assert repair.cheapest(iter(symbols), matrices) == edits_of(symbols), symbols


def test_rules_change_no_result():
    rng = random.Random(4)
    rules = ["ua", chr(repair.FIRST_RULE) * 2, "Ab", "oS", chr(repair.FIRST_RULE + 1) + "d", "bb"]
    matrices = repair.rule_matrices(rules)
    for n in (1, 7, 300, 3000):
        raw = "".join(rng.choices(["ua", "uaua", "Ab", "oS", "d", "bb", "s", "U"], k=n))
        short = raw
        for i, pair in enumerate(rules):
            short = short.replace(pair, chr(repair.FIRST_RULE + i))
        assert len(short) < len(raw) or n == 1
        assert repair.cheapest(iter(short), matrices) == repair.cheapest(iter(raw), matrices)


def test_ropes_compare_as_their_texts():
    rng = random.Random(6)
    parts = [repair.Rope("".join(rng.choices("DIKR", k=50))) for _ in range(3)]
    ropes = [a + b + c + repair.Rope(x) for a in parts for b in parts for c in parts for x in "DK"]
    assert list(map(str, sorted(ropes))) == sorted(map(str, ropes))


def odd_turns(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "S."), ("user", "q?"), ("assistant", "a."), ("user", "q?"), ("assistant", ""), ("tool", "x.")])]
    rows += [(2, None, None, None), (2, None, "user", "A?"), (2, 7, "", "B."), (2, 3, "assistant", "C  "), (3, None, "user", "only."), (None, 1, "user", "no id."), (None, None, "assistant", "none."), (None, 1, "user", "no id.")]
    rows += [(4, 5, "assistant", "same."), (4, 5, "assistant", "same."), (4, 5, "user", "　.\n\t "), (4, 5, "user", "　.\n\t b"), (5, 1, "user", "long " * 100_000), (6, 2**40, "user", "far."), (6, -(2**40), "ass", "far!\x0b")]
    rows += [(10 + c, t, "user" if t % 2 else "assistant", f"{c} {t}.") for c in range(30) for t in range(c % 7)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, raw string, kind int").repartition(3)


def test_odd_conversations_match_sql(spark, tmp_path):
    turns = odd_turns(spark)
    assert_same(repair.report(turns), in_duckdb(tmp_path, conversations=turns), repair.SQL)
    assert repair.report(turns.limit(0)).collect() == []
    gone = spark.createDataFrame([(99,)], "conv_id long")
    (row,) = [r for r in repair.repair(turns, gone).collect() if r.conv_id == 99]
    assert row[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_very_long_conversation_is_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 4)
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice([f"{t}.", f"{t}", "again.", ""])) for t in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    ordered = repair.in_order(turns)
    blocks = repair.symbol_blocks(ordered)
    assert blocks.count() > 40 and 0 < len(repair.grammar(blocks)) <= repair.ROUNDS * repair.PAIRS
    (row,) = repair.repair(turns).collect()
    seen, raw = set(), ""
    for _, _, role, text in rows:
        symbol = role[0] if role[0] in "sua" else "o"
        raw += "b" if not text else "d" if (role, text) in seen else symbol if text.endswith(".") else symbol.upper()
        seen.add((role, text))
    assert (row.cost, row.audit) == repair.cheapest(iter(raw), repair.rule_matrices([]))


# winnowing


def slow_winnow(text, k=winnowing.K, window=winnowing.WINDOW):
    points, base, full = [ord(c) + 1 for c in text], 0x9E3779B97F4A7C15, 2**64
    k = min(k, len(points))
    hashes = []
    for i in range(len(points) - k + 1 if points else 0):
        h = 0
        for p in points[i : i + k]:
            h = (h * base + p) % full
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % full
        hashes.append(h ^ h >> 29)
    chosen = set()
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        some = hashes[i : i + window]
        chosen.add(i + max(j for j, h in enumerate(some) if h == min(some)))
    return [(hashes[p], p) for p in sorted(chosen)]


TEXTS = ["", "a", "short text", "z" * 500, "ab" * 300, "Wörter und 文字 \U0001f600 " * 40, " ".join(map(str, range(400)))]


@pytest.mark.parametrize("chunk", [1 << 20, 100])
def test_chosen_hashes_match_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(winnowing, "CHUNK", chunk)
    for text in TEXTS:
        hashes, places = winnowing.winnow(winnowing.code_points(text))
        assert list(zip(hashes.tolist(), places.tolist())) == slow_winnow(text)


def test_a_common_passage_is_always_found():
    rng = random.Random(1)
    words = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    for _ in range(50):
        passage = words(winnowing.K + winnowing.WINDOW - 1)
        a, b = (words(rng.randrange(300)) + passage + words(rng.randrange(300)) for _ in range(2))
        at = [t.index(passage) for t in (a, b)]
        found = [{(h, p - s) for h, p in zip(*(x.tolist() for x in winnowing.winnow(winnowing.code_points(t)))) if s <= p <= s + len(passage) - winnowing.K} for t, s in zip((a, b), at)]
        assert found[0] & found[1]


def slow_rows(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).hexdigest()))
    out = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        sets = [{h for h, _ in slow_winnow(x)} for x in (t, edited, following)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        prints = [",".join(f"{p}:{h:016x}" for h, p in slow_winnow(x)) for x in (t, edited)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, *near))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_neighbours_match_brute_force(spark, parts):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abcd efgh", k=rng.randrange(400)))) for i in range(40)] + list(enumerate(TEXTS, 100))
    rows += [(5, "again"), (5, "again"), (None, "no identifier"), (None, None), (200, None), (-3, "below zero")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, part int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(map(tuple, winnowing.report(docs).collect()), key=repr) == slow_rows(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_documents_and_long_ones(spark):
    schema = "doc_id long, text string"
    assert winnowing.report(spark.createDataFrame([], schema)).collect() == []
    assert sorted(map(tuple, winnowing.report(spark.createDataFrame([(1, "alone " * 30)], schema)).collect())) == slow_rows([(1, "alone " * 30)])
    (row,) = winnowing.report(spark.createDataFrame([(1, "long text of many words " * 120_000)], schema)).collect()
    assert row.n_chars == 2_880_000 and row.near_next == 1
    places = winnowing.fingerprints(spark.createDataFrame([(1, TEXTS[5]), (2, None)], schema)).collect()
    assert [(r.hash % 2**64, r.place) for r in sorted(places, key=lambda r: r.place)] == slow_winnow(TEXTS[5])

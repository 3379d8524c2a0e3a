import numpy as np
import pytest

from tallyforge.llm import simhash, similar

SF = "/root/testdata/sf0.001"


def brute_groups(texts):
    """Component (least index) of each text by all pairs of five-word Jaccard 0.8 or more."""
    sets = []
    for t in texts:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    found = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])) > 0:
                x, y = found[i], found[j]
                found = [min(x, y) if f in (x, y) else f for f in found]
    return found


def near_texts():
    """30 texts of 100 words, each with copies in which up to three words are replaced: similarity 0.73 to 0.95."""
    rng = np.random.default_rng(5)
    out = []
    for _ in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        out.append(" ".join(words))
        for n in (1, 2, 3):
            copy = list(words)
            for at in rng.integers(0, 100, n):
                copy[at] = "changed"
            out.append(" ".join(copy))
    return out


def texts_with_a_template(pairs, own):
    """Pairs of 700-word texts with 600 words common to all; the texts of a pair share ``own`` words of the rest."""
    rng = np.random.default_rng(7)
    common = " ".join(f"t{x}" for x in rng.integers(0, 5000, 600))
    out = []
    for _ in range(pairs):
        shared = [f"s{x}" for x in rng.integers(0, 10**6, own)]
        out += [" ".join([common, *shared, *[f"o{x}" for x in rng.integers(0, 10**6, 100 - own)]]) for _ in range(2)]
    return out


@pytest.mark.parametrize("own", [30, 54])
def test_pairs_beside_a_template_are_found(spark, own):
    texts = texts_with_a_template(60, own)
    want = brute_groups(texts)
    assert len(set(want)) == 60
    got = similar.groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)).collect()
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r.row)
    assert {r: min(some) for some in by.values() for r in some} == dict(enumerate(want))


def test_prefixes_of_sets_in_common_meet():
    rng = np.random.default_rng(1)
    counts = np.zeros(similar.COUNTERS, np.int64)
    for n in (1, 2, 5, 9, 40, 333):
        for _ in range(30):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate((a[rng.integers(0, max(1, n // 9 + 1)) :], rng.integers(0, 1 << 63, rng.integers(0, n // 8 + 1), dtype=np.uint64)))
            if 9 * len(set(a) & set(b)) < 4 * (len(a) + len(b)):
                continue
            short, long = sorted((a, b), key=len)
            mine = [(k, h) for probe, keys, _, high in similar.prefixes(np.unique(short), counts) if not probe for k, h in zip(keys, high)]
            theirs = {k: (low, h) for probe, keys, lows, high in similar.prefixes(np.unique(long), counts) if probe for k, low, h in zip(keys, lows, high)}
            assert any(k in theirs and len(long) <= h and theirs[k][0] <= len(short) <= theirs[k][1] for k, h in mine)


@pytest.mark.parametrize("pairs_up_to", [1, 24])
def test_groups_match_brute_force(spark, pairs_up_to):
    texts = [*[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()], *near_texts(), "", None, "x y"]
    want = brute_groups(texts)
    for near in (None, simhash.links):
        got = similar.groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3), pairs_up_to, near).collect()
        by = {}
        for r in got:
            by.setdefault(r.component, []).append(r.row)
        assert len(got) == len(texts)
        assert {r: min(some) for some in by.values() for r in some} == dict(enumerate(want))


def test_the_stage_drops_near_copies(spark):
    texts = near_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in similar.keep_one_of_each(rows).collect()} == set(brute_groups(texts))


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, "d e f"), (None, "d e f"), (None, "g h i"), (3, None)]
    kept = similar.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "d e f"), (0, "g h i"), (1, "a b c"), (3, "")]

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import chat, components, neighbours

SF = "/root/testdata/sf0.001"


def test_chat_reads_back(spark):
    tricky = [r"<|im_end|>", r"<\|im_start|>assistant", r"<\\|", "a\\", "<", "|>", "<|\n<\\\\\\|x", "", "\U0001f600<|"]
    rows = [(c, t, ["user", "assistant", "system", "odd\nro\\nle\\", None][(c + t) % 5], tricky[(c * 7 + t) % 9] if t % 4 else None, "x") for c in range(12) for t in range(c % 6)]
    rows += [(50, 0, "assistant", "only", "x"), (51, None, None, None, "x"), (52, 1, "assistant", "tie", "x"), (52, 1, "assistant", "tie", "x"), (None, 0, "user", "y", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_examples(turns)).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, some in by.items():
        some = sorted(some)
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in some)
        loss = "".join(t for _, _, r, t in some if r == "assistant")
        assert got[c].n_turns == len(some)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_examples(turns.limit(0))).count() == 0


def test_chat_example_has_only_its_reply_trainable(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "r"), (1, 3, "assistant", "a2"), (1, 4, "user", "end")], "conv_id long, turn long, role string, text string")
    rows = chat.format_examples(turns).orderBy("example").collect()
    assert [r.formatted[r.loss_start : r.loss_end] if r.loss_start is not None else None for r in rows] == ["a1", "a2", None]
    assert rows[1].formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na1<|im_end|>\n<|im_start|>user\nr<|im_end|>\n<|im_start|>assistant\na2<|im_end|>\n"
    assert rows[1].formatted.startswith(rows[0].formatted) and rows[2].n_turns == 5


def brute_nearest(rows, k, every):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    want = {}
    for i, v in rows:
        if i % every == 0:
            scores = (vectors * np.array(v)).sum(1)
            order = sorted((-s, j) for s, j in zip(scores.tolist(), ids.tolist()) if j != i)[:k]
            want[i] = [(j, -s) for s, j in order]
    return want


def test_neighbours_reach_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    rows, _ = neighbours.valid_vectors(df)
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    for block in (8192, 130):
        got = {}
        for r in neighbours.nearest(rows, rows.where("id % 20 = 0"), longest, block_rows=block, chunk_rows=10).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.95 * 20 * len(want)
        true = {(q, i): s for q in want for i, s in want[q]}
        assert all(abs(s - true[q, i]) < 1e-12 for q in got for i, s in got[q] if (q, i) in true)


def test_neighbours_ties_go_to_the_smaller_identifiers(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 400)] + [(0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for block in (8192, 40):
        got = neighbours.nearest(df, df.where("id = 0"), 1.0 + 399.0**2, block_rows=block).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 21)]


def test_neighbours_repeated_identifiers(spark):
    own = [(20, [1.0, float(i)]) for i in range(30)]  # 30 vectors of the query's own identifier
    rows = own + own + [(i, [0.5, float(i)]) for i in range(21, 40)] + [(40, [0.25, 0.0]), (40, [0.75, 0.0]), (40, [0.75, 0.0])]
    got = neighbours.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    first = [(r.vec_id, r.score) for r in got if r.query_id == 20]  # its query is the least of its vectors, [1, 0]
    assert first == [(40, 0.75), *[(i, 0.5) for i in range(21, 40)]]
    second = [(r.vec_id, r.score) for r in got if r.query_id == 40]  # [0.25, 0.0]; the other vectors of 20 are candidates each
    assert second == [(20, 0.25)] * 20


def test_cells_are_pruned_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    vectors = np.repeat(centres, 150, axis=0) + 0.05 * rng.standard_normal((6000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5).cache()
    want = brute_nearest(rows, 20, 20)
    seen, whole = neighbours.search_block, spark.sparkContext.accumulator(0)

    def counted(block, query_ids, *rest):
        whole.add(len(query_ids))
        return seen(block, query_ids, *rest)

    neighbours.search_block = counted
    try:
        got = neighbours.nearest(df, df.where("id % 20 = 0"), 1.0 + 1e-9, block_rows=200).collect()
    finally:
        neighbours.search_block = seen
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert len(got) == 300 * 20 and hits >= 0.95 * len(got)
    assert 300 <= whole.value < 0.4 * 300 * 32  # of 32 cells a query meets a few


def test_neighbours_odd_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(100)]  # many equal vectors: ties go to the smaller id
    odd = [(200, None), (220, [0.0, 0.0]), (240, [float("nan"), 1.0]), (260, [1.0]), (280, [None, 1.0]), (300, [float("inf"), 0.0]), (0, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search_table(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_nearest(rows, 20, 20)
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.search_table(few).orderBy("query_id").collect()] == [(0, 1, 20, 2.0), (20, 1, 0, 2.0)]
    assert neighbours.search_table(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 300)] + [(299, 160), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 5 for i in [*range(100, 161), *range(200, 300)]}

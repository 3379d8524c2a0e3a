"""Approximate nearest neighbours by inner product, over low-dimensional stable projections.

Vectors get one more component that gives all the same length, so that the largest inner product is the smallest
Euclidean distance. The top of one kd-tree over 8 Gaussian projections, fitted on a bounded sample (SAMPLE rows, at most
CELLS cells), deals all vectors into cells; a cell is split by hash into blocks of bounded size, each with its own
kd-tree. The squared ratio of projected to true distance is chi-square with 8 degrees of freedom: a vector nearer than the
best k so far lies within a projected distance that is known with probability ``found``. So a query first walks a block of
its nearest cell, carries the distance of its k-th candidate, and goes on only to cells whose projected box lies within
that distance. In a block it walks the leaves by projected distance, verifies their vectors exactly, and stops by the same
test. Queries of a batch travel to a block together; more than that are dealt out as a skewed join.

Defined results: vectors that are null, zero, of another dimension than most vectors (of equally many, the larger), or
hold a null or non-finite component take no part, as query or candidate; rows equal in identifier and vector count once;
rows of one identifier with other vectors are candidates each, and its query is the least of its vectors; a query excludes
all rows of its own identifier; of vectors that are equal in a block, those with the k + 1 smallest identifiers are kept,
which no result can miss; all candidates tied with the k-th are ordered by identifier, however many; fewer candidates than
k give fewer rows; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import spool

PROJECTIONS, LEAF, SEED = 8, 256, 11
#: Most cells, and rows that their tree is fitted on (twice as many at most reach the driver, with their 8 projections).
CELLS, SAMPLE = 4096, 1 << 16
#: Relative rounding of a product of long vectors.
ROUNDING = 1e-12


def chi_square_quantile(p: float, degrees: int = PROJECTIONS) -> float:
    """For an even number of degrees of freedom, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
        low, high = (x, high) if below < p else (low, x)
    return high


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``id, v`` (array of double) of the vectors that take part, and their dimension."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = most[0] if most else 0
    return rows.where(F.size("v") == dimension), dimension


def projection(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimension + 1, PROJECTIONS))


def kd_order(points: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of the points by leaf, and the first place of each leaf: halved along the widest side down to LEAF points."""
    order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            starts.append(a)
            continue
        own = points[order[a:b]]
        axis = int((own.max(0) - own.min(0)).argmax())
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
        todo += [(a, a + half), (a + half, b)]
    return order, sorted(starts)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _points(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest - (vectors**2).sum(1), 0))
    return np.column_stack([vectors, rest]) @ projection(vectors.shape[1])


def fit_cells(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of each inner node of a tree with 2 ** depth leaves, in the order of a heap."""
    axes, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    of = np.zeros(len(sample), np.int64)
    for node in range(len(axes)):
        own = sample[of == node]
        if len(own):
            axes[node] = (own.max(0) - own.min(0)).argmax()
            cuts[node] = np.median(own[:, axes[node]])
        of = np.where(of == node, 2 * node + 1 + (sample[:, axes[node]] > cuts[node]), of)
    return axes, cuts


def cell_of(points: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range((len(axes) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > cuts[node])
    return node - len(axes)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes): least squared projected distance."""
    out = np.zeros((len(points), len(low)))
    for d in range(PROJECTIONS):
        p = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0) ** 2
    return out


def build_block(ids: np.ndarray, vectors: np.ndarray, longest: float, k: int) -> dict[str, bytes]:
    """A block's distinct vectors in kd-tree order with the smallest identifiers of each."""
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    by = np.lexsort((ids, of.ravel()))
    ids, of = ids[by], of.ravel()[by]
    fresh = np.concatenate(([True], (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])))
    ids, of = ids[fresh], of[fresh]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    ids, of = ids[place <= k], of[place <= k]
    points = _points(distinct, longest)
    order, starts = kd_order(points)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort((ids, rank[of]))
    ids, of = ids[by], rank[of][by]
    points = points[order]
    return {
        "ids": ids.tobytes(), "firsts": np.searchsorted(of, np.arange(len(order) + 1)).tobytes(), "vectors": distinct[order].tobytes(),
        "starts": np.array(starts).tobytes(), "low": np.minimum.reduceat(points, starts).tobytes(), "high": np.maximum.reduceat(points, starts).tobytes(),
    }


def search_block(block: dict, query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, longest: float, k: int, found: float):
    """(place of the query, candidate, score) of the k nearest of each query in this block, the nearest first.

    ``known``: the k-th score that each query has found elsewhere; what is below is of no use.
    """
    dimension = queries.shape[1]
    ids, firsts = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["firsts"], np.int64)
    vectors = np.frombuffer(block["vectors"]).reshape(-1, dimension)
    starts = np.append(np.frombuffer(block["starts"], np.int64), len(vectors))
    bounds = box_distances(queries @ projection(dimension)[:-1], *(np.frombuffer(block[c]).reshape(-1, PROJECTIONS) for c in ("low", "high")))
    turn = np.argsort(bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, turn, axis=1)
    limit, lengths = chi_square_quantile(found), (queries**2).sum(1) + longest
    alone, only = firsts[1:] - firsts[:-1] == 1, ids[firsts[:-1]]  # vectors of one identifier, which may be the query's own
    best, kth, slack = np.full((len(queries), k), -np.inf), known.copy(), ROUNDING * lengths
    active, candidates = np.arange(len(queries)), []
    for r in range(len(starts) - 1):
        beyond = bounds[active, r] > limit * np.maximum(lengths[active] - 2 * kth[active], 0)
        active = active[~beyond]
        leaves = turn[active, r]
        for leaf in np.unique(leaves):
            q = active[leaves == leaf]
            a, b = starts[leaf], starts[leaf + 1]
            score = queries[q] @ vectors[a:b].T
            score[alone[a:b] & (only[a:b] == query_ids[q, None])] = -np.inf
            best[q] = np.partition(np.concatenate([best[q], score], axis=1), -k, axis=1)[:, -k:]
            kth[q] = np.maximum(kth[q], best[q].min(axis=1))
            row, column = np.nonzero((score >= (kth[q] - slack[q])[:, None]) & (score > -np.inf))
            candidates.append((q[row], column + a, score[row, column]))
    q, m, score = (np.concatenate(x) for x in zip(*candidates)) if candidates else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    near = score >= kth[q] - slack[q]
    q, m = q[near], m[near]
    exact = np.concatenate([(vectors[m[i : i + 50_000]] * queries[q[i : i + 50_000]]).sum(axis=1) for i in range(0, len(m), 50_000)] or [np.zeros(0)])
    each = firsts[m + 1] - firsts[m]
    place = np.repeat(firsts[m] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum()) if len(m) else m
    q, exact, candidate = np.repeat(q, each), np.repeat(exact, each), ids[place]
    other = candidate != query_ids[q]
    q, exact, candidate = q[other], exact[other], candidate[other]
    by = np.lexsort((candidate, -exact, q))
    q, exact, candidate = q[by], exact[by], candidate[by]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], candidate[first], exact[first]


def nearest(vectors: DataFrame, queries: DataFrame, longest: float, k: int = 20, found: float = 0.97, block_rows: int | None = None, chunk_rows: int = 2048, cells: int = CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` among ``vectors`` (both ``id, v`` of one dimension; query ids distinct).

    ``longest``: the largest squared length. ``block_rows``: by default 8192, fewer if they are above 16 MB. Every vector is
    indexed. Only the cells' boxes and sizes reach the driver.
    """
    n, dimension = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    block_rows = block_rows or max(256, min(8192, (16 << 20) // (8 * (dimension or 1))))
    depth = min(max(0, -(-n // block_rows) - 1).bit_length(), cells.bit_length() - 1)

    def project(batches):
        for batch in filter(len, batches):
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(_points(_matrix(batch.column(0), len(batch)), longest).ravel()), PROJECTIONS).cast(pa.list_(pa.float64()))], names=["p"])

    some = vectors.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(n, 1))) < SAMPLE).select("v").limit(2 * SAMPLE)
    sample = some.mapInArrow(project, "p array<double>").toArrow().column("p").combine_chunks() if depth else pa.array([], pa.list_(pa.float64()))
    axes, cuts = fit_cells(_matrix(sample, len(sample)) if len(sample) else np.zeros((0, PROJECTIONS)), depth)

    def deal(batches):
        for batch in filter(len, batches):
            ids, v = batch.column("id").to_numpy(), _matrix(batch.column("v"), len(batch)) + 0.0
            rows = np.column_stack([ids.view(np.float64), v])
            fresh = np.sort(np.unique(rows.view(np.uint8).view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_index=True)[1])
            p = _points(v[fresh], longest)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (v[fresh], p)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), *lists, pa.array(cell_of(p, axes, cuts))], names=["id", "v", "p", "cell"])

    dealt = spool(vectors.mapInArrow(deal, "id long, v array<double>, p array<double>, cell long"), "dealt")
    sides = [f(F.col("p")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(PROJECTIONS)]
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *sides).toArrow()
    low, high = np.full((1 << depth, PROJECTIONS), np.inf), np.full((1 << depth, PROJECTIONS), -np.inf)
    subs = np.zeros(1 << depth, np.int64)
    at = boxes.column("cell").to_numpy()
    subs[at] = -(-boxes.column("n").to_numpy() // block_rows)
    for i in range(PROJECTIONS):
        low[at, i], high[at, i] = boxes.column(f"min{i}").to_numpy(), boxes.column(f"max{i}").to_numpy()
    limit = chi_square_quantile(found)

    def build(table: pa.Table) -> pa.Table:
        made = build_block(table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks(), len(table)), longest, k)
        return pa.table({c: table.column(c)[:1] for c in ("cell", "sub")} | {c: pa.array([x], pa.binary()) for c, x in made.items()})

    def sub(cell: int, query_ids: np.ndarray) -> np.ndarray:
        return query_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33) if subs[cell] > 1 else np.zeros(len(query_ids), np.uint64)

    def send(batches):
        """Chunks of queries to the blocks that they meet: without ``known``, a block of the nearest cell; then all others."""
        for whole in batches:
            for first in range(0, len(whole), chunk_rows):
                batch = whole.slice(first, chunk_rows)
                ids, v = batch.column("id").to_numpy(), _matrix(batch.column("v"), len(batch))
                again = "known" in batch.schema.names
                known = batch.column("known").to_numpy() if again else np.full(len(ids), -np.inf)
                near = np.where(subs > 0, np.nan_to_num(box_distances(v @ projection(v.shape[1])[:-1], low, high), nan=0.0), np.inf)
                nearest_cell = near.argmin(axis=1)
                meets = ~(near > (limit * np.maximum((v**2).sum(1) + longest - 2 * known, 0))[:, None]) & (subs > 0)
                out = {c: [] for c in ("cell", "sub", "query_ids", "queries", "known")}
                for cell in np.unique(np.nonzero(meets)[1] if again else nearest_cell).tolist():
                    q = np.flatnonzero(meets[:, cell] if again else nearest_cell == cell)
                    own = np.where(nearest_cell[q] == cell, (sub(cell, ids[q]) % np.uint64(subs[cell])).astype(np.int64), -1)
                    for s in range(subs[cell]):
                        some = q[(own != s) if again else (own == s)]
                        if len(some):
                            for c, x in zip(out, (cell, s, ids[some].tobytes(), v[some].tobytes(), known[some].tobytes())):
                                out[c].append(x)
                if out["cell"]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if c in ("cell", "sub") else pa.binary()) for c, x in out.items()], names=list(out))

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, known = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["known"])
                v = np.frombuffer(row["queries"]).reshape(len(query_ids), -1)
                q, candidates, scores = search_block(row, query_ids, v, known, longest, k, found)
                cuts = np.searchsorted(q, np.arange(len(query_ids) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (candidates, scores)]
                queries = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
                kth = np.where(np.diff(cuts) >= k, scores[np.minimum(cuts[:-1] + k - 1, len(scores) - 1)] if len(scores) else -np.inf, -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids), queries, *lists, pa.array(np.maximum(kth, known))], names=["id", "v", "ids", "scores", "known"])

    sizes = vectors.sparkSession.createDataFrame([(i, x) for i, x in enumerate(subs.tolist()) if x], "cell long, subs long")
    blocks = dealt.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("id", "v"), "subs"))  # at most CELLS rows
    blocks = spool(blocks.select("cell", "sub", "id", "v").groupBy("cell", "sub").applyInArrow(build, "cell long, sub long, ids binary, firsts binary, vectors binary, starts binary, low binary, high binary"), "blocks")

    def meet(rows: DataFrame) -> DataFrame:
        chunks = rows.mapInArrow(send, "cell long, sub long, query_ids binary, queries binary, known binary")
        return chunks.join(blocks.hint("merge"), ["cell", "sub"]).mapInArrow(search, "id long, v array<double>, ids array<long>, scores array<double>, known double")

    own = spool(meet(queries.select("id", "v")), "own-cells")
    others = meet(own.select("id", "v", "known"))
    pairs = [x.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x")) for x in (own, others)]
    pairs = pairs[0].union(pairs[1]).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``every``; candidates: all other rows."""
    rows, dimension = valid_vectors(embeddings)
    rows = spool(rows, "vectors")
    if not dimension:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    return nearest(rows, rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), longest, k)

"""Centroid clustering (Lloyd's rounds) with ns-bounds, in exact integers.

A vector keeps the distance to its centroid, a distance to every other centroid, and for each the round in which it was
computed. All centroids of all rounds are kept (rounds x k vectors), so a stored distance is loosened by the norm of the
centroid's total displacement since that round, which is at most the sum of its drifts round by round. Only centroids
whose loosened distance does not exceed the vector's own are evaluated again, exactly, so assignments are those of a full
scan. Rounds are passes over a table in the shared folder; sums of a round are merged before they are shuffled, and only
k sums reach the driver.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part; components
are integers floor(scale * x), beyond 2^27 either way the nearest of these; repeated rows are vectors of their own;
starting vectors with one identifier (null counts as empty) are taken by their components; fewer vectors than k give as
many centroids; distances tie to the smaller number; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, spool

#: With components of at most this size a squared distance in some hundred dimensions fits a long.
LIMIT = 1 << 27
#: Relative slack of a bound, far above the rounding of its terms: what lies within is computed exactly.
SLACK = 1e-7
#: Distances computed at a time.
CHUNK = 1 << 15
STATE = "vec_id long, x array<int>, cluster int, distance long, own double, own_at int, other array<float>, other_at array<tinyint>, evaluated int"


def integer_vectors(rows: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.greatest(F.least(F.floor(scale * c.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return rows.where((F.size(v) == dim) & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest SHA-256 values of ``seed:vec_id``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()], np.int64)


def squared(x: np.ndarray, centroids: np.ndarray, row: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``x[row]`` to ``centroids[of]``."""
    out = np.empty(len(row), np.int64)
    for at in range(0, len(row), CHUNK):
        gap = x[row[at : at + CHUNK]] - centroids[of[at : at + CHUNK]]
        out[at : at + CHUNK] = np.einsum("ij,ij->i", gap, gap)
    return out


def displacements(history: np.ndarray) -> np.ndarray:
    """(round, centroid): how far each centroid of each round lies from where it is now, a little more at most."""
    gap = (history - history[-1]).astype(float)
    return np.sqrt((gap * gap).sum(axis=2)) * (1 + SLACK)


def _down(distance: np.ndarray) -> np.ndarray:
    """As 32-bit values that are not above ``distance``."""
    return np.nextafter((distance * (1 - SLACK)).astype(np.float32), np.float32(0))


def assign_all(x: np.ndarray, centroids: np.ndarray) -> dict[str, np.ndarray]:
    """The state after the first scan."""
    n, k = len(x), len(centroids)
    row, of = np.divmod(np.arange(n * k), k)
    d = squared(x, centroids, row, of).reshape(n, k)
    cluster = d.argmin(axis=1) if n else np.zeros(0, np.int64)
    least = d[np.arange(n), cluster]
    return {"cluster": cluster, "distance": least, "own": np.sqrt(least), "own_at": np.zeros(n, np.int64), "other": _down(np.sqrt(d)), "other_at": np.zeros((n, k), np.int64), "evaluated": np.full(n, k)}


def assign_bounded(x: np.ndarray, state: dict[str, np.ndarray], history: np.ndarray, exact: bool = False) -> dict[str, np.ndarray]:
    """The state after a round with the last centroids of ``history``; ``exact``: ``distance`` is computed for all vectors."""
    now, moved, centroids = len(history) - 1, displacements(history), history[-1]
    n, k = len(x), len(centroids)
    cluster, own, own_at = state["cluster"].copy(), state["own"].copy(), state["own_at"].copy()
    distance, other, other_at, evaluated = (state[c].copy() for c in ("distance", "other", "other_at", "evaluated"))
    below = other - moved[other_at, np.arange(k)]
    below[np.arange(n), cluster] = np.inf
    above = (own + moved[own_at, cluster]) * (1 + SLACK)
    some = np.nonzero((below <= above[:, None]).any(axis=1) | exact)[0]  # the others keep their centroid, whatever it is now
    distance[some] = squared(x, centroids, some, cluster[some])
    own[some], own_at[some] = np.sqrt(distance[some]), now
    above[some] = own[some] * (1 + SLACK)
    np.add.at(evaluated, some, 1)
    at, of = np.nonzero(below[some] <= above[some, None])
    row = some[at]
    found = squared(x, centroids, row, of)
    other[row, of], other_at[row, of] = _down(np.sqrt(found)), now
    np.add.at(evaluated, row, 1)
    before = cluster.copy()
    order = np.lexsort((of, found, row))  # the first of each row is its nearest, ties to the smaller number
    row, of, found = row[order], of[order], found[order]
    first = np.concatenate(([True], row[1:] != row[:-1]))[: len(row)]
    row, of, found = row[first], of[first], found[first]
    nearer = (found < distance[row]) | (found == distance[row]) & (of < cluster[row])
    row, of, found = row[nearer], of[nearer], found[nearer]
    other[row, before[row]], other_at[row, before[row]] = _down(own[row]), now
    cluster[row], distance[row], own[row], own_at[row] = of, found, np.sqrt(found), now
    return {"cluster": cluster, "distance": distance, "own": own, "own_at": own_at, "other": other, "other_at": other_at, "evaluated": evaluated}


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def _round(rows: DataFrame, history: np.ndarray, exact: bool) -> DataFrame:
    """The states of ``rows`` (vectors in the first round, states later) under the last centroids of ``history``."""
    k, dim = history.shape[1:]

    def run(batches):
        hold()
        for batch in batches:
            x = _matrix(batch.column("x"), dim, np.int64)
            if len(history) == 1:
                state = assign_all(x, history[0])
            else:
                state = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "distance", "own", "own_at", "evaluated")}
                state |= {"other": _matrix(batch.column("other"), k, np.float32), "other_at": _matrix(batch.column("other_at"), k, np.int64)}
                state = assign_bounded(x, state, history, exact)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("x"), pa.array(state["cluster"], pa.int32()), pa.array(state["distance"], pa.int64()), pa.array(state["own"], pa.float64()),
                    pa.array(state["own_at"], pa.int32()), _lists(state["other"], pa.float32()), _lists(state["other_at"], pa.int8()), pa.array(state["evaluated"], pa.int32()),
                ],
                names=["vec_id", "x", "cluster", "distance", "own", "own_at", "other", "other_at", "evaluated"],
            )

    return rows.mapInArrow(run, STATE)


def moved_centroids(states: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the clusters' means; the centroid of an empty cluster stays."""
    sums = [F.sum(F.col("x")[i].cast("long")) for i in range(centroids.shape[1])]
    out = centroids.copy()
    for cluster, n, *total in states.groupBy("cluster").agg(F.count("*"), *sums).collect():
        out[cluster] = [s // n for s in total]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """States of ``vectors`` (``vec_id, x``) after ``rounds`` rounds and one more assignment; and the centroids of every round."""
    states = spool(vectors, "vectors")
    first = first_centroids(states, k, seed)
    if not len(first):
        return states.sparkSession.createDataFrame([], STATE), first[None]
    history = first[None]
    for n in range(rounds + 1):
        states = spool(_round(states, history, exact=n == rounds), "states")
        if n < rounds:
            history = np.concatenate((history, moved_centroids(states, history[-1])[None]))
    return states, history


def report(rows: DataFrame, k: int = 16, rounds: int = 3) -> DataFrame:
    states, history = cluster(integer_vectors(rows), k, rounds)
    inertia = dict(states.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows at most
    named = [(i, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, history[-1][i].tolist())).encode()).hexdigest()) for i, n in inertia.items()]
    of = states.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return states.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 16, rounds: int = 3) -> str:
    """The same by full scans."""
    out = [
        f"""WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x AS c
  FROM kept QUALIFY k < {k})"""
    ]
    for n in range(rounds + 1):
        out.append(f"""a{n} AS (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': k}}) AS best
  FROM kept, c{n} GROUP BY r)""")
        if n < rounds:
            out.append(f"""s{n} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c
  FROM (SELECT best.k AS k, i, sum(v) AS s, count(*) AS n
        FROM (SELECT r, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM kept) u JOIN a{n} USING (r) GROUP BY ALL) GROUP BY k),
c{n + 1} AS (SELECT k, coalesce(s{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN s{n} USING (k))""")
    last = f"""
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.k = best.k
"""
    return ",\n".join(out) + last

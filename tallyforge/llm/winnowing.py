"""Document fingerprints by winnowing.

Every run of K code points has a rolling hash (Karp-Rabin, mixed so that minima fall anywhere). Of each WINDOW
consecutive hashes the least is chosen, the rightmost of equal ones, and kept with its place. So two texts that share a
passage of K + WINDOW - 1 code points share a chosen hash whose places lie in that passage, and no passage shorter than K
matches but by chance of 64-bit hashes. Texts are read whole, a chunk of code points at a time.

``with_neighbours`` compares each document with an edited form of it and with the next document in descending order of
identifiers. The order is cut into buckets by a sample of its keys; a bucket's first document also goes to the bucket
before, as the next one of its last, so texts are moved once. Each bucket is sorted and passes a task as a stream of which
one document is held.

Defined results: texts are taken as they are; null counts as empty, which has no hashes; a text of fewer than K code
points is one run, one of fewer than WINDOW runs one window; likeness is the share of common among all distinct chosen
hashes, 1 between two texts without any; rows are ordered by identifier (descending, null last), then by the text's
SHA-256, so repeated rows are neighbours (those equal in both pass one task, hashed once); a single row is its own next one; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, slices

#: Code points of a run and runs of a window: any common passage of 100 code points is found.
K, WINDOW = 24, 77
#: Runs that are hashed at a time.
CHUNK = 1 << 20
#: Sampled keys for each bucket.
SAMPLE = 64
BASE, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def run_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of every run of ``k`` code points: of twice as long runs from those of half the length."""
    k = min(k, len(points))
    if not k:
        return np.zeros(0, np.uint64)
    size, power, found = 1, int(BASE), points.astype(np.uint64) + np.uint64(1)
    single = found
    for bit in bin(k)[3:]:
        found, size, power = found[: len(found) - size] * np.uint64(power) + found[size:], 2 * size, power * power % 2**64
        if bit == "1":
            found, size, power = found[: len(single) - size] * BASE + single[size:], size + 1, power * int(BASE) % 2**64
    found = (found ^ found >> np.uint64(32)) * ODD
    return found ^ found >> np.uint64(29)


def rightmost_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the least of every ``window`` values, the rightmost of equal ones; sorted, each once."""
    window = min(window, len(values))
    if not window:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(values)), 1

    def least(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] <= values[left], right, left)

    while 2 * span <= window:
        at, span = least(at[: len(at) - span], at[span:]), 2 * span
    if span < window:
        at = least(at[: len(values) - window + 1], at[window - span :])
    return np.unique(at)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their places in a text."""
    runs = max(0, len(points) - k + 1)
    if runs <= CHUNK:
        found = run_hashes(points, k)
        at = rightmost_minima(found, window)
        return found[at], at
    hashes, places = [], []
    for start in range(0, runs - window + 1, CHUNK):  # the windows that begin here need the runs of window - 1 more places
        found = run_hashes(points[start : min(start + CHUNK + window - 1, runs) + k - 1], k)
        at = rightmost_minima(found, window)
        hashes.append(found[at])
        places.append(at + start)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], places


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    """``place:hash`` of each chosen hash, in order."""
    return ",".join(f"{p}:{h:016x}" for h, p in zip(hashes.tolist(), places.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of hashes, sorted."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - common
    return common / every if every else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id, place, hash``: one row for each chosen hash of each text."""

    def run(batches):
        hold()
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                found = [winnow(code_points(t or ""), k, window) for t in batch.column("text").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(h) for h, _ in found]))
                hashes = np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in found]])
                places = np.concatenate([np.zeros(0, np.int64), *[p for _, p in found]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), pa.array(places), pa.array(hashes.view(np.int64))], names=["doc_id", "place", "hash"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, place long, hash long")


class _Document:
    """A document with its fingerprint, while its neighbour is compared with it."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.points = doc_id, text, code_points(text)
        self.found = winnow(self.points)
        self.set = np.unique(self.found[0])

    def row(self, following: _Document) -> tuple:
        half = len(self.points) // 2
        edited = np.concatenate((self.points[: len(self.points) - half], following.points[:half]))
        found = winnow(edited)
        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")).hexdigest()
        return self.doc_id, len(self.points), digest, written(*self.found), written(*found), likeness(self.set, np.unique(found[0])), likeness(self.set, following.set)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [x.split() for x in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _order(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` and what they are ordered by: ``none, down, sha``."""
    out = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return out.withColumns({"none": F.col("doc_id").isNull(), "down": F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")), "sha": F.sha2("text", 256)})


def _buckets(bounds: list[tuple], guests: dict[tuple, int]):
    """The bucket of a key, and the one before it in which the key is a guest, if it is the first of its bucket."""

    @F.pandas_udf("array<int>")
    def of(none: pd.Series, down: pd.Series, sha: pd.Series) -> pd.Series:
        keys = list(zip(none.tolist(), down.tolist(), sha.tolist()))
        return pd.Series([[bisect_right(bounds, k), *([guests[k]] if k in guests else [])] for k in keys])

    return of("none", "down", "sha")


def _ranges(rows: DataFrame, buckets: int) -> tuple[list[tuple], dict[tuple, int]]:
    """Bounds that cut the order in about equal parts, from a sample of SAMPLE keys a part; and of each part's first key,
    the part before (the last one's before the first). One key for each part reaches the driver."""
    every = rows.count()
    if not every:
        return [], {}
    keys = rows.select("none", "down", "sha")
    some = sorted(map(tuple, keys.sample(min(1.0, SAMPLE * buckets / every), seed=1).collect()))
    bounds = sorted({some[len(some) * i // buckets] for i in range(1, buckets)} if some else ())
    first = keys.groupBy(_buckets(bounds, {})[0].alias("bucket")).agg(F.min(F.struct("none", "down", "sha")).alias("key")).orderBy("bucket").collect()
    return bounds, {tuple(r.key): before.bucket for r, before in zip(first, first[-1:] + first[:-1])}


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text (its later half replaced by the beginning of the next document), and
    their likeness. ``buckets``: parts of the order, by default as many as shuffle partitions."""

    def run(batches):
        hold()
        before = bucket = None
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                done = []
                for at, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                    if at != bucket:
                        before, bucket = None, at
                    if guest and before is None:
                        continue
                    now = before if before is not None and before.text == text and before.doc_id == doc_id else _Document(doc_id, text)
                    if before is not None:
                        done.append(before.row(now))
                    before = None if guest else now
                if done:
                    yield _batch(done)

    rows = _order(docs, id_col, text_col)
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("*", F.posexplode(_buckets(*_ranges(rows, buckets))).alias("guest", "bucket"))
    dealt = dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "guest", "none", "down", "sha")
    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(run, RESULT)


def report(docs: DataFrame) -> DataFrame:
    return with_neighbours(docs.select("doc_id", "text"))

"""SimHash near-dedup with Golay-code keys.

A fingerprint is cut into three segments. A 23-bit word lies within three bits of exactly one codeword of the perfect
binary Golay code, and the codewords of a word and of its one-bit neighbours are one or six; two words that differ in at
most two bits share at least one of them, since some word lies within one bit of both. Of at most two wrong bits at
least one segment has none, so a fingerprint gets, for each segment taken as exact, that segment with each codeword
index of the next one as a key. Fingerprints that share a key are joined and verified.

Very full keys are not joined in pairs: there every member names the words within one bit of it, and those that name the
same word, at most 65, are linked to the least of them. Two fingerprints differ in at most two bits exactly when they
share such a word, so no link's component is lost and the work stays in proportion to the members.

Defined results: null and empty texts have fingerprint zero and are linked like any other; texts are read whole; rows
with equal fingerprints, repeated rows among them, are one node; rows with a null identifier keep a fingerprint and get
the component of their fingerprint; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import hold, slices, spool
from .components import connected_components

SEED, CHUNK = 42, 1 << 15
#: Bits in which linked fingerprints may differ; the keys are made for this number.
BITS = 2
#: Widths of the three segments, from the low bits up.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the [23, 12] Golay code (fixed value).
GENERATOR = 0b101011100011


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """Bit set where over half of the shingles' XXH64 values have it; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    each = min(words_each, len(words))
    starts, ends = starts[: len(words) - each + 1], ends[each - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        some = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit integer."""

    def run(batches):
        hold()
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                found = np.array([fingerprint(t, words_each) for t in batch.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Of every single wrong bit; and by syndrome, the pattern of at most three wrong bits that causes it."""
    single = []
    for bit in range(23):
        rest = 1 << bit
        for high in range(22, 10, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - 11)
        single.append(rest)
    wrong = np.zeros(2048, np.int64)
    for i in range(23):
        wrong[single[i]] = 1 << i
        for j in range(i):
            wrong[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                wrong[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return np.array(single, np.int64), wrong


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 24): codeword index of each 23-bit word and of its one-bit neighbours; repeats are replaced by -1."""
    single, wrong = _syndromes()
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(23):
        syndrome ^= (words >> bit & 1) * single[bit]
    flips = np.concatenate(([0], 1 << np.arange(23)))
    changed = np.concatenate(([0], single))
    found = np.sort((words[:, None] ^ flips ^ wrong[syndrome[:, None] ^ changed]) >> 11, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def _parts(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in SEGMENTS:
        out.append((fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint (unsigned)."""
    rows, keys, parts = [], [], _parts(fp)
    for s in range(3):
        index = golay_indices(parts[(s + 1) % 3])
        row, column = np.nonzero(index >= 0)
        rows.append(row)
        keys.append(s << 40 | parts[s][row] << 12 | index[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _near_words(fp: np.ndarray) -> np.ndarray:
    """(n, 65): each fingerprint and its one-bit neighbours."""
    return fp[:, None] ^ np.concatenate(([0], 1 << np.arange(64, dtype=np.uint64))).astype(np.uint64)


def links(nodes: DataFrame, pairs_up_to: int = 24) -> DataFrame:
    """Edges ``u, v`` between the ``rep`` of distinct fingerprints ``fp`` whose closure is that of all pairs within two bits."""

    def make_keys(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fp), 20_000):
                row, key = keys_of(fp[at : at + 20_000].view(np.uint64))
                row = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("fp").take(row), batch.column("rep").take(row)], names=["key", "fp", "rep"])

    def make_words(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fp), 10_000):
                words = _near_words(fp[at : at + 10_000].view(np.uint64)).view(np.int64)
                row = pa.array(np.repeat(np.arange(len(words)), 65) + at)
                yield pa.RecordBatch.from_arrays([pa.array(words.ravel()), batch.column("rep").take(row)], names=["word", "rep"])

    keys = spool(nodes.where("rep is not null").mapInArrow(make_keys, "key long, fp long, rep long"), "keys")
    sizes = spool(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    shared = keys.join(sizes, "key")
    small = shared.where(F.col("n") <= pairs_up_to).select("key", "fp", "rep")
    other = small.select("key", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    pairs = small.join(other, "key").where((F.col("rep") < F.col("rep2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= BITS))
    full = shared.where(F.col("n") > pairs_up_to).select("fp", "rep").distinct()
    words = full.mapInArrow(make_words, "word long, rep long")
    least = words.groupBy("word").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = words.join(least, "word").where("rep <> v")
    return pairs.select(F.col("rep2").alias("u"), F.col("rep").alias("v")).union(stars.select(F.col("rep").alias("u"), "v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: component_id is the smallest identifier reachable over links of at most two bits."""
    rows = spool(with_fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = spool(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = connected_components(links(nodes))
    of = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, by verified five-word similarity of 0.8 or more.

    Candidates are the pairs of five-word fingerprints that share a Golay key and lie within two bits, and those that
    ``similar`` adds for texts further apart, which no number of Golay keys in reason would reach.
    """
    return similar.keep_one_of_each(docs, id_col, text_col, near=links)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

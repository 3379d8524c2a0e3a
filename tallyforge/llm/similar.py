"""Near-dedup of whole texts by exact similarity of five-word shingles: candidates are verified on the whole sets.

Two texts are near duplicates if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Candidates are
the pairs that ``near`` finds among the sets' SimHash fingerprints (SimHash near-dedup passes its Golay keys, which reach
two bits) and, as texts at 0.8 differ in 3 to 15 bits of 64, those that share a band of min-hashes: of BANDS keys, each
made of ROWS minima, a pair at 0.8 shares at least one but for one in 20,000, and a closer pair but for far fewer. Every
candidate is verified, so no other texts are linked.

Keys of more than ``pairs_up_to`` members are not joined in pairs. Their members are verified against two of them, which
links most of a group of copies. What a full key's members still lack is found exactly: a key whose members are one
component by then lacks nothing; of any other, each pair of two components has a member outside the key's largest
component. These members, and the members of the largest components, meet by prefixes: shingles are ordered by rising
frequency (a sketch of fixed size), and two sets with enough in common share one of their rarest, how many depends on
both lengths. A text that shares a template, a licence or a form with very many others meets them by what is its own, so
these lists stay short; ones that hold one component only are dropped.

Defined results: A-Z are lower-cased, words end at ASCII white space; a text of fewer than five words is one shingle; null
and empty texts are equal; texts are read whole; texts with equal sets (by 128 bits) are one node, named by its first row;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, hold, may_match, slices, spool
from .components import connected_components

SEED, WORDS, BANDS, ROWS = 42, 5, 25, 5
#: Bands whose full keys give pivots; the exact step covers the full keys of all.
PIVOT_BANDS = 8
#: Counters of the frequency sketch, and the rows it is moved in.
COUNTERS, SLABS = 1 << 20, 64
#: Ratio of the longest to the shortest set of a length class.
CLASS = 1.1
CHUNK = 1 << 12
STEP = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """The set of 64-bit hashes of the text's five-word shingles, sorted."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w, SEED) for w in (text or "").encode("utf-8", "replace").lower().split()], np.uint64)
    if not len(words):
        return words
    each = min(WORDS, len(words))
    n = len(words) - each + 1
    out = np.zeros(n, np.uint64)
    for i in range(each):
        out = out * STEP + words[i : i + n]
    return np.unique(_mix(out))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band of minima; none for an empty set."""
    if not len(found):
        return found
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), CHUNK):
        np.minimum(least, np.multiply.outer(FACTORS, found[at : at + CHUNK]).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in _mix(least).reshape(BANDS, ROWS).T:
        out = out * STEP + column
    return _mix(out)


def set_fingerprint(found: np.ndarray) -> int:
    """Bit set where over half of the set's hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        ones += np.unpackbits(found[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sketches(rows: DataFrame) -> DataFrame:
    """``row, h1, h2, fp, keys`` of ``row, text``: a digest of the set, its fingerprint, its band keys."""

    def run(batches):
        hold()
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                sets = [shingles(t) for t in batch.column("text").to_pylist()]
                digests = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes(), SEED), 1 << 64) for s in sets], np.uint64).reshape(-1, 2)
                h1, h2, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (digests[:, 0].copy(), digests[:, 1].copy(), [set_fingerprint(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([batch.column("row"), h1, h2, fp, _lists([band_keys(s) for s in sets])], names=["row", "h1", "h2", "fp", "keys"])

    return rows.mapInArrow(run, "row long, h1 long, h2 long, fp long, keys array<long>")


def _sets(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, found`` of those rows of ``held`` that are ``nodes``; only rows that may be are moved."""

    def run(batches):
        hold()
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("row"), _lists([shingles(t) for t in batch.column("text").to_pylist()])], names=["node", "found"])

    some = may_match(held, F.col("row"), nodes, F.col("node"), "__near").where("__near").select(F.col("row"), "text")
    return some.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").mapInArrow(run, "node long, found array<long>")


def _candidates(keys: DataFrame, sizes: DataFrame, pairs_up_to: int) -> DataFrame:
    """Pairs ``a, b`` of nodes that share a small key, and those of members of full keys with their pivots. ``keys``: ``node,
    band, key``; ``sizes``: ``key, n``."""
    shared = may_match(keys, F.col("key"), sizes, F.col("key"), "__near").where("__near").select("node", "band", "key")
    small = spool(shared.join(sizes.where(F.col("n") <= pairs_up_to), "key").select("key", F.col("node").alias("a")), "shared-keys")
    pairs = small.join(small.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b")
    full = spool(shared.where(F.col("band") < PIVOT_BANDS).join(sizes.where(F.col("n") > pairs_up_to), "key").select("key", "node", "n"), "full-keys")
    known = full.groupBy("node").agg(F.sum("n").alias("known"))  # the text that others are copies of holds the fullest keys
    central, random = F.max(F.struct("known", "node"))["node"], F.min(F.struct(F.xxhash64("node"), "node"))["node"]
    pivots = spool(full.join(known, "node").groupBy("key").agg(central.alias("p0"), random.alias("p1")), "pivots")
    # a node's pivots are told apart before pairs are made of them: most of its keys have the same ones
    of = full.join(pivots, "key").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(F.array("p0", "p1")))).alias("ps"))
    met = of.select("node", F.explode("ps").alias("p")).where("node <> p")
    return pairs.union(met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")))


def _near_pairs(sketches: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs ``a, b`` of nodes with equal fingerprints (each with the least of them) or with fingerprints that ``near`` links."""
    prints = sketches.where("size(keys) > 0").select("fp", "node")
    least = spool(prints.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    equal = prints.join(least, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return equal.union(near(least).select(F.least("u", "v"), F.greatest("u", "v")))


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``u, v`` of those ``pairs`` whose similarity is 0.8 or more."""
    pairs = spool(pairs.distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = spool(_sets(held, ends), "sets")
    first, second = (sets.select(F.col("node").alias(c), F.col("found").alias(f"s{c}")) for c in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(first, "a").join(second, "b").where(9 * common >= 4 * (F.size("sa") + F.size("sb"))).select(F.col("b").alias("u"), F.col("a").alias("v"))


def _frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each counter (their low bits) occur: merged in SLABS pieces, COUNTERS values in all."""
    width = COUNTERS // SLABS

    def count(batches):
        hold()
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            found = batch.column("found").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((found & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            yield _slabs({i: total[i * width : (i + 1) * width] for i in range(SLABS)})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slab").to_pylist(), batch.column("counts").to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(raw, "<i8")
        if total:
            yield _slabs(total)

    merged = sets.select("found").mapInArrow(count, "slab int, counts binary").repartition("slab").mapInArrow(add, "slab int, counts binary")
    out = np.zeros(COUNTERS, np.int64)
    for r in merged.collect():
        out[r.slab * width : (r.slab + 1) * width] = np.frombuffer(r.counts, "<i8")
    return out


def _slabs(pieces: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in pieces.values()], pa.binary())], names=["slab", "counts"])


def prefixes(found: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(is_probe, key, low, high) of a set: the shingles by which it can meet the sets of ``low`` to ``high`` shingles, as the
    shorter of two (keys of its own length class) or the longer one (of each class that it can meet)."""
    n, out = len(found), []
    often = counts[(found & np.uint64(COUNTERS - 1)).astype(np.int64)]
    order = np.lexsort((found, often))
    rare, alone = found[order], often[order] == 1  # a counter of one is that of a shingle of this set alone, which meets nothing
    at = np.arange((n - -(-4 * n // 5)) + 1)
    high = (5 * n - 9 * at) // 4  # a partner of more shingles that has enough in common shares a rarer one

    def keys(some: np.ndarray, length_class: int) -> np.ndarray:
        return _mix(some * STEP + np.uint64(length_class))

    own = (high >= n) & ~alone[at]
    out.append((False, keys(rare[at[own]], _class(n)), np.full(own.sum(), n), high[own]))
    low, high = -(-4 * n // 5), np.minimum(high, n)
    for c in range(_class(low), _class(n) + 1):
        some = [i for i in at[~alone[at]].tolist() if high[i] >= low and _class(int(high[i])) >= c]
        out.append((True, keys(rare[some], c), np.full(len(some), low), high[some]))
    return out


def _class(n: int) -> int:
    return int(np.log(n) / np.log(CLASS) + 1e-9)


#: Bits of the filter that says by which keys the members outside largest components can be met.
MET_BITS = 1 << 23


def _postings(sets: DataFrame, counts: np.ndarray, wanted: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``probe, key, node, component, n, low, high``: by which keys sets can be met. ``wanted``: filters of the keys of those to
    be met as shorter and as longer ones."""
    shared = sets.sparkSession.sparkContext.broadcast((counts, wanted))

    def run(batches):
        hold()
        counts, wanted = shared.value
        for batch in batches:
            nodes, components, found = (batch.column(c) for c in ("node", "component", "found"))
            for node, component, one in zip(nodes.to_pylist(), components.to_pylist(), found):
                values = one.values.to_numpy().view(np.uint64)
                own = prefixes(values, counts)
                probe = np.concatenate([np.full(len(k), p) for p, k, _, _ in own])
                key, low, high = (np.concatenate([x[i] for x in own]) for i in (1, 2, 3))
                if wanted:
                    place = (key & np.uint64(MET_BITS - 1)).astype(np.int64)
                    ok = np.where(probe, wanted[0][place >> 3], wanted[1][place >> 3]) >> (place & 7) & 1 == 1
                    probe, key, low, high = probe[ok], key[ok], low[ok], high[ok]
                m = len(key)
                columns = [probe, key.view(np.int64), np.full(m, node), np.full(m, component), np.full(m, len(values)), low, high]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["probe", "key", "node", "component", "n", "low", "high"])

    return sets.select("node", "component", "found").mapInArrow(run, "probe boolean, key long, node long, component long, n long, low long, high long")


def _filter_of(postings: DataFrame) -> np.ndarray:
    """A bit for each key (its low bits); of fixed size."""
    place = F.col("key").bitwiseAND(F.lit(MET_BITS - 1)) + 1  # buckets count from place 1
    made = postings.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(MET_BITS // 8, np.uint8)
    for r in made.collect():
        out[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _missing(keys: DataFrame, sizes: DataFrame, components: DataFrame, held: DataFrame, pairs_up_to: int) -> DataFrame | None:
    """Pairs ``a, b`` of different components that a full key holds and that can be similar enough. ``keys``: ``node, keys``."""
    named = keys.join(components, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.posexplode("keys").alias("band", "key"))
    full = spool(sizes.where(F.col("n") > pairs_up_to).select("key"), "full")
    rows = may_match(named, F.col("key"), full, F.col("key"), "__near").where("__near")
    by = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count("*").alias("components"))
    mixed = spool(by.where("components > 1").join(full, "key", "left_semi").select("key", "largest"), "mixed-keys")
    outside = spool(rows.join(mixed, "key").where("component <> largest").select("node", "component").distinct(), "outside")
    if outside.isEmpty():
        return None
    inside = keys.select("node").join(components, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    inside = inside.join(mixed.select(F.col("largest").alias("component")).distinct(), "component", "left_semi").join(outside, "node", "left_anti")
    both = spool(outside.withColumn("out", F.lit(True)).unionByName(inside.withColumn("out", F.lit(False))), "members")
    sets = spool(_sets(held, both).join(both, "node"), "sets")
    counts = _frequencies(sets)
    mine = spool(_postings(sets.where("out"), counts), "postings")
    others = spool(_postings(sets.where("NOT out"), counts, (_filter_of(mine.where("NOT probe")), _filter_of(mine.where("probe")))), "postings")
    every = mine.withColumn("out", F.lit(True)).unionByName(others.withColumn("out", F.lit(False)))
    lists = every.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    every = spool(every.join(lists, "key", "left_semi"), "postings")
    short, long = every.where("NOT probe"), every.where("probe")
    x, y = (df.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("node", "component", "n", "low", "high", "out")]) for i, df in ((1, short), (2, long)))
    fits = "component1 <> component2 AND n2 BETWEEN low1 AND high1 AND n1 BETWEEN low2 AND high2 AND struct(n1, node1) < struct(n2, node2)"
    met = x.where("out1").join(y, "key").where(fits).union(x.where("NOT out1").join(y.where("out2"), "key").where(fits))
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))


def groups(held: DataFrame, pairs_up_to: int = 24, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``row, component`` of ``row, text``: rows of one component are near duplicates, by links of similarity 0.8 or more.
    ``near`` gives more candidates ``u, v`` of distinct fingerprints ``fp, rep``."""
    sketches = spool(_sketches(held), "sketches")
    first = sketches.groupBy("h1", "h2").agg(F.min("row").alias("node"))
    rows = spool(sketches.select("row", "h1", "h2").join(first, ["h1", "h2"]).select("row", "node"), "nodes")
    nodes = spool(sketches.withColumnRenamed("row", "node").join(rows.where("row = node").select("node"), "node", "left_semi").select("node", "fp", "keys"), "node-sketches")
    keys = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = spool(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    pairs = _candidates(keys, sizes, pairs_up_to)
    if near:
        pairs = pairs.union(_near_pairs(nodes, near))
    edges = spool(_verified(pairs, held), "links")
    found = spool(connected_components(edges), "components")
    more = _missing(nodes.select("node", "keys"), sizes, found, held, pairs_up_to)
    if more is not None:
        found = connected_components(_verified(more, held).union(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    return rows.join(found, "node", "left").select("row", F.coalesce("component", "node").alias("component"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of each group of near duplicates: the smallest identifier, null last, and of its rows the first.

    All columns of ``docs`` pass through, whatever their names.
    """
    row, gone = free_names(docs, "__row", "__gone")
    held = spool(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    of = held.select(F.col(row).alias("row"), F.col(id_col).alias("id")).join(groups(held.select(F.col(row).alias("row"), F.col(text_col).alias("text")), near=near), "row")
    of = spool(of, "groups")
    first = of.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("first"))
    dropped = spool(of.join(first, "component").where("row <> first").select(F.col("row").alias(row)), "dropped")
    flagged = may_match(held, F.col(row), dropped, F.col(row), gone)
    return flagged.where(~F.col(gone)).union(flagged.where(gone).join(dropped, row, "left_anti").select(*flagged.columns)).select(*docs.columns)

"""Points and the narrowest range that holds each: ranges are flattened into a line of pieces, and points are swept along it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.standardize import ip_to_number, ipv6_to_hex
from .ordered import cell_of, sampled_bounds

#: Parts of the key order, and parts that the points of each are dealt into, so that a part with a third of them is split.
CELLS, SPREAD = 64, 8
#: Where a piece begins in relation to its key, and a point between them.
AT, POINT, BEHIND = 0, 1, 2
ROWS = 1 << 14


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges by cell and start; gives where, in each cell, another value begins to hold: (cell, key, side, value or null).

    ``open_`` holds (rank, until, value) of the open ranges that may still count, by rank and thereby by end as well: a range
    that ends no later than one of a better rank never counts. So those that have ended come first, and the first is best.
    """
    at, open_, now, held, out = None, [], None, None, []

    def begins(key, side):
        """The best open range holds from here; of several changes at one place the last counts."""
        nonlocal held
        if held and held[:2] != (key, side):
            close()
        held = (key, side, open_[0][2] if open_ else None)

    def close():
        nonlocal now, held
        if held and held[2] != now:
            out.append((at, *held))
            now = held[2]
        held = None

    def end(before=None):
        while open_ and (before is None or open_[0][1] < before):
            key = open_.pop(0)[1]
            begins(key, BEHIND)

    def batch():
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int32(), pa.string()))], names=["cell", "key", "side", "value"])
        out.clear()
        return rows

    for some in batches:
        for cell, key, until, rank, value in zip(*(some.column(c).to_pylist() for c in ("cell", "key", "until", "rank", "value"))):
            if cell != at:
                end()
                close()
                at, now = cell, None
            end(key)
            i = bisect_left(open_, (rank,))
            if i and open_[i - 1][1] >= until:
                continue
            j = i
            while j < len(open_) and open_[j][1] <= until:
                j += 1
            open_[i:j] = [(rank, until, value)]
            if i == 0:
                begins(key, AT)
            if len(out) >= ROWS:
                yield batch()
    end()
    close()
    if out:
        yield batch()


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell, part, key and side; a point gets the value of the piece that began last."""
    at, now = None, None
    for batch in batches:
        points, values = [], []
        for cell, part, side, value, point in zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "side", "value", "point"))):
            if (cell, part) != at:
                at, now = (cell, part), None
            if side != POINT:
                now = value
            elif now is not None:
                points.append(point)
                values.append(now)
        yield pa.RecordBatch.from_arrays([pa.array(points, pa.string()), pa.array(values, pa.string())], ["point", "value"])


def narrowest_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(point, value) of the range with the least ``rank`` that holds a point; points without one, or with one whose value is
    null, are left out.

    ``points``: point and its key; ``ranges``: start, until (keys, both inside), rank and value, all text; of equal ranks the
    values must be equal. Bounds sampled from the ranges cut the keys into cells. A range goes to the cells of its two ends; of
    the ranges that hold a cell as a whole only the best one matters there, found by one aggregate, so no range is ever cut
    into blocks, however wide it is. Each cell's ranges become a line of pieces of one value, and only these meet the points,
    which are read once. A task holds the open ranges that may still count, none of which ends before a narrower one.
    """
    ends = ranges.select(F.explode(F.array("start", "until")).alias("key"))
    bounds = [r.key for r in sampled_bounds(ends, {"key": "asc"}, CELLS)]

    def cell(c: str) -> Column:
        return cell_of(bounds, lambda b: F.col(c) < b)

    placed = ranges.withColumns({"first": cell("start"), "last": cell("until")})
    lines = placed.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("cell"), F.col("start").alias("key"), "until", "rank", "value")
    if inner := range(1, len(bounds)):
        best = [F.min(F.when((F.col("first") < c) & (F.col("last") > c), F.struct("rank", "value"))) for c in inner]
        whole = placed.where("last > first + 1").agg(F.array(*best).alias("best")).select(F.posexplode("best").alias("at", "b")).where("b is not null")
        # such a range is open before the cell's first key and after its last one
        lines = lines.union(whole.select(F.col("at") + inner[0], F.lit(""), F.lit("~"), "b.rank", "b.value"))
    pieces = lines.repartition("cell").sortWithinPartitions("cell", "key", "until", "rank").mapInArrow(_flatten, "cell int, key string, side int, value string")
    pieces = pieces.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).withColumn("point", F.lit(None).cast("string"))
    part = F.pmod(F.xxhash64("point"), F.lit(SPREAD)).cast("int").alias("part")
    asked = points.where("key is not null").select(cell("key").alias("cell"), "key", F.lit(POINT).alias("side"), F.lit(None).cast("string").alias("value"), part, "point")
    run = pieces.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "key", "side")
    return run.mapInArrow(_sweep, "point string, value string")


def _difference(low: Column, high: Column) -> Column:
    """``high`` - ``low`` of 32 hex digits as 40 digits that sort as the numbers do."""

    def half(c: Column, at: int) -> Column:
        return F.conv(F.substring(c, at, 16), 16, 10).cast("decimal(20,0)")

    upper, lower = half(high, 1) - half(low, 1), half(high, 17) - half(low, 17)
    borrow = lower < 0
    upper, lower = upper - borrow.cast("int"), F.when(borrow, lower + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(lower)
    return F.concat(*[F.lpad(x.cast("decimal(20,0)").cast("string"), 20, "0") for x in (upper, lower)])


def _v4_key(number: Column) -> Column:
    return F.concat(F.lit("4"), F.lpad(F.lower(F.hex(number)), 32, "0"))


def _v6_key(address: Column) -> Column:
    return F.concat(F.lit("6"), ipv6_to_hex(address))


def address_key(ip: Column) -> Column:
    """A text that sorts as addresses do, IPv4 before IPv6; anything else is null."""
    return F.coalesce(_v4_key(ip_to_number(ip)), _v6_key(ip))


def ip_country(df: DataFrame, ranges: DataFrame, ip_col: str = "ip_address", ranges_v6: DataFrame | None = None) -> DataFrame:
    """``df`` with ``country_code`` of the narrowest range that holds the address, of equally wide ones that with the smaller
    start, then country; null without one, and where the address is null or none.

    ``ranges``: start, end as numbers and country; ``ranges_v6``: the same for IPv6, with start and end as text. Ranges may
    nest and overlap; reversed ones, and those without an end, hold nothing. Each distinct address is looked up once.
    """
    top = (1 << 32) - 1
    v4 = ranges.select(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("country").alias("value"))
    v4 = v4.where((F.col("s") <= F.col("e")) & (F.col("e") >= 0) & (F.col("s") <= top))
    known = v4.select(_v4_key(F.greatest("s", F.lit(0))).alias("start"), _v4_key(F.least("e", F.lit(top))).alias("until"), "value")
    if ranges_v6 is not None:
        v6 = ranges_v6.select(_v6_key(F.col("start")).alias("start"), _v6_key(F.col("end")).alias("until"), F.col("country").alias("value"))
        known = known.union(v6.where("start <= until"))
    width = _difference(F.substring("start", 2, 32), F.substring("until", 2, 32))
    rank = F.concat(width, "start", F.coalesce(F.concat(F.lit("1"), "value"), F.lit("0")))
    every = df.select(F.col(ip_col).alias("point")).distinct().withColumn("key", address_key(F.col("point")))
    found = narrowest_ranges(every, known.withColumn("rank", rank)).withColumnRenamed("value", "country_code")
    return df.drop("country_code").join(found, F.col(ip_col) == F.col("point"), "left").drop("point")

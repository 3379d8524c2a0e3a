"""Sharding by extendible hashing, in built-in functions only.

A row's place is a 60-bit hash: 30 bits of its key, then 30 bits of its identifier. The directory starts as one bucket;
only buckets above the byte limit are split on another bit, until every shard fits. Rows of one key share a shard as
long as they fit together; a key that is too large, if a third of all rows have it, goes on splitting on the identifier's
bits. Bytes are summed once per cell of a fixed number of bits and the splits are decided on the cells, which is one
pass over the rows; only rows of cells that are still too large are summed again at more bits.

Defined results: a null key or identifier hashes as the text ``null``; null texts have no bytes; a row larger than the
limit, or rows equal in key and identifier, cannot be split and share a shard marked oversize; an empty table gives an
empty one; all other columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, spool

KEY_BITS = ID_BITS = 30
BITS = KEY_BITS + ID_BITS
#: Cells for each shard of the expected number, as a power of two.
FINER = 5
CELLS_PER_TASK = 200_000


def _hash(value: Column, bits: int) -> Column:
    """The first bits of the MD5 of the value's text."""
    digits = -(-bits // 4)
    number = F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("null")).cast("binary")), 1, digits), 16, 10).cast("long")
    return F.shiftrightunsigned(number, 4 * digits - bits)


def place(key: Column, row_id: Column) -> Column:
    return F.shiftleft(_hash(key, KEY_BITS), ID_BITS).bitwiseOR(_hash(row_id, ID_BITS))


def _prefix(h: str, depth: str | int) -> str:
    return f"shiftrightunsigned({h}, {BITS} - {depth})"


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``depth, prefix, n_rows, n_bytes``: the shards of ``rows`` (``h``, ``b``)."""
    total = rows.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    step = min(BITS, max(4, (max(1, total) // max(1, limit)).bit_length() + FINER))
    open_rows, shards, done, n_open = rows, [], 0, 1
    while True:
        deep = min(BITS, done + step)
        tasks = max(1, (n_open << (deep - done)) // CELLS_PER_TASK)
        cells = open_rows.groupBy(F.expr(_prefix("h", deep)).alias("cell")).agg(F.sum("b").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        cells = spool(cells, "cells", tasks)
        up = cells.select("*", F.explode(F.sequence(F.lit(done), F.lit(deep))).alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {deep} - depth)"))
        sums = up.groupBy("depth", "prefix").agg(F.sum("b").alias("n_bytes"), F.sum("n").alias("n_rows"), (F.min("lo") == F.max("hi")).alias("one"))
        sums = spool(sums.withColumn("fits", (F.col("n_bytes") <= limit) | F.col("one")), "sums", tasks)
        # a bucket is split only if it is too large; so a shard fits and the bucket above it does not
        above = sums.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        whole = sums.where("fits").select("depth", "prefix", "n_rows", "n_bytes")
        found = whole.join(above, ["depth", "prefix"], "left_semi")
        shards.append(found.union(whole.where("depth = 0")) if done == 0 else found)
        left = sums.where((F.col("depth") == deep) & ~F.col("fits")).select(F.col("prefix").alias("cell"))
        n_open = left.count()
        if not n_open:
            break
        open_rows = open_rows.join(left, F.expr(_prefix("h", deep)) == F.col("cell"), "left_semi")
        done = deep
    out = shards[0]
    for more in shards[1:]:
        out = out.union(more)
    return spool(out.withColumn("oversize", F.col("n_bytes") > limit), "directory", max(1, total // max(1, limit) // CELLS_PER_TASK))


def shard(df: DataFrame, limit: int, key: Column, row_id: Column, n_bytes: Column) -> DataFrame:
    """``df`` with ``shard`` (its hash prefix as a bit string; empty if one shard holds all), ``shard_rows``, ``shard_bytes``, ``oversize``."""
    results = ("shard", "shard_rows", "shard_bytes", "oversize")
    h, b = free_names(df, "__hash", "__bytes")
    df = df.select(*[c for c in df.columns if c.lower() not in results], place(key, row_id).alias(h), F.coalesce(n_bytes.cast("long"), F.lit(0)).alias(b))
    rows = spool(df.select(F.col(h).alias("h"), F.col(b).alias("b")), "places")
    shards = directory(rows, limit)
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect()) or [0]  # at most one for each bit
    bits = F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(conv(prefix, 10, 2), depth, '0') END")
    shards = shards.select("depth", "prefix", bits.alias("shard"), F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"), "oversize")
    # each hash meets exactly one shard: its prefix at one of the depths in use
    tries = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.expr(_prefix("h", d)).alias("prefix")) for d in depths]))
    hashes = rows.select("h").distinct().withColumn("t", tries).select("h", "t.*")
    of = hashes.join(shards, ["depth", "prefix"]).select(F.col("h").alias(h), *results)
    return df.join(of, h).drop(h, b)


def write_shards(df: DataFrame, path: str) -> None:
    """One folder for each shard of a sharded ``df``; every shard is one task's work and one file."""
    parts = max(1, df.select("shard").distinct().count())
    df.repartition(parts, "shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, limit: int, key_col: str = "doc_id") -> DataFrame:
    """Documents by ``key_col``; those of one key that do not fit together are split by identifier and text, so that only
    equal rows and single large ones are above the limit."""
    row_id = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    rows = docs.select("doc_id", F.col(key_col).alias("key"), row_id.alias("row_id"), F.octet_length("text").cast("long").alias("n_bytes"))
    return shard(rows, limit, F.col("key"), F.col("row_id"), F.col("n_bytes")).select("doc_id", "shard", "shard_rows", "shard_bytes", "oversize")


def sql(limit: int, key_col: str) -> str:
    """For a table without repeated rows."""
    key, row_id = (f"(('0x' || substr(md5({x}), 1, 8))::UBIGINT >> 2)::BIGINT" for x in (f"coalesce({key_col}::VARCHAR, 'null')", "coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))"))
    return f"""
WITH rows AS (SELECT doc_id, coalesce(strlen(text), 0) AS b, ({key} << {ID_BITS}) | {row_id} AS h FROM documents),
up AS (SELECT doc_id, b, h, d, h >> ({BITS} - d) AS p FROM rows, range(0, {BITS} + 1) r(d)),
sums AS (SELECT d, p, sum(b) AS s, count(*) AS n, min(h) = max(h) AS one FROM up GROUP BY d, p),
ends AS (SELECT u.doc_id, min(u.d) AS d FROM up u JOIN sums s ON u.d = s.d AND u.p = s.p WHERE s.s <= {limit} OR s.one GROUP BY u.doc_id)
SELECT u.doc_id, CASE WHEN e.d = 0 THEN '' ELSE lpad(bin(u.p), e.d::INTEGER, '0') END AS shard,
       s.n::BIGINT AS shard_rows, s.s::BIGINT AS shard_bytes, s.s > {limit} AS oversize
FROM ends e JOIN up u ON u.doc_id = e.doc_id AND u.d = e.d JOIN sums s ON s.d = u.d AND s.p = u.p
"""

"""Exact dedup as a stateful stream.

Documents stream in; a keyed state in RocksDB, without watermark or expiry, retains for each digest the stable
identifier, the number of copies and a content locator (file and row of that copy). Copies are merged before they are
shuffled, so a text that a third of all rows share costs a row per task. Digests that were hit are then checked on the
full bytes: the least and the greatest text of a digest, and the one at its locator, must be the same. Rows of a digest
that differ, which only a collision gives, are grouped by the text itself. Rows whose digest was not hit are not moved.

Defined results: a null text counts as empty; texts are compared whole, after no change; of equal texts the row with the
largest identifier stays; null identifiers sort lowest; rows that repeat an identifier and text are one group, of which
each row is marked kept; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, may_match, scratch_path, spool

#: State on local disk with copies in the checkpoint; no space is reserved ahead, as there are many small stores.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _digest(text: Column, digest_bits: int) -> Column:
    full = F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))
    return full if digest_bits == 256 else F.substring(full, 1, digest_bits // 8)


LOCATOR = "concat_ws('#', _metadata.file_path, _metadata.row_index)"
STATE = "digest binary, last struct<doc_id: bigint, locator: string>, n bigint"


def _numbers(spark: SparkSession, folder: str, prefix: str, complete: bool = False) -> list[int]:
    """Numbers of the tables ``prefix``N in ``folder``; ``complete``: of those only that were written to their end."""
    if not exists(spark, folder):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [x.getPath().getName() for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    found = sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))
    return [n for n in found if exists(spark, f"{folder}/{prefix}{n}/_SUCCESS")] if complete else found


def _newest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of every digest. What several batches have changed is merged once and written, so that a later call reads
    that table and the batches after it."""
    merged = max(_numbers(spark, f"{checkpoint}/merged", "upto=", complete=True), default=-1)
    batches = [n for n in _numbers(spark, f"{checkpoint}/changed", "batch=") if n > merged]
    parts = [f"{checkpoint}/merged/upto={merged}"] * (merged >= 0) + [f"{checkpoint}/changed/batch={n}" for n in batches]
    if not parts:
        return spark.createDataFrame([], STATE)
    found = spark.read.schema(STATE).parquet(*parts)
    if len(parts) == 1:  # a batch names a digest once
        return found
    path = f"{checkpoint}/merged/upto={batches[-1]}"
    newest = found.groupBy("digest").agg(F.max(F.struct("n", "last")).alias("s"))
    newest.select("digest", "s.last", "s.n").write.mode("overwrite").parquet(path)
    return spark.read.schema(STATE).parquet(path)


def stream_state(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, checkpoint: str | None = None, **source) -> DataFrame:
    """``digest, doc_id, n, locator`` after all files of the Parquet table ``path`` went through the stream.

    With the ``checkpoint`` of an earlier call (a folder), only new files are read and the state goes on. ``source``:
    options of the file source, such as ``maxBytesPerTrigger``.
    """
    checkpoint = checkpoint or scratch_path(spark, "exact-dedup")
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    stream = spark.readStream.schema(schema).options(**source).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern: the path may be one file
    rows = stream.select(F.col(id_col).cast("long").alias("doc_id"), _digest(F.coalesce(F.col(text_col), F.lit("")), digest_bits).alias("digest"), F.expr(LOCATOR).alias("locator"))
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("last"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{checkpoint}/stream")
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{checkpoint}/changed/batch={batch}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return _newest(spark, checkpoint).select("digest", "last.doc_id", "n", "last.locator")


def exact_duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, **source) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, locator`` for every row of the Parquet table ``path``."""
    state = stream_state(spark, path, id_col, text_col, digest_bits, **source)
    hit = state.where("n > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), "locator")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    rows = spark.read.parquet(path).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.expr(LOCATOR).alias("own_locator"))
    rows = may_match(rows.withColumn("digest", _digest(F.col("text"), digest_bits)), F.col("digest"), hit, F.col("digest"), "near")
    marks = spool(rows.select("doc_id", "digest", sha.alias("text_sha256"), "own_locator", "near"), "marks")
    size, keep = F.coalesce("group_size", F.lit(1).cast("long")), F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = ["doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.coalesce("locator", "own_locator").alias("locator")]
    alone = marks.where("NOT near").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", F.col("own_locator").alias("locator"))
    near = marks.where("near").join(hit.hint("merge"), "digest", "left")
    # full bytes of the digests that were hit; a digest's copies are merged before they move
    bytes_of = rows.where("near").groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"), F.max(F.struct("doc_id", F.col("own_locator").alias("at"), "text")).alias("held"))
    same = F.expr("least = greatest AND held.text = least AND held.at = locator")
    differing = spool(bytes_of.join(hit.select("digest", "locator"), "digest").where(~same).select("digest"), "differing")
    if differing.isEmpty():
        return alone.unionByName(near.select(*out))
    true = rows.where("near").select("doc_id", "text", "digest").join(differing, "digest", "left_semi")
    groups = true.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    split = true.join(groups, "text").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"), F.lit(None).cast("string").alias("locator"))
    return alone.unionByName(near.join(differing, "digest", "left_anti").select(*out)).unionByName(split)

"""Shared helpers: the cluster's shared folder, lineage cuts and streaming Arrow batches through Python."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where the setting is absent and the master is this
    machine alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Gives the C library's free memory back to the machine; none where it has no such function.
_TRIM = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)


def release() -> None:
    """Free memory of this Python worker goes back to the machine, which the JVM of the executor shares."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: What the operator that runs in this Python worker keeps between tasks.
_held: dict = {}


def hold(key=None, make=None):
    """``make()``, kept for later tasks of this worker under ``key``; what another operator has kept is let go."""
    if key not in _held:
        _held.clear()
        release()
        if make:
            _held[key] = make()
            release()
    return _held.get(key)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def spool(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: no branch recomputes it, and a lost executor costs nothing.

    ``tasks``: that many at most, for tables known to be small.
    """
    path = scratch_path(df.sparkSession, name)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with underscores added until no column of ``df`` has the name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of the filter of ``may_match``: 256 bitmaps of 4 KB, whatever the input.
FILTER_BITS = 1 << 23


def may_match(rows: DataFrame, key: Column, keys: DataFrame, its_key: Column, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only where ``key`` is in no row of ``keys``.

    A broadcast filter of fixed size, so that rows without a partner need not be moved for the join that follows. With very
    many keys it lets more through, and the join decides.
    """
    bucket, bits = free_names(rows, "__bucket", "__bits")

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    made = keys.groupBy(F.bitmap_bucket_number(place(its_key)).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(its_key))).alias(bits))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = rows.withColumn(bucket, F.bitmap_bucket_number(place(key))).join(F.broadcast(made), bucket, "left")
    return on.withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(bucket, bits)


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 16 << 20):
    """``batch`` in runs of rows whose ``column`` holds about ``max_bytes`` at most (a single larger row stands alone). What
    their processing leaves free is released after each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(first, i - first)
            release()
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)
    release()

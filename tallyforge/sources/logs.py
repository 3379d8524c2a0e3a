"""Raw log files: lines, inventory and fingerprints."""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".log", ".gz")


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value, file``: one row per line of plain or gzip text. A gzip file cannot be split and is one task; deal its rows out
    (``repartition``) before heavy work if files are few and large."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def every_file(spark: SparkSession, root: str) -> DataFrame:
    """``path, modified, length`` of all files below ``root``, empty ones too, as the file system lists them. Paths are listed by
    the driver, contents are not read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    listed, rows = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while listed.hasNext():
        f = listed.next()
        if not f.getPath().getName().startswith(("_", ".")):
            rows.append((f.getPath().toString(), dt.datetime.fromtimestamp(f.getModificationTime() / 1000), f.getLen()))
    return spark.createDataFrame(rows, "path string, modified timestamp, length long")


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """``path, modified, length`` of all files below ``root`` with an extension (case ignored) changed in the days given."""
    files = every_file(spark, root)
    files = files.where(F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).isin([e.lower() for e in extensions]))
    if start:
        files = files.where(F.to_date("modified") >= F.lit(start))
    if end:
        files = files.where(F.to_date("modified") <= F.lit(end))
    return files


#: Bytes of the first block of a head or tail; doubled until it holds the lines.
BLOCK = 1 << 14


def head_and_tail(file, length: int, n: int = 25) -> tuple[bytes, bytes, int]:
    """The first and the last ``n`` lines of an open file that can seek, and the bytes read for them."""
    read, size = 0, min(BLOCK, length)
    while True:
        file.seek(0)
        head = file.read(size)
        read += len(head)
        if size == length or head.count(b"\n") >= n:
            break
        size = min(2 * size, length)
    size = min(BLOCK, length)
    while True:
        file.seek(length - size)
        tail = file.read(size)
        read += len(tail)
        if size == length or tail.count(b"\n") > n:  # one more, as the block begins inside a line
            break
        size = min(2 * size, length)
    return b"".join(io.BytesIO(head).readlines()[:n]), b"".join(io.BytesIO(tail).readlines()[-n:]), read


def fingerprint_of(content: bytes, n: int = 25) -> str:
    """MD5 of the first ``n`` lines, the size as text and the last ``n`` lines."""
    lines = io.BytesIO(content).readlines()
    return hashlib.md5(b"".join(lines[:n]) + str(len(content)).encode() + b"".join(lines[-n:])).hexdigest()


def fingerprint(spark: SparkSession, path: str, n: int = 25) -> DataFrame:
    """``path, length, hash, bytes_read`` of every file below ``path``, empty ones too: MD5 of the first ``n`` lines, the size and
    the last ``n`` lines, read by position, whatever the size of the file. For stores that pyarrow opens (local and mounted
    folders, hdfs, s3, gs); ``fingerprint_whole`` reads from any other."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            hashes, read = [], []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                system, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
                with system.open_input_file(name) as file:
                    head, tail, n_read = head_and_tail(file, length, n)
                hashes.append(hashlib.md5(head + str(length).encode() + tail).hexdigest())
                read.append(n_read)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(hashes, pa.string()), pa.array(read, pa.int64())], names=["path", "length", "hash", "bytes_read"])

    files = every_file(spark, path).select("path", "length")
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // 64)))
    return files.repartition(tasks).mapInArrow(run, "path string, length long, hash string, bytes_read long")


def fingerprint_whole(spark: SparkSession, path: str, n: int = 25) -> DataFrame:
    """As ``fingerprint``, through Spark's reader: any store, but whole files of at most 2 GB, and empty ones are not listed."""

    def run(batches):
        for batch in batches:
            hashes = [fingerprint_of(c.as_py(), n) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(hashes)], names=["path", "length", "hash"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")
    return files.mapInArrow(run, "path string, length long, hash string")

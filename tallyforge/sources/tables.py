"""Tables as text: TSV files and archives of them, robot lists, address ranges, settings."""

from __future__ import annotations

import csv
import io
import itertools
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.standardize import ip_to_number


def read_tsv(spark: SparkSession, path: str, sep: str = "\t", schema: str | T.StructType | None = None) -> DataFrame:
    """Columns by the header; all text without a schema."""
    reader = spark.read.option("sep", sep).option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_tsv_archive(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Rows of all ``*.csv`` members of tar.gz archives, with ``member``; columns by name, absent ones null, all text.

    Other files among ``path`` are read as plain TSV by their extension.
    """
    return unpack_archives(spark.read.format("binaryFile").load(path), columns, sep)


def unpack_archives(files: DataFrame, columns: list[str], sep: str = "\t", rows_each: int = 10_000) -> DataFrame:
    """As ``read_tsv_archive`` of files given as ``path, content``. An archive is one row and is unpacked member by member;
    its lines leave the task in runs of ``rows_each``."""
    names = [*columns, "member"]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if file.endswith((".tar.gz", ".tgz")):
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
                        for m in archive:
                            if m.isfile() and m.name.endswith(".csv"):
                                yield from lines(m.name, archive.extractfile(m))
                else:
                    yield from lines(file.rsplit("/", 1)[-1], io.BytesIO(content))

    def lines(member, raw):
        reader = csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline=""), delimiter=sep)
        while rows := list(itertools.islice(reader, rows_each)):
            yield pa.RecordBatch.from_arrays([*(pa.array([r.get(c) for r in rows], pa.string()) for c in columns), pa.array([member] * len(rows))], names=names)

    return files.select("path", "content").mapInArrow(run, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON list with both a pattern and a date; the latest date of each pattern."""
    rows = spark.read.schema("pattern string, last_changed string").json(path, multiLine=True)
    rows = rows.where("pattern is not null and last_changed is not null")
    return rows.groupBy("pattern").agg(F.max(F.try_to_date("last_changed")).alias("last_changed"))


def read_ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``start, end, country`` (numbers) from CSV rows of first address, last address, country."""
    rows = spark.read.schema("first string, last string, country string").csv(path, header=True)
    return rows.select(ip_to_number(F.col("first")).alias("start"), ip_to_number(F.col("last")).alias("end"), "country").where("start is not null and end is not null")


def snapshot_id(spark: SparkSession, path: str) -> DataFrame:
    """``path, id``: SHA-256 of each file's content."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("id"))


def load_settings(settings: DataFrame, collections: DataFrame) -> dict[str, DataFrame]:
    """The wide settings table as dimension tables; rows of unknown collections are skipped."""
    known = settings.join(collections.select(F.col("collection").alias("acronym")).distinct(), "acronym", "left_semi").withColumnRenamed("acronym", "collection")
    return {
        "directories": known.select("collection", "path", "directory_name").where("path is not null").distinct(),
        "files_per_day": known.select("collection", F.col("quantity").cast("int").alias("quantity"), F.try_to_date("start_date").alias("start_date"), F.try_to_date("end_date").alias("end_date")).where("quantity is not null").distinct(),
        "emails": known.select("collection", F.explode(F.split("e_mail", r"[;,]\s*")).alias("e_mail")).where("e_mail <> ''").distinct(),
        "validation": known.select("collection", F.col("sample_size").try_cast("double").alias("sample_size"), F.col("buffer_size").try_cast("int").alias("buffer_size")).where("sample_size is not null").distinct(),
        "translators": known.select("collection", F.col("path").alias("directory"), "translator_class").where("translator_class is not null").distinct(),
    }

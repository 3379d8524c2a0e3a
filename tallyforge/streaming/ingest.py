"""Incremental ingest, hourly sessions and micro-batch merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import MetricStore
from ..operators.metrics import ITEM, SESSION, Rules, click_keys


def stream_logs(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """``value, file`` of new text files; the checkpoint of the query is where it resumes."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("file"))


def stream_table(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New rows of a Parquet table (a folder, or one file)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to Parquet, exactly once, and stops."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_sessions(hits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Clicks and first and last time per client, item and clock hour; lines later than ``delay`` are dropped."""
    timed = hits.withColumn("time", F.col("local_datetime").cast("timestamp")).withWatermark("time", delay)
    by = timed.groupBy(F.window("time", "1 hour"), *SESSION, *ITEM).agg(F.count("*").alias("n_clicks"), F.min("time").alias("first"), F.max("time").alias("last"))
    return by.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), *SESSION, *ITEM, "n_clicks", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


def distinct_files(files: DataFrame, delay: str = "7 days", time: str = "modified") -> DataFrame:
    """The first file of each hash; hashes are remembered for ``delay``."""
    return files.withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into_store(hits: DataFrame, raw_path: str, store: MetricStore, checkpoint: str, documents_of: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Keeps each batch's hits by collection, day and batch number and recomputes the days that it touches from all hits
    kept of those days, so that a batch that runs twice changes nothing. No other days are read. Hits without a collection
    or time are left out."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"date": F.to_date("local_datetime"), "batch": F.lit(number)}).where("collection is not null and date is not null")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "date", "batch").parquet(raw_path)
        days = rows.select("collection", "date").distinct().collect()  # of one batch
        if not days:
            return
        escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        kept = spark.read.schema(rows.schema).option("basePath", raw_path).parquet(*[f"{raw_path}/collection={escape(c)}/date={d}" for c, d in days])
        store.replace_days(documents_of(kept.drop("batch", "date")), spark.createDataFrame(days, "collection string, date date"))

    return for_each_batch(hits, work, checkpoint)


def stream_kept_clicks(hits: DataFrame, rules: Rules = Rules(), delay: str = "1 hour", seq: str = "seq") -> DataFrame:
    """The double-click filter in stream state: one row for each run of clicks of a session and item of which each follows the
    one before within the gap, with ``second`` (of the last click, the one that counts), ``n_clicks`` and ``is_request``.

    A run is a session window of the clicks' seconds; its state is an aggregate, whatever a robot does, and is given out when
    the watermark has passed it. Hits of a run may come in any order and batch within ``delay``; later ones are dropped.
    """
    hits, keys = click_keys(hits, rules)
    timed = hits.withColumn("time", F.col("second").cast("timestamp")).withWatermark("time", delay)
    runs = timed.groupBy(F.session_window("time", f"{1000 * rules.gap_seconds + 500} milliseconds"), *keys).agg(
        F.count("*").alias("n_clicks"),
        F.max("second").alias("second"),
        F.max_by(F.col("content_type").isin(*rules.request_types), F.struct("second", seq)).alias("is_request"),
    )
    return runs.select(*keys, "second", "n_clicks", "is_request")

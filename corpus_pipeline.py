"""From documents to packed training sequences: language ID, line dedup, near-dedup, packing.

Each stage is a function (spark, docs, sf_dir) whose result is written and read again as the next one's ``docs``. Stages
return the columns of ``docs`` as they were, whatever other columns there are and however they are called; the last one
returns pieces. Each takes an empty table to an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import langid, lines, packing, simhash
from tallyforge.llm.common import free_names, spool
from tallyforge.llm.queries import vocabulary


def _apart(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage(docs)`` with the columns of ``docs`` alone; those named like the stage's own columns step aside meanwhile."""
    clashing = [c for c in docs.columns if c.lower() in names]
    aside = dict(zip(clashing, free_names(docs.select("*", *[F.lit(0).alias(n) for n in names if n not in docs.columns]), *clashing)))
    return stage(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language cannot be told: no letter (so null and empty texts go), or two codewords about
    as near. The classifier learns from the rows of ``docs`` outside the held-out fifth; without any labelled row all go.
    Repeated rows are judged alike and all stay or go; a null doc_id counts as an empty text for the fold."""

    def stage(rows: DataFrame) -> DataFrame:
        return langid.predict(rows, langid.fit_on_documents(rows)).where(~F.col("ambiguous"))

    return _apart(docs, ("lang_pred", "score", "ambiguous"), stage)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of three-line windows; n_chars follows a text that changes. All rows stay, null and empty
    texts and those with a null doc_id as they are; rows that repeat a doc_id lose the same lines."""

    def stage(rows: DataFrame) -> DataFrame:
        out = lines.remove_repeated_lines(rows)
        chars = F.when(F.col("removed_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
        return out.withColumn("n_chars", chars)

    return _apart(docs, ("removed_lines",), stage)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word similarity of 0.8 or more): the smallest doc_id, null last, and
    of repeated rows one. Null and empty texts are one group."""
    return simhash.keep_one_of_each(docs)


#: Smaller word caches than by default: after the shuffles of the other stages the JVM holds most of an executor's memory.
CACHE = (150_000, 200_000)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece; a null or empty text is its end id, repeated rows are packed
    one by one."""
    return packing.pack_documents(docs, vocabulary(), cache=CACHE)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pack", pack)]

#: SQL has no trigram classifier, fingerprint linking or tokenizer; tests/llm/test_stages.py holds each stage's rows against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name)
    return docs

"""Filters, searches, orderings and pages."""

from __future__ import annotations

import datetime as dt
from functools import reduce

import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .literals import ascii_lower, pieces_of, required_literal

NOT_FOUND_STATUS = ("CRE", "INV")
PREFERRED_LANGUAGES = ("pt", "es", "en")


#: Spellings of named groups in other dialects, and what they are in Java.
DIALECT = ((r"\(\?P<", r"(?<"), (r"\(\?P=(\w+)\)", r"\\k<$1>"))
#: Code points of a pattern's literal that agents are met by; and so many patterns are broadcast.
LITERAL, BROADCAST = 64, 100_000


def compiled_patterns(robots: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """The list's distinct patterns as ``given``, ``pattern`` (as Java reads them) and ``good``: whether it can compile them."""
    rows = robots.select(F.col(pattern_col).alias("given")).where("given is not null").distinct()
    own = reduce(lambda x, d: F.regexp_replace(x, *d), DIALECT, F.col("given"))
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("(?i)"), "pattern"))
    return rows.withColumn("pattern", own).withColumn("good", compiled.isNotNull())


def robot_patterns(robots: DataFrame, pattern_col: str = "pattern") -> tuple[list[str], dict[str, str]]:
    """The list's patterns, as Java reads them; and those that it cannot compile, with the reason. Both are read to the driver,
    for a report; ``without_robots`` leaves them where they are."""
    compiler = robots.sparkSession.sparkContext._jvm.java.util.regex.Pattern
    good, bad = [], {}
    for given, pattern, fits in compiled_patterns(robots, pattern_col).orderBy("given").collect():
        if fits:
            good.append(pattern)
            continue
        try:
            compiler.compile(f"(?i){pattern}")
        except IllegalArgumentException as error:
            bad[given] = str(error).split("\n")[0]
    return good, bad


def _with_literals(patterns: DataFrame) -> DataFrame:
    """``pattern, literal``: what an agent must contain, A-Z folded."""

    def run(batches):
        for batch in batches:
            literals = [ascii_lower(required_literal(p))[:LITERAL] for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(literals, pa.string())], names=["pattern", "literal"])

    return patterns.select("pattern").mapInArrow(run, "pattern string, literal string")


def robot_agents(agents: DataFrame, patterns: DataFrame) -> DataFrame:
    """Those of ``agents`` (one string column) that a pattern (column ``pattern``) matches, each once.

    Every pattern is tried only on agents that contain the literal that its matches must contain, found by an equi-join of the
    literals with the agents' pieces of the literals' lengths; those without such a literal are tried on all. An agent that
    occurs in many lines is tried once. At most 65 numbers reach the driver.
    """
    name = agents.columns[0]
    distinct = agents.distinct()
    rows = _with_literals(patterns)
    counts = dict(rows.groupBy(F.char_length("literal")).count().collect())
    few = F.broadcast if sum(counts.values()) <= BROADCAST else lambda df: df
    matches = F.rlike("text", F.concat(F.lit("(?i)"), "pattern"))
    pieces = pieces_of(distinct, sorted(set(counts) - {0}), fold=True)
    found = pieces.join(few(rows.where("literal <> ''")), F.col("piece") == F.col("literal")).where(matches).select("text")
    if counts.get(0):
        every = distinct.select(F.col(name).alias("text")).where("text is not null")
        found = found.union(every.join(few(rows.where("literal = ''")), matches, "left_semi"))
    return found.select(F.col("text").alias(name)).distinct()


def without_robots(lines: DataFrame, robots: DataFrame, agent_col: str = "user_agent", pattern_col: str = "pattern") -> DataFrame:
    """Lines whose agent matches no pattern (case ignored); a null agent stays. Patterns that cannot be compiled are left out:
    ``robot_patterns`` gives them."""
    patterns = compiled_patterns(robots, pattern_col).where("good").select("pattern").distinct()
    return lines.join(robot_agents(lines.select(agent_col), patterns), agent_col, "left_anti").select(*lines.columns)


def select_work(files: DataFrame, start: dt.date, end: dt.date, replace: bool = False, errors: bool = True) -> DataFrame:
    """Files to parse: queued, with those in error and those done if asked, with a probable date in the range."""
    status = ["QUE"] + ["ERR"] * errors + ["PRO"] * replace
    return files.where(F.col("status").isin(status) & F.col("probable_date").between(F.lit(start), F.lit(end)))


def visible_files(files: DataFrame, start: dt.date, end: dt.date, changed: str = "modified") -> DataFrame:
    return files.where(F.to_date(changed).between(F.lit(start), F.lit(end)))


def found_files(files: DataFrame) -> DataFrame:
    """Files that count as found: neither just created nor invalid."""
    return files.where(~F.col("status").isin(*NOT_FOUND_STATUS))


def metadata(table: DataFrame, cols: list[str], collection: str | None = None) -> DataFrame:
    """Chosen columns of one collection; both reach the scan."""
    rows = table if collection is None else table.where(F.col("collection") == collection)
    return rows.select(*cols)


def facet_filter(df: DataFrame, **equal) -> DataFrame:
    return reduce(lambda d, x: d.where(F.col(x[0]).eqNullSafe(F.lit(x[1]))), equal.items(), df)


def text_of(df: DataFrame, c: str) -> Column:
    """Column ``c`` as it is searched: arrays, maps and structs as JSON."""
    kind = df.schema[c].dataType
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.col(c).cast("string")


def search(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows of which any field contains the text, case ignored. Reads every row; ``grams.GramIndex`` does not."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(text_of(df, c)).contains(query.lower()), F.lit(False)) for c in fields])
    return df.where(hit)


def retain_events(events: DataFrame, delete_all: bool = False, type_contains: str | None = None, start=None, end=None, type_col: str = "event_type", created: str = "created") -> DataFrame:
    """What remains after deleting all, or those of a type (case ignored) created within the bounds."""
    if delete_all:
        return events.limit(0)
    gone = F.lit(True)
    if type_contains:
        gone = gone & F.lower(type_col).contains(type_contains.lower())
    if start is not None:
        gone = gone & (F.col(created) >= F.lit(start))
    if end is not None:
        gone = gone & (F.col(created) <= F.lit(end))
    return events.where(~F.coalesce(gone, F.lit(False)))


def publication_window(df: DataFrame, start: dt.date, end: dt.date, col: str = "published") -> DataFrame:
    """Undated rows stay."""
    return df.where(F.col(col).isNull() | F.col(col).between(F.lit(start), F.lit(end)))


def newest_first(df: DataFrame, created: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(created), F.desc(tie))


def by_name(df: DataFrame, name: str, tie: str) -> DataFrame:
    return df.orderBy(name, tie)


def page(df: DataFrame, order: list, number: int, size: int = 1000) -> DataFrame:
    """Page ``number`` (from 1) of rows in a total order, for first pages; ``ordered.Pages`` is for any."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def preferred_language(df: DataFrame, keys: list[str], lang_col: str, wanted: str | None = None) -> DataFrame:
    """One row per key: the wanted language, else pt, es, en, else the first by name."""
    order = [x for x in (wanted, *PREFERRED_LANGUAGES) if x]
    rank = F.lit(len(order))
    for i, x in reversed(list(enumerate(order))):
        rank = F.when(F.col(lang_col) == x, i).otherwise(rank)
    row = F.row_number().over(W.partitionBy(*keys).orderBy(rank, F.col(lang_col).asc_nulls_last()))
    return df.withColumn("__rank", row).where("__rank = 1").drop("__rank")

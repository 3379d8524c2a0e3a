"""Checks of a table against column rules: ``check_table`` gives message, row_id and column of every error."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.standardize import strip

TRUE_FALSE = ("yes", "no", "y", "n", "true", "false", "t", "f", "1", "0")
#: Date patterns that are tried when none is given; a full stop or comma after a month's name or a day has gone before.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "M/d/yy", "d-M-yyyy", "d.M.yyyy", "yyyyMMdd", "yyyy",
    *(f.replace("MMM", m) for m in ("MMM", "MMMM") for f in ("d MMM yyyy", "MMM d yyyy", "MMM yyyy", "MMM-yyyy")),
)
TIME_FORMATS = ("H:m:s", "H:m", "HHmm", "h:m:s a", "h:m a")


@dataclass(frozen=True)
class Rule:
    """``kind``: string, integer, float, bool, date or datetime. Length and pattern hold for strings."""

    column: str
    kind: str = "string"
    column_required: bool = True
    value_required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    formats: tuple[str, ...] = field(default=())


WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"


#: What the letters of a date pattern stand for in a text.
SHAPES = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]{3,}", "MMM": "[A-Za-z]{3}", "a": "[AaPp][Mm]"}


def _shape(pattern: str) -> str:
    """A regular expression that every text of the date pattern meets, and few others."""
    parts = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z]+)", pattern)
    tokens = [(a + more, other) for a, more, other in parts]
    return "^" + "".join(re.escape(other) if other else SHAPES.get(t) or (r"\d{2}" if len(t) == 2 else r"\d{1,2}") for t, other in tokens) + "$"


def _cleaned(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, WEEKDAY, ""), r"(?<=[A-Za-z])\.?,?(?=[ -])|(?<=\d),(?= )", "")


def _parsed(x: Column, formats: tuple[str, ...]) -> Column:
    """The time of the first of our own patterns that reads the text. A pattern is tried only where the text has its shape."""
    return F.coalesce(*[F.when(x.rlike(_shape(f)), F.try_to_timestamp(x, F.lit(f))) for f in formats])


def _is_date(x: Column, formats: tuple[str, ...]) -> Column:
    if formats:
        return F.coalesce(*[F.try_to_timestamp(_cleaned(x), F.lit(f)) for f in formats]).isNotNull()
    return _parsed(_cleaned(x), DATE_FORMATS).isNotNull()


def _is_datetime(x: Column, formats: tuple[str, ...]) -> Column:
    """A date, or a day and a time after a space or a T."""
    if formats:
        return _is_date(x, formats)
    x = _cleaned(x)
    day, time = (F.regexp_extract(x, r"^(.*\S)[ T](\d\S*(?: [AaPp][Mm])?)$", i) for i in (1, 2))
    both = _parsed(day, tuple(f for f in DATE_FORMATS if "d" in f)).isNotNull() & _parsed(time, TIME_FORMATS).isNotNull()
    return _parsed(x, (*DATE_FORMATS, "MMM d H:m:s yyyy")).isNotNull() | both


def problems(rule: Rule) -> list[Column]:
    """A message where the check fails, else null. Blank values fail only where a value is required."""
    value = F.coalesce(F.col(rule.column).cast("string"), F.lit(""))
    text = strip(value)
    found = [(F.char_length(value) == 0, "missing value")] if rule.value_required else []
    if rule.kind == "string":
        if rule.min_length is not None:
            found.append(((value != "") & (F.char_length(value) < rule.min_length), "too short"))
        if rule.max_length is not None:
            found.append((F.char_length(value) > rule.max_length, "too long"))
        if rule.pattern:
            found.append(((value != "") & ~value.rlike(f"^(?:{rule.pattern})"), "pattern does not match"))
    elif rule.kind == "integer":
        found.append(((text != "") & ~text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), "not an integer"))
    elif rule.kind == "float":
        found.append(((text != "") & text.try_cast("double").isNull(), "not a number"))
    elif rule.kind == "bool":
        found.append(((text != "") & ~F.lower(text).isin(*TRUE_FALSE), "not a boolean"))
    elif rule.kind == "date":
        found.append(((text != "") & ~_is_date(text, rule.formats), "not a date"))
    elif rule.kind == "datetime":
        found.append(((text != "") & ~_is_datetime(text, rule.formats), "not a date and time"))
    else:
        raise ValueError(f"no such kind: {rule.kind}")
    return [F.when(bad, F.lit(message)) for bad, message in found]


def check_columns(df: DataFrame, rules: list[Rule], extra_allowed: bool = True, ignore_case: bool = False) -> list[tuple[str, str]]:
    """(message, column) of missing and, if not allowed, extra columns."""
    fold = str.lower if ignore_case else str
    have, want = {fold(c) for c in df.columns}, {fold(r.column) for r in rules}
    out = [("missing column", r.column) for r in rules if r.column_required and fold(r.column) not in have]
    return out + ([] if extra_allowed else [("extra column", c) for c in df.columns if fold(c) not in want])


def check_table(df: DataFrame, rules: list[Rule], row_id: str, extra_allowed: bool = True, ignore_case: bool = False, first_only: bool = False) -> DataFrame:
    """All errors, or the first by row. One pass over the table whatever the number of rules."""
    kind = "message string, row_id string, column string"
    schema_errors = check_columns(df, rules, extra_allowed, ignore_case)
    fold = str.lower if ignore_case else str
    have = {fold(c) for c in df.columns}
    each = [F.when(m.isNotNull(), F.struct(m.alias("message"), F.lit(r.column).alias("column"))) for r in rules if fold(r.column) in have for m in problems(r)]
    out = df.sparkSession.createDataFrame([(m, None, c) for m, c in schema_errors], kind)
    if each:
        errors = df.select(F.col(row_id).cast("string").alias("row_id"), F.explode(F.array_compact(F.array(*each))).alias("e"))
        out = out.union(errors.select("e.message", "row_id", "e.column"))
    if first_only:
        number = F.col("row_id").try_cast("decimal(38,0)")
        out = out.orderBy(F.col("row_id").isNotNull(), number, "row_id", "column", "message").limit(1)
    return out


def check_widths(lines: DataFrame, width: int, separator: str = ",", value_col: str = "value") -> DataFrame:
    """Lines with fewer or more values than columns; quoted separators are no borders; blank lines are skipped."""
    sep = "\\" + separator if separator in "|.*+?^$()[]{}\\" else separator
    bare = F.regexp_replace(F.col(value_col), '"[^"]*"', "")
    n = F.size(F.split(bare, sep, -1))
    message = F.when(n < width, "fewer values than columns").when(n > width, "more values than columns")
    return lines.where(strip(F.col(value_col)) != "").select("*", n.alias("n_values"), message.alias("message")).where("message is not null")


def count_errors(errors: DataFrame) -> DataFrame:
    return errors.groupBy("column", "message").agg(F.count("*").alias("n"))

"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines that are not blank is hashed. A window that occurs more than once, in one document
or many, has its first occurrence (smallest document, then place) kept; the lines that its later occurrences cover are
removed, and overlapping occurrences remove the union of their lines. All in built-in functions: occurrences of a window
are merged before they are shuffled, and only documents that may lose lines are moved to what they lose.

Defined results: lines end at a line feed; blank lines (white space only) belong to no window and always stay; documents
of fewer than three other lines stay as they are, empty and null texts too; rows that share an identifier are one
document whose windows count once, and lose the same lines; rows with a null identifier stay as they are; an empty table
gives an empty one; all other columns pass through, and helper columns start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, may_match, spool

#: A window's hash: 128 bits, as 64 are too few for more than some billions of windows.
HASHES = "xxhash64({0}) AS h1, xxhash64('second', {0}) AS h2"


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id, pos, at, h1, h2``: each window's first place among the lines that count, their places in the text, its hash."""
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).contains("\n")).select(
        F.col(id_col).cast("long").alias("id"),
        F.expr(f"filter(transform(split({_quoted(text_col)}, '\\n', -1), (x, i) -> struct(i AS i, x AS x)), l -> l.x rlike '\\\\S')").alias("l"),
    )
    lines = lines.where(F.size("l") >= size)
    each = ", ".join(f"l[p + {k}].x" for k in range(size))
    spans = F.expr(f"transform(sequence(0, size(l) - {size}), p -> struct(l[p].i AS first, l[p + {size - 1}].i AS last, transform(slice(l, p + 1, {size}), y -> y.i) AS at, {HASHES.format(each)}))")
    return lines.select("id", F.posexplode(spans).alias("pos", "w")).select("id", F.col("w.first").alias("pos"), "w.at", "w.h1", "w.h2")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id, removed``: places (from 0, sorted) of the lines that each document loses."""
    found = windows(docs, id_col, text_col, size)
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("first"), F.max(F.struct("id", "pos")).alias("last"))
    first = first.where("first <> last").drop("last")
    later = found.join(first, ["h1", "h2"]).where("struct(id, pos) <> first").select("id", F.explode("at").alias("i"))
    return later.groupBy("id").agg(F.array_sort(F.collect_set("i")).alias("removed"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` shortened and a column ``removed_lines`` (replaced if it exists)."""
    own, gone, near = free_names(docs, "__id", "__removed", "__near")
    lost = spool(repeated_lines(docs, id_col, text_col, size), "lost-lines").select(F.col("id").alias(own), F.col("removed").alias(gone))
    key = F.col(id_col).cast("long")
    flagged = may_match(docs, key, lost, F.col(own), near)
    rest = F.expr(f"array_join(filter(split({_quoted(text_col)}, '\\n', -1), (x, i) -> NOT array_contains({gone}, i)), '\\n')")
    hit = flagged.where(near).join(lost.hint("merge"), key == F.col(own), "left")
    shorter = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest)
    hit = hit.withColumn(text_col, shorter).withColumn("removed_lines", F.coalesce(F.size(gone), F.lit(0)).cast("long")).drop(own, gone)
    return flagged.where(~F.col(near)).withColumn("removed_lines", F.lit(0).cast("long")).unionByName(hit).drop(near)


def report(docs: DataFrame) -> DataFrame:
    out = remove_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "removed_lines", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, u.i AS i, u.x AS x, row_number() OVER (PARTITION BY doc_id ORDER BY u.i) AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x})) AS u
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
  WHERE regexp_matches(u.x, '[^\\t\\n\\x0B\\f\\r ]')),
spans AS (
  SELECT doc_id, i AS a, lead(i) OVER w AS b, lead(i, 2) OVER w AS c,
         x || chr(10) || lead(x) OVER w || chr(10) || lead(x, 2) OVER w AS s
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, a) AS n FROM spans WHERE s IS NOT NULL),
lost AS (
  SELECT doc_id, list(DISTINCT i) AS gone
  FROM (SELECT doc_id, unnest([a, b, c]) AS i FROM ranked WHERE n > 1) GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, coalesce(len(l.gone), 0) AS removed_lines,
         CASE WHEN l.gone IS NULL THEN coalesce(d.text, '')
              ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(l.gone, i)), chr(10)) END AS t
  FROM documents d LEFT JOIN lost l ON d.doc_id = l.doc_id)
SELECT doc_id, removed_lines::BIGINT AS removed_lines, length(t)::BIGINT AS n_chars, sha256(t) AS text_sha256 FROM kept
"""

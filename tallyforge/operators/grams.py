"""An index of three-letter pieces for searches in texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import search, text_of

#: Pieces of a query whose lists are intersected: the rarest ones.
RAREST = 4


#: Letters that a task sorts at once; a longer text is cut into overlapping parts.
LETTERS = 1 << 20


def _runs(texts: Iterable[str], rows: Iterable[int]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts and their rows in runs of about ``LETTERS`` letters."""
    held, at, n = [], [], 0
    for text, row in zip(texts, rows):
        for first in range(0, len(text) - 2, LETTERS):
            held.append(text[first : first + LETTERS + 2])
            at.append(row)
            n += len(held[-1])
            if n >= LETTERS:
                yield held, at
                held, at, n = [], [], 0
    if held:
        yield held, at


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a run of texts by their runs of three code points."""
    for batch in batches:
        ids, texts = batch.columns
        for held, at in _runs(texts.flatten().to_pylist(), pc.list_parent_indices(texts).to_pylist()):
            letters = np.frombuffer("".join(held).encode("utf-32-le"), "<u4").astype(np.int64)
            lengths = [len(text) for text in held]
            text, row = np.repeat(np.arange(len(held)), lengths), np.repeat(at, lengths)
            whole = text[2:] == text[:-2]
            codes, row = (letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])[whole], row[:-2][whole]
            order = np.argsort(codes, kind="stable")  # rows rise already
            codes, row = codes[order], row[order]
            other = np.append(True, codes[1:] != codes[:-1])
            first = other | np.append(True, row[1:] != row[:-1])
            starts = np.flatnonzero(other[first])
            codes, row = codes[first], row[first]
            own = codes[starts]
            joined = np.stack([own >> 42, own >> 21 & 0x1FFFFF, own & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
            pieces = pa.array([joined[i : i + 3] for i in range(0, len(joined), 3)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), ids.take(pa.array(row)))
            yield pa.RecordBatch.from_arrays([pieces, lists], names=["piece", "ids"])


class GramIndex:
    """Lists of the ids of rows by the pieces of three letters in their ``fields``, as files sorted by piece under ``path``; a
    file has the lists of one task's rows.

    ``add`` indexes rows under the name of a load; the same name again replaces that load's rows, so a retry is safe. A search
    gives the rows of ``filters.search`` among those indexed, with equal ids all of them; a query below three letters reads every row.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str]):
        self.spark, self.path, self.key, self.fields = spark, path.rstrip("/"), key, fields

    def add(self, rows: DataFrame, load: str) -> None:
        name = hashlib.sha256(load.encode()).hexdigest()[:16]
        texts = F.array(*[F.coalesce(text_of(rows, c), F.lit("")) for c in self.fields])
        # rows are dealt, not their many pieces: each task sorts the lists of its own rows
        dealt = rows.select(F.col(self.key).alias("id"), texts.alias("texts")).repartition(F.xxhash64("id", "texts"))
        schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("ids", T.ArrayType(rows.schema[self.key].dataType))])
        lists = dealt.select("id", F.transform("texts", F.lower).alias("texts")).mapInArrow(_lists, schema)
        lists.sortWithinPartitions("piece").write.mode("overwrite").parquet(f"{self.path}/lists/load={name}")
        written = self.spark.read.schema(schema).parquet(f"{self.path}/lists/load={name}")
        written.groupBy("piece").agg(F.sum(F.size("ids").cast("long")).alias("n")).sort("piece").write.mode("overwrite").parquet(f"{self.path}/sizes/load={name}")

    def candidates(self, query: str) -> DataFrame | None:
        """Ids whose texts hold the rarest pieces of ``query``; None for a query without a piece."""
        low = query.lower()
        pieces = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        if not pieces:
            return None
        sizes = self.spark.read.parquet(f"{self.path}/sizes").where(F.col("piece").isin(pieces)).groupBy("piece").agg(F.sum("n").alias("n")).collect()
        known = {r.piece: r.n for r in sizes}
        rarest = sorted(pieces, key=lambda p: known.get(p, 0))[:RAREST]
        lists = self.spark.read.parquet(f"{self.path}/lists").where(F.col("piece").isin(rarest))
        which = reduce(lambda bits, i: F.when(F.col("piece") == rarest[i], 1 << i).otherwise(bits), range(len(rarest)), F.lit(0))
        found = lists.select(which.alias("bit"), F.explode("ids").alias("id")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
        return found.where(F.col("bits") == (1 << len(rarest)) - 1).select("id")

    def search(self, df: DataFrame, query: str) -> DataFrame:
        found = self.candidates(query)
        rows = df if found is None else df.join(found, df[self.key].eqNullSafe(found.id), "left_semi")
        return search(rows, query, self.fields)

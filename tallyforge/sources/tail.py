"""A streaming source of growing text files: lines that are added to a known file are read, each once.

The offset of a batch is a byte position for each file, always behind a line end; what follows the last line end waits
until its line is complete. So a query that stops inside a file goes on there, whatever was added meanwhile. Long additions
are cut into ranges of BYTES; a line belongs to the range in which it begins. A task reads one range, or a run of them where a
batch has more than TASKS and they are short, so that many small files do not become as many tasks.

A file that has become shorter is a new one under the old name and is read from its beginning. Compressed files cannot be
continued: ``ingest.stream_logs`` reads those as a whole. An offset holds every file of the folder, so very many finished
files belong in other folders. The folder is on a store that pyarrow opens (local and mounted folders, hdfs, s3, gs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tailed_lines"
#: Of a range; and of a block that is searched for a line end.
BYTES, BLOCK = 64 << 20, 1 << 16
#: Of a batch whose ranges are short; and files that the driver looks into at once.
TASKS, LOOKS = 64, 16


def line_end(file, start: int, end: int) -> int:
    """The position behind the last line end of the bytes from ``start`` to ``end``; ``start`` if there is none."""
    at = end
    while at > start:
        size = min(BLOCK, at - start)
        file.seek(at - size)
        found = file.read(size).rfind(b"\n")
        if found >= 0:
            return at - size + found + 1
        at -= size
    return start


@dataclass
class Range(InputPartition):
    """Lines that begin from ``start`` on and before ``end``; ``first``: a line begins at ``start``."""

    path: str
    start: int
    end: int
    first: bool
    bytes_each: int = BLOCK


@dataclass
class Run(InputPartition):
    """Ranges that one task reads, one after the other."""

    parts: list[Range]


def runs_of(parts: list[Range], most: int = BYTES) -> list[Run]:
    """``parts`` in their order, in at most TASKS runs of about equal length; in more, of about ``most`` bytes, if they are long."""
    each = min(max(1, sum(p.end - p.start for p in parts) // TASKS), most)
    out, size = [], each
    for part in parts:
        if size >= each:
            out.append(Run([]))
            size = 0
        out[-1].parts.append(part)
        size += part.end - part.start
    return out


def ranges_of(path: str, start: int, end: int, each: int) -> list[Range]:
    return [Range(path, at, min(at + each, end), at == start) for at in range(start, end, each)]


def lines_of(file, part: Range) -> Iterator[tuple[int, bytes]]:
    """(position, line without its end) of a range; the last line is read beyond it."""
    at = part.start - (not part.first)  # a line that begins at ``start`` follows a line end
    file.seek(at)
    rest, skip = b"", not part.first
    while at < part.end or rest:
        block = file.read(part.bytes_each)
        if not block:
            return
        whole = rest + block
        begin = 0
        while (end := whole.find(b"\n", begin)) >= 0:
            if skip:
                skip = False
            elif at + begin >= part.end:
                return
            else:
                yield at + begin, whole[begin:end].removesuffix(b"\r")
            begin = end + 1
        if at + begin >= part.end:
            return
        at, rest = at + begin, whole[begin:]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix = options["path"], options.get("suffix", ".log")
        self.each = int(options.get("bytes", BYTES))
        self.known: dict[str, int] = {}

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(re.sub(r"^(file:)?/(?!/)", "file:///", self.root))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = self._system()
        found = [f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if f.is_file and f.path.endswith(self.suffix)]

        def end(f: fs.FileInfo) -> int:
            before = self.known.get(f.path, 0)
            before = before if before <= f.size else 0
            if before == f.size:
                return before
            with system.open_input_file(f.path) as file:
                return line_end(file, before, f.size)

        with ThreadPoolExecutor(LOOKS) as looks:
            self.known = dict(zip([f.path for f in found], looks.map(end, found)))
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Run]:
        out = []
        for path, until in sorted(end.items()):
            begin = start.get(path, 0)
            out += ranges_of(path, begin if begin <= until else 0, until, self.each)
        return runs_of(out)

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        rows = []
        for path, parts in groupby(run.parts, key=lambda part: part.path):
            with system.open_input_file(path) as file:
                for part in parts:
                    for at, line in lines_of(file, part):
                        rows.append((line.decode("utf-8", "replace"), path, at))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["value", "file", "position"])


class TailedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string, file string, position long"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def stream_tail(spark: SparkSession, path: str, suffix: str = ".log", bytes_each: int = BYTES) -> DataFrame:
    """``value, file, position`` of complete lines below ``path``; the checkpoint of the query is where it resumes."""
    spark.dataSource.register(TailedLines)
    return spark.readStream.format(NAME).option("path", path).option("suffix", suffix).option("bytes", bytes_each).load()

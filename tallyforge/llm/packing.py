"""Best-fit packing of tokenised documents into sequences of fixed length.

A document is its ids and an end id. Only longer documents are cut, into full pieces and a last one; a full piece is a
sequence by itself. The others are dealt by a hash, so that every task sees the same mix of lengths, and packed online: a
task takes its pieces in runs of fixed size, the longest of a run first, keeps a fixed number of open sequences (over all
its runs) in a bitset keyed by free space, puts each piece where the least space stays free, and closes the fullest when
one too many is open.

Defined results: a null text counts as empty and is its end id alone; texts are read whole; rows are independent, so
repeated rows are packed one by one; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE, Encoder, byte_symbols, encoder, read_vocabulary
from .common import record_batch, slices, spool

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: And a number that tells repeated rows apart, so that they are dealt out as others are.
NUMBERED = PIECES.append(pa.field("number", pa.int64()))


class LibraryEncoder(Encoder):
    """The same ids with the words merged by the tokenizers library's model."""

    def __init__(self, source: str, cache: tuple[int, int] = CACHE):
        from tokenizers import Tokenizer

        self.library, self.symbols = Tokenizer.from_str(source), byte_symbols()
        super().__init__(source, cache)

    def merge_words(self, words: list[str]) -> list[bytes]:
        # the model takes a normalised word in the symbols of its bytes, which are the characters of printable ASCII
        tokenize, out = self.library.model.tokenize, []
        for word in words:
            if not (word.isascii() and word.isprintable()):
                word = "".join([self.symbols[b] for b in word.encode("utf-8", "replace")])
            out.append(array("I", [t.id for t in tokenize(word)]).tobytes())
        return out


def cut_pieces(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache: tuple[int, int] = CACHE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit
    integers), and its number among those of the task."""
    source, end = read_vocabulary(docs, vocabulary), end_id.to_bytes(4, "little")

    def run(batches):
        coder, number = encoder(source.value, LibraryEncoder, cache), 0
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                out = {f.name: [] for f in NUMBERED}
                for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")).to_pylist()):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * length)):
                        some = ids[at : at + 4 * length]
                        for name, value in zip(NUMBERED.names, (doc, piece, at // 4, len(some) // 4, zlib.crc32(some), number)):
                            out[name].append(value)
                        number += 1
                yield record_batch(NUMBERED, out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, number long")


class OpenSequences:
    """At most ``most`` open sequences, found by free space through one bit for each amount that occurs."""

    def __init__(self, length: int, most: int, first_id: int):
        self.most, self.next_id, self.open, self.bits = most, first_id, 0, 0
        self.length, self.by_space = length, [[] for _ in range(length + 1)]

    def take(self, space: int) -> int:
        found = self.by_space[space].pop()
        self.open -= 1
        if not self.by_space[space]:
            self.bits ^= 1 << space
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        if fits := self.bits >> size:
            space = size + (fits & -fits).bit_length() - 1
            sequence = self.take(space)
        else:
            space, sequence, self.next_id = self.length, self.next_id, self.next_id + 1
        if left := space - size:
            if self.open == self.most and size < self.length:
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest is closed
            self.by_space[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.length - space


def pack(pieces: DataFrame, length: int = 2048, open_sequences: int = 4096, run_pieces: int = 8192, pieces_per_task: int = 200_000) -> DataFrame:
    """``pieces`` (with ``length`` of 1 to ``length``) with sequence_id and offset.

    ``pieces`` is read twice, once for its count: pass a written table. Sequences are numbered by task and order; tasks
    get rows by hash (of ``number``, too, if there is one) and sort them, so that a task that runs again does the same.
    """
    tasks = max(1, -(-pieces.filter(F.col("length") < length).count() // pieces_per_task))

    def run(batches):
        from pyspark import TaskContext

        held = OpenSequences(length, open_sequences, TaskContext.get().partitionId() << 40)
        def place(run: pa.Table):
            run = run.take(np.argsort(-run.column("length").to_numpy(), kind="stable"))
            placed = [held.place(n) for n in run.column("length").to_pylist()]
            for i, name in enumerate(("sequence_id", "offset")):
                run = run.append_column(name, pa.array([p[i] for p in placed], pa.int64()))
            yield from run.combine_chunks().to_batches()

        waiting = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= run_pieces:
                rows = pa.Table.from_batches(waiting)
                for at in range(0, len(rows) - run_pieces + 1, run_pieces):
                    yield from place(rows.slice(at, run_pieces))
                waiting = rows.slice(len(rows) // run_pieces * run_pieces).to_batches()
        if waiting:
            yield from place(pa.Table.from_batches(waiting))

    number = F.col("number") if "number" in pieces.columns else F.lit(0)
    order = [F.xxhash64("doc_id", "piece", "start", number), F.col("doc_id"), F.col("piece"), F.col("length"), F.col("ids_crc32")]
    dealt = pieces.repartition(tasks, order[0]).sortWithinPartitions(*order).select(*PIECES.names)
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, length: int = 2048, cache: tuple[int, int] = CACHE) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there. ``cache``: entries of a worker's caches
    of pieces and words, which change the time alone."""
    return pack(spool(cut_pieces(docs, vocabulary, length, cache=cache), "pieces"), length)

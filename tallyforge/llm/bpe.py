"""BPE encoding and decoding with a given vocabulary file.

A text is cut at ASCII white space; each distinct piece of a batch is normalised, cut into words (at other white space
too) and merged by a priority queue of merge ranks over a doubly linked symbol list. White space never joins two pieces,
so the ids of a piece do not depend on its neighbours and a bounded per-worker cache of pieces is exact.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; texts of any
length are handled whole; strings of the special tokens inside a text become those tokens; rows are independent, so
repeated rows give repeated results and an empty table an empty one; all other columns pass through unchanged.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, slices

#: The file's words. ``regex`` follows a newer Unicode than the library: NEWER stands for what only it takes for letters or numbers.
WORD = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[NEWER]]+|[\p{N}--[NEWER]]|[[^\s\p{L}\p{N}]||[NEWER]]+"
#: Most pieces: letters of Latin-1, which no normal form changes, and ASCII marks that are one word (no apostrophe).
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
#: Entries (odd pieces, words) of each half of a worker's caches, about 400 MB in all, and the longest text that is kept there.
CACHE, CACHE_LENGTH = (400_000, 500_000), 48


@functools.lru_cache(maxsize=2)
def library_words(source: str) -> tuple[regex.Pattern, Callable[[str], str]]:
    """The pattern of words in the library's own character classes, and its normaliser.

    Only code points that ``regex`` takes for letters or numbers and Python's tables do not know can differ; for these the
    library's pre-tokenizer is asked.
    """
    library = tokenizers.Tokenizer.from_str(source)
    parts, newer = library.pre_tokenizer.pre_tokenize_str, []
    for block in range(0, 0x110000, 1 << 12):
        points = "".join(map(chr, [x for x in range(block, block + (1 << 12)) if not 0xD800 <= x < 0xE000]))
        newer += [c for c in regex.findall(r"[\p{L}\p{N}]", points) if unicodedata.category(c) == "Cn" and len(parts(f"!{c}!")) == 1]
    runs: list[list[int]] = []
    for c in map(ord, [*newer, "\ufffe"]):  # never empty: a code point that no text holds as a letter
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return regex.compile(WORD.replace("NEWER", "".join([f"\\U{a:08x}-\\U{b:08x}" for a, b in runs]))), library.normalizer.normalize_str


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def merge_symbols(ids: list[int], table: dict[int, int]) -> list[int]:
    """``ids`` after all merges. ``table``: left id << 16 | right id -> rank << 16 | merged id.

    The queue holds (rank, place of the left symbol); an entry is stale when its symbols have been merged meanwhile.
    """
    get, pop, push = table.get, heapq.heappop, heapq.heappush
    queue = [found << 32 | i for i, found in enumerate(map(get, [a << 16 | b for a, b in zip(ids, ids[1:])])) if found is not None]
    if not queue:
        return ids
    heapq.heapify(queue)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        entry = pop(queue)
        i, found = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j >= n or ids[i] < 0 or get(ids[i] << 16 | ids[j]) != found:
            continue
        ids[i] = merged = found & 0xFFFF
        ids[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (new := get(merged << 16 | ids[k])) is not None:
                push(queue, new << 32 | i)
        k = before[i]
        if k >= 0 and (new := get(ids[k] << 16 | merged)) is not None:
            push(queue, new << 32 | k)
    return [x for x in ids if x >= 0]


class Cache:
    """A dictionary of bounded size: what was not used since the last two fillings is forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get_all(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Values of distinct keys; those that are not held are made, all in one call."""
        found = list(map(self.new.get, keys))
        missing = [k for k, f in zip(keys, found) if f is None]
        if not missing:
            return found
        unknown = [k for k in missing if k not in self.old]
        values = dict(zip(unknown, make(unknown)))
        if len(values) < len(missing):
            values |= {k: self.old[k] for k in missing if k not in values}
        if len(self.new) + len(missing) > self.most:
            self.new, self.old = {}, self.new
        self.new.update((k, values[k]) for k in missing[: self.most] if len(k) <= CACHE_LENGTH)
        return [values[k] if f is None else f for k, f in zip(keys, found)]


class Encoder:
    """Encodes and decodes with the vocabulary in ``source``, the JSON text of a BPE file with word ends."""

    def __init__(self, source: str, cache: tuple[int, int] = CACHE):
        spec = json.loads(source)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.table: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.table.setdefault(vocab[a] << 16 | vocab[b], rank << 16 | vocab[a + b])
        self.inner = [vocab[s] for s in byte_symbols()]
        self.last = [vocab[s + end] for s in byte_symbols()]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.strings = pa.array([strings.get(i, "") for i in range(max(strings) + 1)], pa.string())
        self.pieces, self.words = map(Cache, cache)
        self.word, self.normalize = library_words(source)

    def words_of(self, piece: str) -> list[str]:
        """Words of a run of characters without white space, special tokens among them."""
        if self.cut and "<|" in piece:
            return [w for part in self.cut.split(piece) for w in ([part] if part in self.special else self.normal_words(part))]
        return self.normal_words(piece)

    def normal_words(self, piece: str) -> list[str]:
        piece = piece.lower() if piece.isascii() else self.normalize(piece)  # by the library's tables of forms and cases
        return [piece] if piece.isalpha() else self.word.findall(piece)

    def merge_words(self, words: list[str]) -> list[bytes]:
        out = []
        for word in words:
            raw = word.encode("utf-8", "replace")
            ids = [self.inner[b] for b in raw]
            ids[-1:] = [self.last[b] for b in raw[-1:]]
            out.append(array("I", merge_symbols(ids, self.table)).tobytes())
        return out

    def _odd(self, pieces: list[str]) -> list[bytes]:
        cut = [self.words_of(p) for p in pieces]
        words = list({w for ws in cut for w in ws} - self.special.keys())
        known = dict(zip(words, self.words.get_all(words, self.merge_words)))
        known |= {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        return [b"".join([known[w] for w in ws]) for ws in cut]

    def ids_of(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces as binary: little-endian unsigned 32-bit integers. Plain ones are cut in Arrow."""
        plain = pc.match_substring_regex(pieces, f"^{LETTERS}+{MARKS}*$")
        some, odd = pieces.filter(plain), pieces.filter(pc.invert(plain)).to_pylist()
        tails = pc.replace_substring_regex(some, f"^{LETTERS}+", "").dictionary_encode()
        words = pc.utf8_lower(pc.replace_substring_regex(some, f"{MARKS}+$", "")).dictionary_encode()
        known = [pa.array(self.words.get_all(x.dictionary.to_pylist(), self.merge_words), pa.binary()).take(x.indices) for x in (words, tails)]
        both = pa.concat_arrays([pc.binary_join_element_wise(*known, b""), pa.array(self.pieces.get_all(odd, self._odd), pa.binary())])
        plain = plain.to_numpy(zero_copy_only=False)
        return both.take(pa.array(np.where(plain, np.cumsum(plain) - 1, len(some) + np.cumsum(~plain) - 1)))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as binary. Pieces are told apart in Arrow, so that Python sees each distinct word once."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        pieces = cut.flatten().dictionary_encode()
        return _joined(self.ids_of(pieces.dictionary).take(pieces.indices), cut.value_lengths(), b"")

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each binary of ids; a null counts as none."""
        ids = pc.fill_null(ids, b"")
        each = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
        return _joined(self.strings.take(pa.array(each.astype(np.int32))), pc.divide(pc.binary_length(ids), 4), " ")


def _joined(values: pa.Array, lengths: pa.Array, separator: str | bytes) -> pa.Array:
    """Runs of ``values`` of the given lengths, each joined to one value."""
    offsets = np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False)))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), separator)


def encoder(source: str, kind: type[Encoder] = Encoder, cache: tuple[int, int] = CACHE) -> Encoder:
    """One per Python worker, so that its cache lasts over tasks."""
    return hold((kind.__name__, hash(source), cache), lambda: kind(source, cache))


def read_vocabulary(df: DataFrame, path: str):
    """The vocabulary file (fixed size) as a broadcast, so that executors need no local copy."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with ``ids_col`` (binary: little-endian unsigned 32-bit ids) and, if named, the text decoded from those ids.

    Columns of those names that ``df`` already has are replaced.
    """
    names = [c for c in (ids_col, decoded_col) if c]
    kept = [c for c in df.columns if c not in names]
    source = read_vocabulary(df, vocabulary)

    def run(batches):
        coder = encoder(source.value)
        for whole in batches:
            for batch in slices(whole, text_col):
                columns = [batch.column(c) for c in kept] + [coder.encode(batch.column(text_col))]
                if decoded_col:
                    columns.append(coder.decode(columns[-1]))
                yield pa.RecordBatch.from_arrays(columns, names=kept + names)

    schema = df.select(*kept).withColumn(ids_col, F.lit(b""))
    schema = schema.withColumn(decoded_col, F.lit("")) if decoded_col else schema
    needed = df.select(*kept) if text_col in kept else df.select(*kept, text_col)
    return needed.mapInArrow(run, schema.schema)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with ``decoded_col``: the vocabulary strings of ``ids_col`` joined by one space. Null ids count as none."""
    kept = [c for c in df.columns if c != decoded_col]
    source = read_vocabulary(df, vocabulary)

    def run(batches):
        coder = encoder(source.value)
        for whole in batches:
            for batch in slices(whole, ids_col):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), coder.decode(batch.column(ids_col))], names=[*kept, decoded_col])

    return df.select(*kept).mapInArrow(run, df.select(*kept).withColumn(decoded_col, F.lit("")).schema)


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return encode(docs.select("doc_id", "text"), vocabulary, decoded_col="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Language identification by error-correcting output codes.

Languages get codewords; for each bit a binary classifier over hashed byte trigrams tells the languages with a 1 from
those with a 0 (log-odds of the trigram under the two sides, averaged over the text). Loss-weighted decoding takes the
language whose codeword has the least exponential loss, each bit weighted by the margin that the classifier is expected
to reach on that language. Trigrams are counted over all labelled rows; only one count for each language and bucket
reaches the driver.

Defined results: a null text or one without a letter is ``und`` with score 0 and counts as ambiguous; with no labelled
row every text is ``und``; with one language every other text is that; texts are read whole; rows are independent, so
repeated rows give repeated results; an empty table gives an empty one; other columns pass through in ``predict`` and
those named like its results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, slices

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
UNDETERMINED = "und"
#: ASCII that is no letter counts as a space.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts, each text between two spaces; and (first, end) of each text's own."""
    raw = [b" " + t.lower().encode("utf-8", "replace").translate(FOLD) + b" " for t in texts]
    lengths = np.array([len(r) for r in raw])
    ends = np.cumsum(lengths)
    b = np.frombuffer(b"".join([*raw, b"  "]), np.uint8).astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    buckets = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    return buckets, np.stack([ends - lengths, ends - 2], axis=1)


#: Bucket of three spaces, which say nothing.
BLANK = int((np.array([0x202020], np.uint32) * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS))[0])


def codewords(n: int, most: int = 63, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1: every split of the languages up to 7, else distinct random splits."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = [[1 if i == 0 else -1 if (s >> (i - 1)) & 1 else 1 for i in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(bits, float).T
    rng = np.random.default_rng(seed)
    return max((np.where(rng.random((n, most)) < 0.5, -1.0, 1.0) for _ in range(50)), key=lambda m: (m @ m.T - 2 * most * np.eye(n)).max() * -1)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # (bits, buckets)
    trust: np.ndarray  # (languages, bits)


def count_trigrams(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, bucket, n`` over all rows whose text and language are not null."""

    def run(batches):
        hold()
        counts: dict[str, np.ndarray] = {}

        def out():
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
            counts.clear()

        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                langs = batch.column("lang").to_pylist()
                buckets, spans = trigrams(batch.column("text").to_pylist())
                for lang in set(langs):
                    own = [buckets[a:b] for (a, b), x in zip(spans, langs) if x == lang]
                    counts[lang] = counts.get(lang, 0) + np.bincount(np.concatenate(own), minlength=BUCKETS)
            if len(counts) > 200:
                yield from out()
        yield from out()

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = count_trigrams(labelled, text_col, lang_col).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    index = {x: i for i, x in enumerate(languages)}
    counts[[index[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    codes = codewords(len(languages))
    weights = np.zeros((codes.shape[1], BUCKETS))
    for b, column in enumerate(codes.T):
        weights[b] = np.log(p[column > 0].mean(0)) - np.log(p[column < 0].mean(0))
    weights[:, BLANK] = 0
    trust = np.maximum(codes * (p @ weights.T), 0) + 1e-9
    return Model(languages, codes, weights.astype(np.float32), trust / trust.sum(1, keepdims=True) if codes.shape[1] else trust)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword, and how clearly it is nearest (0 to 1)."""
    n = len(model.languages)
    if n == 1:
        return np.zeros(len(margins), int), np.ones(len(margins))
    loss = np.stack([np.exp(-np.clip(model.codes[i] * margins, -30, 30)) @ model.trust[i] for i in range(n)], axis=1)
    order = np.sort(loss, axis=1)
    return loss.argmin(1), (order[:, 1] - order[:, 0]) / (order[:, 1] + order[:, 0])


def predict(df: DataFrame, model: Model, text_col: str = "text", ambiguous_below: float = 0.02) -> DataFrame:
    """``df`` with lang_pred, score and ambiguous (the two nearest codewords are about as near)."""
    names = ["lang_pred", "score", "ambiguous"]
    kept = [c for c in df.columns if c.lower() not in names]
    sent = df.sparkSession.sparkContext.broadcast(model)  # languages x buckets, whatever the number of rows

    def run(batches):
        hold()
        model = sent.value
        for whole in batches:
            for batch in slices(whole, text_col, 4 << 20):
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                lettered = np.array([bool(model.languages) and any(map(str.isalpha, t)) for t in texts], bool)
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                if lettered.any():
                    buckets, spans = trigrams([t for t, x in zip(texts, lettered) if x])
                    cuts = spans.ravel()
                    sums = np.stack([np.add.reduceat(w[buckets], cuts, dtype=np.float64)[::2] for w in model.weights] or [np.zeros(len(spans))], axis=1)
                    used = np.maximum(np.add.reduceat((buckets != BLANK).astype(np.int32), cuts)[::2], 1)
                    best[lettered], score[lettered] = decode(model, sums / used[:, None])
                found = [model.languages[i] if x else UNDETERMINED for i, x in zip(best, lettered)]
                unsure = ~lettered | (score < ambiguous_below)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string()), pa.array(score), pa.array(unsure)], names=kept + names)

    return df.select(*kept).mapInArrow(run, df.select(*kept, F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2])).schema)


def held_out(id_col: str = "doc_id"):
    """A null identifier counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_on_documents(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()))


def report(docs: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text"), fit_on_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")

"""Rows of every stage of the pipeline, and of the language query, against brute force in plain Python."""

import math
import zlib

import pytest
from test_similar import brute_groups, near_texts

import corpus_pipeline
from tallyforge.llm import langid
from tallyforge.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, removed_lines string, __row string, __id string, ambiguous int"


def buckets(text):
    raw = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
    return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 17 for i in range(len(raw) - 2)]


def brute_languages(rows):
    """(language, score) of each (doc_id, text, lang), by error-correcting output codes over all splits of the languages."""
    blank, counts = buckets("   ")[0], {}
    for i, text, lang in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 and text is not None and lang is not None:
            own = counts.setdefault(lang, [0] * 32768)
            for b in buckets(text):
                own[b] += 1
    langs = sorted(counts)
    p = {x: [(c + 0.5) / (sum(counts[x]) + 0.5 * 32768) for c in counts[x]] for x in langs}
    splits = [[1 if k == 0 or not s >> (k - 1) & 1 else -1 for k in range(len(langs))] for s in range(1, 2 ** (len(langs) - 1))]
    weights, trust = [], {x: [] for x in langs}
    for split in splits:
        ones, others = ([x for x, c in zip(langs, split) if c == side] for side in (1, -1))
        w = [math.log(sum(p[x][b] for x in ones) / len(ones)) - math.log(sum(p[x][b] for x in others) / len(others)) for b in range(32768)]
        w[blank] = 0.0
        weights.append(w)
        for x, c in zip(langs, split):
            trust[x].append(max(c * sum(a * b for a, b in zip(p[x], w)), 0) + 1e-9)
    out = []
    for _, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            out.append(("und", 0.0))
            continue
        found = [b for b in buckets(text) if b != blank]
        margins = [sum(w[b] for b in found) / max(1, len(found)) for w in weights]
        losses = {}
        for k, x in enumerate(langs):
            t = [v / sum(trust[x]) for v in trust[x]]
            losses[x] = sum(v * math.exp(-split[k] * m) for v, split, m in zip(t, splits, margins))
        first, second = sorted(losses, key=losses.get)[:2]
        out.append((first, (losses[second] - losses[first]) / (losses[second] + losses[first])))
    return out


def brute_line_dedup(rows):
    """Text of each (doc_id, text): windows of three lines that are not blank lose every occurrence but the first."""
    spans = {}
    for i, text in rows:
        if i is not None and text is not None:
            at = [n for n, x in enumerate(text.split("\n")) if x.strip("\t\n\x0b\f\r ")]
            parts = text.split("\n")
            for a, b, c in zip(at, at[1:], at[2:]):
                spans.setdefault((parts[a], parts[b], parts[c]), set()).add((i, a, b, c))
    lost = {}
    for found in spans.values():
        for i, *at in sorted(found)[1:]:
            lost.setdefault(i, set()).update(at)
    return [t if i not in lost or t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lost[i]) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    """The given documents with odd ones: nulls in every column, empty and long texts, repeated rows, clashing columns."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    last = max(r[0] for r in rows)
    rows += [(last + 1 + i, t, "en", "made", len(t)) for i, t in enumerate(near_texts()[:40])]
    rows += [
        (9001, None, None, None, None), (9002, "", "en", None, 0), (9003, "a b c\nd e\nf\ng h i", "en", "s", 17), (9004, "a b c\nd e\nf\nother words here", "en", "s", 28),
        (9005, "same words in this row", "en", "s", 22), (9005, "same words in this row", "en", "s", 22), (None, "no identifier at all here", None, None, None),
        (None, "same words in this row", None, None, None), (9006, "12345 --- !!!", "de", "s", 13), (9007, "x" * 3_000_000, None, None, None), (9008, "line of text\n" * 40_000, "en", "s", 520_000), (9009, "word " * 200_000, "en", "s", 1_000_000),
    ]
    return spark.createDataFrame([(*r, "s", "r", "k", "i", 7) for r in rows], COLUMNS).repartition(3)


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def test_language_stage_and_query(spark, docs):
    rows = docs.collect()
    want = brute_languages([(r.doc_id, r.text, r.lang) for r in rows])
    assert len({x for x, _ in want}) > 4
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.report(docs.where("doc_id is not null")).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()}
    assert all(r.lang is None for r in rows if r.doc_id is None)  # so the query without those rows learns the same
    for r, (lang, score) in zip(rows, want):
        if r.doc_id is not None:
            assert got[r.doc_id, r.text][0] == lang and abs(got[r.doc_id, r.text][1] - score) < 1e-4
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    assert all(abs(score - 0.02) > 1e-4 for _, score in want)
    assert plain(kept.collect()) == plain(r for r, (lang, score) in zip(rows, want) if lang != "und" and score >= 0.02)


def test_line_stage(spark, docs):
    rows = docs.collect()
    kept = corpus_pipeline.line_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(r.doc_id, t, *r[2:4], r.n_chars if t == r.text else len(t), *r[5:]) for r, t in zip(rows, brute_line_dedup([(r.doc_id, r.text) for r in rows]))]
    assert plain(kept.collect()) == plain(want) and any(t != r.text for r, (_, t, *_) in zip(rows, want))


def test_near_dedup_stage(spark, docs):
    rows = docs.collect()
    groups = {}
    for r, g in zip(rows, brute_groups([r.text for r in rows])):
        groups.setdefault(g, []).append(r)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    first = [min(some, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for some in groups.values()]
    assert len(first) < len(rows) - 30
    assert plain((r.doc_id, r.text) for r in kept.collect()) == plain((r.doc_id, r.text) for r in first)


def test_pack_stage(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    want = []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            some = ids[at : at + 2048]
            want.append((r.doc_id, k, at, len(some), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in some))))
    got = corpus_pipeline.pack(spark, docs, SF).collect()
    assert plain(r[:5] for r in got) == plain(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= sum(r[3] for r in want) // 2048 + 2


def test_stages_take_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0
        if name != "pack":
            assert out.columns == docs.columns

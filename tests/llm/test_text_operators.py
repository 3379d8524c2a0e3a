import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallyforge.llm import bpe, exact, html_text, langid, lines, packing, sharding, simhash
from tallyforge.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
ODD = [(1, ""), (2, None), (3, "x"), (4, "a b c d\n" * 3000), (5, "same\ntext\nhere\nagain"), (6, "same\ntext\nhere\nagain"), (6, "same\ntext\nhere\nagain"), (None, "no id"), (7, "\x1c <|endoftext|> é")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "x", 0) for i, t in ODD], "doc_id long, text string, lang string, __id string, n_chars long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints):
    found = {i: i for i in fingerprints}
    changed = True
    while changed:
        changed = False
        for a, x in fingerprints.items():
            for b, y in fingerprints.items():
                if (x ^ y).bit_count() <= 2 and found[a] != found[b]:
                    found[a] = found[b] = min(found[a], found[b])
                    changed = True
    return found


def test_simhash_matches_brute_force(docs):
    rows = docs.collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    want = brute_components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.fingerprint_report(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("pairs_up_to", [1, 5, 1000])
def test_links_of_full_and_small_keys_have_the_same_components(spark, pairs_up_to):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    prints = set(base)
    for x in base:
        for _ in range(20):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    signed = [(int(np.uint64(x).view(np.int64)), i) for i, x in prints.items()]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), pairs_up_to=pairs_up_to).collect()
    found = {i: i for i in prints}
    for _ in prints:
        before = dict(found)
        for u, v in edges:
            found[u] = found[v] = min(found[u], found[v])
        if found == before:
            break
    assert found == brute_components(prints)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    i, j = rng.integers(0, 23, 500), rng.integers(0, 23, 500)
    a, b = simhash.golay_indices(words), simhash.golay_indices(words ^ (1 << i) ^ (1 << j))
    for x, y in zip(a, b):
        assert {*x[x >= 0]} & {*y[y >= 0]}
    assert {len(x[x >= 0]) for x in a} == {1, 6}


def test_simhash_odd_rows(odd, none):
    got = simhash.fingerprint_report(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[2].component_id == 1
    assert by[6].component_id == 5
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and {1, 3, 4, 5, 7} <= {r.doc_id for r in kept.collect()} <= {1, 3, 4, 5, 7, None}
    assert simhash.fingerprint_report(none).count() == simhash.keep_one_of_each(none).count() == 0


def test_exact_digest_collisions_are_told_apart(spark, docs, tmp_path):
    path = str(tmp_path / "d")
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(ODD[:6], "doc_id long, text string").selectExpr("doc_id + 100000", "text"))
    rows.repartition(5).write.parquet(path)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    for bits in (256, 8):  # 8 bits collide
        got = exact.exact_duplicates(spark, path, digest_bits=bits, maxFilesPerTrigger=1).drop("locator").collect()
        assert sorted(map(tuple, got)) == want


def test_exact_state_goes_on_with_new_files(spark, tmp_path):
    path, held = str(tmp_path / "d"), f"file://{tmp_path}/held"
    spark.createDataFrame([(1, "a"), (2, "b"), (9, None)], "doc_id long, text string").coalesce(1).write.parquet(path)
    assert {(r.doc_id, r.n) for r in exact.stream_state(spark, path, checkpoint=held).collect()} == {(1, 1), (2, 1), (9, 1)}
    spark.createDataFrame([(3, "a"), (4, "")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    got = exact.stream_state(spark, path, checkpoint=held).collect()
    assert {(r.doc_id, r.n) for r in got} == {(3, 2), (2, 1), (9, 2)}
    assert all("#" in r.locator for r in got)
    assert exact.stream_state(spark, path, checkpoint=held).count() == 3  # nothing new
    spark.createDataFrame([(5, "c"), (6, "a")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    state = exact.stream_state(spark, path, checkpoint=held)
    assert {(r.doc_id, r.n) for r in state.collect()} == {(6, 3), (2, 1), (9, 2), (5, 1)}
    assert len({f.split("/")[-2] for f in state.inputFiles()}) == 1  # merged into one table


def test_exact_hot_text_moves_a_row_a_task(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(0, 4000, 1, 8).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('hot ', 50) ELSE concat('t', id) END AS text").write.parquet(path)
    got = exact.exact_duplicates(spark, path)
    assert [tuple(r) for r in got.groupBy("group_size", "kept").count().orderBy("group_size", "kept").collect()] == [(1, True, 2666), (1334, False, 1333), (1334, True, 1)]
    assert got.where("group_size > 1 AND keep_id <> 3999").count() == 0


def test_exact_empty_table(spark, none, tmp_path):
    path = str(tmp_path / "d")
    none.write.parquet(path)
    assert exact.exact_duplicates(spark, path).count() == 0


def test_lines_cover_overlapping_windows(spark, odd, none):
    rows = [(1, "a\nb\nc\nd\n\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "b\n\nc\nd\nz"), (4, "q\nq\nq\nq"), (5, "a\nb")]
    got = {r.doc_id: r.text for r in lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a\nb\nc\nd\n\ne", 2: "x\ny", 3: "\nz", 4: "q", 5: "a\nb"}  # of 4, the second window covers the last three lines
    out = lines.remove_repeated_lines(odd)
    assert {"__id", "removed_lines"} <= {*out.columns}
    by = {(r.doc_id, r.text) for r in out.collect()}
    assert (6, "") in by and (5, ODD[4][1]) in by and (2, None) in by and (None, "no id") in by
    assert lines.remove_repeated_lines(none).count() == 0


def test_bpe_is_the_librarys(docs, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    for df in (docs, odd):
        texts = {(r.doc_id, r.text) for r in df.collect()}
        want = set()
        for i, t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            want.add((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert set(map(tuple, bpe.round_trip_digests(df, vocabulary()).collect())) == want
    assert bpe.round_trip_digests(none, vocabulary()).count() == 0
    twice = bpe.decode(bpe.encode(odd, vocabulary()), vocabulary(), decoded_col="text")
    assert twice.count() == len(ODD) and "ids" in twice.columns


ALPHABET = [*"abcXYZ  \n\t.,;'’sσΣςİıéßÿµ123½²<|>\x00\x0b\x0c\x1c\x1f\x85", *"\u0327\u0301\u0307\u00a0\u2003\u2028\u3000\u180e\ufeff\u200b\u200d\u0345", *"가가ÅﬁअिǄ\U0001f600", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "İ̧", "naïve.", "Über,"]


@pytest.mark.parametrize("kind", [bpe.Encoder, packing.LibraryEncoder])
def test_encoders_equal_the_library_on_random_texts(kind):
    import random

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(6000)] + ["x" * 300_000, "word, " * 200_000, "é.," * 50_000]
    with open(vocabulary(), encoding="utf-8") as f:
        coder = kind(f.read(), cache=(700, 500))  # so small that both halves are dropped on the way
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for at in range(0, len(texts), 500):
        got = coder.encode(pa.array(texts[at : at + 500]))
        assert [np.frombuffer(x, "<u4").tolist() for x in got.to_pylist()] == want[at : at + 500]
        assert coder.decode(got).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want[at : at + 500]]
    assert coder.encode(pa.array([None, ""], pa.string())).to_pylist() == [b"", b""] and len(coder.encode(pa.array([], pa.string()))) == 0


def test_merging_equals_the_plain_rule():
    table = {1 << 16 | 2: 5 << 16 | 3, 3 << 16 | 2: 1 << 16 | 4, 2 << 16 | 2: 3 << 16 | 6, 6 << 16 | 1: 0 << 16 | 7}
    rng = np.random.default_rng(0)
    for _ in range(300):
        ids = [int(x) for x in rng.integers(1, 3, rng.integers(0, 12))]
        want = list(ids)
        while pairs := [(table[a << 16 | b], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a << 16 | b in table]:
            found, i = min(pairs)
            want[i : i + 2] = [found & 0xFFFF]
        assert bpe.merge_symbols(list(ids), table) == want


def test_packing_is_whole_and_tight(docs, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    for df in (docs, odd):
        want = []
        for r in df.collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
            for k, at in enumerate(range(0, len(ids), 2048)):
                some = np.array(ids[at : at + 2048], "<u4")
                want.append((r.doc_id or -1, k, at, len(some), zlib.crc32(some.tobytes())))
        got = packing.pack_documents(df, vocabulary()).collect()
        assert sorted((r.doc_id or -1, *r[1:5]) for r in got) == sorted(want)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in by.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r.length for r in got)
        assert len(by) <= total // 2048 + 2
    assert packing.pack_documents(none, vocabulary()).count() == 0


def test_open_sequences_close_the_fullest():
    held = packing.OpenSequences(10, 2, 0)
    assert [held.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the third closes sequence 1, the fuller
    assert [held.place(n) for n in (3, 2, 10)] == [(0, 6), (2, 8), (3, 0)]


def test_shards_fit(spark, docs, odd, none):
    limit = 20_000
    rows = sharding.shard_documents(docs, limit).collect()
    assert len(rows) == docs.count() and len({r.doc_id for r in rows}) == len(rows)
    sizes = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for name, some in by.items():
        total = sum(sizes[r.doc_id] for r in some)
        assert total == some[0].shard_bytes and len(some) == some[0].shard_rows
        assert total <= limit or len(some) == 1 and some[0].oversize
        if name:  # it was split because the bucket above was too large
            assert sum(sizes[r.doc_id] for r in rows if r["shard"].startswith(name[:-1])) > limit
    assert sharding.shard_documents(odd, limit).count() == len(ODD)
    assert sharding.shard_documents(none, limit).count() == 0


def test_repeated_identifiers_are_split_by_text(spark):
    rows = [(1, f"text {i} " * 20, "hot") for i in range(300)] + [(None, f"other {i}", "hot") for i in range(300)] + [(2, "same " * 100, "x")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for key in ("source", "doc_id"):
        out = sharding.shard_documents(df, 2000, key).collect()
        assert len(out) == len(rows)
        assert {r.doc_id for r in out if r.oversize} == {2}  # nine equal rows cannot be split


def test_a_hot_key_is_split_on_the_identifier(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    out = sharding.shard(df, 500, F.col("key"), F.col("id"), F.lit(1))
    sizes = {r["shard"]: r["n"] for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 4000 and max(sizes.values()) <= 500
    assert out.where("key = 'hot'").select("shard").distinct().count() >= 3


def test_written_shards(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    out = sharding.shard(docs, 100_000, F.col("doc_id"), F.col("doc_id"), F.octet_length("text"))
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- x --><div class="ad">Buy, now.</div><div id="cookie-notice">We use cookies.</div>
<div class="page"><article><h1>Head &amp; line</h1><p><b>First,  text<br><p>Second&nbsp;one, <i>in</i>line. With more words, and marks.</p><form>Mail</form><p>Third &lt;b&gt;
<aside>Side</aside></article><div class="comments"><p>A reader's comment, quite long, with many words.</p></div></div><footer>&copy; me</footer>"""


def test_every_code_point_is_cut_as_by_the_library():
    from tokenizers import Tokenizer

    with open(vocabulary(), encoding="utf-8") as f:
        source = f.read()
    library, own = Tokenizer.from_str(source), bpe.Encoder(source)
    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    for joint in ("", "a", "!"):
        texts = [joint.join(chars[i : i + 256]) for i in range(0, len(chars), 256)]
        for at in range(0, len(texts), 500):
            want = library.encode_batch(texts[at : at + 500], add_special_tokens=False)
            for got, w in zip(own.encode(pa.array(texts[at : at + 500])).to_pylist(), want):
                assert np.frombuffer(got, "<u4").tolist() == w.ids


def test_html_text(spark):
    more = " With more words, and marks." * 8
    page = PAGE.replace(" With more words, and marks.", more)
    assert html_text.main_text(page) == f"Head & line First, text Second one, inline.{more} Third <b>"
    plain = "<body><div><a href=x>One</a><a>Two</a></div><div><p>Long text here, with marks. And more of it, to read.</p><p>Another one, also long enough to count, surely.</p></div><div>tiny</div></body>"
    assert html_text.main_text(plain) == "Long text here, with marks. And more of it, to read. Another one, also long enough to count, surely."
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>x"), (3, None, "<p>x"), (4, "u", "<" * 3000 + "<a b='"), (5, "u", "no tags, just text")]
    out = html_text.report(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in out.collect())
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1)] and got[5] == (5, "no tags, just text", 18)
    assert html_text.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_pages_keep_the_article(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    same = []
    for r in html_text.report(pages).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner).replace("\x00", "")).split())
        same.append(r.text.replace(" ", "") == want.replace(" ", ""))
    assert sum(same) >= 0.9 * len(same)  # of 50; test_html_whole has the larger table


def test_language_of_held_out_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in langid.report(docs).collect() if r.held_out]
    assert {r.doc_id for r in rows} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows)
    assert right >= 0.97
    model = langid.fit_on_documents(docs)
    got = {(r.doc_id, r.text): (r.lang_pred, r.ambiguous) for r in langid.predict(odd, model).collect()}
    assert got[(2, None)] == got[(1, "")] == ("und", True) and got[(3, "x")][0] in model.languages
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.report(odd).collect()} == {"und"}  # no labelled row
    assert langid.predict(odd, langid.fit(spark.createDataFrame([("abc", "xx")], "text string, lang string"))).where("lang_pred = 'xx'").count() == 7


def test_codewords_differ():
    for n in (2, 3, 7, 8, 40):
        codes = langid.codewords(n)
        least = min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i])
        assert codes.shape[0] == n and least >= max(1, codes.shape[1] // 4)

import hashlib
import time
import zlib

import numpy as np
import pytest
from odd import documents, odd_documents, rows_of, with_clashes
from public_tokenizers import path
from tokenizers import Tokenizer

from tollway.llm import bpe, orc_tokens, queries

PATH = path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    found = library.encode(text or "", add_special_tokens=False)
    return len(found.ids), sha(" ".join(map(str, found.ids))), sha(library.decode(found.ids, skip_special_tokens=False))


ODD = [
    "a<|endoftext|>b <|startoftext|>", "I'll DON'T 'S we've", "Σίσυφος ΟΔΟΣ", "é İ ǅ ﬁ 日本語 x　y​z", "a\x1cb\x1d c\x85d\xa0e", "12345 ½ ²",
    "x" * 100 + " " + "ab!!!" * 40, "👩‍👩‍👧 🏽", "<|EndOfText|>", "'re're've", "﻿ ok", "한국어 각", "ſK", " a b", "word" * 500, "<|", "|>", "́a",
]


def test_pieces_equal_the_library(library):
    vocab = bpe.vocabulary(PATH)
    for text in ODD:
        ids = [i for p in vocab.encode_pieces(bpe.pieces(text)) for i in p]
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("odd", ["\x1c", "\x1d", "\x1e", "\x1f", "\x1c\x1f"])
def test_separators_at_the_ends_are_kept(spark, library, odd):
    texts = [f"a{odd}", f"{odd}ab", odd, f" {odd} a {odd}\n", f"{odd}a b{odd}", f"\x85a{odd}\xa0"]
    vocab = bpe.vocabulary(PATH)
    for text in texts:
        assert [i for p in vocab.encode_pieces(bpe.pieces(text)) for i in p] == library.encode(text, add_special_tokens=False).ids, text
    docs = documents(spark, texts)
    assert rows_of(bpe.digests(docs, PATH)) == sorted((r.doc_id, *expected(library, r.text)) for r in docs.collect())


def test_matrix_and_lists_take_the_same_merges():
    vocab = bpe.vocabulary(PATH)
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"aeinrst"), size=k)) for k in range(1, bpe.SHORT + 1) for _ in range(20)]
    assert vocab.merge_short(words) == [vocab.merge_long(w) for w in words]


def test_very_long_words_equal_the_library(library):
    vocab = bpe.vocabulary(PATH)
    rng = np.random.default_rng(8)
    start = time.perf_counter()
    for letters, size in ((b"acgt", 300_000), (b"abcdefghijklmnopqrstuvwxyz", 300_000), (b"a", 1_000_000)):
        word = bytes(rng.choice(list(letters), size=size)).decode()
        assert vocab.encode_pieces([word])[0] == library.encode(word, add_special_tokens=False).ids
    assert time.perf_counter() - start < 120


def test_long_pieces_are_not_remembered(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONGEST", 4)
    docs = documents(spark, ["one seventeen one", "seventeen two", "", "seventeen"])
    assert rows_of(bpe.digests(docs.coalesce(1), PATH)) == sorted((r.doc_id, *expected(library, r.text)) for r in docs.collect())
    ids = {r.doc_id: r.ids for r in bpe.encode(docs.coalesce(1), PATH).collect()}
    assert ids[3] == library.encode("seventeen", add_special_tokens=False).ids


def test_digests_of_the_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op2_rank_array_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id])


def test_odd_rows(spark, library):
    docs = odd_documents(spark)
    want = sorted(((r.doc_id, *expected(library, r.text)) for r in docs.collect()), key=repr)
    assert rows_of(bpe.digests(docs, PATH)) == want
    assert rows_of(bpe.digests(with_clashes(docs.drop("n_tokens")), PATH)) == want
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_a_full_memory_changes_nothing(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    docs = documents(spark, ["one two three four five", "one two", "six seven one"])
    assert rows_of(bpe.digests(docs.coalesce(1), PATH)) == sorted((r.doc_id, *expected(library, r.text)) for r in docs.collect())


def test_encode_then_decode(spark, library):
    docs = documents(spark, ["The lazy dog.", None, ""])
    ids = bpe.encode(docs, PATH)
    assert {r.doc_id: r.ids for r in ids.collect()}[0] == library.encode("The lazy dog.", add_special_tokens=False).ids
    assert {r.doc_id: r.text for r in bpe.decode(ids, PATH).collect()} == {0: "the</w> lazy</w> dog</w> .</w>", 1: "", 2: ""}


def positions(rows, library):
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_orc_of_the_whole_table(spark, sf_dir, library):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = queries.QUERIES["op6_orc_tokens"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == positions(rows, library)


def test_orc_of_odd_rows(spark, library):
    docs = odd_documents(spark)
    got = orc_tokens.write_and_read(with_clashes(docs), PATH).collect()
    want = {(r.doc_id, *one[2:]) for r in docs.collect() for one in positions([(r.doc_id, r.text)], library)}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == docs.count()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert orc_tokens.write_and_read(docs.limit(0), PATH).count() == 0


def test_ids_of_odd_texts_equal_the_library(library, monkeypatch):
    texts = [*ODD, "\x00 \x01a\x7fb", "</w> a</w>b", "don't DON'T 'tis", "a<|b <|endoftext|> c|>", "Éçaux,leÀ İstanbul Straße·ÿ", "e\u0301tude ŉ Ĳ ŀ ¼x²", "».Ünd" * 9, "ªº µ \xad-\xa0\x85", "J\u030c"]
    for limit in (900_000, 5):
        monkeypatch.setattr(orc_tokens, "REMEMBERED", limit)
        known = orc_tokens.Ids(PATH)
        for some in (texts, texts[::-1], texts[5:9]):
            for text, got in zip(some, known.encode(some)):
                assert np.frombuffer(got, dtype="<i4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    every = [chr(c) + "a" + chr(c) + chr(c) + "1 " + chr(c) for c in range(0x250)]
    for text, got in zip(every, known.encode(every)):
        assert np.frombuffer(got, dtype="<i4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_orc_lookup_prunes(spark, sf_dir, tmp_path, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, also of a small table
    try:
        folder = orc_tokens.write(docs, PATH, str(tmp_path / "ids"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r)[:3] for r in orc_tokens.layout(spark, folder).collect()) == [x[:3] for x in positions(sorted((r.doc_id, r.text) for r in docs.collect()), library)]
    rows = orc_tokens.lookup(spark, folder, [7, 150])
    text = {r.doc_id: r.text for r in docs.filter("doc_id in (7, 150)").collect()}
    assert {r.doc_id: r.ids[:-1] for r in rows.collect()} == {d: library.encode(t, add_special_tokens=False).ids for d, t in text.items()}
    assert "PushedFilters: [In(doc_id" in rows._jdf.queryExecution().toString()
    import pyarrow.orc as orc

    files = sorted((tmp_path / "ids").glob("*.orc"))
    assert len(files) > 1 and all(orc.ORCFile(f).row_index_stride == 2000 for f in files)

import random
import zlib
from collections import Counter

import pytest
from odd import SCHEMA, odd_documents, rows_of, with_clashes

from tollway.llm import phrases, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=2000, longest=4):
    """All phrases counted one by one; every longer candidate is tried."""

    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate(UPPER)
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = set()
    for (lang, *words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, *words[i : i + k])
                if 100 * a >= 80 * candidates[inner]:
                    dropped.add(inner)
    out = []
    for (lang, *words), a in candidates.items():
        if (lang, *words) in dropped:
            continue
        cuts = [(f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, len(words))]
        score, _, left, right = min((2000000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    out.sort()
    rank, found = Counter(), []
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found, key=repr)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], SCHEMA)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "é", "Σ", "a\x1cb", "x\x85y", "\xa0", "it's", "日本"]
    marks = [" ", " ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "? ", "!", ";", ":", "\r\n"]
    return [(rng.choice(["en", "en", "en", "de", None, "und"]), "".join(rng.choice(words[: rng.choice([4, 12])]) + rng.choice(marks) for _ in range(rng.randrange(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize("seed,least,top", [(1, 3, 2000), (2, 5, 7), (3, 2, 40)])
def test_equals_a_plain_count(spark, seed, least, top):
    rows = [*texts(seed), ("en", None), ("en", ""), (None, "new york. " * 40)]
    assert rows_of(phrases.collocations(docs_of(spark, rows), least, top=top)) == plain(rows, least, top)


@pytest.mark.parametrize("bits,block,entries", [(1 << 9, 200, 3), (1 << 20, 1, 1), (1 << 15, 1 << 20, 2000)])
def test_sizes_change_nothing(spark, monkeypatch, bits, block, entries):
    monkeypatch.setattr(phrases, "STEP_BYTES", 300)
    monkeypatch.setattr(phrases, "ENTRIES", entries)
    rows = texts(4, 80)
    found = phrases.collocations(docs_of(spark, rows).repartition(3), 3, bits=bits, block_bytes=block)
    assert rows_of(found) == plain(rows, 3)


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    full = zlib.compress(b"\xff" * 512)
    monkeypatch.setattr(phrases, "word_bitmap", lambda *a: full)
    monkeypatch.setattr(phrases, "frequent_hashes", lambda *a: full)
    rows = texts(5)
    assert rows_of(phrases.collocations(docs_of(spark, rows), 3)) == plain(rows, 3)


def test_more_buckets_and_high_limits(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PER_BUCKET", 2)
    rows = [*texts(7), ("en", "new york city. " * 400)]
    for least in (3, 300):
        assert rows_of(phrases.collocations(docs_of(spark, rows).repartition(4), least)) == plain(rows, least)


def test_two_and_three_words(spark):
    rows = texts(6)
    for longest in (2, 3):
        assert rows_of(phrases.collocations(docs_of(spark, rows), 3, longest=longest)) == plain(rows, 3, longest=longest)


def test_subsumed_at_the_border(spark):
    # "a b" 10 times, "a b c" 8 times: 100 * 8 >= 80 * 10 drops "a b"; with 7 it stays
    for n, kept in ((8, False), (7, True)):
        rows = [("en", "a b c. " * n + "a b. " * (10 - n))]
        found = {r.phrase for r in phrases.collocations(docs_of(spark, rows), 2).collect()}
        assert ("a b" in found) == kept and "a b c" in found


def test_whole_table_equals_a_plain_run(spark, sf_dir):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES["op11_phrase_stripes"](spark, sf_dir)) == plain(rows)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert rows_of(phrases.collocations(with_clashes(docs), 2)) == plain(rows, 2)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs_of(spark, [("en", None), (None, " \t\n")])).count() == 0

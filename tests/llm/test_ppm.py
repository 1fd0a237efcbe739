import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import odd_documents, rows_of, with_clashes

from tollway.llm import ppm, queries


def by_hand(rows, order=ppm.ORDER):
    """Context tries as plain dictionaries, byte by byte."""

    texts = [(d, (t or "").encode("utf-8", "replace").lower(), d is None or zlib.crc32(str(d).encode()) % 7 != 2) for d, t in rows]
    trie, words, ends = defaultdict(Counter), Counter(), 0

    def steps(text):
        full = bytes([ppm.PAD]) * order + text + bytes([ppm.END])
        for i in range(order, len(full)):
            yield full[i - order : i], full[i]

    for _, text, learns in texts:
        if learns:
            for context, symbol in steps(text):
                for k in range(order + 1):
                    trie[context[k:]][symbol] += 1
            words.update(text.split())
            ends += 1
    total, distinct = sum(words.values()) + ends, len(words) + (ends > 0)

    def probability(context, symbol):
        out, excluded = 0.0, set()
        for k in range(order + 1):
            seen = {s: n for s, n in trie.get(context[k:], {}).items() if s not in excluded}
            if not seen:
                continue
            n = sum(seen.values())
            if symbol in seen:
                return out + math.log10((2 * seen[symbol] - 1) / (2 * n))
            out += math.log10(len(seen) / (2 * n))
            excluded |= set(seen)
        return out - math.log10(ppm.SYMBOLS - len(excluded))

    out = []
    for d, text, learns in texts:
        counts = [words[w] for w in text.split()] + [ends]
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in counts)
        out.append((d, not learns, len(counts), sum(c > 0 for c in counts), total, base, sum(probability(c, s) for c, s in steps(text))))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: repr(r[:5]))
    want = sorted(want, key=lambda r: repr(r[:5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for key in {r[:5] for r in want}:  # rows with equal ids and counts in any order
        a, b = (sorted(r[5:] for r in rows if r[:5] == key) for rows in (got, want))
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op7_ppm_scores"](spark, sf_dir).collect()
    want = {r[0]: r for r in by_hand(rows)}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[:5] == want[r.doc_id][:5] and np.allclose(tuple(r)[5:], want[r.doc_id][5:], rtol=1e-9)


@pytest.mark.parametrize("order", [2, 5])
def test_odd_rows_in_small_blocks(spark, order):
    docs = odd_documents(spark).filter("doc_id is null or doc_id <> 4")  # the very long text is in the next test
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], order)
    same(ppm.score(docs, order).collect(), want)
    same(ppm.score(with_clashes(docs), order, block_bytes=64).collect(), want)
    assert ppm.score(docs.limit(0)).count() == 0


def test_long_text_is_scored_whole(spark):
    docs = odd_documents(spark).filter("doc_id = 4")
    row = ppm.score(docs, 3).first()
    assert row.n_tokens == 90_001 and row.score < 0 and abs(row.score - by_hand([(4, docs.first().text)], 3)[0][6]) < 1e-6


def test_nothing_to_learn_from(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    docs = spark.createDataFrame([(held[0], "ab c"), (held[1], None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(docs).collect()}
    assert got[held[0]].base_score == 0 and abs(got[held[0]].score + 5 * math.log10(257)) < 1e-9 and got[held[0]].train_tokens == 0


def test_probabilities_of_a_context_add_up():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice(list(b"abcd"), size=80)) for _ in range(6)]
    code, n = ppm._distinct(ppm.gram_codes(texts, 3))
    nodes = ppm.trie(code, n, 3, [])
    for context in (b"abc", b"zab", b"zzz", b"dda"):
        wanted = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], dtype=np.int64)
        # 256 byte values, with 0xFF for the end; one more symbol stands for the byte 0xFF, which no text has
        p = 10 ** ppm.log_probabilities(wanted, nodes)
        left = min(p)
        assert abs(p.sum() + left - 1) < 1e-9


@pytest.mark.parametrize("rows", ["1", "7"])
def test_parts_of_a_block_may_come_in_any_batches(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).repartition(2)
    whole = rows_of(ppm.score(docs, block_bytes=20_000))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        assert rows_of(ppm.score(docs, block_bytes=20_000)) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_longer_contexts_predict_held_out_texts_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cost = [-sum(r.score for r in ppm.score(docs, order).filter("held_out").collect()) for order in (2, 5)]
    size = sum(len((r.text or "").encode()) + 1 for r in docs.filter(ppm.held_out(docs.doc_id)).collect())
    assert cost[1] < 0.95 * cost[0] < 0.5 * size * math.log10(ppm.SYMBOLS)

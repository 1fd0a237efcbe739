import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, odd_documents, rows_of, with_clashes

from tollway.llm import queries, suffix_dedup as S


def by_hand(rows, width=S.WIDTH):
    raw = [(d, (t or "").encode("utf-8", "replace")) for d, t in rows]
    seen = Counter(b[i : i + width] for _, b in raw for i in range(len(b) - width + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        n = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), n, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES["op5_suffix_repeats"](spark, sf_dir)) == by_hand(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=0, max_size=60), st.integers(1, 40))
def test_suffix_arrays(text, depth):
    x = np.array([*text, 0])
    got = S.suffix_array(x, depth).tolist()
    assert sorted(got) == list(range(len(x)))
    heads = [x[i : i + depth].tolist() for i in got]
    assert heads == sorted(heads)


def test_suffix_array_of_bytes_is_the_full_order():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = np.append(rng.integers(1, rng.integers(2, 257), size=400), 0)
        x[100:180] = x[20:100]
        got = S.suffix_array(x, 10_000).tolist()
        assert got == sorted(range(len(x)), key=lambda i: x[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=6), st.integers(9, 24))
def test_shards(texts, width):
    texts = [t.encode() for t in texts if len(t) >= width]
    if not texts:
        return
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    got = S.repeated_in_shard(texts, [1] * len(texts), width)
    assert [g.tolist() for g in got] == [[seen[t[i : i + width]] > 1 for i in range(len(t) - width + 1)] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=80), min_size=1, max_size=5), st.integers(10, 30))
def test_runs_cover_every_string_once_and_equal_strings_have_equal_seeds(texts, width):
    texts = [t.encode() for t in texts]
    start, size, seed = S.runs_of(texts, width, 8)
    joined, at = b"".join(texts), 0
    want = []
    for t in texts:
        want += range(at, at + max(0, len(t) - width + 1))
        at += len(t)
    place = [(a + k, v) for a, n, v in zip(start, size, seed) for k in range(n)]
    assert [p for p, _ in place] == want
    by = {}
    for p, v in place:
        assert by.setdefault(joined[p : p + width], v) == v


def test_seeds_do_not_depend_on_the_step(monkeypatch):
    raw = np.random.default_rng(3).integers(97, 100, size=3000, dtype=np.uint8)
    want = [x.tolist() for x in S.seeds_at(raw, 60, 13)]
    h = S.seed_hashes(raw, 13)
    assert want[1] == [int(i + np.argmin(h[i : i + 48])) for i in range(3000 - 59)] and want[0] == h[want[1]].tolist()
    monkeypatch.setattr(S, "STEP", 7)
    assert [x.tolist() for x in S.seeds_at(raw, 60, 13)] == want


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeats_in_small_blocks_and_shards(spark, hot):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdé"), size=4))
    passage = " ".join(word() for _ in range(90))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts = [f"{t} {passage[int(rng.integers(0, 80)):]} {word()}" if i % 2 else t for i, t in enumerate(texts)]
    texts += [texts[1], texts[1].replace("a", "b", 1), "z" * 500, "xy" * 300, passage[:150], None, ""]
    docs = documents(spark, texts)
    want = by_hand(list(enumerate(texts)))
    assert rows_of(S.remove_repeats(docs, hot_runs=hot, shard_bytes=2000, block_bytes=1500).drop("kept")) == want
    assert sum(r[2] for r in want) > 2000


def test_odd_rows(spark):
    docs = odd_documents(spark)
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(S.remove_repeats(docs).drop("kept")) == want
    assert rows_of(S.remove_repeats(with_clashes(docs)).drop("kept")) == want
    assert S.remove_repeats(docs.limit(0)).count() == 0
    for r in S.remove_repeats(docs).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed

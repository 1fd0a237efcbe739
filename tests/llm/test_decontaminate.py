import numpy as np
import pytest
from odd import documents, odd_documents, rows_of, with_clashes

from tollway.llm import decontaminate as D
from tollway.llm import queries

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew potions beneath an ancient crooked oak"


def filler(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("w" + "".join(rng.choice(list("abcdefgh"), size=6)) for _ in range(n))


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(0, ITEM), (1, "an unrelated question about the moons of jupiter and their orbital periods"), (2, None), (3, ""), (4, "forty-two"), (5, ITEM)], "item_id long, text string")


def full_score(item, text, match=D.Match()):
    """Smith-Waterman over the whole text, cell by cell."""

    a, b = D.fold(item), D.fold(text)
    above = [0] * (len(b) + 1)
    best = 0
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (match.hit if x == y else match.miss), above[j] + match.gap, row[j - 1] + match.gap))
        best = max(best, *row)
        above = row
    return best / (match.hit * len(a))


def test_exact_and_edited_copies(spark, items):
    words = ITEM.split()
    edited = " ".join("CHANGED" if i % 6 == 4 else w for i, w in enumerate(words))
    dropped = " ".join(w for i, w in enumerate(words) if i % 7 != 3)
    docs = documents(spark, [
        filler(80, 1), f"{filler(40, 2)} {ITEM.upper()}. {filler(30, 3)}", f"{filler(9, 4)} {edited} {filler(9, 5)}", f"{dropped} {filler(5, 6)}",
        f"{filler(20, 7)} the quick brown fox jumps {filler(20, 8)}", "the answer is forty-two of course",
    ])
    got = D.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (1, 5), (2, 0), (2, 5), (3, 0), (3, 5), (5, 4)}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.item_id == 0:
            assert abs(r.score - full_score(ITEM, text[r.doc_id])) < 1e-12
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, items).collect()) == [0, 4]


def test_a_passage_in_every_document_keeps_its_seeds(spark, items):
    docs = documents(spark, [f"{filler(30, i)} {ITEM} {filler(10, 99 + i)}" for i in range(60)])
    assert D.contaminated(docs, items).filter("item_id = 0").count() == 60


def test_passes_add_up(spark, items, monkeypatch):
    docs = documents(spark, [f"{filler(10, 1)} {ITEM}", filler(20, 2)])
    want = rows_of(D.contaminated(docs, items))
    monkeypatch.setattr(D, "PASS_BYTES", 60)
    assert rows_of(D.contaminated(docs, items)) == want
    assert D.drop_contaminated(docs, items).count() == 1


def test_whole_table_against_full_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    test = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.score for r in queries.QUERIES["op10_benchmark_alignment"](spark, sf_dir).collect()}
    want = {}
    for d in docs:
        known = D.read_items([(t.item_id, t.text) for t in test])
        words = D.numbered(D.fold(d.text), known)
        for i, seq in enumerate(known.sequences):
            score = D.align(seq, words, D.Match())[0] / (2 * len(seq))
            if score >= D.Match().least_score:
                want[(d.doc_id, known.ids[i])] = score
    assert got.keys() == want.keys() and got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_odd_rows(spark, items):
    docs = odd_documents(spark)
    assert D.contaminated(docs, items).count() == 0
    clash = with_clashes(docs)
    assert D.contaminated(clash, items).count() == 0 and D.drop_contaminated(clash, items).count() == docs.count()
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0 and D.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_align_equals_cells():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 4, size=rng.integers(1, 12)), rng.integers(0, 4, size=rng.integers(0, 30))
        words = lambda x: " ".join("abcd"[i] for i in x)
        assert D.align(a, b, D.Match())[0] == (round(full_score(words(a), words(b)) * 2 * len(a)) if len(b) else 0)


def edited(words, rng, share, common):
    """A copy with a share of its words changed, left out or followed by another."""

    out = []
    for w in words:
        kind = rng.random()
        if kind < share / 3:
            out.append(str(rng.choice(common)))
        elif kind < 2 * share / 3:
            continue
        else:
            out += [w, str(rng.choice(common))] if kind < share else [w]
    return out


def zipf_words(rng, n, vocabulary, rank):
    return [vocabulary[i] for i in np.minimum(rng.zipf(1.3, size=n) + rank - 1, len(vocabulary) - 1)]


@pytest.mark.parametrize("least, most", [(5, 9), (10, 19), (20, 39), (40, 80)])
def test_edited_copies_are_found_as_by_full_alignment(spark, least, most):
    rng = np.random.default_rng(least)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [zipf_words(rng, int(rng.integers(least, most + 1)), vocabulary, 0) for _ in range(40)]
    texts = [" ".join(zipf_words(rng, 20, vocabulary, 0) + edited(item, rng, share, vocabulary[:50]) + zipf_words(rng, 20, vocabulary, 0)) for item in items for share in (0.1, 0.25, 0.4)]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(documents(spark, texts), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    known = D.read_items([(i, " ".join(w)) for i, w in enumerate(items)])
    want = {(d, i) for d, t in enumerate(texts) for i, seq in enumerate(known.sequences) if D.align(seq, D.numbered(D.fold(t), known), D.Match())[0] / (2 * len(seq)) >= 0.5 and i == d // 3}
    assert len(want) > 60 and len(want & got) >= 0.9 * len(want)


def test_other_documents_change_no_row(spark, items):
    words = ITEM.split()
    own = [f"{filler(20, i)} {' '.join(w for j, w in enumerate(words) if (j + i) % 5)}" for i in range(10)] + [filler(30, 77)]
    want = rows_of(D.contaminated(documents(spark, own), items))
    more = documents(spark, own + [filler(400, 1000 + i) for i in range(200)])
    assert want and rows_of(D.contaminated(more, items)) == want


def test_repeated_items_are_aligned_once_and_all_reported(spark, monkeypatch):
    monkeypatch.setattr(D, "PASS_BYTES", 4 * len(ITEM))
    items = spark.createDataFrame([(i, ITEM) for i in range(300)] + [(7, ITEM), (None, ITEM), (900, None)], "item_id long, text string")
    docs = documents(spark, [f"{filler(9, 1)} {ITEM}", filler(9, 2)])
    assert len(list(D.item_passes(docs, items, D.Match()))) == 1
    got = D.contaminated(docs, items).collect()
    assert sorted((r.item_id is None, r.item_id) for r in got if r.item_id is not None) == sorted((False, i) for i in [*range(300), 7])
    assert len(got) == 302 and {(r.doc_id, r.score) for r in got} == {(0, 1.0)}

import zlib

import numpy as np
import pytest
from odd import documents, odd_documents, rows_of, with_clashes
from pyspark.sql import functions as F

from tollway.llm import queries
from tollway.llm import toxicity as X

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return queries.QUERIES["op8_weak_supervision"](spark, D).collect()


def test_held_out_accuracy(spark, scored):
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in scored if r.held_out and r.doc_id in label]
    clean, toxic = [p for p, y in held if not y], [p for p, y in held if y]
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.4 * len(toxic)  # 33 toxic texts to learn four languages from


def test_shape(spark, scored):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{D}/documents.parquet").collect())
    assert sorted(r.doc_id for r in scored) == ids
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def made(spark, n=600):
    rng = np.random.default_rng(6)
    bad = ["grumblewort", "snarkbane", "vileton", "muckish", "drossen"]
    texts, labels = [], []
    for i in range(n):
        words = [str(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"])) + str(rng.integers(0, 40)) for _ in range(60)]
        y = int(rng.random() < 0.3)
        if y:
            for w in rng.choice(bad, size=rng.integers(1, 4), replace=False):
                words[int(rng.integers(0, 60))] = str(w) + str(rng.choice(["", "s", "ed", "ly"]))
        texts.append(" ".join(words))
        labels.append((i, 1, y))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_made_corpus_is_learned(spark):
    docs, labels = made(spark)
    got = {r.doc_id: r for r in X.score(docs, labels).collect()}
    wrong = [r.doc_id for r in labels.collect() if got[r.doc_id].held_out and got[r.doc_id].predicted != r.toxic]
    assert len(wrong) <= 4


def test_held_out_labels_change_nothing(spark):
    docs, labels = made(spark, 300)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(X.score(docs, flipped)) == rows_of(X.score(docs, labels))
    renamed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert rows_of(X.score(renamed, labels)) == rows_of(X.score(docs, labels))


def counted(spark, votes, parts=3):
    seen, count = np.unique(votes, return_counts=True)
    return spark.createDataFrame(list(zip(seen.tolist(), count.tolist(), strict=True)), "votes long, n long").repartition(parts)


def plain_model(votes, cliques, lexicons, rounds=60):
    """Expectation maximization text by text, in plain numbers."""

    n = len(votes)
    p = [0.9 if v & lexicons else 0.01 for v in votes]
    state = [[sum(((v >> one) & 1) << k for k, one in enumerate(c)) for v in votes] for c in cliques]
    for _ in range(rounds):
        weight = [[1 - x for x in p], p]
        prior = min(max(sum(p) / n, 1e-4), 0.5)
        silent = [(sum(w for w, v in zip(side, votes, strict=True) if not v & lexicons) + 0.01) / (sum(side) + 0.02) for side in weight]
        rates = []
        for c, of in zip(cliques, state, strict=True):
            rates.append([])
            for side in weight:
                sums = [0.01] * (1 << len(c))
                for s, w in zip(of, side, strict=True):
                    sums[s] += w
                rates[-1].append([x / sum(sums) for x in sums])
        p = []
        for i, v in enumerate(votes):
            side = [1 - prior, prior]
            for y in (0, 1):
                for of, rate in zip(state, rates, strict=True):
                    side[y] *= rate[y][of[i]] if of[i] else 1.0
                side[y] *= 1.0 if v & lexicons else silent[y]
            p.append(side[1] / sum(side))
    return prior, silent, rates, p


def test_label_model_equals_a_plain_one_over_all_combinations(spark):
    rng = np.random.default_rng(11)
    n, lexicons = 1500, 0b11111
    y = rng.random(n) < 0.2
    fire = np.stack([np.where(y, rng.random(n) < 0.4, rng.random(n) < 0.03) for _ in range(5)] + [rng.random(n) < 0.1 for _ in X.PATTERNS], axis=1)
    votes = (fire << np.arange(9)).sum(axis=1).tolist()
    cliques = [[0, 2], [1], [3, 4, 5], [6], [7], [8]]
    prior, silent, rates, p = plain_model(votes, cliques, lexicons)
    got = X.expect(counted(spark, votes), cliques, lexicons)
    assert abs(got.prior - prior) < 1e-4 and np.abs(got.silent - silent).max() < 1e-4
    assert max(np.abs(a - np.array(b)).max() for a, b in zip(got.rates, rates, strict=True)) < 1e-4
    assert np.abs(got.posterior(np.array(votes)) - p).max() < 1e-3


def test_label_model_does_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(12)
    votes = rng.integers(0, 1 << 12, size=9000)  # some 3,600 combinations
    lexicon = X.Lexicon(voter_of=list(range(8)))
    one, many = (X.fit_label_model(counted(spark, votes, k), lexicon, X.Config()) for k in (1, 7))
    assert one.cliques == many.cliques and one.prior == many.prior and all((a == b).all() for a, b in zip(one.rates, many.rates, strict=True))


def test_sums_stay_exact_for_huge_numbers_of_texts():
    votes, n = np.array([0, 1, 3]), np.array([(1 << 47) + 1, (1 << 33) + 5, 7])
    sums = X.part_sums(votes, n, np.array([0.0, 1.0, 1.0]), [[0], [1]], 0b11, 2)
    clean, toxic = sums[: len(sums) // 2], sums[len(sums) // 2 :]
    assert [x // X.SHARES for x in clean] == [(1 << 47) + 1, (1 << 47) + 1, (1 << 47) + 1, 0, (1 << 47) + 1, 0, 0, 0, 0, 0]
    assert [x // X.SHARES for x in toxic] == [(1 << 33) + 12, 0, 0, (1 << 33) + 12, (1 << 33) + 5, 7, (1 << 33) + 12, 7, 7, 7]


def test_no_vote_combinations_give_no_model(spark):
    assert X.fit_label_model(spark.createDataFrame([], "votes long, n long"), X.Lexicon(voter_of=[0]), X.Config()) is None


def test_label_model_finds_rates_without_labels(spark):
    rng = np.random.default_rng(7)
    lexicon = X.Lexicon(voter_of=[0, 1, 2, 3])
    n = 20_000
    y = rng.random(n) < 0.1
    fire = np.stack([np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in [(0.6, 0.001), (0.5, 0.002), (0.4, 0.001), (0.5, 0.001)]], axis=1)
    pattern = rng.random((n, len(X.PATTERNS))) < 0.05  # tell nothing
    votes = (np.concatenate([fire, pattern], axis=1) << np.arange(8)).sum(axis=1)
    model = X.fit_label_model(counted(spark, votes), lexicon, X.Config())
    guess = model.posterior(votes) > 0.5
    assert (guess == y).mean() > 0.985 and 0.07 < model.prior < 0.13
    twice = np.concatenate([fire, fire[:, :1], pattern], axis=1)  # one voter stands twice
    votes = (twice << np.arange(9)).sum(axis=1)
    model = X.fit_label_model(counted(spark, votes), X.Lexicon(voter_of=[0, 1, 2, 3, 4]), X.Config())
    assert any({0, 4} <= set(c) for c in model.cliques) and ((model.posterior(votes) > 0.5) == y).mean() > 0.985


def test_linear_classifier_fits_soft_labels():
    rows = [[0], [0, 1], [1], []] * 200
    w = X.fit_linear(rows, np.array([0.9, 0.9, 0.1, 0.1] * 200), 2, X.Config())
    p = lambda hits: 1 / (1 + np.exp(-(w[hits].sum() + w[2])))
    assert abs(p([0]) - 0.9) < 0.05 and abs(p([]) - 0.1) < 0.05 and abs(w[1]) < 0.1


def test_odd_rows(spark):
    docs, labels = made(spark, 200)
    odd = docs.unionByName(odd_documents(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1001, 1, None), (1, 0, 0), (99_999, 0, 1)], "doc_id long, quality int, toxic int"))
    got = X.score(odd, more)
    assert got.count() == odd.count()
    assert rows_of(X.score(with_clashes(odd), more.withColumn("text", F.lit("clash")))) == rows_of(got)
    empty = {r.score for r in got.collect() if r.doc_id in (1001, 1002, 1003)}
    assert len(empty) == 1 and empty.pop() < 0.1
    assert X.score(docs.limit(0), labels).count() == 0
    none = X.score(docs, labels.limit(0)).collect()
    assert len(none) == 200 and not any(r.predicted for r in none)

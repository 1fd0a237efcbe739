from collections import Counter, defaultdict

import numpy as np
from odd import documents, odd_documents, rows_of, with_clashes

from tollway.llm import quality, queries
from tollway.llm.quality import Rules


def base_by_hand(text):
    raw = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", raw) if w]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in raw.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in raw), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def reference_by_hand(rows, rules):
    classes, words = defaultdict(lambda: np.zeros(len(quality.CLASSES))), defaultdict(Counter)
    for r in rows:
        for lang in {r.lang or "", ""}:
            classes[lang] += quality.class_counts((r.text or "").encode())
            words[lang].update((r.text or "").encode().lower().split())
    out = {}
    for lang, seen in words.items():
        if sum(seen.values()) >= rules.reference_least_words or lang == "":
            top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: rules.common_words]
            out[lang] = quality.Reference(classes[lang], {w: i for i, (w, _) in enumerate(top)}, np.array([*[n for _, n in top], sum(seen.values()) - sum(n for _, n in top)], dtype=float))
    return out


def test_whole_table_against_a_plain_run(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    known = reference_by_hand(rows, Rules())
    got = {r.doc_id: r for r in queries.QUERIES["op4_distribution_divergence"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base_by_hand(r.text)
        want = quality.judge(r.text, r.lang, known, Rules())
        assert g.kept == want[6] and (g.class_distance, g.word_distance) == (want[7], want[8])
        assert not (g.kept and g.base_failed)


def test_good_rows_stay_and_bad_rows_go(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op4_distribution_divergence"](spark, d).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = [r for r in rows if labels[r.doc_id]], [r for r in rows if not labels[r.doc_id]]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad if r.n_words >= 100) >= 0.9 * sum(r.n_words >= 100 for r in bad)


def test_distance():
    a, b = np.array([1.0, 0, 3]), np.array([0.0, 5, 0])
    assert quality.distance(a, a) == 0 and abs(quality.distance(a, b) - 1) < 1e-12


def test_counts_by_hand():
    text = "a b c a b c x\na b c\n\na b c\n é|#"
    raw = text.encode()
    assert quality.counts(raw, raw.split()) == base_by_hand(text)[1:5]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = quality.assess(docs).collect()
    want = sorted(((r.doc_id, *base_by_hand(r.text)) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == want
    clash = with_clashes(docs)
    assert rows_of(quality.assess(clash)) == rows_of(quality.assess(docs))
    assert quality.assess(docs.limit(0)).count() == 0 and quality.keep(docs.limit(0)).count() == 0
    assert quality.keep(clash).columns == clash.columns
    kept = quality.keep(docs).collect()
    assert len(kept) == sum(r.kept for r in got)


def test_small_counters_give_the_same_reference(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = rows_of(quality.corpus_counts(docs))
    monkeypatch.setattr(quality, "HELD", 50)
    assert rows_of(quality.corpus_counts(docs)) == before


def test_unknown_language_uses_all_documents(spark):
    plain = " ".join(["the cat sat on the mat and the dog ran to the house"] * 3)
    docs = documents(spark, [f"{plain} {i} extra words make this one differ a little" for i in range(60)])
    other = docs.limit(1).withColumn("lang", __import__("pyspark").sql.functions.lit("zz"))
    got = quality.assess(docs.unionByName(other)).collect()
    assert all(r.word_distance is None or r.word_distance < 0.2 for r in got)

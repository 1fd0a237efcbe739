import corpus_pipeline
from odd import odd_documents, with_clashes
from public_tokenizers import path
from test_bpe import expected
from test_quality import reference_by_hand
from test_simhash import clusters_by_hand
from tokenizers import Tokenizer

import __spark_entry__
from tollway.llm import decontaminate, pii, quality, queries


def plain_run(spark, sf_dir):
    """The five stages row by row."""

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    known = reference_by_hand(rows, quality.Rules())
    rows = [r for r in rows if quality.judge(r.text, r.lang, known, quality.Rules())[6]]
    group = {d: c for d, _, c in clusters_by_hand([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    items = decontaminate.read_items([(t.item_id, t.text) for t in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    match = decontaminate.Match()

    def leaked(text):
        words = decontaminate.numbered(decontaminate.fold(text), items)
        return any(decontaminate.align(s, words, match)[0] >= match.least_score * match.hit * len(s) for s in items.sequences)

    kept = [r.doc_id for r in rows if not leaked(r.text)]
    # each value's pseudonym is checked by itself in test_pii; here its text is taken over
    changed = pii.pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.DEMO_KEY)
    text = {r.doc_id: r.text for r in changed.collect()}
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    return sorted((d, *expected(library, text[d])) for d in kept)


def test_whole_table_against_a_plain_run(spark, sf_dir):
    want = plain_run(spark, sf_dir)
    got = sorted(tuple(r) for r in __spark_entry__.queries()["pipeline"](spark, sf_dir).collect())
    assert got == want and 50 < len(got) < 200


def test_stages_stand_odd_rows(spark, sf_dir):
    docs = with_clashes(odd_documents(spark))
    for some in (docs, docs.limit(0)):
        rows = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf_dir)
            assert rows.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).count() == rows.count()
    # without the quality rules, which odd rows fail, the other stages keep them but for copies
    rows = docs
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        rows = stage(spark, rows, sf_dir)
    groups = clusters_by_hand([(r.doc_id, r.text) for r in docs.collect()], groups=True)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).count() == len(groups)


def test_every_stage_is_one_operator():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminated", "pseudonyms", "tokens"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))

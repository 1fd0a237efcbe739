"""Documents without a text are prompts like others."""

import json

import pytest
from pyspark.sql import functions as F

from tollway.catalog import load
from tollway.sources import replay, wide

QUERIES = load().QUERIES


@pytest.fixture(scope="module")
def blank_dir(spark, sf_dir, tmp_path_factory):
    """The given documents and 27 more that are empty, blanks only or null, under each remainder of nine."""

    folder = tmp_path_factory.mktemp("blank")
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.get(F.array(F.lit(""), F.lit("  "), F.lit(None)), (F.col("id") / 9).cast("int"))
    more = spark.range(27).select(
        (F.col("id") + given.count()).alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(0).cast("bigint").alias("n_chars")
    )
    given.unionByName(more).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_a_blank_prompt_is_refused_unless_allowed(spark):
    row = ("mmlu-law", "a", 0.5, "ok", 0.25)
    schema = "sample_id string, prompt string, eval_name string, oracle_model_to_route_to string, `a` double, `a|model_response` string, `a|total_cost` double"
    w = spark.createDataFrame([("s0", "text", *row), ("s1", "", *row), ("s2", "  ", *row), ("s3", None, *row)], schema)
    found = lambda *more: {tuple(r) for r in wide.value_violations(w, *more).collect()}
    assert found() == {(f"s{k}", "prompt", "empty text") for k in (1, 2, 3)}
    assert found(True) == {("s3", "prompt", "empty text")}
    with pytest.raises(ValueError):
        wide.require_valid(w.where("sample_id < 's3'"))
    assert wide.require_valid(w.where("sample_id < 's3'"), blank_prompts=True) == ["a"]


def test_balanced_diagnostic_takes_blank_documents(spark, blank_dir):
    card = {r["policy"]: r for r in QUERIES["balanced_diagnostic"](spark, blank_dir).collect()}
    half = spark.read.parquet(f"{blank_dir}/documents.parquet").where("doc_id % 9 <> 8")
    domain = F.expr("CASE doc_id % 9 WHEN 0 THEN 'mmlu' WHEN 1 THEN 'gsm8k' WHEN 2 THEN 'mtbench' WHEN 3 THEN 'arc-challenge' WHEN 4 THEN 'hellaswag' WHEN 5 THEN 'mbpp' WHEN 6 THEN 'winogrande' ELSE 'mmlu' END")
    digest = F.sha2(F.concat_ws("\x1f", F.lit("rev1"), domain, F.col("doc_id").cast("string")), 256)
    n = half.where(F.substring(digest, 1, 1) >= "8").count()
    assert len(card) == 7 and card["always-cheapest"]["calls"] == card["bilinear"]["calls"] == 3 * n


def test_blank_lines_are_refused_unless_allowed(spark, tmp_path):
    outcome = {"model_id": "m", "output": "o", "cost": "0.5", "quality": 0.25}
    prompts = ["text", "", "  ", None, 7]
    path = tmp_path / "log.json"
    path.write_text("\n".join(json.dumps({"example_id": f"e{k}", "prompt": p, "domain": "d", "outcomes": [outcome]}) for k, p in enumerate(prompts)))

    def problems(**how):
        return [r["problem"] for r in replay.read_lines(spark, str(path), True, strict=False, **how).orderBy("ord").collect()]

    assert problems() == [None] + ["example text"] * 4
    assert problems(blank_prompts=True) == [None] * 3 + ["example text"] * 2
    with pytest.raises(Exception, match="row 1: example text"):
        replay.read_lines(spark, str(path), True).collect()
    with pytest.raises(Exception, match="row 3: example text"):
        replay.read_lines(spark, str(path), True, blank_prompts=True).collect()


def test_json_round_trip_takes_blank_documents(spark, blank_dir):
    want = QUERIES["outcomes_with_quotes"](spark, blank_dir).collect()
    assert len(want) == 5 * 227 and sorted(QUERIES["replay_json_round_trip"](spark, blank_dir).collect()) == sorted(want)


def test_prefix_replay_takes_blank_documents(spark, blank_dir):
    inside = spark.read.parquet(f"{blank_dir}/documents.parquet").where("doc_id % 9 <> 8").count()
    (row,) = QUERIES["prefix_smoke_replay"](spark, blank_dir).collect()
    assert (row["policy"], row["n_queries"], row["n_failed"]) == ("always-cheapest", inside - inside // 5, 0)


def test_prefix_replay_still_checks_texts(spark, blank_dir):
    from tollway.catalog.logs import wide_log
    from tollway.plans.diagnostic import prefix_replay

    with pytest.raises(ValueError, match="empty text"):
        prefix_replay(wide_log(spark, blank_dir))
    with pytest.raises(ValueError, match="empty text"):
        prefix_replay(wide_log(spark, blank_dir).withColumn("m2|model_response", F.lit(" ")), blank_prompts=True)

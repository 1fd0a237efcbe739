"""Readers, validation and saved artifacts."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from samples import ROWS, TIERS, sample_log
from tollway.functions.fingerprint import data_identity, replay_identity, row_digest
from tollway.operators import splits
from tollway.plans import benchmark
from tollway.plans.route import route
from tollway.plans.train import train
from tollway.sources import artifacts, embeddings, numbering, wide
from tollway.sources import replay as source


def document():
    costs = {"swift": "0.20", "steady": "0.60", "expert": "1e0"}
    return {
        "schema_version": 1, "name": "sample", "license": "none", "provenance": "made up", "domain_labels_are_observable": True,
        "tier_specs": [{"tier": t.tier, "budget_limit": str(t.budget), "weight": t.weight} for t in TIERS],
        "examples": [
            {
                "example_id": r[0], "domain": r[1], "prompt": r[2],
                "outcomes": [{"model_id": m, "output": f"{m} answer", "cost": costs[m], "quality": q} for m, q in zip(costs, r[3:])],
            }
            for r in ROWS
        ],
    }


def put(tmp_path, doc, name="log.json"):
    path = tmp_path / name
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False, indent=1))
    return str(path)


def test_document_round_trip(spark, tmp_path):
    log, tiers = source.read_document(spark, put(tmp_path, document()))
    assert tiers == TIERS
    want = sorted(map(str, sample_log(spark).select("example_id", "domain", "prompt", "models").collect()))
    assert sorted(map(str, log.select("example_id", "domain", "prompt", "models").collect())) == want
    assert log.select("observable_tag").distinct().count() == 4
    assert log.first()["outputs"][0].endswith("answer")


def test_lines(spark, tmp_path):
    text = "\n".join(json.dumps(e, ensure_ascii=False) for e in document()["examples"])
    log = source.read_lines(spark, put(tmp_path, text), observable=False)
    rows = log.orderBy("ord").collect()
    assert [r["example_id"] for r in rows] == [r[0] for r in ROWS] and [r["ord"] for r in rows] == list(range(8))
    assert rows[0]["observable_tag"] is None


def outcome(doc):
    return doc["examples"][0]["outcomes"][0]


BAD = {
    "unknown root field": lambda d: d.update(extra=1),
    "missing root field": lambda d: d.pop("license"),
    "version": lambda d: d.update(schema_version=2),
    "version text": lambda d: d.update(schema_version="1"),
    "flag": lambda d: d.update(domain_labels_are_observable=1),
    "no tiers": lambda d: d.update(tier_specs=[]),
    "no examples": lambda d: d.update(examples=[]),
    "duplicate tier": lambda d: d["tier_specs"].append(d["tier_specs"][0]),
    "tier name": lambda d: d["tier_specs"][0].update(tier="slow"),
    "tier weight": lambda d: d["tier_specs"][0].update(weight=True),
    "zero weight": lambda d: d["tier_specs"][0].update(weight=0),
    "budget number": lambda d: d["tier_specs"][0].update(budget_limit=0.35),
    "unknown example field": lambda d: d["examples"][0].update(note="x"),
    "blank prompt": lambda d: d["examples"][0].update(prompt="  "),
    "duplicate example": lambda d: d["examples"].append(d["examples"][0]),
    "no outcomes": lambda d: d["examples"][0].update(outcomes=[]),
    "duplicate model": lambda d: d["examples"][0]["outcomes"].append(outcome(d)),
    "unknown outcome field": lambda d: outcome(d).update(note="x"),
    "negative cost": lambda d: outcome(d).update(cost="-0.1"),
    "cost number": lambda d: outcome(d).update(cost=0.2),
    "cost text": lambda d: outcome(d).update(cost="cheap"),
    "quoted": lambda d: outcome(d).update(quoted_cost=None),
    "quality flag": lambda d: outcome(d).update(quality=True),
    "quality text": lambda d: outcome(d).update(quality="0.5"),
    "blank output": lambda d: outcome(d).update(output=""),
}


@pytest.mark.parametrize("name", BAD)
def test_bad_documents(spark, tmp_path, name):
    doc = document()
    BAD[name](doc)
    with pytest.raises(Exception):
        source.read_document(spark, put(tmp_path, doc))[0].collect()


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', '{"quality": NaN}', "[1]", "{"])
def test_bad_json(spark, tmp_path, text):
    with pytest.raises(Exception):
        source.read_document(spark, put(tmp_path, text))


def test_a_line_is_parsed_once(spark, tmp_path):
    from tollway.catalog.logs import shown_long

    outcome = {"model_id": "m", "output": "o", "cost": "0.5", "quality": 0.25}
    text = "\n".join(json.dumps({"example_id": f"e{k}", "prompt": "p", "domain": "d", "outcomes": [outcome]}) for k in range(3))
    shown = shown_long(source.read_lines(spark, put(tmp_path, text), True))
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert [tuple(r) for r in shown.orderBy("example_id").collect()] == [(f"e{k}", "m", 500000, 500000, 250) for k in range(3)]


def test_lenient_lines_name_the_problem(spark, tmp_path):
    good, bad = document()["examples"][:2]
    bad["outcomes"][0]["quality"] = "x"
    text = "\n".join(json.dumps(e) for e in (good, bad, [1]))
    rows = source.read_lines(spark, put(tmp_path, text), True, strict=False).orderBy("ord").collect()
    assert [r["problem"] for r in rows] == [None, "outcome", "example is not an object"]
    assert rows[1]["models"] is None and len(rows[0]["models"]) == 3


def test_explicit_quote(spark, tmp_path):
    doc = document()
    outcome(doc)["quoted_cost"] = "0.25"
    log, _ = source.read_document(spark, put(tmp_path, doc))
    models = {m["model_id"]: m for m in log.where("example_id = 'general-001'").first()["models"]}
    assert models["swift"]["quoted"] == Decimal("0.25") and models["swift"]["realized"] == Decimal("0.20")


def test_numbers_follow_source_order(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "x")
    rows = numbering.with_ord(df).collect()
    assert all(r["x"] == r["ord"] for r in rows) and len(rows) == 1000


def test_numbers_follow_files_of_unequal_size(spark, tmp_path):
    sizes, n = [50, 500, 20, 900], 0
    for i, size in enumerate(sizes):
        (tmp_path / f"part-{i}.txt").write_text("".join(f"{n + k} {'x' * (k % 90)}\n" for k in range(size)))
        n += size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # several splits of a file, and files packed by size
    try:
        lines = spark.read.text(str(tmp_path)).where(F.length("value") > 0)
        rows = numbering.with_ord(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n and all(int(r["value"].split()[0]) == r["ord"] for r in rows)
    assert set(rows[0].asDict()) == {"value", "ord"}


WIDE = ["sample_id", "prompt", "eval_name", "oracle_model_to_route_to", "a", "a|model_response", "a|total_cost"]


@pytest.mark.parametrize("columns", [WIDE[1:], WIDE[:-1], WIDE[:4], [c for c in WIDE if c != "a"], WIDE + ["b|total_cost"], WIDE + ["a"]])
def test_bad_wide_columns(columns):
    with pytest.raises(ValueError):
        wide.wide_models(columns)


def test_wide_domains_and_csv(spark, tmp_path):
    names = ["mmlu-law", "grade-school-math", "mtbench-2", "arc-challenge", "hellaswag", "mbpp", "winogrande", "other"]
    schema = "sample_id string, prompt string, eval_name string, oracle_model_to_route_to string, `a` double, `a|model_response` string, `a|total_cost` double"
    rows = [(f"s{i}", "line one\nsays \"hi\"", n, "no_model_correct", 0.5, "ok", 0.25) for i, n in enumerate(names)]
    path = str(tmp_path / "wide")
    spark.createDataFrame(rows, schema).coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    w = wide.read_wide(spark, path, "csv", schema)
    assert wide.require_valid(w) == ["a"]
    got = [r["d"] for r in w.orderBy("sample_id").select(wide.eval_domain(F.col("eval_name")).alias("d")).collect()]
    assert got == ["mmlu", "gsm8k", "mtbench", "arc-challenge", "hellaswag", "mbpp", "winogrande", None]
    with pytest.raises(ValueError):
        wide.read_wide(spark, path, "pickle")
    with pytest.raises(ValueError):
        wide.read_wide(spark, path, "csv")
    log = wide.to_log(w.withColumn("ord", F.lit(0).cast("bigint")), {"a": Decimal(1)}, include_unmapped=True)
    assert log.where("domain = 'unmapped:other'").count() == 1 and log.count() == 8


def test_diagnostic_tiers():
    quotes = {"a": Decimal(3), "b": Decimal(1), "c": Decimal(2), "d": Decimal(4)}
    assert [t.budget for t in wide.diagnostic_tiers(quotes)] == [1, 3, 4]
    with pytest.raises(ValueError):
        wide.diagnostic_tiers({"a": Decimal(1), "b": Decimal(1), "c": Decimal(1)})
    with pytest.raises(ValueError):
        wide.diagnostic_tiers({"a": Decimal(1), "b": Decimal(2)})


def test_split_ignores_outcomes_and_survives_salting(spark):
    rows = spark.range(500).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("example_id"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("domain"))
    pick = lambda salts: {(r["example_id"], r["role"]) for r in splits.balanced_split(rows, "r", 20, 5, salts).collect()}
    assert pick(1) == pick(64) and len(pick(8)) == 50
    assert {e for e, _ in pick(8)} != {e for e, _ in {(r["example_id"], r["role"]) for r in splits.balanced_split(rows, "other", 20, 5).collect()}}


def test_share_split_takes_every_row_in_proportion(spark):
    rows = spark.range(9000).select(F.col("id").cast("string").alias("example_id"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("domain"))
    got = {(r["domain"], r["role"]): r["count"] for r in splits.share_split(rows, "r", 2, 1).groupBy("domain", "role").count().collect()}
    assert sum(got.values()) == 9000
    assert abs(got["hot", "evaluation"] - 2100) < 150 and abs(got["cold", "evaluation"] - 900) < 100
    with pytest.raises(ValueError):
        splits.share_split(rows, "r", 0, 1)


def test_prefix_split_covers_the_log(spark):
    rows = spark.range(503).select((F.col("id") * 7).alias("ord")).repartition(3)
    got = splits.prefix_split(rows).collect()
    assert len(got) == 503 and {r["ord"] for r in got if r["role"] == "calibration"} == {7 * i for i in range(100)}


def test_identities(spark):
    log = sample_log(spark)
    shuffled = log.repartition(5).orderBy(F.desc("example_id"))
    assert data_identity(log).first() == data_identity(shuffled).first()
    moved = log.withColumn("ord", 7 - F.col("ord"))
    assert data_identity(log).first() == data_identity(moved).first()
    assert replay_identity(log).first() != replay_identity(moved).first()
    changed = log.withColumn("prompt", F.concat("prompt", F.lit("!")))
    assert data_identity(log).first() != data_identity(changed).first()


def test_digests_tell_fields_and_nulls_apart(spark):
    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), ("a", "b1:c"), ("a1:b", "c"), (None, "c"), ("-", "c"), ("\x00", "c"), ("", "c"), ("", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(row_digest([F.col("a"), F.col("b")]).alias("d")).distinct().count() == len(rows)


def test_embedding_checks(spark):
    log = sample_log(spark)
    vectors = log.select("example_id", F.sha2("prompt", 256).alias("prompt_sha256"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert embeddings.attach(log, vectors, 2).count() == 8
    for bad in (
        vectors.limit(7), vectors.unionByName(vectors.limit(1)), vectors.withColumn("prompt_sha256", F.lit("x")),
        vectors.withColumn("embedding", F.array(F.lit(1.0))), vectors.withColumn("embedding", F.array(F.lit(1.0), F.lit(float("nan")))),
    ):
        with pytest.raises(ValueError):
            embeddings.attach(log, bad, 2)


@pytest.mark.parametrize("config", [benchmark.LinearConfig(), benchmark.StumpConfig(rounds=2, min_leaf=1)])
def test_train_save_load_route(spark, tmp_path, config):
    log, path = sample_log(spark), str(tmp_path / "out")
    t = train(log, TIERS, config, path)
    lambdas = artifacts.verify_policy(spark, f"{path}/policy", f"{path}/predictor", log, TIERS)
    assert lambdas == t.lambdas
    p = artifacts.load_predictor(spark, f"{path}/predictor")
    catalogue = {"swift": Decimal("0.2"), "steady": Decimal("0.6"), "expert": Decimal(1)}
    prompts = log.select("example_id", "prompt")
    a = route(prompts, catalogue, TIERS, lambdas, p.scorer, p.calibrators, ["example_id"])
    b = route(prompts, catalogue, TIERS, lambdas, t.fitted.scorer, t.fitted.calibrators, ["example_id"])
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.where("decision is null").isEmpty()
    for bad_log, bad_tiers in ((log.withColumn("prompt", F.lit("x")), TIERS), (log.withColumn("ord", 7 - F.col("ord")), TIERS), (log, TIERS[:2])):
        with pytest.raises(ValueError, match="tuned"):
            artifacts.verify_policy(spark, f"{path}/policy", f"{path}/predictor", bad_log, bad_tiers)


def test_steps_beyond_a_task_give_the_same_scores(spark, tmp_path, monkeypatch):
    from tollway.operators import isotonic, predict
    from tollway.operators.scoring import Calibrators, StepTable

    log = sample_log(spark)
    near = train(log, TIERS, benchmark.LinearConfig(), str(tmp_path / "near"))
    monkeypatch.setattr(isotonic, "MAX_LOCAL_STEPS", 1)
    far = train(log, TIERS, benchmark.LinearConfig(), str(tmp_path / "far"))
    assert isinstance(near.fitted.calibrators, Calibrators) and isinstance(far.fitted.calibrators, StepTable)
    assert near.lambdas == far.lambdas
    loaded = artifacts.load_predictor(spark, str(tmp_path / "far/predictor"))
    assert isinstance(loaded.calibrators, StepTable)
    cells = benchmark.prepare_fits(log, TIERS)
    shown = lambda df: sorted(map(str, df.select("example_id", "mask", "predicted").collect()))
    masks = cells.plan.masks(1)
    a = predict.predict_excluding(cells.features, cells.plan, near.fitted.scorer, near.fitted.calibrators, masks)
    b = predict.predict_excluding(cells.features, cells.plan, far.fitted.scorer, far.fitted.calibrators, masks)
    assert shown(a) == shown(b) and a.count() == 8
    whole = lambda f, c: shown(predict.predict_all(cells.features, f, c).withColumn("mask", F.lit(0)))
    assert whole(near.fitted.scorer, near.fitted.calibrators) == whole(loaded.scorer, loaded.calibrators)
    broken = spark.read.parquet(str(tmp_path / "far/predictor/steps")).withColumn("value", -F.col("value") * F.col("ub"))
    broken.unionByName(broken.withColumn("value", F.col("value") + 1)).write.parquet(str(tmp_path / "steps"))
    with pytest.raises(ValueError, match="out of order"):
        artifacts.check_steps(isotonic.load(spark.read.parquet(str(tmp_path / "steps")).withColumn("model_pos", F.lit(0))))


def test_shared_budget_training(spark, tmp_path):
    from tollway.schema import TierSpec

    pooled = [TierSpec(t.tier, t.budget * 8, t.weight) for t in TIERS]
    t = train(sample_log(spark), pooled, benchmark.LinearConfig(), str(tmp_path / "out"), ledger="cumulative", grid=[(0, 1), (1, 2), (5, 1)])
    assert set(t.lambdas) == {"fast", "balanced", "premium"}


def test_remaining_budget_is_checked(spark):
    prompts = spark.createDataFrame([("hello", Decimal("0.25")), ("hello", None)], "prompt string, remaining decimal(28,12)")
    catalogue = {"swift": Decimal("0.2"), "steady": Decimal("0.6")}
    got = route(prompts, catalogue, TIERS[1:2], keep=["remaining"]).collect()
    assert {r["remaining"]: r["decision"] for r in got}[Decimal("0.25")] == "swift"
    with pytest.raises(Exception, match="remaining"):
        route(prompts.withColumn("remaining", F.lit(Decimal(9)).cast("decimal(28,12)")), catalogue, TIERS).collect()

"""Predictors of surface and embedding features: training, saved identity, loading, routing."""

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from samples import MODELS, TIERS, sample_log
from tollway.catalog.logs import embedded_log
from tollway.catalog.sample import dense_log
from tollway.functions.encode import with_features
from tollway.functions.surface import prompt_hash
from tollway.operators import policies
from tollway.plans import benchmark
from tollway.plans.route import route
from tollway.plans.train import train
from tollway.session import scratch_path
from tollway.sources import artifacts, embeddings
from tollway.streaming.route import FittedRouting, release

IDENTITY = embeddings.EmbeddingIdentity("own", "lengths", "r1", "mean", False, "ab" * 32, 2)
CATALOGUE = {m: Decimal("0.001") * (k + 1) for k, m in enumerate(sorted(MODELS))}


def vectors_of(log):
    h = prompt_hash(F.col("prompt")).alias("prompt_sha256")
    n = F.length("prompt").cast("float")
    return embeddings.Embedded(IDENTITY, log.select(h, F.array(n, -n).alias("embedding")).dropDuplicates(["prompt_sha256"]))


@pytest.fixture(scope="module", params=["bilinear", "stumps"])
def saved(spark, request):
    log = sample_log(spark)
    path = scratch_path(spark, "embedded-test")
    config = {"bilinear": benchmark.LinearConfig(), "stumps": benchmark.StumpConfig(rounds=3)}[request.param]
    return log, path, train(log, TIERS, config, path, embedded=vectors_of(log))


def test_saved_predictor_scores_as_the_fitted_one(spark, saved):
    log, path, trained = saved
    p = artifacts.load_predictor(spark, f"{path}/predictor", IDENTITY)
    assert p.meta["feature_names"][-2:] == ["embedding:0", "embedding:1"]
    assert embeddings.EmbeddingIdentity.from_json(p.meta["embedding"]) == IDENTITY
    lambdas = artifacts.verify_policy(spark, f"{path}/policy", f"{path}/predictor", log, TIERS)
    made = [
        route(log.select("example_id", "prompt"), CATALOGUE, TIERS, lambdas, s, c, ["example_id"], embedded=vectors_of(log))
        for s, c in ((p.scorer, p.calibrators), (trained.fitted.scorer, trained.fitted.calibrators))
    ]
    rows = [sorted(map(tuple, m.collect()), key=repr) for m in made]
    assert rows[0] == rows[1] and len(rows[0]) == log.count() * len(TIERS)


@pytest.mark.parametrize("name,value", [("provider", "other"), ("model", "m2"), ("revision", "r2"), ("pooling", "cls"), ("normalize", True), ("manifest_sha256", "cd" * 32), ("width", 3)])
def test_another_identity_is_refused(spark, saved, name, value):
    _, path, _ = saved
    with pytest.raises(ValueError, match=f"another embedding {name}"):
        artifacts.load_predictor(spark, f"{path}/predictor", replace(IDENTITY, **{name: value}))


def test_identity_is_needed_exactly_where_there_are_vectors(spark, saved):
    log, path, _ = saved
    with pytest.raises(ValueError, match="needs embeddings"):
        artifacts.load_predictor(spark, f"{path}/predictor")
    plain = scratch_path(spark, "plain-test")
    train(log, TIERS, benchmark.LinearConfig(), plain)
    with pytest.raises(ValueError, match="without embeddings"):
        artifacts.load_predictor(spark, f"{plain}/predictor", IDENTITY)


def test_prompts_without_a_vector_fail(spark, saved):
    log, path, _ = saved
    p = artifacts.load_predictor(spark, f"{path}/predictor", IDENTITY)
    unknown = spark.createDataFrame([("x", "never embedded")], "example_id string, prompt string")
    with pytest.raises(Exception, match="no embedding"):
        route(unknown, CATALOGUE, TIERS, None, p.scorer, p.calibrators, ["example_id"], embedded=vectors_of(log)).collect()


def test_equal_prompts_share_their_vector(spark):
    log = sample_log(spark)
    rows = log.select("prompt").unionAll(log.select("prompt"))
    found = embeddings.attach_prompts(rows, vectors_of(log)).collect()
    assert len(found) == 2 * log.count() and all(r["embedding"] == [len(r["prompt"]), -len(r["prompt"])] for r in found)


def test_texts_do_not_travel_to_the_vectors(spark, sf_dir):
    log, recorded = embedded_log(spark, sf_dir, [policies.seeded_random()])
    joined = with_features(embeddings.attach(log, recorded, 64), "embedding", 64)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "prompt#" not in plan and "text#" not in plan
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ord"), "embedding")
    plain = with_features(dense_log(spark, sf_dir).join(vectors, "ord"), "embedding", 64)
    plain = policies.with_facts(plain, [policies.seeded_random()], ["fast", "balanced", "premium"])
    shown = lambda df: df.select("example_id", "x", "_facts").orderBy("example_id").collect()
    assert shown(joined) == shown(plain) and joined.count() == plain.count()


def test_vectors_are_written_with_their_identity(spark):
    good = vectors_of(sample_log(spark))
    path = scratch_path(spark, "vectors-test")
    embeddings.save(good, path)
    again = embeddings.load(spark, path)
    assert again.identity == IDENTITY and again.vectors.exceptAll(good.vectors).isEmpty()
    v = good.vectors
    for bad in (v.unionAll(v.limit(1)), v.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), v.withColumn("embedding", F.array(*[F.lit(float("nan")).cast("float")] * 2))):
        path = scratch_path(spark, "vectors-bad")
        embeddings.save(embeddings.Embedded(IDENTITY, bad), path)
        with pytest.raises(ValueError, match="bad embedding"):
            embeddings.load(spark, path)


@pytest.mark.parametrize("change", [{"provider": " "}, {"model": ""}, {"revision": 1}, {"normalize": 1}, {"manifest_sha256": "AB" * 32}, {"manifest_sha256": "a"}, {"width": 0}, {"width": True}])
def test_identities_are_checked(change):
    with pytest.raises(ValueError, match="embedding"):
        replace(IDENTITY, **change)


def test_unknown_identity_fields_are_refused():
    with pytest.raises(ValueError, match="known fields"):
        embeddings.EmbeddingIdentity.from_json('{"provider": "own"}')


def test_a_stream_takes_up_a_new_release(spark):
    log = sample_log(spark)
    known = vectors_of(log)
    root = scratch_path(spark, "releases-test")
    paths = [f"{root}/{name}" for name in ("linear", "stumps")]
    train(log, TIERS, benchmark.LinearConfig(), paths[0], embedded=known)
    train(log, TIERS, benchmark.StumpConfig(rounds=3), paths[1], embedded=known)
    job = FittedRouting(f"{root}/releases", CATALOGUE, TIERS, f"{root}/out", ["example_id"], known)
    with pytest.raises(ValueError, match="released"):
        job._latest(spark)
    wanted = []
    for number, path in enumerate(paths, 1):
        assert release(spark, job.releases, path) == number
        new = log.select(F.concat("example_id", F.lit(f"-{number}")).alias("example_id"), "prompt")
        new.write.mode("append").parquet(f"{root}/in")
        job.start(spark.readStream.schema(new.schema).parquet(f"{root}/in"), f"{root}/progress").awaitTermination()
        p = artifacts.load_predictor(spark, f"{path}/predictor", IDENTITY)
        lambdas, _ = artifacts.load_policy(spark, f"{path}/policy")
        batch = route(new, CATALOGUE, TIERS, lambdas, p.scorer, p.calibrators, ["example_id"], embedded=known)
        wanted += [(*r, number) for r in batch.collect()]
    assert sorted(map(repr, map(tuple, job.decisions(spark).collect()))) == sorted(map(repr, wanted))


def test_a_stream_refuses_other_vectors(spark, saved):
    log, path, _ = saved
    root = scratch_path(spark, "refusal-test")
    release(spark, f"{root}/releases", path)
    other = embeddings.Embedded(replace(IDENTITY, revision="r2"), vectors_of(log).vectors)
    with pytest.raises(ValueError, match="another embedding revision"):
        FittedRouting(f"{root}/releases", CATALOGUE, TIERS, f"{root}/out", embedded=other)._latest(spark)
    with pytest.raises(ValueError, match="other tiers"):
        FittedRouting(f"{root}/releases", CATALOGUE, TIERS[:1], f"{root}/out", embedded=vectors_of(log))._latest(spark)

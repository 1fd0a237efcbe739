"""Surface features on hand-written strings."""

import pytest
from pyspark.sql import functions as F

from tollway.functions.costs import add_cost, cost_text, divide_cost, parse_cost, scale_cost, subtract_cost
from tollway.functions import surface
from tollway.functions.encode import FEATURE_NAMES, with_features
from tollway.functions.surface import with_surface


def surf(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, prompt string")
    return with_surface(rows).orderBy("i").collect()


@pytest.mark.parametrize(
    "text",
    [
        "render <a>link</a>", "</A data-value='x\ny'>", "plain\rdef example(): pass", "use ```x```", "  SELECT 1",
        "\tpublic static void main", "call console.log(1)", "#include <stdio.h>", "　import os",
    ],
)
def test_code(spark, text):
    assert surf(spark, text)[0]["has_code"]


@pytest.mark.parametrize("text", ["compare <1 and >2", "a < b", "<a" * 100000, "\"\n \"" * 100000 + "x", "we imported it", "definitely"])
def test_not_code(spark, text):
    assert not surf(spark, text)[0]["has_code"]


@pytest.mark.parametrize("text", ["$x$", r"\frac{1}{2}", "a ≤ b", "the Equation", "정리를 보여라", "Proof."])
def test_math(spark, text):
    assert surf(spark, text)[0]["has_math"]


@pytest.mark.parametrize("text", ["costs $5", "bulletproof", r"\fractal"])
def test_not_math(spark, text):
    assert not surf(spark, text)[0]["has_math"]


def test_every_tag(spark):
    texts = [
        "debug this", "algebra homework", "quantum physics", "a clinical question", "a contract clause", "stock prices", "hello there",
        "파이썬 질문", "화학 문제", "환자 상태", "판례 요약", "투자 조언", "코드python",
    ]
    tags = [r["tags"] for r in surf(spark, *texts)]
    assert tags == [
        ["code"], ["math"], ["science"], ["medicine"], ["law"], ["finance"], ["general"],
        ["code"], ["science"], ["medicine"], ["law"], ["finance"], ["code"],
    ]


def test_counts(spark):
    r = surf(spark, "a　b c", "one\ntwo\n", "é😀")
    assert [(x["n_char"], x["n_word"], x["n_line"]) for x in r] == [(5, 3, 1), (8, 2, 3), (2, 1, 1)]


def test_embedding_width_is_checked(spark):
    rows = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [1.0, float("nan")])], "prompt string, e array<double>")
    ok = with_features(rows.where("prompt = 'x'"), "e", 2).select(F.size("x").alias("n")).first()["n"]
    assert ok == len(FEATURE_NAMES) + 2
    for bad, width in ((rows.where("prompt = 'x'"), 3), (rows, 2)):
        with pytest.raises(Exception, match="embedding"):
            with_features(bad, "e", width).select("x").collect()


def test_costs(spark):
    rows = spark.createDataFrame([(t,) for t in ["1.500", "0", "1e-3", "100", "+2", "-1", "abc", "1_0", ".5", "1e400"]], "t string")
    got = rows.select(cost_text(parse_cost(F.col("t"))).alias("c")).collect()
    assert [r["c"] for r in got] == ["1.5", "0", "0.001", "100", "2", "-1", None, None, "0.5", None]
    one = spark.range(1).select(F.lit("0.3").cast("decimal(28,12)").alias("a"), F.lit("0.1").cast("decimal(28,12)").alias("b"))
    r = one.select(
        cost_text(add_cost(F.col("a"), F.col("b"))).alias("s"), cost_text(subtract_cost(F.col("a"), F.col("b"))).alias("d"),
        cost_text(scale_cost(F.col("a"), F.lit(3))).alias("m"), cost_text(divide_cost(F.col("a"), F.lit(4))).alias("q"),
    ).first()
    assert list(r) == ["0.4", "0.2", "0.9", "0.075"]
    with pytest.raises(Exception, match="negative"):
        one.select(subtract_cost(F.col("b"), F.col("a"))).collect()


def test_single_characters_are_searched_as_bytes(spark):
    odd = [*surface.MATH_SYMBOLS, *(f"a{c}b" for c in surface.CONTROL_SPACES), "ınt", "plain a<b", None]
    rows = surface.with_flags(spark.createDataFrame([(k, p) for k, p in enumerate(odd)], "k int, prompt string")).drop("_hangul")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    for characters in (surface.MATH_SYMBOLS, surface.CONTROL_SPACES, surface.FOLDED_LETTERS):
        assert f"[{characters}]" not in plan
    got = rows.orderBy("k").collect()
    assert [r["has_math"] for r in got] == [True] * 7 + [False] * 6 + [None]
    assert [r["n_word"] for r in got] == [1] * 7 + [2] * 4 + [1, 2, None] and got[11]["_low"] == "int"

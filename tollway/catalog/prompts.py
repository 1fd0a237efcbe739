"""Prompt features, feature schemas and encoded rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.catalog.registry import query, table
from tollway.catalog.sample import dense_log, sql_log, tiers
from tollway.functions import encode, surface
from tollway.operators import cells as cell_ops
from tollway.operators import moments
from tollway.operators.folds import domain_list, with_folds
from tollway.operators.policies import demo_predictions, visible_candidates
from tollway.session import materialize, spread

# The patterns again in the other engine's dialect, with explicit word edges.
_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
SQL_CODE = (
    r"(?i)```|(^|[\r\n])[\t\f\v \x{00A0}]*(def|class|function|import|from|SELECT|public static)" + _EDGE_R
    + r"|console\.log|System\.out|#include"
)
SQL_MATH = r"(?i)\$[^$]+\$|\\(frac|sum|int|sqrt|begin)" + _EDGE_R + r"|[∑∫√≈≠≤≥]|" + _EDGE_L + r"(equation|proof|theorem)" + _EDGE_R + r"|방정식|증명|정리|미분|적분"
SQL_TAGS = {
    "code": _EDGE_L + r"(python|javascript|typescript|java|rust|sql|api|debug|algorithm)" + _EDGE_R + r"|파이썬|자바스크립트|코드|디버그|알고리즘",
    "math": _EDGE_L + r"(math|algebra|geometry|calculus|probability)" + _EDGE_R + r"|수학|대수|기하|미적분|확률",
    "science": _EDGE_L + r"(physics|chemistry|biology|scientific)" + _EDGE_R + r"|물리|화학|생물|과학",
    "medicine": _EDGE_L + r"(medical|medicine|diagnosis|clinical|patient)" + _EDGE_R + r"|의학|진단|임상|환자",
    "law": _EDGE_L + r"(law|legal|statute|contract|court)" + _EDGE_R + r"|법률|법원|판례|계약서",
    "finance": _EDGE_L + r"(finance|investment|stock|accounting|revenue)" + _EDGE_R + r"|금융|투자|주식|회계|매출",
}


def surface_sql(source: str, key: str, text: str) -> str:
    """CTE ``surf``: key, counts, flags and one boolean per tag."""

    def hit(pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    tags = ", ".join(
        f"{hit('(?i)' + p)}" + (" OR has_code" if t == "code" else " OR has_math" if t == "math" else "") + f" AS tag_{t}"
        for t, p in SQL_TAGS.items()
    )
    return f"""flags AS (SELECT *, {hit(SQL_CODE)} OR regexp_matches({text}, '(?i)</?[a-z][^>]*>') AS has_code, {hit(SQL_MATH)} AS has_math FROM {source}),
surf AS (SELECT {key} AS k, length({text}) AS n_char, CAST(len(regexp_extract_all({text}, '[^\\s\\x{{0085}}\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+')) AS BIGINT) AS n_word,
  length({text}) - length(replace({text}, chr(10), '')) + 1 AS n_line, has_code, has_math, {tags} FROM flags)"""


_TAG_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN tag_{t} THEN '{t}' END" for t in surface.TAGS if t != "general"
) + "], lambda v: v IS NOT NULL)"
SHOWN = f"""SELECT k, n_char, n_word, n_line, has_code, has_math,
  CASE WHEN len({_TAG_LIST}) = 0 THEN 'general' ELSE array_to_string({_TAG_LIST}, ',') END AS tags FROM surf"""


def shown(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), "n_char", "n_word", "n_line", "has_code", "has_math", F.concat_ws(",", "tags").alias("tags"))


@query("surface_features", "F1 F2 F3 F4 F5 F6", f"WITH {surface_sql('documents', 'doc_id', 'text')} {SHOWN}")
def surface_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(surface.with_surface(spread(table(spark, sf_dir, "documents")), "text"), "doc_id")


@query("surface_features_pages", "F1 F2 F3 F4 F5 F6", f"WITH {surface_sql('pages', 'page_id', 'html')} {SHOWN}")
def surface_features_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages: markup makes the code flag true."""

    return shown(surface.with_surface(spread(table(spark, sf_dir, "pages")), "html"), "page_id")


@query("surface_features_turns", "F1 F2 F3 F4 F5 F6", f"WITH {surface_sql('conversations', 'conv_id * 1000 + turn', 'text')} {SHOWN}")
def surface_features_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return shown(surface.with_surface(c, "text"), "key")


_VECTOR = """feat AS (SELECT d.doc_id, d.lang, [ln(1 + n_char), ln(1 + n_word), ln(1 + n_line), has_code::INT::DOUBLE, has_math::INT::DOUBLE,
  tag_code::INT::DOUBLE, tag_finance::INT::DOUBLE, (NOT (tag_code OR tag_finance OR tag_law OR tag_math OR tag_medicine OR tag_science))::INT::DOUBLE,
  tag_law::INT::DOUBLE, tag_math::INT::DOUBLE, tag_medicine::INT::DOUBLE, tag_science::INT::DOUBLE] AS x
  FROM documents d JOIN surf ON surf.k = d.doc_id)"""
FEATURES_SQL = f"{surface_sql('documents', 'doc_id', 'text')}, {_VECTOR}"


@query("raw_feature_rows", "F9 P11", f"WITH {FEATURES_SQL} SELECT CAST(doc_id AS VARCHAR) AS example_id, lang AS domain, " + ", ".join(f"round(x[{i + 1}], 6) AS x{i}" for i in range(12)) + " FROM feat")
def raw_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.with_features(dense_log(spark, sf_dir))
    return rows.select("example_id", "domain", *[F.round(F.element_at("x", i + 1), 6).alias(f"x{i}") for i in range(12)])


@query("feature_schema_by_fold", "F7 J10", f"""WITH {FEATURES_SQL}, h AS (SELECT DISTINCT lang AS held_out FROM documents)
SELECT held_out, count(*) AS n_rows, round(avg(x[1]), 6) AS mean_char, round(avg(x[2]), 6) AS mean_word, round(avg(x[3]), 6) AS mean_line,
  round(stddev_pop(x[1]), 6) AS scale_char, round(stddev_pop(x[2]), 6) AS scale_word, round(CASE WHEN stddev_pop(x[3]) > 0 THEN stddev_pop(x[3]) ELSE 1 END, 6) AS scale_line,
  CAST(sum(CASE WHEN x[6] > 0 THEN 1 ELSE 0 END) > 0 AS INT) + CAST(max(x[7]) > 0 AS INT) + CAST(max(x[8]) > 0 AS INT) + CAST(max(x[9]) > 0 AS INT) + CAST(max(x[10]) > 0 AS INT) + CAST(max(x[11]) > 0 AS INT) + CAST(max(x[12]) > 0 AS INT) AS n_tags
FROM feat JOIN h ON feat.lang <> h.held_out GROUP BY held_out""")
def feature_schema_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = dense_log(spark, sf_dir)
    rows = with_folds(surface.with_surface(log).drop("models"), domain_list(log)).where("role = 'train'")
    s = encode.fit_schema(rows, ["held_out"])
    names = ("char", "word", "line")
    return s.select(
        "held_out", "n_rows", *[F.round(F.element_at("means", i + 1), 6).alias(f"mean_{n}") for i, n in enumerate(names)],
        *[F.round(F.element_at("scales", i + 1), 6).alias(f"scale_{n}") for i, n in enumerate(names)],
        F.size("tag_list").alias("n_tags"),
    )


@query("encoded_rows", "F8 F7", f"""WITH {FEATURES_SQL}, s AS (SELECT avg(x[1]) AS m1, avg(x[2]) AS m2, avg(x[3]) AS m3, stddev_pop(x[1]) AS s1, stddev_pop(x[2]) AS s2, stddev_pop(x[3]) AS s3 FROM feat)
SELECT CAST(doc_id AS VARCHAR) AS example_id, round((x[1] - m1) / s1, 6) AS z1, round((x[2] - m2) / s2, 6) AS z2, round((x[3] - m3) / s3, 6) AS z3, x[5] AS has_math FROM feat, s""")
def encoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows under one schema fitted on all of them."""

    rows = surface.with_surface(dense_log(spark, sf_dir).drop("models")).withColumn("context", F.lit("all"))
    e = encode.encode_rows(rows, F.broadcast(encode.fit_schema(rows, ["context"])), ["context"])
    return e.select("example_id", *[F.round(F.element_at("encoded", i), 6).alias(f"z{i}") for i in (1, 2, 3)], F.element_at("encoded", 5).alias("has_math"))


@query("domain_moments", "M2 M1", f"""WITH {sql_log()}, {FEATURES_SQL},
y AS (SELECT ord, list(q / 1000.0 ORDER BY model_id) AS y FROM long GROUP BY ord),
r AS (SELECT lang, x, y FROM feat JOIN y ON ord = doc_id),
i AS (SELECT unnest(range(1, 13)) AS i), j AS (SELECT unnest(range(1, 18)) AS j)
SELECT lang AS domain, CAST(i AS INT) AS i, CAST(j AS INT) AS j, count(*) AS n,
  round(covar_pop(x[i], CASE WHEN j <= 12 THEN x[j] ELSE y[j - 12] END) * count(*), 5) AS comoment
FROM r, i, j GROUP BY lang, i, j""")
def domain_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centered co-moments of features with features and with model qualities."""

    log = dense_log(spark, sf_dir)
    cells = materialize(cell_ops.cells(encode.with_features(log), tiers(), 5), "cells")
    return shown_moments(moments.domain_moments(cells, 12, 5))


def shown_moments(packed: DataFrame) -> DataFrame:
    """Per domain the centered co-moments as (i, j) rows."""

    rows = []
    for domain, m in moments.load(packed, 12, 5).items():
        both = np.concatenate(m.centered, axis=1)
        rows += [(domain, i + 1, j + 1, int(m.n), float(both[i, j])) for i in range(12) for j in range(17)]
    shown_rows = packed.sparkSession.createDataFrame(rows, "domain string, i int, j int, n bigint, v double")
    return shown_rows.select("domain", "i", "j", "n", (F.round("v", 5) + F.lit(0.0)).alias("comoment"))


@query("feature_cells", "M1 M2 K7", f"""WITH {sql_log()}, {FEATURES_SQL}, w AS (SELECT ord, sum(q) AS q, sum(realized) AS c FROM long GROUP BY ord)
SELECT domain, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(q) AS BIGINT) AS q_milli, CAST(sum(c) AS BIGINT) AS cost_micro FROM (
  SELECT lang AS domain, n_char, n_word, n_line, f.x[4:12] AS rest, count(*) AS n, sum(q) AS q, sum(c) AS c
  FROM feat f JOIN surf ON k = doc_id JOIN w ON ord = doc_id GROUP BY ALL) GROUP BY domain""")
def feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cell_ops.cells(encode.with_features(dense_log(spark, sf_dir)), tiers(), 5)
    total = lambda name: F.aggregate(name, F.lit(0).cast("decimal(38,12)"), lambda a, v: (a + v).cast("decimal(38,12)"))
    return c.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_rows"),
        (F.sum(total("sum_q")) * 1000).cast("bigint").alias("q_milli"), F.round(F.sum(total("sum_c")) * 1000000, 0).cast("bigint").alias("cost_micro"),
    )


DEMO_SQL = f"""{surface_sql('documents', 'doc_id', 'text')}, demo AS (SELECT l.*, least(1.0, n_char / 500.0::DOUBLE + 0.22::DOUBLE * has_code::INT + 0.22::DOUBLE * has_math::INT + 0.02::DOUBLE * greatest(n_line - 1, 0)) AS difficulty, (rk - 1) / 4.0::DOUBLE AS rank
  FROM long l JOIN surf ON k = ord),
demo_q AS (SELECT *, CAST(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.82::DOUBLE + 0.12::DOUBLE * rank - (0.42::DOUBLE - 0.38::DOUBLE * rank) * difficulty)) * 1e9) AS BIGINT) AS nano FROM demo)"""


@query("demo_predictions", "B12", f"WITH {sql_log()}, {DEMO_SQL} SELECT example_id, model_id, round(nano / 1e9, 6) AS predicted FROM demo_q")
def demo_prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = dense_log(spark, sf_dir)
    rows = surface.with_flags(log).withColumn("predicted", demo_predictions(visible_candidates(F.col("models"))))
    from tollway.operators.predict import long_predictions

    return long_predictions(rows).select("example_id", "model_id", F.round(F.col("predicted_nano") / 1e9, 6).alias("predicted"))


@query("static_predictions", "M15 M14 A20", f"WITH {sql_log()} SELECT example_id, model_id, CAST(round((0.2::DOUBLE + 0.1::DOUBLE * rk) * 1e9) AS BIGINT) AS predicted_nano FROM long")
def static_prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollway.operators.policies import static_predictions
    from tollway.operators.predict import long_predictions

    scores = spark.createDataFrame([(f"m{r}", 0.2 + 0.1 * r) for r in range(1, 6)], "model_id string, score double")
    return long_predictions(static_predictions(dense_log(spark, sf_dir), scores))

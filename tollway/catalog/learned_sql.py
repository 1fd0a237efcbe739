"""The learned benchmark as SQL: fits, calibration, lambda search and replay from the tables.

A different route from the Spark jobs: row-level covariances and elimination instead of
merged moments, the largest-smallest mean form instead of pooling, a choice per breakpoint
instead of intervals.
"""

from __future__ import annotations

import re

from tollway.catalog.baselines import SQL_CALLS, SQL_PICKS, SQL_TABLE, SQL_TABLE_PICK
from tollway.catalog.prompts import FEATURES_SQL
from tollway.catalog.sample import sql_log

# Members of every training subset, named by the mask of omitted domains; {features} has doc_id, lang and x.
_MEMBERS_OF = """dom AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS pos FROM (SELECT DISTINCT lang FROM documents)),
masks AS (SELECT m AS mask FROM range(0, 16) r(m) WHERE bit_count(m) <= 3),
ys AS (SELECT ord, list(q / 1000.0::DOUBLE ORDER BY model_id) AS y FROM long GROUP BY ord),
fy AS MATERIALIZED (SELECT f.doc_id, f.lang, pos, x, y FROM {features} f JOIN ys ON ord = doc_id JOIN dom USING (lang)),
mem AS MATERIALIZED (SELECT mask, doc_id, x, y FROM masks JOIN fy ON (mask >> pos) & 1 = 0),
pp AS (SELECT unnest(range(0, 5)) AS mp)"""
_MEMBERS = _MEMBERS_OF.replace("{features}", "feat")


def ridge_sql(width: int = 12) -> str:
    """Ridge weights per training subset by Gauss-Jordan elimination; the first three features are scaled."""

    return _RIDGE.replace("{w}", str(width)).replace("{w1}", str(width + 1)).replace("{w6}", str(width + 6))


_RIDGE = """ii AS (SELECT unnest(range(1, {w1})) AS i), jj AS (SELECT unnest(range(1, {w6})) AS j),
scl AS MATERIALIZED (SELECT mask, i, avg(x[i]) AS mx, CASE WHEN i <= 3 AND stddev_pop(x[i]) > 0 THEN stddev_pop(x[i]) ELSE 1 END AS s FROM mem, ii GROUP BY mask, i),
cov AS (SELECT mask, i, j, covar_pop(x[i], CASE WHEN j <= {w} THEN x[j] ELSE y[j - {w}] END) * count(*) AS c FROM mem, ii, jj GROUP BY mask, i, j),
nrm AS (SELECT c.mask, c.i, c.j, c.c / a.s / coalesce(b.s, 1) + CASE WHEN c.i = c.j THEN 1 ELSE 0 END AS v
  FROM cov c JOIN scl a ON a.mask = c.mask AND a.i = c.i LEFT JOIN scl b ON b.mask = c.mask AND b.i = c.j),
lines AS (SELECT mask, i, list(v ORDER BY j) AS r FROM nrm GROUP BY mask, i),
mat AS (SELECT mask, list(r ORDER BY i) AS m FROM lines GROUP BY mask),
gj AS (SELECT mask, 1 AS k, m FROM mat UNION ALL
  SELECT mask, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
     ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= {w}),
coef AS MATERIALIZED (SELECT g.mask, mp, scl.i, m[scl.i][{w1} + mp] / s AS w, mx FROM gj g JOIN scl USING (mask), pp WHERE k = {w1}),
my AS (SELECT mask, mp, avg(y[mp + 1]) AS my FROM mem, pp GROUP BY mask, mp),
model AS MATERIALIZED (SELECT mask, mp, list(w ORDER BY i) AS w, any_value(my) - sum(w * mx) AS bias FROM coef JOIN my USING (mask, mp) GROUP BY mask, mp)"""

_RAW = """raw AS MATERIALIZED (SELECT doc_id, lang, pos, mask, mp, bias + list_dot_product(x, w) AS s FROM fy JOIN model ON (mask >> pos) & 1 = 1 OR mask = 0)"""


def stump_raw(rounds: int, rate: float = 0.1, min_leaf: int = 2) -> str:
    """Boosted stumps, one set of CTEs per round, then the scores of left-out rows."""

    parts = [
        "long_x AS MATERIALIZED (SELECT doc_id, unnest(x) AS v, unnest(range(12)) AS feature FROM fy)",
        "b0 AS MATERIALIZED (SELECT mask, mp, avg(y[mp + 1]) AS base FROM mem, pp GROUP BY mask, mp)",
        "t0 AS MATERIALIZED (SELECT mask, mp, doc_id, x, y[mp + 1] - base AS r FROM mem JOIN b0 USING (mask))",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"""s{k} AS (SELECT mask, mp, feature, v, sum(r) AS r, count(*) AS n FROM t{k - 1} JOIN long_x USING (doc_id) GROUP BY ALL),
w{k} AS (SELECT *, sum(r) OVER o - r AS l, sum(n) OVER o - n AS nl, sum(r) OVER p AS tr, sum(n) OVER p AS tn FROM s{k}
  WINDOW o AS (PARTITION BY mask, mp, feature ORDER BY v), p AS (PARTITION BY mask, mp, feature)),
g{k} AS (SELECT *, l * l / nl + (tr - l) * (tr - l) / (tn - nl) - tr * tr / tn AS gain FROM w{k} WHERE nl >= {min_leaf} AND tn - nl >= {min_leaf}),
k{k} AS MATERIALIZED (SELECT mask, mp, feature, v, l / nl AS lv, (tr - l) / (tn - nl) AS rv FROM g{k} WHERE gain > 1e-10
  QUALIFY row_number() OVER (PARTITION BY mask, mp ORDER BY round(gain, 10) DESC, feature, v) = 1),
t{k} AS MATERIALIZED (SELECT t.mask, t.mp, doc_id, x, r - CASE WHEN k.v IS NULL THEN 0 ELSE {rate} * CASE WHEN x[feature + 1] < v THEN lv ELSE rv END END AS r
  FROM t{k - 1} t LEFT JOIN k{k} k ON k.mask = t.mask AND k.mp = t.mp)""")
    total = " + ".join(
        ["base", *[f"CASE WHEN k{k}.v IS NULL THEN 0 ELSE {rate} * CASE WHEN x[k{k}.feature + 1] < k{k}.v THEN k{k}.lv ELSE k{k}.rv END END" for k in range(1, rounds + 1)]]
    )
    joins = " ".join(f"LEFT JOIN k{k} ON k{k}.mask = b0.mask AND k{k}.mp = b0.mp" for k in range(1, rounds + 1))
    parts.append(f"raw AS MATERIALIZED (SELECT doc_id, lang, pos, b0.mask, b0.mp, {total} AS s FROM fy JOIN b0 ON (b0.mask >> pos) & 1 = 1 OR b0.mask = 0 {joins})")
    return ", ".join(parts)

# Monotone calibration per context and model, then the value at the next calibration point.
_CALIBRATE = """qs AS (SELECT ord, rk - 1 AS mp, q FROM long),
pairs AS (SELECT c.mask AS ctx, r.mp, r.s, q.q FROM masks c JOIN raw r ON (c.mask >> r.pos) & 1 = 0 AND r.mask = (c.mask | (1 << r.pos))
  JOIN qs q ON q.ord = r.doc_id AND q.mp = r.mp WHERE bit_count(c.mask) <= 2),
g AS (SELECT ctx, mp, s, sum(q) AS y, count(*) AS n, row_number() OVER (PARTITION BY ctx, mp ORDER BY s) AS i FROM pairs GROUP BY ctx, mp, s),
c AS MATERIALIZED (SELECT *, sum(y) OVER w AS cy, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY ctx, mp ORDER BY i)),
ab AS (SELECT a.ctx, a.mp, a.i AS a, b.i AS b, (b.cy - a.cy + a.y)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.ctx = b.ctx AND a.mp = b.mp AND b.i >= a.i),
low AS (SELECT ctx, mp, a, b, min(mean) OVER (PARTITION BY ctx, mp, a ORDER BY b DESC) AS low FROM ab),
val AS (SELECT ctx, mp, b AS i, max(low) / 1000.0::DOUBLE AS value FROM low GROUP BY ctx, mp, b),
fit AS MATERIALIZED (SELECT c.ctx, c.mp, c.s, v.value FROM c JOIN val v ON v.ctx = c.ctx AND v.mp = c.mp AND v.i = c.i),
top AS (SELECT ctx, mp, max(value) AS value FROM fit GROUP BY ctx, mp),
pred AS MATERIALIZED (SELECT r.doc_id, r.pos, r.mask AS ctx, r.mp, coalesce(f.value, t.value) AS value
  FROM (SELECT * FROM raw WHERE bit_count(mask) <= 2) r ASOF LEFT JOIN fit f ON f.ctx = r.mask AND f.mp = r.mp AND r.s <= f.s
  JOIN top t ON t.ctx = r.mask AND t.mp = r.mp)"""

# Scored candidates the search for each outer domain may read; all rows for a deployable policy.
_OUTER = """SELECT o.pos AS outer_pos, lt.tier, lt.budget, lt.ord, lt.model_id, lt.quoted, lt.realized, lt.q,
    CAST(round(p.value * 1e9) AS HUGEINT) AS nano, CAST(lt.quoted AS HUGEINT) * 1000000 AS pico
  FROM dom o JOIN pred p ON p.pos <> o.pos AND p.ctx = ((1 << o.pos) | (1 << p.pos)) JOIN lt ON lt.ord = p.doc_id AND lt.rk - 1 = p.mp WHERE lt.quoted <= lt.budget"""
_EVERYTHING = _OUTER.replace("o.pos AS outer_pos", "0 AS outer_pos").replace(
    "dom o JOIN pred p ON p.pos <> o.pos AND p.ctx = ((1 << o.pos) | (1 << p.pos))", "(SELECT * FROM pred WHERE ctx = (1 << pos)) p"
)


def tune_sql(source: str) -> str:
    """Lambda per outer domain and tier: every row's own breakpoints, replayed and summed."""

    return f"""ot AS MATERIALIZED ({source}),
roots AS (SELECT DISTINCT a.outer_pos, a.tier, a.ord, a.nano - b.nano AS dq, a.pico - b.pico AS dc,
    (2 * (a.nano - b.nano) * 10000000000000000000000000000::HUGEINT + (a.pico - b.pico)) // (2 * (a.pico - b.pico)) AS key
  FROM ot a JOIN ot b USING (outer_pos, tier, ord) WHERE a.pico > b.pico AND a.nano >= b.nano
  UNION SELECT outer_pos, tier, ord, 0, 1, 0 FROM ot),
spots AS (SELECT outer_pos, tier, ord, key, min(dq) AS dq, arg_min(dc, dq) AS dc FROM roots GROUP BY ALL),
win AS (SELECT s.*, a.model_id, a.q, a.realized, CAST(a.realized > a.budget AS INT) AS bad FROM spots s JOIN ot a USING (outer_pos, tier, ord)
  QUALIFY row_number() OVER (PARTITION BY s.outer_pos, s.tier, s.ord, s.key ORDER BY s.dc * a.nano - s.dq * a.pico DESC, a.quoted, a.model_id) = 1),
chg AS (SELECT *, q - coalesce(lag(q) OVER w, 0) AS xq, realized - coalesce(lag(realized) OVER w, 0) AS xc, bad - coalesce(lag(bad) OVER w, 0) AS xb
  FROM win WINDOW w AS (PARTITION BY outer_pos, tier, ord ORDER BY key)),
ev AS (SELECT outer_pos, tier, key, any_value(dq) AS dq, any_value(dc) AS dc, sum(xq) AS xq, sum(xc) AS xc, sum(xb) AS xb FROM chg GROUP BY outer_pos, tier, key),
cur AS (SELECT *, sum(xq) OVER w AS tq, sum(xc) OVER w AS tc, sum(xb) OVER w AS tb FROM ev WINDOW w AS (PARTITION BY outer_pos, tier ORDER BY key)),
lam AS MATERIALIZED (SELECT outer_pos, tier, dq, dc FROM cur WHERE tb = 0 QUALIFY row_number() OVER (PARTITION BY outer_pos, tier ORDER BY tq DESC, tc, key) = 1)"""


def _pick(columns: str, contexts: str, price: str) -> str:
    return f"""SELECT {columns} FROM {contexts} p JOIN lt ON lt.ord = p.doc_id AND lt.rk - 1 = p.mp
  JOIN lam ON {price} AND lam.tier = lt.tier WHERE lt.quoted <= lt.budget
  QUALIFY row_number() OVER (PARTITION BY lt.tier, lt.example_id ORDER BY lam.dc * CAST(round(p.value * 1e9) AS HUGEINT) - lam.dq * CAST(lt.quoted AS HUGEINT) * 1000000 DESC, lt.quoted, lt.model_id) = 1"""


_HEAD = f"WITH RECURSIVE {sql_log()}, {FEATURES_SQL}, {_MEMBERS}"
RIDGE_SQL = f"{_HEAD}, {ridge_sql()}"
RAW_SQL = f"{RIDGE_SQL}, {_RAW}"
CALIBRATED_SQL = f"{RAW_SQL}, {_CALIBRATE}"


#: Embedding entries in the table ``embeddings``.
VECTOR_WIDTH = 64
# Each prompt has the vector numbered by the first document of that text, modulo the number of vectors.
_WIDE = """firsts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents),
wide AS MATERIALIZED (SELECT f.doc_id, f.lang, list_concat(f.x, list_transform(e.embedding, lambda v: CAST(v AS DOUBLE))) AS x
  FROM feat f JOIN firsts USING (doc_id) JOIN embeddings e ON e.vec_id = first_id % (SELECT count(*) FROM embeddings))"""
_OF_WIDE = f"{_MEMBERS_OF.replace('{features}', 'wide')}, {ridge_sql(12 + VECTOR_WIDTH)}, {_RAW}"
EMBEDDED_RAW_SQL = f"WITH RECURSIVE {sql_log()}, {FEATURES_SQL}, {_WIDE}, {_OF_WIDE}"
# Only documents that have a vector of their own number.
_OWN_VECTOR = """wide AS MATERIALIZED (SELECT f.doc_id, f.lang, list_concat(f.x, list_transform(e.embedding, lambda v: CAST(v AS DOUBLE))) AS x
  FROM feat f JOIN embeddings e ON e.vec_id = f.doc_id)"""
_VECTOR_DOCUMENTS = "vector_documents AS (SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))"


def of_vector_documents(rest: str) -> str:
    """A statement on the surface and embedding features of the documents that have a vector of their own number."""

    def named(sql: str) -> str:
        return re.sub(r"\bdocuments\b", "vector_documents", sql)

    fitted = f"WITH RECURSIVE {_VECTOR_DOCUMENTS}, {named(sql_log())}, {named(FEATURES_SQL)}, {_OWN_VECTOR}, {named(_OF_WIDE)}"
    return fitted + named(rest)


def stump_sql(rounds: int) -> str:
    return f"{_HEAD}, {stump_raw(rounds)}"


def benchmark_sql(name: str = "bilinear", fitted: str = RAW_SQL) -> str:
    """CTEs up to ``scores`` for the six baselines and the learned policy."""

    learned = _pick(f"'{name}' AS policy, lt.tier, lt.example_id, lt.model_id", "(SELECT * FROM pred WHERE ctx = (1 << pos))", "lam.outer_pos = p.pos")
    picks = " UNION ALL ".join([*SQL_PICKS.values(), SQL_TABLE_PICK, learned])
    return f"{fitted}, {_CALIBRATE}, {tune_sql(_OUTER)}, {SQL_TABLE}, picks AS ({picks}), {SQL_CALLS}"


def capped_sql(cap: int) -> str:
    """As ``benchmark_sql`` with a rank-spaced hash sample of breakpoints, every value replayed."""

    one = "10000000000000000000000000000"
    grid = f"""allc AS MATERIALIZED (SELECT o.pos AS outer_pos, l.ord, l.rk, CAST(round(p.value * 1e9) AS HUGEINT) AS nano, CAST(l.quoted AS HUGEINT) * 1000000 AS pico
  FROM dom o JOIN pred p ON p.pos <> o.pos AND p.ctx = ((1 << o.pos) | (1 << p.pos)) JOIN long l ON l.ord = p.doc_id AND l.rk - 1 = p.mp),
cpt AS (SELECT a.outer_pos, a.nano - b.nano AS dq, a.pico - b.pico AS dc, (2 * (a.nano - b.nano) * {one}::HUGEINT + (a.pico - b.pico)) // (2 * (a.pico - b.pico)) AS key
  FROM allc a JOIN allc b USING (outer_pos, ord) WHERE a.pico > b.pico AND a.nano >= b.nano),
creal AS (SELECT outer_pos, key, min(dq * 1000) AS num, arg_min(dc, dq) AS den FROM cpt GROUP BY outer_pos, key),
chash AS (SELECT *, row_number() OVER (PARTITION BY outer_pos ORDER BY sha256(CAST(key // {one} AS VARCHAR) || '.' || lpad(CAST(key % {one} AS VARCHAR), 28, '0'))) AS h,
  row_number() OVER (PARTITION BY outer_pos ORDER BY key) AS lo, row_number() OVER (PARTITION BY outer_pos ORDER BY key DESC) AS hi FROM creal),
cbnd AS (SELECT outer_pos, key, any_value(num) AS num, any_value(den) AS den FROM (SELECT outer_pos, key, num, den FROM chash WHERE h <= {cap} OR lo = 1 OR hi = 1
  UNION ALL SELECT pos, 0, 0, 1 FROM dom) GROUP BY outer_pos, key),
cnext AS (SELECT *, lead(key) OVER (PARTITION BY outer_pos ORDER BY key) AS nk FROM cbnd),
cand AS (SELECT outer_pos, key, num, den FROM cbnd UNION ALL
  SELECT outer_pos, CASE WHEN nk IS NULL THEN key + 10000000000000000000000000 ELSE (key + nk) // 2 END,
    CASE WHEN nk IS NULL THEN (key + 10000000000000000000000000 + 5000000000000) // 10000000000000 ELSE (key + nk + 10000000000000) // 20000000000000 END, 1000000000000 FROM cnext),
crank AS (SELECT *, row_number() OVER (PARTITION BY outer_pos ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY outer_pos) AS n FROM cand),
cgrid AS MATERIALIZED (SELECT outer_pos, key, CAST(num AS HUGEINT) AS num, CAST(den AS HUGEINT) AS den FROM crank WHERE i IN (SELECT (j * (n - 1)) // {cap - 1} FROM range({cap}) t(j))),
ot AS MATERIALIZED ({_OUTER}),
cwin AS (SELECT g.outer_pos, o.tier, g.key, g.num, g.den, o.q, o.realized, o.realized > o.budget AS bad FROM cgrid g JOIN ot o USING (outer_pos)
  QUALIFY row_number() OVER (PARTITION BY g.outer_pos, o.tier, g.key, o.ord ORDER BY g.den * 1000 * o.nano - g.num * o.pico DESC, o.quoted, o.model_id) = 1),
csum AS (SELECT outer_pos, tier, key, any_value(num) AS num, any_value(den) AS den, sum(q) AS tq, sum(realized) AS tc, count(*) FILTER (bad) AS tb FROM cwin GROUP BY outer_pos, tier, key),
lam AS MATERIALIZED (SELECT outer_pos, tier, num AS dq, den * 1000 AS dc FROM csum WHERE tb = 0 QUALIFY row_number() OVER (PARTITION BY outer_pos, tier ORDER BY tq DESC, tc, key) = 1)"""
    learned = _pick("'bilinear' AS policy, lt.tier, lt.example_id, lt.model_id", "(SELECT * FROM pred WHERE ctx = (1 << pos))", "lam.outer_pos = p.pos")
    picks = " UNION ALL ".join([*SQL_PICKS.values(), SQL_TABLE_PICK, learned])
    return f"{CALIBRATED_SQL}, {grid}, {SQL_TABLE}, picks AS ({picks}), {SQL_CALLS}"


def trained_sql(fitted: str = RAW_SQL) -> str:
    """Every prompt routed by the fit on all rows with lambdas tuned on cross-fitted scores."""

    columns = "lt.example_id, lt.tier, lt.model_id AS decision, lt.quoted AS quoted_micro, round(round(p.value * 1e9) / 1e9 + 1e-10, 8) AS predicted"
    return f"{fitted}, {_CALIBRATE}, {tune_sql(_EVERYTHING)} " + _pick(columns, "(SELECT * FROM pred WHERE ctx = 0)", "lam.outer_pos = 0")

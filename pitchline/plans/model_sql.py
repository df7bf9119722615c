"""DuckDB SQL of the model queries: the optimum by plain gradient steps, root
splits by scans over all cuts, the permutation by row numbers."""

from __future__ import annotations

from pitchline.operators.fitting import draw_sql
from pitchline.plans.common import r6
from pitchline.plans.oracle_sql import HT_ENCODED, HT_NUMERIC, HT_SQL, M, qi

FEW_FEATURES = HT_NUMERIC[0:2] + HT_NUMERIC[3:5]       # few distinct rows: the SQL sums over these
CLASSES = ("A", "D", "H")


def _imputed(features, where="split = 'train'") -> str:
    """Labelled training rows, nulls filled with the training medians."""
    cols = ", ".join(f"coalesce(CAST({qi(c)} AS DOUBLE), (SELECT median({qi(c)}) FROM hx WHERE split = 'train'), 0.0E0) AS x{i}"
                     for i, c in enumerate(features))
    return f"xu AS (SELECT match_id, target_match_result AS y, {cols} FROM hx WHERE {where})"


def logistic_optimum_sql(c: float = 0.01, steps: int = 1500) -> str:
    """Gradient steps of length 1 on the mean loss, from zero."""
    p = len(FEW_FEATURES)
    std = ", ".join(f"(x{i} - (SELECT avg(x{i}) FROM xu)) / coalesce(nullif((SELECT stddev_pop(x{i}) FROM xu), 0), 1) AS x{i}" for i in range(p))
    params = [(k, j) for k in CLASSES for j in range(p + 1)]
    zero = ", ".join(f"0.0E0 AS b_{k}{j}" for k, j in params)
    names = ", ".join(f"b_{k}{j}" for k, j in params)
    score = {k: " + ".join([f"b_{k}{j} * x{j}" for j in range(p)] + [f"b_{k}{p}"]) for k in CLASSES}
    exps = ", ".join(f"exp({score[k]}) AS e_{k}" for k in CLASSES)
    step = ", ".join(
        f"b_{k}{j} - (sum(wt * (e_{k} / (e_A + e_D + e_H) - CASE WHEN y = '{k}' THEN 1 ELSE 0 END)" + (f" * x{j}" if j < p else "") + ")"
        + (f" / max(total) + b_{k}{j} / ({c!r}E0 * max(total))" if j < p else " / max(total)") + f") AS b_{k}{j}" for k, j in params)
    out = " UNION ALL ".join(f"SELECT '{k}' AS class, '{(FEW_FEATURES + ['intercept'])[j]}' AS feature, {r6(f'b_{k}{j}', 'coefficient')} FROM last" for k, j in params)
    return f"""WITH RECURSIVE {M}, {HT_SQL.strip()}, {HT_ENCODED}, {_imputed(FEW_FEATURES)},
xs AS (SELECT y, {std} FROM xu),
cw AS (SELECT y, (SELECT count(*) FROM xu) / (3.0E0 * count(*)) AS w FROM xu GROUP BY y),
g AS MATERIALIZED (SELECT y, {', '.join(f'x{i}' for i in range(p))}, count(*) * any_value(w) AS wt, (SELECT CAST(count(*) AS DOUBLE) FROM xu) AS total
      FROM xs JOIN cw USING (y) GROUP BY y, {', '.join(f'x{i}' for i in range(p))}),
gd AS (
  SELECT 0 AS it, {zero}
  UNION ALL
  SELECT it + 1, {step} FROM (SELECT gd.*, g.*, {exps} FROM gd, g WHERE it < {steps}) s GROUP BY it, {names}),
last AS (SELECT * FROM gd WHERE it = {steps})
{out}"""


def _long(features) -> str:
    return " UNION ALL ".join(f"SELECT match_id, y, {i} AS f, x{i} AS v FROM xu" for i in range(len(features)))


def boosted_first_round_sql(rate_rows=0.6, share=0.5, lam=10.0, alpha=2.0, seed=42) -> str:
    """Root and second level of the first round's three trees."""
    p = len(HT_NUMERIC)
    stream = f"{2 * seed * 1_000_003} + 2 * c"
    t = lambda g: f"(sign({g}) * greatest(abs({g}) - {alpha!r}E0, 0))"
    s = lambda g, h: f"({t(g)} * {t(g)} / ({h} + {lam!r}E0))"

    def level(name, rows):
        return f"""{name}h AS (SELECT c, node, f, v, sum(g) AS g, sum(h) AS h FROM {rows} GROUP BY c, node, f, v),
{name}c AS (SELECT *, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER a AS gt, sum(h) OVER a AS ht FROM {name}h
  WINDOW u AS (PARTITION BY c, node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY c, node, f)),
{name}g AS (SELECT *, round({s('gl', 'hl')} + {s('gt - gl', 'ht - hl')} - {s('gt', 'ht')}, 9) AS gain FROM {name}c WHERE hl >= 1 AND ht - hl >= 0.999999),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c, node ORDER BY gain DESC, f, v) AS rk FROM {name}g) q WHERE rk = 1 AND gain > 1e-6)"""

    names = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in HT_NUMERIC) + "]"
    return f"""WITH {M}, {HT_SQL.strip()}, {HT_ENCODED}, {_imputed(HT_NUMERIC)}, long AS ({_long(HT_NUMERIC)}),
cls AS (SELECT unnest([0, 1, 2]) AS c, unnest(['A', 'D', 'H']) AS label),
cols AS (SELECT c, label, f FROM (SELECT c, label, f, row_number() OVER (PARTITION BY c ORDER BY {draw_sql('f', stream + ' + 1')}, f) AS rk
  FROM cls, range({p}) r(f)) q WHERE rk <= {int(p * share)}),
smp AS (SELECT cls.c, match_id FROM xu, cls WHERE {draw_sql('match_id', stream)} < {rate_rows!r}E0),
r0 AS (SELECT k.c, 0 AS node, l.match_id, l.f, l.v, 1.0E0 / 3 - CASE WHEN l.y = k.label THEN 1 ELSE 0 END AS g, 4.0E0 / 9 AS h
  FROM long l JOIN cols k ON l.f = k.f JOIN smp ON smp.c = k.c AND smp.match_id = l.match_id),
{level('a', 'r0')},
side AS (SELECT r0.c, r0.match_id, CASE WHEN r0.v <= a.v THEN 1 ELSE 2 END AS node FROM r0 JOIN a ON r0.c = a.c AND r0.f = a.f),
r1 AS (SELECT r0.* REPLACE (side.node AS node) FROM r0 JOIN side ON r0.c = side.c AND r0.match_id = side.match_id),
{level('b', 'r1')}
SELECT label AS class, CAST(node AS BIGINT) AS node, {names}[f + 1] AS feature, {r6('v', 'cut')}, {r6('gain', 'gain')},
  {r6(f"-{t('gl')} / (hl + {lam!r}E0)", 'left_weight')}, {r6(f"-{t('(gt - gl)')} / (ht - hl + {lam!r}E0)", 'right_weight')}
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) JOIN cls USING (c)"""


def forest_roots_sql(trees: int = 5, seed: int = 42, tries: int = 4) -> str:
    import math
    p = len(HT_NUMERIC)
    stream = f"{seed * 1_000_003} + 64 * t"
    cdf, acc = [], 0.0
    for i in range(7):
        acc += math.exp(-1) / math.factorial(i)
        cdf.append(acc)
    u = draw_sql("match_id", stream)
    times = " + ".join(f"(CASE WHEN u >= {c!r}E0 THEN 1 ELSE 0 END)" for c in cdf)
    cls = lambda x: ", ".join(x.format(k=k) for k in CLASSES)
    sq = lambda pre: f"(({pre('A')}) * ({pre('A')}) + ({pre('D')}) * ({pre('D')}) + ({pre('H')}) * ({pre('H')})) / (({pre('A')}) + ({pre('D')}) + ({pre('H')}))"
    names = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in HT_NUMERIC) + "]"
    return f"""WITH {M}, {HT_SQL.strip()}, {HT_ENCODED}, {_imputed(HT_NUMERIC)}, long AS ({_long(HT_NUMERIC)}),
cw AS (SELECT y, (SELECT count(*) FROM xu) / (3.0E0 * count(*)) AS w FROM xu GROUP BY y),
mids AS (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS mid FROM (SELECT DISTINCT f, v FROM long)),
bag AS (SELECT t, match_id, y, n FROM (SELECT t, match_id, y, {times} AS n FROM (SELECT t, match_id, y, {u} AS u FROM xu, range({trees}) r(t))) WHERE n > 0),
bags AS (SELECT t, count(*) AS rows_in, sum(n) AS drawn FROM bag GROUP BY t),
tried AS (SELECT t, f FROM (SELECT t, f, row_number() OVER (PARTITION BY t ORDER BY {draw_sql('f', stream + ' + 1')}, f) AS rk
  FROM range({trees}) r(t), range({p}) s(f)) WHERE rk <= {tries}),
h AS (SELECT b.t, l.f, l.v, count(*) AS r, {cls("sum(CASE WHEN b.y = '{k}' THEN b.n * w ELSE 0 END) AS h_{k}")}
  FROM bag b JOIN cw USING (y) JOIN tried ON tried.t = b.t JOIN long l ON l.f = tried.f AND l.match_id = b.match_id GROUP BY b.t, l.f, l.v),
c AS (SELECT t, f, v, sum(r) OVER u AS rl, sum(r) OVER a AS rt, {cls('sum(h_{k}) OVER u AS l_{k}')}, {cls('sum(h_{k}) OVER a AS t_{k}')} FROM h
  WINDOW u AS (PARTITION BY t, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY t, f)),
g AS (SELECT *, round({sq(lambda k: f'l_{k}')} + {sq(lambda k: f't_{k} - l_{k}')} - {sq(lambda k: f't_{k}')}, 9) AS gain FROM c WHERE rl >= 15 AND rt - rl >= 15 AND rt >= 30),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY gain DESC, f, v) AS rk FROM g) WHERE rk = 1)
SELECT CAST(best.t AS BIGINT) AS tree, CAST(rows_in AS BIGINT) AS rows_in, CAST(drawn AS BIGINT) AS drawn, {names}[best.f + 1] AS feature,
  {r6('mid', 'cut')}, {r6('gain', 'gain')}
FROM best JOIN bags USING (t) JOIN mids ON mids.f = best.f AND mids.v = best.v"""


def permutation_importance_sql(seed: int = 42) -> str:
    features = ["home_ppg", "away_ppg", "home_xg"]
    rule = lambda h, a: f"CASE WHEN {h} > {a} + 0.5E0 THEN 'H' WHEN {a} > {h} + 0.5E0 THEN 'A' ELSE 'D' END"
    hit = lambda e: f"sum(CASE WHEN {e} = result THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE)"
    of = {"home_ppg": rule("o_home_ppg", "away_ppg"), "away_ppg": rule("home_ppg", "o_away_ppg"), "home_xg": rule("home_ppg", "away_ppg")}
    base = hit(rule("home_ppg", "away_ppg"))
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, {r6(base, 'accuracy')}, {r6(hit(of[f]), 'permuted_accuracy')}, {r6(f'{base} - {hit(of[f])}', 'importance')} FROM j" for f in features)
    return f"""WITH {M}, r AS (SELECT match_id, result, home_ppg, away_ppg, row_number() OVER (ORDER BY match_id) AS a,
    row_number() OVER (ORDER BY {draw_sql('match_id', str(seed))}, match_id) AS b FROM m WHERE result IS NOT NULL),
j AS (SELECT r.*, o.home_ppg AS o_home_ppg, o.away_ppg AS o_away_ppg FROM r JOIN r o ON r.a = o.b)
{rows}"""


def model_failures_sql() -> str:
    return f"""WITH {M}, {HT_SQL.strip()}, n AS (SELECT count(*) AS n FROM hsplit WHERE split = 'test')
SELECT model, stage, message, CAST(CASE WHEN stage = 'done' THEN n ELSE 0 END AS BIGINT) AS test_rows
FROM n, (VALUES ('naive_bayes', 'done', NULL), ('logistic_regression', 'done', NULL), ('xgboost', 'fit', 'TypeError'), ('no_such_model', 'fit', 'ValueError')) v(model, stage, message)"""

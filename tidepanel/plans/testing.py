"""Registered queries of selection bias: bootstraps, superior ability, overfitting, walk-forward, blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blends, calendar, curves, research, resample, weights
from ..sources import panel
from .queries import CURVES, SPLIT_RETURNS, TYPE, WM, _curves, _r, _registered, _split_returns
from .transforms import GRID


def _u(*parts: str) -> str:
    """resample.uniform in SQL."""
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8) AS UBIGINT) / 4294967296.0"


@_registered(f"""WITH {CURVES}, k AS (SELECT run_id, ts, ret AS x, row_number() OVER (PARTITION BY run_id ORDER BY ts) - 1 AS i FROM r), z AS (SELECT run_id, count(*) AS n, avg(x) AS mean FROM k GROUP BY 1),
b AS (SELECT run_id, i, m FROM (SELECT run_id, i, avg(x) OVER w AS m, count(*) OVER w AS c FROM k WINDOW w AS (PARTITION BY run_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) WHERE c = 20),
d AS (SELECT run_id, n, mean, rep, unnest(range(CAST(ceil(n / 20.0) AS BIGINT))) AS k FROM (SELECT *, unnest(range(200)) AS rep FROM z WHERE n >= 40)), p AS (SELECT d.*, CAST(floor({_u("'7'", 'rep', 'k')} * (n - 19)) AS BIGINT) AS i FROM d),
m AS (SELECT p.run_id, rep, avg(m) AS m, any_value(mean) AS mean FROM p JOIN b ON b.run_id = p.run_id AND b.i = p.i GROUP BY 1, 2), s AS (SELECT run_id, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper, (count(*) FILTER (abs(m - mean) >= abs(mean)) + 1) / 201.0 AS p FROM m GROUP BY 1)
SELECT z.run_id, n, round(mean, 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper, round(p, 6) AS p FROM z LEFT JOIN s USING (run_id)""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = curves.with_returns(_curves(spark, sf_dir))
    return resample.block_mean(r, "ret", 20, 200, 7).select("run_id", "n", *[_r(c, c) for c in ("mean", "lower", "upper", "p")])


POSITIONS = f"""cells AS (SELECT n, rep, unnest(range(n)) AS k FROM (SELECT n, unnest(range(40)) AS rep FROM sizes)), fl AS (SELECT *, k = 0 OR {_u("'7'", "'start'", 'rep', 'k')} < 1.0 / 20 AS fresh FROM cells),
st AS (SELECT n, rep, k, max(CASE WHEN fresh THEN k END) OVER (PARTITION BY n, rep ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k0 FROM fl),
pos AS (SELECT n, rep, k, CAST((floor({_u("'7'", "'at'", 'rep', 'k0')} * n) + k - k0) % n AS BIGINT) AS pos FROM st)"""


@_registered(f"""WITH {CURVES}, bm AS (SELECT ts, avg(ret) AS benchmark FROM r GROUP BY ts), pr AS (SELECT run_id, r.ts, ret * 0.1 AS strategy, benchmark * 0.1 AS benchmark, row_number() OVER (PARTITION BY run_id ORDER BY r.ts) - 1 AS pos FROM r JOIN bm ON bm.ts = r.ts),
rn AS (SELECT run_id, count(*) AS n FROM pr GROUP BY 1), sizes AS (SELECT DISTINCT n FROM rn), {POSITIONS},
dr AS (SELECT rn.run_id, rn.n, rep, k, strategy, benchmark FROM rn JOIN pos ON pos.n = rn.n JOIN pr ON pr.run_id = rn.run_id AND pr.pos = pos.pos),
cu AS (SELECT *, exp(sum(ln(1 + strategy)) OVER w) AS level FROM dr WINDOW w AS (PARTITION BY run_id, rep ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hi AS (SELECT *, greatest(1.0, max(level) OVER w) AS high FROM cu WINDOW w AS (PARTITION BY run_id, rep ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pk AS (SELECT *, level >= high * (1 - 1e-15) AS peak, coalesce(max(CASE WHEN level >= high * (1 - 1e-15) THEN k END) OVER (PARTITION BY run_id, rep ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS p FROM hi),
rp AS (SELECT run_id, rep, (exp(sum(ln(1 + strategy)) * 252.0 / any_value(n)) - 1) * 100 AS cagr, (exp(sum(ln(1 + benchmark)) * 252.0 / any_value(n)) - 1) * 100 AS bench, max(1 - level / high) * 100 AS mdd,
  max(CASE WHEN peak AND k - p > 1 THEN k - p WHEN NOT peak THEN k - p ELSE 0 END) AS longest, CASE WHEN sum(ln(1 + strategy)) < sum(ln(1 + benchmark)) THEN 1.0 ELSE 0.0 END AS below FROM pk GROUP BY 1, 2)
SELECT run_id, round(quantile_cont(cagr, 0.05), 4) AS cagr_p05, round(quantile_cont(cagr - bench, 0.05), 4) AS excess_p05, round(avg(below) * 100, 4) AS under_pct, round(quantile_cont(mdd, 0.95), 4) AS mdd_p95, round(quantile_cont(longest, 0.95), 2) AS longest_p95 FROM rp GROUP BY run_id""")
def bootstrap_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = curves.with_returns(_curves(spark, sf_dir))
    bench = r.groupBy("ts").agg((F.avg("ret") * 0.1).alias("benchmark"))
    pairs = r.join(bench, "ts").select("run_id", "ts", (F.col("ret") * 0.1).alias("strategy"), "benchmark")
    u = resample.uncertainty(pairs, 20, 40, 7, 252)
    return u.select("run_id", *[F.round(c, 4).alias(c) for c in ("cagr_p05", "excess_p05", "under_pct", "mdd_p95")], F.round("longest_p95", 2).alias("longest_p95"))


CANDIDATES = f"""{CURVES}, bm AS (SELECT ts, avg(ret) AS b FROM r GROUP BY ts), ex AS (SELECT run_id AS candidate, r.ts, round(ret - b, 8) AS d FROM r JOIN bm ON bm.ts = r.ts), ca AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT ts FROM ex GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT candidate) FROM ex))),
nu AS (SELECT ex.*, pos FROM ex JOIN ca USING (ts)), mn AS (SELECT candidate, count(*) AS n, avg(d) AS mean FROM nu GROUP BY 1), sizes AS (SELECT max(n) AS n FROM mn), {POSITIONS},
bo AS (SELECT candidate, rep, avg(d) AS m FROM nu JOIN pos USING (pos) GROUP BY 1, 2), om AS (SELECT candidate, stddev_pop(m) AS s FROM bo GROUP BY 1), ss AS (SELECT mn.*, s * sqrt(n) AS omega FROM mn JOIN om USING (candidate))"""


def _excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = curves.with_returns(_curves(spark, sf_dir))
    return r.join(r.groupBy("ts").agg(F.avg("ret").alias("b")), "ts").select(F.col("run_id").alias("candidate"), "ts", F.round(F.col("ret") - F.col("b"), 8).alias("d"))


@_registered(f"""WITH {CANDIDATES}, g AS (SELECT *, greatest(mean, 0) AS lo, CASE WHEN mean < -omega / sqrt(n) * sqrt(2 * ln(ln(n))) THEN 0 ELSE mean END AS co FROM ss), t AS (SELECT greatest(max(sqrt(n) * mean / omega), 0) AS statistic, count(*) AS candidates FROM ss),
z AS (SELECT rep, greatest(max(sqrt(n) * (m - lo) / omega), 0) AS lo, greatest(max(sqrt(n) * (m - co) / omega), 0) AS co, greatest(max(sqrt(n) * (m - mean) / omega), 0) AS up FROM bo JOIN g USING (candidate) GROUP BY rep)
SELECT candidates, round(statistic, 6) AS statistic, round(avg(CASE WHEN lo > statistic THEN 1.0 ELSE 0.0 END), 6) AS p_lower, round(avg(CASE WHEN co > statistic THEN 1.0 ELSE 0.0 END), 6) AS p_consistent, round(avg(CASE WHEN up > statistic THEN 1.0 ELSE 0.0 END), 6) AS p_upper FROM z, t GROUP BY candidates, statistic""")
def superior_ability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = resample.superior_ability(_excess(spark, sf_dir), 20, 40, 7)
    return s.select("candidates", *[_r(c, c) for c in ("statistic", "p_lower", "p_consistent", "p_upper")])


@_registered(f"""WITH RECURSIVE {CANDIDATES}, zz AS (SELECT bo.candidate, rep, sqrt(n) * (m - mean) / omega AS z, sqrt(n) * mean / omega AS t FROM bo JOIN ss USING (candidate)), c1 AS (SELECT quantile_cont(z, 0.8) AS c FROM (SELECT rep, max(z) AS z FROM zz GROUP BY rep)), o1 AS (SELECT DISTINCT candidate FROM zz, c1 WHERE t > c),
c2 AS (SELECT quantile_cont(z, 0.8) AS c FROM (SELECT rep, max(z) AS z FROM zz WHERE candidate NOT IN (SELECT candidate FROM o1) GROUP BY rep)), o2 AS (SELECT DISTINCT candidate FROM zz, c2 WHERE t > c AND candidate NOT IN (SELECT candidate FROM o1) AND EXISTS (SELECT 1 FROM o1)),
c3 AS (SELECT quantile_cont(z, 0.8) AS c FROM (SELECT rep, max(z) AS z FROM zz WHERE candidate NOT IN (SELECT candidate FROM o1 UNION SELECT candidate FROM o2) GROUP BY rep)), o3 AS (SELECT DISTINCT candidate FROM zz, c3 WHERE t > c AND candidate NOT IN (SELECT candidate FROM o1 UNION SELECT candidate FROM o2) AND EXISTS (SELECT 1 FROM o2))
SELECT candidate, round(mean, 6) AS mean, CASE WHEN candidate IN (SELECT candidate FROM o1) THEN 1 WHEN candidate IN (SELECT candidate FROM o2) THEN 2 WHEN candidate IN (SELECT candidate FROM o3) THEN 3 END AS step FROM ss""".replace("WITH RECURSIVE", "WITH"))
def stepwise_superior(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resample.without_twins(_excess(spark, sf_dir))
    return resample.stepwise_superior(d, 20, 40, 7, 0.2).select("candidate", _r("mean", "mean"), "step")


@_registered(f"""WITH {SPLIT_RETURNS}, e AS (SELECT count(*) AS splits, avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END) AS pbo, avg(CASE WHEN outs < 0 THEN 1.0 ELSE 0.0 END) AS loss FROM sel)
SELECT candidate, count(*) AS wins, round(avg(ins), 6) AS is_score, round(avg(outs), 6) AS oos_score, splits, round(pbo, 6) AS pbo, round(loss, 6) AS loss, round(count(*) / splits, 6) AS win_share FROM sel, e GROUP BY candidate, splits, pbo, loss""")
def overfitting_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = research.overfitting(research.cscv_selection(research.split_scores(_split_returns(spark, sf_dir), research.cscv_splits(spark, 6))))
    return s.select("candidate", "wins", "splits", *[_r(c, c) for c in ("is_score", "oos_score", "pbo", "loss", "win_share")])


METRIC_SQL = {
    "cvar_sharpe": "SELECT 'cvar_sharpe' AS metric, c.split, c.inside, c.candidate, avg(ret) / abs(avg(ret) FILTER (ret <= q)) * sqrt(252) AS score FROM c JOIN q5 ON q5.split = c.split AND q5.inside = c.inside AND q5.candidate = c.candidate GROUP BY 2, 3, 4",
    "log_return": "SELECT 'log_return', split, inside, candidate, sum(ln(1 + ret)) FROM c GROUP BY 2, 3, 4", "simple_return": "SELECT 'simple_return', split, inside, candidate, exp(sum(ln(1 + ret))) - 1 FROM c GROUP BY 2, 3, 4",
    "martin": "SELECT 'martin', split, inside, candidate, (exp(sum(ln(1 + ret)) * 252 / count(*)) - 1) / sqrt(avg(dd * dd)) FROM dn GROUP BY 2, 3, 4", "calmar": "SELECT 'calmar', split, inside, candidate, (exp(sum(ln(1 + ret)) * 252 / count(*)) - 1) / abs(min(dd)) FROM dn GROUP BY 2, 3, 4",
}


@_registered(f"""WITH {SPLIT_RETURNS}, md AS (SELECT split FROM (SELECT DISTINCT split FROM sp) ORDER BY md5('3:' || least(split, 63 - split)), split LIMIT 4), c AS (SELECT split, inside, candidate, ts, ret * 0.01 AS ret FROM rb JOIN sp USING (block) WHERE split IN (SELECT split FROM md)), q5 AS (SELECT split, inside, candidate, quantile_cont(ret, 0.05) AS q FROM c GROUP BY 1, 2, 3),
lv AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS l FROM c WINDOW w AS (PARTITION BY split, inside, candidate ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), dn AS (SELECT *, l / greatest(1.0, max(l) OVER w) - 1 AS dd FROM lv WINDOW w AS (PARTITION BY split, inside, candidate ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT metric, split, inside, candidate, round(score, 5) AS score FROM ({' UNION ALL '.join(METRIC_SQL.values())})""")
def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics over four seeded splits."""
    splits = research.cscv_splits(spark, 6, 4, 3)
    r = _split_returns(spark, sf_dir).withColumn("ret", F.col("ret") * 0.01)
    out = None
    for m in METRIC_SQL:
        one = research.split_scores(r, splits, m).select(F.lit(m).alias("metric"), "split", "inside", "candidate", F.round("score", 5).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


FOLDS = f"""{CURVES}, sp AS (SELECT date_trunc('month', min(ts)) AS a, max(ts) AS z FROM r), f0 AS (SELECT CAST(unnest(generate_series(a + INTERVAL 12 MONTH, z::TIMESTAMP, INTERVAL 6 MONTH)) AS DATE) AS t, z FROM sp), fo AS (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS fold, CAST(t - INTERVAL 12 MONTH AS DATE) AS ta, t AS tb, CAST(t + INTERVAL 9 MONTH AS DATE) AS tc FROM f0 WHERE t + INTERVAL 9 MONTH <= z + 1),
fs AS (SELECT fold, run_id AS candidate, tb, tc, round(avg(ret) FILTER (ts < tb), 8) AS inside, round(avg(ret) FILTER (ts >= tb), 8) AS outside FROM r JOIN fo ON ts >= ta AND ts < tc GROUP BY 1, 2, 3, 4), fw AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY inside DESC NULLS LAST, candidate) AS i FROM fs), ww AS (SELECT * FROM fw WHERE i = 1)"""


def _fold_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = curves.with_returns(_curves(spark, sf_dir))
    folds = calendar.walk_forward(r, 12, 9, 6)
    rows = r.join(F.broadcast(folds), (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("test_end")))  # some folds
    mean = lambda c: F.round(F.avg(F.when(c, F.col("ret"))), 8)
    s = rows.groupBy("fold", F.col("run_id").alias("candidate"), "test_start", "test_end").agg(mean(F.col("ts") < F.col("test_start")).alias("inside"), mean(F.col("ts") >= F.col("test_start")).alias("outside"))
    return s, r


@_registered(f"""WITH {FOLDS}, n AS (SELECT count(*) AS f FROM ww), w AS (SELECT candidate, count(*) AS wins FROM ww GROUP BY 1)
SELECT fs.candidate, count(*) AS folds, round(median(inside), 6) AS median_inside, round(median(outside), 6) AS median_outside, round(avg(CASE WHEN outside > 0 THEN 1.0 WHEN outside <= 0 THEN 0.0 END), 6) AS positive, coalesce(any_value(wins), 0) AS wins, round(coalesce(any_value(wins), 0) / any_value(f), 6) AS win_share FROM fs LEFT JOIN w USING (candidate), n GROUP BY fs.candidate""")
def walk_forward_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _fold_scores(spark, sf_dir)
    c = blends.candidate_summary(s, blends.fold_winners(s))
    return c.select("candidate", "folds", "wins", *[_r(x, x) for x in ("median_inside", "median_outside", "positive", "win_share")])


@_registered(f"""WITH {FOLDS}, sg AS (SELECT fold, candidate, tb AS a, least(tc, coalesce(lead(tb) OVER (ORDER BY tb), tc)) AS z FROM ww), rs AS (SELECT r.ts, fold, candidate, CASE WHEN r.ts = min(r.ts) OVER (PARTITION BY fold) THEN 0 ELSE ret * 0.1 END AS ret FROM r JOIN sg ON run_id = candidate AND ts >= a AND ts < z WHERE z > a)
SELECT ts, fold, candidate, round(100 * exp(sum(ln(1 + ret)) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS value FROM rs""")
def stitched_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = _fold_scores(spark, sf_dir)
    w = blends.fold_winners(s).withColumnRenamed("test_start", "start").withColumnRenamed("test_end", "end")
    returns = r.select(F.col("run_id").alias("candidate"), "ts", (F.col("ret") * 0.1).alias("ret"))
    return blends.stitched(returns, blends.deployment(w), 100.0).withColumn("value", F.round("value", 4))


ALIGNED = f"{CURVES}, nr AS (SELECT count(DISTINCT run_id) AS n FROM cv), co AS (SELECT ts FROM cv GROUP BY ts HAVING count(*) = (SELECT n FROM nr)), al AS (SELECT run_id, ts, value / first_value(value) OVER (PARTITION BY run_id ORDER BY ts) AS value FROM cv WHERE ts IN (SELECT ts FROM co))"
SHARES = {"ECONOMY": 0.5, "SMALL": 0.3, "PROMO": 0.2}
SHARE_SQL = "CASE run_id WHEN 'ECONOMY' THEN 0.5 WHEN 'SMALL' THEN 0.3 WHEN 'PROMO' THEN 0.2 END"


@_registered(f"WITH {ALIGNED} SELECT run_id, ts, round(value, 6) AS value FROM al")
def aligned_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blends.aligned(_curves(spark, sf_dir)).select("run_id", "ts", _r("value", "value"))


@_registered(f"""WITH {CURVES}, s AS (SELECT run_id, min(ts) AS a, max(ts) AS z FROM cv GROUP BY 1), w AS (SELECT max(a) AS a, min(z) AS z FROM s), g AS (SELECT t.ts, s.run_id, cv.value FROM (SELECT DISTINCT ts FROM cv) t CROSS JOIN s LEFT JOIN cv ON cv.ts = t.ts AND cv.run_id = s.run_id),
f AS (SELECT ts, run_id, last_value(value IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM g) SELECT ts, run_id, round(value, 6) AS value FROM f, w WHERE ts >= a AND ts <= z""")
def filled_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blends.aligned_union(_curves(spark, sf_dir)).select("ts", "run_id", _r("value", "value"))


@_registered(f"WITH {ALIGNED} SELECT ts, round(sum(value * {SHARE_SQL}), 6) AS value FROM al WHERE run_id IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY ts")
def drifting_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blends.drifting(blends.aligned(_curves(spark, sf_dir)), SHARES).select("ts", _r("value", "value"))


@_registered(f"""WITH {ALIGNED}, b AS (SELECT *, {SHARE_SQL} AS w, date_trunc('month', ts) AS p FROM al WHERE run_id IN ('ECONOMY', 'SMALL', 'PROMO')), e AS (SELECT run_id, p, arg_max(value, ts) AS e, lag(arg_max(value, ts)) OVER (PARTITION BY run_id ORDER BY p) AS o FROM b GROUP BY 1, 2),
g AS (SELECT b.*, w * value / coalesce(o, 1.0) AS g, w * e / coalesce(o, 1.0) AS ge FROM b JOIN e USING (run_id, p)), c AS (SELECT DISTINCT run_id, p, w, ge FROM g), s AS (SELECT p, sum(ge) AS s FROM c GROUP BY p),
t AS (SELECT p, any_value(s) AS growth, sum(abs(w - ge / s)) / 2 AS aft FROM c JOIN s USING (p) GROUP BY p), u AS (SELECT *, coalesce(lag(aft) OVER (ORDER BY p), 0) AS turn FROM t), k AS (SELECT *, greatest(0, 1 - turn * 0.001) AS kept FROM u),
v AS (SELECT p, coalesce(exp(sum(ln(growth * kept)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) * kept AS lvl, sum(turn) OVER (ORDER BY p) AS turnover FROM k)
SELECT ts, round(sum(g) * any_value(lvl), 6) AS value, round(any_value(turnover), 6) AS turnover FROM g JOIN v USING (p) GROUP BY ts""")
def rebalanced_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blends.rebalanced(blends.aligned(_curves(spark, sf_dir)), SHARES, "monthly", 10.0).select("ts", _r("value", "value"), _r("turnover", "turnover"))


@_registered(f"""WITH {ALIGNED}, b AS (SELECT *, {SHARE_SQL} AS w, year(ts) * 12 + month(ts) AS p FROM al WHERE run_id IN ('ECONOMY', 'SMALL', 'PROMO')), e AS (SELECT run_id, p, any_value(w) AS w, arg_max(value, ts) AS e, arg_min(value, ts) AS f FROM b GROUP BY run_id, p),
x AS (SELECT e.*, coalesce(lag(e.e) OVER (PARTITION BY e.run_id ORDER BY e.p), e.f) AS base, e.w * CASE WHEN lag(e.e) OVER (PARTITION BY e.run_id ORDER BY e.p) IS NOT NULL AND coalesce(a.e / c.e - 1 <= 0, false) THEN 0.4 ELSE 1.0 END AS tg
  FROM e LEFT JOIN e a ON a.run_id = e.run_id AND a.p = e.p - 1 LEFT JOIN e c ON c.run_id = e.run_id AND c.p = e.p - 4),
t AS (SELECT p, greatest(0, 1 - sum(tg)) AS rest, sum(tg * e / base) + greatest(0, 1 - sum(tg)) AS growth FROM x GROUP BY p), s AS (SELECT x.p, tg, lag(tg * e / base / growth) OVER (PARTITION BY run_id ORDER BY x.p) AS old FROM x JOIN t USING (p)),
u AS (SELECT p, sum(abs(tg - old)) AS moved FROM s GROUP BY p), k AS (SELECT t.p, rest, growth, coalesce((moved + abs(rest - lag(rest / growth) OVER (ORDER BY t.p))) / 2, 0) AS turn FROM t JOIN u USING (p)), v AS (SELECT *, greatest(0, 1 - turn * 0.001) AS kept FROM k),
z AS (SELECT p, rest, coalesce(exp(sum(ln(growth * kept)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) * kept AS lvl, sum(turn) OVER (ORDER BY p) AS turnover FROM v)
SELECT ts, round((sum(tg * value / base) + any_value(rest)) * any_value(lvl), 6) AS value, round(any_value(turnover), 6) AS turnover FROM b JOIN x USING (run_id, p) JOIN z USING (p) GROUP BY ts""")
def trend_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blends.trend_exposed(blends.aligned(_curves(spark, sf_dir)), SHARES, 3, 0.4, 10.0).select("ts", _r("value", "value"), _r("turnover", "turnover"))


@_registered(f"""WITH {CURVES}, t AS (SELECT DISTINCT ts FROM cv), q AS (SELECT date_trunc('quarter', ts)::DATE AS ts, round(avg(price) / 500, 6) AS annual FROM panel GROUP BY 1), k AS (SELECT t.ts, q.annual FROM t ASOF LEFT JOIN q ON t.ts >= q.ts)
SELECT ts, round((pow(1 + coalesce(lag(annual) OVER (ORDER BY ts), annual) / 100, 1.0 / 252) - 1) * 1e6, 4) AS ppm FROM k""")
def risk_free_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "type")
    rates = p.groupBy(F.trunc("ts", "quarter").alias("ts")).agg(F.round(F.avg("price") / 500, 6).alias("annual"))
    return blends.risk_free(p.select("ts").distinct(), rates, 252).select("ts", F.round(F.col("rate") * 1e6, 4).alias("ppm"))


@_registered(f"""WITH {CURVES}, s AS (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts) AS nxt, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS i FROM cv) SELECT run_id, ts, round(value, 6) AS value FROM cv UNION ALL SELECT run_id, ts - CAST(coalesce(datediff('day', ts, nxt), 1) AS INTEGER), 1000.0 FROM s WHERE i = 1""")
def anchored_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.anchored(_curves(spark, sf_dir), 1000.0).select("run_id", "ts", _r("value", "value"))


@_registered("""WITH t AS (SELECT o_orderkey, c_nationkey, o_totalprice - 150000 AS pnl FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT c_nationkey, sum(CAST(pnl AS DECIMAL(18,2))) AS net, count(*) AS n FROM t GROUP BY 1)
SELECT c_nationkey, round(CAST(net AS DOUBLE), 2) AS net, n, row_number() OVER (ORDER BY net DESC, c_nationkey) AS place, round(CASE WHEN sum(net) OVER () > 0 THEN CAST(net AS DOUBLE) / CAST(sum(net) OVER () AS DOUBLE) * 100 END, 6) AS net_share, round(CAST(greatest(net, 0) AS DOUBLE) / nullif(CAST(sum(greatest(net, 0)) OVER () AS DOUBLE), 0) * 100, 6) AS positive_share FROM k""")
def profit_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = panel.read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), panel.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    t = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("pnl", (F.col("o_totalprice") - 150000).cast("decimal(18,2)"))
    by = t.groupBy("c_nationkey").agg(F.sum("pnl").cast("double").alias("pnl"), F.count("*").alias("__n"))
    shares = blends.contributions(by, "c_nationkey", "pnl").drop("n").join(by.select("c_nationkey", F.col("__n").alias("n")), "c_nationkey")
    return shares.select("c_nationkey", F.round("net", 2).alias("net"), "n", "place", _r("net_share", "net_share"), _r("positive_share", "positive_share"))


@_registered(f"""WITH {TYPE}, {GRID}, d AS (SELECT min(ts) AS ts FROM panel GROUP BY date_trunc('month', ts)), t AS (SELECT ts, market, CASE WHEN ts IN (SELECT ts FROM d) THEN round(coalesce(volume, 0) / 1000, 8) END AS target FROM grid), h AS (SELECT *, last_value(target IGNORE NULLS) OVER ({WM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM t)
SELECT ts, market, coalesce(target, CASE WHEN ts = (SELECT min(ts) FROM h WHERE ts >= DATE '1997-03-15') THEN held END) AS target FROM h WHERE ts >= DATE '1997-03-15'""")
def seeded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "type").select("ts", "market", "volume"))
    days = weights.rebalance_rows(g.select("ts").distinct(), "monthly").withColumn("__on", F.lit(True))
    t = g.join(days, "ts", "left").select("ts", "market", F.when(F.col("__on"), F.round(F.coalesce("volume", F.lit(0.0)) / 1000, 8)).alias("target"))
    return weights.seeded_window(t, "target", "1997-03-15").select("ts", "market", "target")

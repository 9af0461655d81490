"""Registered queries of single operators that no other query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..operators import calendar, curves, resample, rolling, tables, weights
from ..sources import panel
from .queries import CURVES, SIZE, TYPE, WM, _curves, _r, _registered
from .testing import CANDIDATES, _excess
from .transforms import BY_MARKET


def _elimination(most: int) -> str:
    """The steps of the confidence set one after the other, for so many candidates at most."""
    gone, parts = "SELECT NULL::VARCHAR", []
    for k in range(1, most):
        parts.append(f"""l{k} AS (SELECT * FROM cn WHERE candidate NOT IN (SELECT candidate FROM ({gone}) g(candidate) WHERE candidate IS NOT NULL)), d{k} AS (SELECT candidate, mean, rep, c - avg(c) OVER (PARTITION BY rep) AS d, mean - avg(mean) OVER (PARTITION BY rep) AS g FROM l{k}),
s{k} AS (SELECT candidate, mean, sqrt(avg(d * d)) AS s, any_value(g) AS g FROM d{k} GROUP BY 1, 2), w{k} AS (SELECT candidate, mean, -g / s AS t FROM s{k} WHERE (SELECT count(*) FROM s{k}) > 1 ORDER BY t DESC, candidate LIMIT 1),
p{k} AS (SELECT avg(CASE WHEN z >= t THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT rep, max(-d / s) AS z FROM d{k} JOIN s{k} USING (candidate) GROUP BY rep), w{k})""")
        gone += f" UNION ALL SELECT candidate FROM w{k}"
    steps = " UNION ALL ".join(f"SELECT candidate, mean, {k} AS step, p FROM w{k}, p{k}" for k in range(1, most))
    return ", ".join(parts) + f", steps AS ({steps}), floors AS (SELECT candidate, mean, step, max(p) OVER (ORDER BY step) AS p FROM steps)"


@_registered(f"""WITH {CANDIDATES}, cn AS (SELECT candidate, rep, m - mean AS c, mean FROM bo JOIN mn USING (candidate)), {_elimination(8)}
SELECT candidate, round(mean, 6) AS mean, CAST(step AS INTEGER) AS "order", round(p, 6) AS p FROM floors
UNION ALL SELECT candidate, round(mean, 6), CAST((SELECT count(*) FROM floors) + 1 AS INTEGER), 1.0 FROM mn WHERE candidate NOT IN (SELECT candidate FROM floors)""")
def confidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.confidence_set(_excess(spark, sf_dir), 20, 40, 7).select("candidate", _r("mean", "mean"), "order", _r("p", "p"))


@_registered(f"""WITH {CURVES}, x AS (SELECT run_id, ret - avg(ret) OVER (PARTITION BY run_id) AS e, row_number() OVER (PARTITION BY run_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM r),
z AS (SELECT run_id, any_value(n) AS n, greatest(5, floor(log10(any_value(n)))) AS run, CAST(ceil(sqrt(any_value(n))) + greatest(5, floor(log10(any_value(n)))) AS BIGINT) AS most, sum(e * e) AS ss FROM x GROUP BY 1 HAVING any_value(n) >= 10),
g AS (SELECT run_id, n, run, most, ss, unnest(range(most + 1)) AS lag FROM z), pr AS (SELECT g.run_id, g.lag, sum(a.e * b.e) AS xp FROM g JOIN x a ON a.run_id = g.run_id JOIN x b ON b.run_id = a.run_id AND b.i = a.i - g.lag GROUP BY 1, 2),
hd AS (SELECT g.run_id, g.lag, sum(CASE WHEN x.i <= g.lag THEN x.e * x.e ELSE 0 END) AS head, sum(CASE WHEN x.n - 1 - x.i <= g.lag THEN x.e * x.e ELSE 0 END) AS tail FROM g JOIN x ON x.run_id = g.run_id GROUP BY 1, 2),
c AS (SELECT g.*, xp, abs(xp) / sqrt((ss - head) * (ss - tail)) < 2 * sqrt(log10(n) / n) AS small FROM g JOIN pr USING (run_id, lag) JOIN hd USING (run_id, lag)),
f AS (SELECT a.run_id, min(a.lag - a.run) AS first FROM c a WHERE a.lag >= a.run AND (SELECT bool_and(b.small) FROM c b WHERE b.run_id = a.run_id AND b.lag >= a.lag - a.run AND b.lag < a.lag) GROUP BY 1),
m AS (SELECT c.*, CASE WHEN first IS NULL THEN most ELSE least(most, 2 * greatest(first, 1)) END AS lags FROM c LEFT JOIN f USING (run_id)),
y AS (SELECT run_id, n, lags, sum(CASE WHEN lag <= lags THEN 2 * CASE WHEN lag / lags <= 0.5 THEN 1.0 ELSE 2 * (1 - lag / lags) END * lag * xp / n ELSE 0 END) AS g, sum(CASE WHEN lag = 0 THEN xp / n WHEN lag <= lags THEN 2 * CASE WHEN lag / lags <= 0.5 THEN 1.0 ELSE 2 * (1 - lag / lags) END * xp / n ELSE 0 END) AS lr FROM m GROUP BY ALL)
SELECT run_id, n, CAST(lags AS INTEGER) AS lags, round(least(ceil(least(3 * sqrt(n), n / 3)), pow(g * g / (lr * lr), 1.0 / 3) * pow(n, 1.0 / 3)), 5) AS stationary, round(least(ceil(least(3 * sqrt(n), n / 3)), pow(1.5 * g * g / (lr * lr), 1.0 / 3) * pow(n, 1.0 / 3)), 5) AS circular FROM y""")
def block_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best block lengths of each curve's returns for a bootstrap."""
    found = resample.block_lengths(curves.with_returns(_curves(spark, sf_dir)), "ret")
    return found.where("n >= 10").select("run_id", "n", "lags", F.round("stationary", 5).alias("stationary"), F.round("circular", 5).alias("circular"))


@_registered(f"""WITH {TYPE}, s AS (SELECT ts, market, CASE WHEN price > 1400 THEN 1.0 WHEN price < 1300 THEN 0.0 END AS a, CASE WHEN volume > 40 THEN 1.0 ELSE 0.0 END AS b FROM panel)
SELECT ts, market, CASE WHEN coalesce(a <> 0, false) AND b <> 0 THEN 1.0 ELSE 0.0 END AS all_flags, round(CASE market WHEN 'SMALL' THEN coalesce(a, 0) * 0.5 + b * 0.5 WHEN 'LARGE' THEN b ELSE coalesce(a, 0) END, 6) AS score FROM s""")
def market_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "type")
    a, b = F.when(F.col("price") > 1400, 1.0).when(F.col("price") < 1300, 0.0), F.when(F.col("volume") > 40, 1.0).otherwise(0.0)
    return p.select("ts", "market", ew.all_true([a, b]).alias("all_flags"), _r(ew.market_score(F.col("market"), {"SMALL": [(a, 0.5), (b, 0.5)], "LARGE": [(b, 1.0)]}, [(a, 1.0)]), "score"))


@_registered(f"""WITH {TYPE}, h AS (SELECT ts, market, volume, list(volume) OVER ({BY_MARKET} 19 PRECEDING AND CURRENT ROW) AS l FROM panel)
SELECT ts, market, round(CASE WHEN len(l) = 20 THEN (len(list_filter(l, lambda v: v < volume)) + (len(list_filter(l, lambda v: v = volume)) + 1) / 2.0) / 20 END, 6) AS pct FROM h""")
def turnover_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rolling.turnover_percentile(panel.build_panel(spark, sf_dir, "type"), "volume", 20)
    return t.select("ts", "market", _r("turnover_percentile", "pct"))


@_registered(f"""WITH {TYPE}, sp AS (SELECT date_trunc('month', min(ts)) AS a, max(ts) AS z FROM panel), b AS (SELECT a, z, CAST(unnest(generate_series(a + INTERVAL 24 MONTH, z::TIMESTAMP, INTERVAL 12 MONTH)) AS DATE) AS t FROM sp)
SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS fold, CAST(a AS DATE) AS train_start, t AS test_start, CAST(t + INTERVAL 6 MONTH AS DATE) AS test_end FROM b WHERE t + INTERVAL 6 MONTH <= z + 1""")
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.walk_forward(panel.build_panel(spark, sf_dir, "type"), 24, 6, 12, expanding=True)


@_registered(f"""WITH {CURVES}, h AS (SELECT *, last_value(CASE WHEN drawdown >= 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak, first_value(CASE WHEN drawdown >= 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS recovery FROM r)
SELECT run_id, peak, min(ts) AS onset, min(ts) FILTER (drawdown <= -0.1) AS qualifying, arg_min(ts, (drawdown, ts)) AS trough, any_value(recovery) AS recovery, round(min(drawdown), 6) AS depth, count(*) AS bars FROM h WHERE drawdown < 0 GROUP BY run_id, peak HAVING min(drawdown) <= -0.1""")
def deep_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.episode_table(_curves(spark, sf_dir), 0.1).withColumn("depth", F.round("depth", 6))


@_registered(f"""WITH {SIZE}, m AS (SELECT market, date_trunc('month', ts) AS p, round(avg(amount), 8) AS s FROM panel WHERE volume >= 20 GROUP BY 1, 2), k AS (SELECT market, p, row_number() OVER (PARTITION BY p ORDER BY s DESC, market) AS i FROM m), c AS (SELECT market, CAST(min(p) + INTERVAL 1 MONTH AS DATE) AS since FROM k WHERE i <= 2 GROUP BY 1)
SELECT ts, panel.market, volume FROM panel JOIN c USING (market) WHERE ts >= since""")
def eligible_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.monthly_union(panel.build_panel(spark, sf_dir, "size"), "amount", 2, F.col("volume") >= 20).select("ts", "market", "volume")


@_registered(f"""WITH {SIZE}, o AS (SELECT market, max(ts) AS anchor, arg_max(volume, ts) AS before FROM panel WHERE year(ts) < 1998 GROUP BY 1), n AS (SELECT o.market, anchor, before, arg_min(volume, ts) AS after FROM o JOIN panel USING (market) WHERE ts > anchor GROUP BY 1, 2, 3) SELECT * FROM n WHERE before IS DISTINCT FROM after""")
def anchored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size").select("ts", "market", "volume")
    return tables.changed_after(p.where(F.year("ts") < 1998), p, "market", "ts", "volume")


@_registered("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS fold, o_totalprice AS score FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY fold, o_orderkey) AS i FROM p) SELECT o_custkey, fold, score FROM k WHERE i = 1""")
def first_fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of overlapping folds' predictions of one key, the first fold's."""
    p = panel.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("fold"), F.col("o_totalprice").alias("score"))
    return tables.final_version(p, ["o_custkey"], F.col("fold"), F.col("o_orderkey")).select("o_custkey", "fold", "score")


@_registered(f"""WITH {TYPE}, r AS (SELECT *, CASE WHEN price > 0 AND lag(price) OVER ({WM}) > 0 THEN ln(price / lag(price) OVER ({WM})) END AS lr FROM panel) SELECT ts, market, round(CASE WHEN count(lr) OVER w = 10 THEN sqrt(avg(least(lr, 0) * least(lr, 0)) OVER w) * sqrt(252) END, 6) AS downside FROM r WINDOW w AS ({BY_MARKET} 9 PRECEDING AND CURRENT ROW)""")
def annual_downside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.build_panel(spark, sf_dir, "type").select("ts", "market", _r(rolling.downside_vol(F.col("price"), 10, 252), "downside"))

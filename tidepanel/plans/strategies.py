"""Registered queries that compile a JSON spec, and those of weights that need correlations or covariances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cross_section as xs
from ..operators import covariance, rolling, weights
from ..sources import panel
from . import graph, spec
from .queries import TYPE, WM, _r, _registered
from .transforms import BY_MARKET, GRID

SPEC = """{
 "presets": {"trend": [{"name": "ret{n}", "input": "price", "steps": [{"op": "simple_return", "n": "{n}"}]}, {"name": "rank{n}", "input": "ret{n}", "steps": [{"op": "cross_percentile"}]}]},
 "features": [
  {"preset": "trend", "params": {"n": "{fast}"}}, {"preset": "trend", "params": {"n": "{slow}"}},
  {"name": "score", "sum": {"rank{fast}": 0.6, "rank{slow}": 0.4}},
  {"name": "busy", "input": "volume", "steps": [{"op": "rolling", "n": 3, "kind": "mean"}]},
  {"name": "lively", "input": "busy", "compare": "ge", "other": "{least}"}],
 "universe": {"values": [["lively", "gt", 0.0, 0]], "final": {"x": "score", "top_n": 3, "lag": 1}},
 "weights": {"kind": "equal", "every": "monthly", "gross": 0.9}}"""
WANTED = {"fast": 2, "slow": 5, "least": 10}


@_registered(f"""WITH {TYPE}, {GRID}, a AS (SELECT *, CASE WHEN lag(price, 2) OVER ({WM}) <> 0 THEN price / lag(price, 2) OVER ({WM}) - 1 END AS r2, CASE WHEN lag(price, 5) OVER ({WM}) <> 0 THEN price / lag(price, 5) OVER ({WM}) - 1 END AS r5, CASE WHEN count(volume) OVER w3 = 3 THEN avg(volume) OVER w3 END AS busy FROM grid WINDOW w3 AS ({BY_MARKET} 2 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN r2 IS NOT NULL THEN CASE WHEN count(r2) OVER (PARTITION BY ts) = 1 THEN 1.0 ELSE (row_number() OVER (PARTITION BY ts, r2 IS NOT NULL ORDER BY r2, market) - 1) / (count(r2) OVER (PARTITION BY ts) - 1) END END AS k2, CASE WHEN r5 IS NOT NULL THEN CASE WHEN count(r5) OVER (PARTITION BY ts) = 1 THEN 1.0 ELSE (row_number() OVER (PARTITION BY ts, r5 IS NOT NULL ORDER BY r5, market) - 1) / (count(r5) OVER (PARTITION BY ts) - 1) END END AS k5 FROM a),
c AS (SELECT *, 0.6 * k2 + 0.4 * k5 AS score, price IS NOT NULL AND coalesce(busy >= 10, false) AS base FROM b), d AS (SELECT *, lag(score) OVER ({WM}) AS s1 FROM c), e AS (SELECT *, base AND s1 IS NOT NULL AND row_number() OVER (PARTITION BY ts, base AND s1 IS NOT NULL ORDER BY s1 DESC, market) <= 3 AS sel FROM d)
SELECT ts, market, round(CASE WHEN sel THEN 0.9 / count(*) FILTER (sel) OVER (PARTITION BY ts) ELSE 0 END, 6) AS weight FROM e WHERE ts IN (SELECT min(ts) FROM grid GROUP BY date_trunc('month', ts))""")
def spec_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship form of use: features, universe and weights from one JSON text with parameters."""
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "type").select("ts", "market", "price", "volume"))
    return spec.targets(g, spec.load(SPEC, **WANTED)).select("ts", "market", _r("weight", "weight"))


GRID_SPEC = """{
 "features": [
  {"name": "score", "input": "ret", "steps": [{"op": "shift", "n": 1}]},
  {"name": "ret", "input": "price", "steps": [{"op": "simple_return", "n": "{n}"}]},
  {"name": "busy", "input": "volume", "steps": [{"op": "rolling", "n": 3, "kind": "mean"}]},
  {"name": "lively", "input": "busy", "compare": "ge", "other": 10}],
 "universe": {"values": [["lively", "gt", 0.0, 0]], "final": {"x": "score", "top_n": "{k}"}},
 "weights": {"kind": "equal", "every": "monthly", "gross": 0.9}}"""
AXES = {"n": [2, 5, 10, 20], "k": [2, 3, 5, 8]}


@_registered(f"""WITH {TYPE}, {GRID}, b AS (SELECT *, CASE WHEN count(volume) OVER w3 = 3 THEN avg(volume) OVER w3 END AS busy FROM grid WINDOW w3 AS ({BY_MARKET} 2 PRECEDING AND CURRENT ROW)),
r AS (SELECT v.i, ts, market, price, busy, CASE WHEN lag(price, v.n) OVER w <> 0 THEN price / lag(price, v.n) OVER w - 1 END AS ret FROM b CROSS JOIN (VALUES (0, 2), (1, 5), (2, 10), (3, 20)) v(i, n) WINDOW w AS (PARTITION BY v.i, market ORDER BY ts)),
s AS (SELECT *, lag(ret) OVER (PARTITION BY i, market ORDER BY ts) AS score, price IS NOT NULL AND coalesce(busy >= 10, false) AS base FROM r),
e AS (SELECT i, ts, market, base AND score IS NOT NULL AS may, row_number() OVER (PARTITION BY i, ts, base AND score IS NOT NULL ORDER BY score DESC, market) AS place FROM s),
c AS (SELECT i * 4 + j AS candidate, ts, market, may AND place <= k AS sel FROM e CROSS JOIN (VALUES (0, 2), (1, 3), (2, 5), (3, 8)) u(j, k) WHERE ts IN (SELECT min(ts) FROM grid GROUP BY date_trunc('month', ts)))
SELECT candidate, ts, market, round(CASE WHEN sel THEN 0.9 / count(*) FILTER (sel) OVER (PARTITION BY candidate, ts) ELSE 0 END, 6) AS weight FROM c""")
def grid_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen candidates of one JSON text in one plan."""
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "type").select("ts", "market", "price", "volume"))
    return graph.targets(g, graph.grid(GRID_SPEC, AXES)).select("candidate", "ts", "market", _r("weight", "weight"))


@_registered(f"""WITH {TYPE}, {GRID}, t AS (SELECT ts, market, price, row_number() OVER (PARTITION BY market ORDER BY ts DESC) AS i FROM grid) SELECT market, ts, round(price, 6) AS price FROM t WHERE i <= 6""")
def warm_up_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the spec's longest feature needs for its last value."""
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "type").select("ts", "market", "price", "volume"))
    need = max(spec.history(spec.load(SPEC, **WANTED)).values()) + 1
    return panel.tail_rows(g, need).select("market", "ts", _r("price", "price"))


CLUSTERS = f"""{TYPE}, {GRID}, r AS (SELECT ts, market, price / lag(price) OVER ({WM}) - 1 AS ret FROM grid), ca AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM r)), q AS (SELECT min(ts) AS ts FROM grid GROUP BY date_trunc('quarter', ts)),
bk AS (SELECT grid.ts, market, i AS e FROM grid JOIN q USING (ts) JOIN ca USING (ts)), rw AS (SELECT bk.ts, bk.market, ca.i, ret FROM bk JOIN ca ON ca.i > bk.e - 60 AND ca.i <= bk.e JOIN r ON r.ts = ca.ts AND r.market = bk.market WHERE ret IS NOT NULL),
pm AS (SELECT x.ts, x.market AS a, y.market AS b, count(*) AS n, covar_samp(x.ret, y.ret) AS cov, CASE WHEN stddev_samp(x.ret) > 0 AND stddev_samp(y.ret) > 0 THEN covar_samp(x.ret, y.ret) / (stddev_samp(x.ret) * stddev_samp(y.ret)) END AS c FROM rw x JOIN rw y ON x.ts = y.ts AND x.i = y.i GROUP BY 1, 2, 3)"""


def _quarterly(spark: SparkSession, sf_dir: str, window: int, before: bool = False) -> tuple[DataFrame, DataFrame]:
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "type").select("ts", "market", "price"))
    r = g.withColumn("ret", rolling.simple_return(F.col("price")))
    book = weights.rebalance_rows(g, "quarterly").select("ts", "market")
    return book, covariance.pair_moments(r, book, window, before)


@_registered(f"""WITH RECURSIVE {CLUSTERS}, sz AS (SELECT ts, count(*) AS m FROM bk GROUP BY ts), ok AS (SELECT ts FROM pm JOIN sz USING (ts) WHERE n >= 5 AND c IS NOT NULL GROUP BY ts, m HAVING count(*) = m * m),
ed AS (SELECT ts, a, b FROM pm WHERE c >= 0.2 AND a <> b AND ts IN (SELECT ts FROM ok)), re AS (SELECT ts, market AS a, market AS b FROM bk UNION SELECT re.ts, re.a, ed.b FROM re JOIN ed ON ed.ts = re.ts AND ed.a = re.b), cl AS (SELECT ts, a, min(b) AS k FROM re GROUP BY 1, 2), kn AS (SELECT ts, count(DISTINCT k) AS kn FROM cl GROUP BY 1)
SELECT cl.ts, a AS market, round(CASE WHEN cl.ts IN (SELECT ts FROM ok) THEN 1.0 / (kn * count(*) OVER (PARTITION BY cl.ts, k)) ELSE 1.0 / count(*) OVER (PARTITION BY cl.ts) END, 6) AS weight FROM cl JOIN kn USING (ts)""")
def cluster_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    book, moments = _quarterly(spark, sf_dir, 60)
    return covariance.cluster_equal(book, moments, 0.2, 5).select("ts", "market", _r("weight", "weight"))


@_registered("")
def risk_parity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL for the tree; tested against a plain version."""
    book, moments = _quarterly(spark, sf_dir, 60)
    return covariance.risk_parity_tree(book, moments, 5).select("ts", "market", _r("weight", "weight"))


@_registered("")
def volatility_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL for the eigenvalues; tested against a plain version."""
    book, moments = _quarterly(spark, sf_dir, 60, before=True)
    equal = book.withColumn("weight", F.lit(1.0) / F.count("*").over(xs.at()))
    return covariance.volatility_scale(equal, moments, 2.0, 252, 5, 0.1, 1.0, 0.05)

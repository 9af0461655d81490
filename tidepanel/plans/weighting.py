"""Registered queries of target weights: schedules, budgets by side, scales, sleeves, hedges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..operators import cross_section as xs
from ..operators import weights
from ..sources import panel
from .queries import SIZE, TYPE, WM, _r, _registered
from .transforms import BY_MARKET, GRID

SCHEDULES = ("daily", "weekly", "monthly", "quarterly", "semiannual", "10d", "7d+3")
KEYS = {
    "daily": "ts", "weekly": "date_trunc('week', ts)", "monthly": "date_trunc('month', ts)", "quarterly": "date_trunc('quarter', ts)", "semiannual": "year(ts) * 2 + (month(ts) - 1) // 6",
    "10d": "CAST(floor(datediff('day', DATE '1970-01-05', ts) / 10) AS INTEGER)", "7d+3": "CAST(floor((datediff('day', DATE '1970-01-05', ts) - 3) / 7) AS INTEGER)",
}


@_registered(f"WITH {TYPE}, d AS (SELECT DISTINCT ts FROM panel) " + " UNION ALL ".join(f"SELECT '{k}' AS schedule, min(ts) AS ts FROM d GROUP BY {KEYS[k]}" for k in SCHEDULES))
def rebalance_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = panel.build_panel(spark, sf_dir, "type").select("ts").distinct()
    out = None
    for k in SCHEDULES:
        one = weights.rebalance_rows(days, k).select(F.lit(k).alias("schedule"), "ts")
        out = one if out is None else out.unionByName(one)
    return out


@_registered(f"""WITH {SIZE}, {GRID}, s AS (SELECT ts, market, coalesce(volume >= 40, false) AS sel, least(volume / 100, 1.0) AS score FROM grid)
SELECT ts, market, round(CASE WHEN sel THEN 0.05 ELSE 0 END, 8) AS plain, round(CASE WHEN sel THEN 0.05 * coalesce(lag(score, 1) OVER ({WM}), 0) ELSE 0 END, 8) AS scored FROM s""")
def fixed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "size").select("ts", "market", "price", "volume"))
    chosen, score = F.coalesce(F.col("volume") >= 40, F.lit(False)), F.least(F.col("volume") / 100, F.lit(1.0))
    return g.select("ts", "market", F.round(weights.fixed(chosen, 0.05), 8).alias("plain"), F.round(weights.fixed(chosen, 0.05, score, 1), 8).alias("scored"))


@_registered(f"""WITH {SIZE}, s AS (SELECT *, CAST(sign(price - 1400) AS INTEGER) AS side, CASE WHEN volume > 60 THEN 0.5 ELSE 1.0 END AS m FROM panel), k AS (SELECT * FROM s WHERE side <> 0)
SELECT ts, market, side, round(side * CASE WHEN side > 0 THEN 0.9 * 0.6 ELSE 0.9 * 0.4 END / count(*) OVER w, 9) AS equal, round(side * CASE WHEN side > 0 THEN 0.9 * 0.6 * m ELSE 0.9 * 0.4 END * volume / sum(volume) OVER w, 9) AS by_volume FROM k WINDOW w AS (PARTITION BY ts, side)""")
def side_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size")
    side = F.signum(F.col("price") - 1400)
    equal = weights.side_weights(p, side, 0.9, long_share=0.6).withColumnRenamed("weight", "equal").drop("side")
    scale = F.when(F.col("volume") > 60, 0.5).otherwise(1.0)
    both = weights.side_weights(equal, side, 0.9, F.col("volume"), 0.6, scale_long=scale)
    return both.select("ts", "market", "side", F.round("equal", 9).alias("equal"), F.round("weight", 9).alias("by_volume"))


BOOK = f"""{SIZE}, {GRID}, d AS (SELECT min(ts) AS ts FROM panel GROUP BY date_trunc('month', ts)), b AS (SELECT ts, market, CASE WHEN ts IN (SELECT ts FROM d) THEN CASE WHEN coalesce(volume >= 40, false) THEN 1.0 / nullif(count(*) FILTER (volume >= 40) OVER (PARTITION BY ts), 0) ELSE 0.0 END END AS target, price, volume FROM grid),
held AS (SELECT ts, market, coalesce(last_value(target IGNORE NULLS) OVER ({BY_MARKET} UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS w, price, volume FROM b)"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly equal targets on a dense grid; null between rebalances."""
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "size").select("ts", "market", "price", "volume"))
    days = weights.rebalance_rows(g.select("ts").distinct(), "monthly").withColumn("__on", F.lit(True))
    chosen = F.coalesce(F.col("volume") >= 40, F.lit(False))
    equal = F.coalesce(F.try_divide(F.lit(1.0), F.sum(chosen.cast("int")).over(xs.at())), F.lit(0.0))
    return g.join(days, "ts", "left").withColumn("target", F.when(F.col("__on"), F.when(chosen, equal).otherwise(0.0))).drop("__on")


@_registered(f"""WITH {BOOK}, x AS (SELECT ts, round(avg(CASE WHEN price > 1400 THEN 1.0 WHEN price IS NOT NULL THEN 0.0 END), 8) AS s FROM grid GROUP BY ts), l AS (SELECT ts, coalesce(greatest(least(lag(s, 1) OVER (ORDER BY ts), 0.9), 0.2), 0) AS scale FROM x)
SELECT ts, market, round(w, 6) AS held, round(w * scale, 6) AS scaled FROM held JOIN l USING (ts)""")
def exposure_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _book(spark, sf_dir)
    share = b.withColumn("breadth", F.round(F.avg(ew.compare(F.col("price"), F.lit(1400.0), "gt")).over(xs.at()), 8))
    scale = weights.common_scale(share, "breadth", 1, 0.2, 0.9)
    held = weights.held_targets(b, "target").withColumn("held", F.col("target"))
    return weights.scaled_by(held, "target", scale).select("ts", "market", _r("held", "held"), _r("target", "scaled"))


@_registered(f"""WITH {BOOK}, r AS (SELECT ts, avg(price) > 1400 AS risk FROM grid GROUP BY ts), f AS (SELECT market, min(ts) AS first_ts FROM panel WHERE market IN ('10', '20', '30') GROUP BY 1),
j AS (SELECT b.ts, b.market, target, risk, first_ts IS NOT NULL AND first_ts <= b.ts AS inn FROM b JOIN r ON r.ts = b.ts LEFT JOIN f ON f.market = b.market WHERE target IS NOT NULL)
SELECT ts, market, round(CASE WHEN coalesce(risk, false) THEN target WHEN inn THEN 0.7 / count(*) FILTER (inn) OVER (PARTITION BY ts) ELSE 0 END, 6) AS target FROM j""")
def defensive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _book(spark, sf_dir)
    risk = b.groupBy("ts").agg(ew.compare(F.avg("price"), F.lit(1400.0), "gt").alias("flag"))
    listed = b.where("price is not null").where(F.col("market").isin("10", "20", "30")).groupBy("market").agg(F.min("ts").alias("first_ts"))
    return weights.defensive(b.where("target is not null").select("ts", "market", "target"), "target", risk, listed, 0.7).select("ts", "market", _r("target", "target"))


@_registered(f"""WITH {BOOK}, t AS (SELECT ts, market, target, round(price / 1400, 6) AS beta FROM b WHERE target IS NOT NULL)
SELECT ts, market, round(target, 6) AS target FROM t UNION ALL SELECT ts, 'HEDGE', round(0 - 0.5 * CAST(sum(CAST(target * coalesce(beta, 0) AS DECIMAL(28,12))) AS DOUBLE), 6) FROM t GROUP BY ts""")
def hedged_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _book(spark, sf_dir).where("target is not null").withColumn("beta", F.round(F.col("price") / 1400, 6))
    return weights.with_hedge(t, "target", "beta", "HEDGE", 0.5).select("ts", "market", _r("target", "target"))


@_registered(f"""WITH {SIZE}, q AS (SELECT 'volume' AS sleeve, ts, market, CASE WHEN volume >= 40 THEN 0.1 ELSE 0.0 END AS w FROM panel WHERE ts IN (SELECT min(ts) FROM panel GROUP BY date_trunc('month', ts))
  UNION ALL SELECT 'price', ts, market, CASE WHEN price > 1400 THEN 0.2 ELSE 0.0 END FROM panel WHERE ts IN (SELECT min(ts) FROM panel GROUP BY date_trunc('week', ts))),
a AS (SELECT DISTINCT ts, market FROM q), o AS (SELECT DISTINCT sleeve, market FROM q), h AS (SELECT a.ts, a.market, o.sleeve, coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY o.sleeve, a.market ORDER BY a.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS w FROM a JOIN o USING (market) LEFT JOIN q ON q.ts = a.ts AND q.market = a.market AND q.sleeve = o.sleeve)
SELECT ts, market, round(sum(w * CASE sleeve WHEN 'volume' THEN 0.6 ELSE 0.3 END), 6) AS w FROM h GROUP BY ts, market""")
def sleeve_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size")
    a = weights.rebalance_rows(p, "monthly").select("ts", "market", F.lit("volume").alias("sleeve"), F.when(F.col("volume") >= 40, 0.1).otherwise(0.0).alias("w"))
    b = weights.rebalance_rows(p, "weekly").select("ts", "market", F.lit("price").alias("sleeve"), F.when(F.col("price") > 1400, 0.2).otherwise(0.0).alias("w"))
    return weights.combined_sleeves(a.unionByName(b), "w", {"volume": 0.6, "price": 0.3}).select("ts", "market", _r("w", "w"))


@_registered(f"""WITH {BOOK}, s AS (SELECT ts, market, target, row_number() OVER ({WM}) AS i, first_value(target) OVER ({WM}) AS f FROM b WHERE target IS NOT NULL)
SELECT ts, market, round(f * pow(0.5, i - 1) + coalesce(sum(CASE WHEN i > 1 THEN 0.5 * target * pow(0.5, -i) END) OVER ({BY_MARKET} UNBOUNDED PRECEDING AND CURRENT ROW), 0) * pow(0.5, i), 6) AS average FROM s""")
def smoothed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.ewm_targets(_book(spark, sf_dir).where("target is not null"), "target", 3).select("ts", "market", _r("average", "average"))


@_registered(f"""WITH {SIZE}, t AS (SELECT ts, market, least(volume / 400, 0.3) AS w FROM panel), r AS (SELECT ts, market, w, CASE WHEN total > 0 THEN w * 0.8 / total ELSE w END AS scaled FROM (SELECT *, CAST(sum(CAST(w AS DECIMAL(28,12))) OVER (PARTITION BY ts) AS DOUBLE) AS total FROM t))
SELECT ts, market, round(w, 6) AS w, round(scaled, 6) AS scaled FROM r""")
def rescaled_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = panel.build_panel(spark, sf_dir, "size").select("ts", "market", F.least(F.col("volume") / 400, F.lit(0.3)).alias("w"))
    return t.select("ts", "market", _r("w", "w"), _r(weights.rescale_to(F.col("w"), 0.8), "scaled"))


@_registered(f"""WITH {BOOK}, l AS (SELECT *, lag(w) OVER ({WM}) AS old, min(ts) OVER () AS t0 FROM held), c AS (SELECT ts, market, w FROM l WHERE ts IN (SELECT ts FROM l WHERE old IS NULL OR w <> old)),
g AS (SELECT ts, sum(w) AS gross, count(*) FILTER (w > 0) AS n, min(market) AS least FROM c GROUP BY ts)
SELECT c.ts, c.market, CAST(row_number() OVER (PARTITION BY c.ts ORDER BY c.market) AS INTEGER) AS place, round(w, 6) AS target_weight, round(gross, 6) AS gross_exposure FROM c JOIN g USING (ts) WHERE w > 0
UNION ALL SELECT ts, least, NULL, 0, 0 FROM g WHERE n = 0""")
def sparse_weight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = weights.held_targets(_book(spark, sf_dir), "target").select("ts", "market", "target")
    s = weights.sparse_rows(held, "target")
    return s.select("ts", "market", "place", _r("target_weight", "target_weight"), _r("gross_exposure", "gross_exposure"))


@_registered(f"""WITH {BOOK}, t AS (SELECT ts, market, target FROM b WHERE target IS NOT NULL), f AS (SELECT market, min(ts) AS since FROM t WHERE target <> 0 GROUP BY 1), o AS (SELECT t.* FROM t JOIN f USING (market) WHERE ts >= since),
s AS (SELECT market, arg_max(target, ts) AS target FROM o WHERE ts <= DATE '1996-06-15' GROUP BY 1)
SELECT ts, market, round(target, 6) AS target FROM o WHERE ts > DATE '1996-06-15' UNION ALL SELECT DATE '1996-06-15', market, round(target, 6) FROM s""")
def sleeve_window_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _book(spark, sf_dir).where("target is not null").select("ts", "market", "target")
    return weights.window_requests(t, "target", "1996-06-15").select("ts", "market", _r("target", "target"))


@_registered(f"""WITH {SIZE}, {GRID}, f AS (SELECT *, min(CASE WHEN price IS NOT NULL THEN ts END) OVER (PARTITION BY market) <= ts AS on_list, CASE CAST(market AS INTEGER) WHEN 10 THEN 0.5 WHEN 20 THEN 0.3 WHEN 30 THEN 0.2 END AS w FROM grid)
SELECT ts, market, round(CASE WHEN on_list THEN w / nullif(sum(CASE WHEN on_list THEN w END) OVER (PARTITION BY ts), 0) ELSE 0 END, 6) AS weight FROM f WHERE w IS NOT NULL""")
def benchmark_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "size").select("ts", "market", "price"))
    return weights.listed_shares(g, {"10": 0.5, "20": 0.3, "30": 0.2}).select("ts", "market", _r("weight", "weight"))

"""More registered panel queries: state weights, trends, calendar periods, universe gates, weights and curve reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..operators import calendar, curves, rolling, sliding, weights
from ..operators import cross_section as xs
from ..sources import panel
from .queries import BRAND, CURVES, SIZE, TYPE, WM, _curves, _r, _registered

BY_MARKET = "PARTITION BY market ORDER BY ts ROWS BETWEEN"
GRID = "grid AS (SELECT t.ts, m.market, p.price, p.volume FROM (SELECT DISTINCT ts FROM panel) t CROSS JOIN (SELECT DISTINCT market FROM panel) m LEFT JOIN panel p ON p.ts = t.ts AND p.market = m.market)"


def _panel(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return panel.build_panel(spark, sf_dir, key)


@_registered(f"""WITH {TYPE}, x AS (SELECT *, round(price / 1000 - 1.4, 8) AS z FROM panel)
SELECT ts, market, round(1 - greatest(least(ceil((z - (-0.3)) / 0.125), 4.0), 0.0) / 4 * 0.75, 6) AS stepped,
  round(CASE WHEN z <= -0.3 THEN 0.0 WHEN z < 0.1 THEN 0.2 + floor((z - (-0.3)) / 0.1) / 4 * 0.8 WHEN z < 0.5 THEN 1 - floor((z - 0.1) / 0.1) / 4 * 0.7 ELSE 0.3 END, 6) AS hump,
  CASE WHEN volume > 100 THEN CASE CAST(floor(volume / 100) AS INTEGER) % 3 WHEN 0 THEN amount WHEN 1 THEN volume ELSE -1.0 END END AS by_state,
  round(CASE WHEN volume > 50 THEN price / (volume - 50) END, 6) AS safe, CASE WHEN market = (SELECT min(p_type) FROM part) THEN 2.0 * (z > 0)::INT ELSE 1.0 * (z > 0)::INT + 0.5 * (volume > 100)::INT END AS score FROM x""")
def state_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _panel(spark, sf_dir, "type").withColumn("z", F.round(F.col("price") / 1000 - 1.4, 8))
    first = panel.read(spark, sf_dir, "part").agg(F.min("p_type").alias("__m"))
    z, v, a = F.col("z"), F.col("volume"), F.col("amount")
    state = F.when(v > 100, F.floor(v / 100).cast("int") % 3)
    up, busy = ew.compare(z, F.lit(0.0), "gt"), ew.compare(v, F.lit(100.0), "gt")
    return x.join(F.broadcast(first)).select(  # one row
        "ts", "market", _r(ew.stepped_cap(z, -0.3, 0.2, 0.25, 4), "stepped"), _r(ew.hump_steps(z, -0.3, 0.1, 0.5, 0.2, 0.3, 4), "hump"), ew.by_state(state, {0: a, 1: v}, F.lit(-1.0)).alias("by_state"),
        _r(ew.safe_ratio(F.col("price"), v - 50), "safe"), F.when(F.col("market") == F.col("__m"), ew.market_score(F.lit("m"), {"m": [(up, 2.0)]}, [])).otherwise(ew.market_score(F.lit("o"), {}, [(up, 1.0), (busy, 0.5)])).alias("score"),
    )


@_registered(f"""WITH b AS (SELECT CAST(ts AS DATE) AS ts, event_type AS market, max(value) AS high, min(value) AS low, arg_max(value, CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id) AS close FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(close) OVER ({WM}) AS c1 FROM b) SELECT ts, market, round(greatest(high - low, abs(high - c1), abs(low - c1)), 6) AS true_range FROM l""")
def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panel.read(spark, sf_dir, "events")
    b = e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("market")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    b = b.withColumnRenamed("day", "ts")
    return b.select("ts", "market", _r(ew.true_range(F.col("high"), F.col("low"), rolling.shift(F.col("close"), 1)), "true_range"))


@_registered(f"""WITH {BRAND}, r AS (SELECT *, row_number() OVER ({WM}) AS i, price / lag(price) OVER ({WM}) - 1 AS ret, ln(price) AS y, ln(1 + volume) AS lv FROM panel)
SELECT ts, market, round(CASE WHEN count(ret) OVER w = 15 THEN median(ret) OVER w END, 6) AS med, round(CASE WHEN count(*) OVER w = 15 THEN avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER w END, 6) AS wins,
  round(CASE WHEN count(ret) OVER w = 15 AND abs(avg(ret) OVER w) > 0.001 THEN median(ret) OVER w / abs(avg(ret) OVER w) END, 5) AS consistent,
  round(CASE WHEN count(*) OVER w = 15 THEN covar_pop(y, i) OVER w / var_pop(i) OVER w * pow(covar_pop(y, i) OVER w, 2) / (var_pop(i) OVER w * var_pop(y) OVER w) END, 6) + 0.0 AS trend,
  round(CASE WHEN count(ret) OVER w = 15 THEN sum(ret * volume) OVER w / sum(volume) OVER w END, 6) AS weighted, round(lead(price, 4) OVER ({WM}) / lead(price, 1) OVER ({WM}) - 1, 6) AS label3,
  round(CASE WHEN count(*) OVER w = 15 THEN lv / avg(lv) OVER w END, 6) AS turn_ratio, round(CASE WHEN count(*) OVER w = 15 THEN (lv - avg(lv) OVER w) / stddev_samp(lv) OVER w END, 5) AS turn_z
FROM r WINDOW w AS ({WM} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def trend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, v = F.col("price"), F.col("volume")
    made = sliding.trend_quality(sliding.consistency(_panel(spark, sf_dir, "brand"), "price", 15, 0.001, median_name="med"), "price", 15)
    return rolling.turnover_scores(made, "volume", 15).select(
        "ts", "market", _r("med", "med"), _r(rolling.win_rate(p, 15), "wins"), F.round("consistency", 5).alias("consistent"), _r("trend", "trend"),
        _r(rolling.weighted_momentum(p, v, 15), "weighted"), _r(rolling.next_open_label(p, 3), "label3"), _r("turn_ratio", "turn_ratio"), F.round("turn_z", 5).alias("turn_z"),
    )


@_registered(f"""WITH {TYPE}, m AS (SELECT ts, avg(price) AS ref FROM panel GROUP BY ts), j AS (SELECT p.ts, market, price, ref, price / lag(price) OVER ({WM}) - 1 AS ret, ref / lag(ref) OVER ({WM}) - 1 AS rr FROM panel p JOIN m USING (ts))
SELECT ts, market, round(CASE WHEN count(*) OVER w = 20 THEN price - covar_samp(price, ref) OVER w / var_samp(ref) OVER w * ref END, 4) AS residual,
  round(CASE WHEN count(ret) OVER w = 20 THEN covar_samp(ret, rr) OVER w / var_samp(rr) OVER w END, 5) AS beta20,
  round(price / lag(price, 5) OVER ({WM}) - 1 - CASE WHEN count(ret) OVER w = 20 THEN covar_samp(ret, rr) OVER w / var_samp(rr) OVER w END * (ref / lag(ref, 5) OVER ({WM}) - 1), 5) AS residual_momentum
FROM j WINDOW w AS ({WM} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def residual_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _panel(spark, sf_dir, "type").withColumn("ref", F.avg("price").over(xs.at()))
    p, ref = F.col("price"), F.col("ref")
    moves = j.withColumns({"r": rolling.simple_return(p), "rr": rolling.simple_return(ref)})
    made = sliding.beta(sliding.residual(moves, "price", "ref", 20), "r", "rr", 20, "beta20")
    return made.select("ts", "market", F.round("residual", 4).alias("residual"), F.round("beta20", 5).alias("beta20"), F.round(rolling.simple_return(p, 5) - F.col("beta20") * rolling.simple_return(ref, 5), 5).alias("residual_momentum"))


@_registered(f"""WITH {TYPE}, h AS (SELECT ts, market, round(price, 8) AS price, list(round(price, 8)) OVER ({BY_MARKET} UNBOUNDED PRECEDING AND CURRENT ROW) AS held, list(round(price, 8)) OVER ({BY_MARKET} 29 PRECEDING AND CURRENT ROW) AS l30 FROM panel)
SELECT ts, market, round(CASE WHEN len(held) >= 10 THEN (len(list_filter(held, lambda v: v < price)) + (len(list_filter(held, lambda v: v = price)) + 1) / 2.0) / len(held) END, 6) AS percentile,
  round(CASE WHEN len(l30) >= 12 THEN (len(list_filter(l30, lambda v: v < price)) + len(list_filter(l30, lambda v: v = price)) / 2.0) / len(l30) END, 6) AS mid FROM h""")
def running_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir, "type").select("ts", "market", F.round("price", 8).alias("price"))
    return rolling.mid_rank(rolling.expanding_percentile(p, "price", 10), "price", 30, 12).select("ts", "market", _r("percentile", "percentile"), _r("mid", "mid"))


@_registered(f"""WITH {BRAND}, {GRID}, f AS (SELECT ts, market, CASE WHEN price > 1500 THEN 1 WHEN price < 1300 THEN 0 END AS mark, price FROM grid)
SELECT ts, market, CASE WHEN price IS NOT NULL THEN coalesce(CAST(last_value(mark IGNORE NULLS) OVER ({BY_MARKET} UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 0.0) END AS held FROM f""")
def holding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = panel.dense_grid(_panel(spark, sf_dir, "brand").select("ts", "market", "price"))
    flags = grid.select("ts", "market", ew.compare(F.col("price"), F.lit(1500.0), "gt").alias("entry"), ew.compare(F.col("price"), F.lit(1300.0), "lt").alias("leave"))
    return rolling.holding_state(flags, "entry", "leave").select("ts", "market", "held")


@_registered(f"""WITH {SIZE}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY price DESC, market) AS best, row_number() OVER (PARTITION BY ts ORDER BY price, market) AS up, count(*) OVER (PARTITION BY ts) AS n FROM panel)
SELECT ts, market, round(avg(CASE WHEN best <= 5 THEN CASE WHEN volume > 40 THEN 1.0 ELSE 0.0 END END) OVER (PARTITION BY ts), 6) AS top_breadth,
  round(coalesce(avg(CASE WHEN 1 + floor((best - 1) * 3 / n) = 3 THEN CASE WHEN volume > 40 THEN 1.0 ELSE 0.0 END END) OVER (PARTITION BY ts), 0), 6) AS low_breadth,
  CAST(greatest(least(ceil(CASE WHEN n = 1 THEN 1.0 ELSE (up - 1) / (n - 1) END * 5), 5), 1) AS INTEGER) AS bucket FROM k""")
def breadth_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, busy = F.col("price"), ew.compare(F.col("volume"), F.lit(40.0), "gt")
    return _panel(spark, sf_dir, "size").select("ts", "market", _r(xs.breadth(p, busy, 5), "top_breadth"), _r(xs.breadth(p, busy, quantiles=3, buckets=(3,)), "low_breadth"), xs.percentile_bucket(xs.percentile(p), 5).alias("bucket"))


@_registered(f"""WITH {SIZE}, m AS (SELECT market, date_trunc('month', ts)::DATE AS p, arg_max(price, ts) AS v FROM panel GROUP BY 1, 2 HAVING count(price) >= 2),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(p) FROM m), (SELECT max(p) + INTERVAL 12 MONTH FROM m), INTERVAL 1 MONTH)) AS DATE) AS p),
s AS (SELECT market, cal.p, median(v) AS med FROM cal JOIN m ON m.p < cal.p AND m.p >= cal.p - INTERVAL 3 MONTH GROUP BY 1, 2 HAVING count(*) = 3)
SELECT panel.ts, panel.market, round(med, 6) AS med3, round(o.price, 6) AS start_value FROM panel LEFT JOIN s ON s.market = panel.market AND s.p = date_trunc('month', panel.ts) LEFT JOIN panel o ON o.market = panel.market AND o.ts = date_trunc('month', panel.ts)""")
def calendar_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir, "size").select("ts", "market", "price")
    out = calendar.start_value(calendar.rolling_median(p, "price", "month", 3, "last", 2), "price", "month")
    return out.select("ts", "market", _r("median", "med3"), _r("start_value", "start_value"))


@_registered(f"""WITH {SIZE} SELECT market, date_trunc('quarter', ts)::DATE AS period, max(ts) AS snapshot FROM panel GROUP BY 1, 2""")
def snapshot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.snapshot_dates(_panel(spark, sf_dir, "size"), "quarter")


@_registered(f"""WITH {TYPE}, sp AS (SELECT date_trunc('month', min(ts)) AS a, max(ts) AS z FROM panel), b AS (SELECT CAST(unnest(generate_series(a, z::TIMESTAMP, INTERVAL 5 MONTH)) AS DATE) AS s, z FROM sp),
k AS (SELECT s, CAST(s + INTERVAL 5 MONTH AS DATE) AS e FROM b WHERE s + INTERVAL 5 MONTH <= z + INTERVAL 1 DAY)
SELECT s AS block_start, e AS block_end, count(DISTINCT ts) AS n_days, count(*) AS n_rows FROM panel JOIN k ON ts >= s AND ts < e GROUP BY 1, 2 HAVING count(*) >= 2""")
def month_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.month_blocks(_panel(spark, sf_dir, "type"), 5)


@_registered(f"""WITH {TYPE}, sp AS (SELECT date_trunc('month', min(ts)) AS a, max(ts) AS z FROM panel), b AS (SELECT CAST(unnest(generate_series(a + INTERVAL 24 MONTH, z::TIMESTAMP, INTERVAL 6 MONTH)) AS DATE) AS s, z FROM sp)
SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS fold, CAST(s - INTERVAL 24 MONTH AS DATE) AS train_start, s AS test_start, CAST(s + INTERVAL 6 MONTH AS DATE) AS test_end FROM b WHERE s + INTERVAL 6 MONTH <= z + INTERVAL 1 DAY""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.walk_forward(_panel(spark, sf_dir, "type"), 24, 6, 6)


@_registered(f"""WITH {SIZE}, a AS (SELECT *, datediff('day', min(ts) OVER (PARTITION BY market), ts) AS age, row_number() OVER ({WM}) AS i FROM panel), g AS (SELECT min(ts) AS first FROM (SELECT ts FROM a WHERE volume >= 20 AND age >= 90 GROUP BY ts HAVING count(*) >= 4))
SELECT ts, market, (i - 1) % 7 = 0 AS sampled FROM a, g WHERE age >= 90 AND ts >= first""")
def universe_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir, "size").withColumn("sampled", calendar.every(7))
    return weights.start_gate(weights.min_age(p, 90), F.col("volume") >= 20, 4).select("ts", "market", "sampled")


@_registered(f"""WITH {SIZE}, m AS (SELECT market, date_trunc('month', ts) AS p, round(avg(amount), 8) AS s FROM panel GROUP BY 1, 2), k AS (SELECT market, min(p) + INTERVAL 1 MONTH AS since FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p ORDER BY s DESC, market) <= 2) GROUP BY 1),
i AS (SELECT ts FROM panel GROUP BY ts HAVING sum(CASE WHEN volume > 60 THEN volume ELSE 0 END) > 0)
SELECT panel.ts, panel.market, round(amount, 2) AS amount FROM panel JOIN k ON k.market = panel.market AND panel.ts >= since JOIN i ON i.ts = panel.ts""")
def monthly_union_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir, "size").withColumn("busy", F.when(F.col("volume") > 60, F.col("volume")).otherwise(0.0))
    active = weights.drop_idle_times(p, "busy").select("ts").distinct()
    return weights.monthly_union(p, "amount", 2).join(active, "ts", "left_semi").select("ts", "market", F.round("amount", 2).alias("amount"))


@_registered(f"""WITH {TYPE}, s AS (SELECT ts, market, round(CASE WHEN price > 1400 THEN volume / 1000 ELSE 0 END, 8) AS target FROM panel), n AS (SELECT *, row_number() OVER ({WM}) AS i, first_value(target) OVER ({WM}) AS f FROM s)
SELECT ts, market, round((sum(target) OVER w + (4 - count(*) OVER w) * f) / 4, 6) AS average, round(coalesce(greatest(least(target / 0.5, 0.9), -0.5) * 0.8 / nullif(count(*) FILTER (target > 0) OVER (PARTITION BY ts), 0), 0), 6) AS by_value FROM n WINDOW w AS ({BY_MARKET} 3 PRECEDING AND CURRENT ROW)""")
def averaged_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _panel(spark, sf_dir, "type").select("ts", "market", F.round(F.when(F.col("price") > 1400, F.col("volume") / 1000).otherwise(0.0), 8).alias("target"))
    return weights.target_average(s, "target", 4).select("ts", "market", _r("average", "average"), _r(weights.feature_value(F.col("target"), F.col("target").isNotNull(), 0.5, -0.5, 0.9, 0.8), "by_value"))


@_registered(f"""WITH {BRAND}, {GRID}, f AS (SELECT *, min(CASE WHEN price IS NOT NULL THEN ts END) OVER (PARTITION BY market) AS first_ts FROM grid)
SELECT ts, market, round(1.0 / count(*) OVER (PARTITION BY ts), 6) AS weight FROM f WHERE first_ts <= ts""")
def listed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = panel.dense_grid(_panel(spark, sf_dir, "brand").select("ts", "market", "price"))
    first = F.min(F.when(F.col("price").isNotNull(), F.col("ts"))).over(Window.partitionBy("market"))
    return grid.withColumn("first_ts", first).select("ts", "market", _r(weights.listed_fixed(), "weight")).where("weight is not null")


@_registered(f"""WITH {BRAND} SELECT market, max(ts) AS ts, arg_max(volume, ts) AS volume FROM panel WHERE ts <= DATE '1998-06-15' GROUP BY market""")
def latest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.latest_targets(_panel(spark, sf_dir, "brand"), "volume", F.to_date(F.lit("1998-06-15")))


@_registered(f"""WITH {CURVES}, b AS (SELECT ts, avg(ret) AS bench FROM r GROUP BY ts), e AS (SELECT run_id, r.ts, ret - bench AS excess FROM r JOIN b ON b.ts = r.ts WHERE ret - bench > -1),
i AS (SELECT run_id, ts, CASE WHEN count(*) OVER w = 126 THEN avg(excess) OVER w / stddev_pop(excess) OVER w * sqrt(252) END AS ir FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))
SELECT run_id, count(*) AS n, round(avg(ir), 5) AS mean, round(stddev_pop(ir), 5) AS std, round(quantile_cont(ir, 0.25), 5) AS q25, round(median(ir), 5) AS median, round(quantile_cont(ir, 0.75), 5) AS q75,
  round(avg(CASE WHEN ir > 0 THEN 1.0 ELSE 0.0 END), 5) AS positive, round(min(ir), 5) AS least, round(max(ir), 5) AS most FROM i WHERE ir IS NOT NULL GROUP BY run_id""")
def rolling_ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = curves.excess(curves.with_returns(_curves(spark, sf_dir)))
    s = curves.summarize(curves.rolling_information_ratio(e, 126, 252), "information_ratio")
    return s.select("run_id", "n", *[F.round(c, 5).alias(c) for c in s.columns[2:]])


@_registered(f"""WITH {CURVES}, i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM r),
h AS (SELECT run_id, i, n, lead(i) OVER (PARTITION BY run_id ORDER BY i) AS nxt FROM i WHERE drawdown = 0), d AS (SELECT run_id, coalesce(nxt, n) - i AS bars, nxt IS NOT NULL AS done FROM h),
s AS (SELECT * FROM d WHERE (done AND bars > 1) OR (NOT done AND bars > 0)), w AS (SELECT run_id, round((arg_max(value, ts) / arg_min(value, ts) - 1) * 100, 6) AS return_pct FROM cv WHERE ts BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY 1),
a AS (SELECT run_id, max(bars) FILTER (done) AS longest_completed, list_sort(list(bars) FILTER (done), 'DESC')[2] AS second_completed, max(bars) AS longest, round(quantile_cont(bars, 0.9), 6) AS p90, round(list_avg(list_sort(list(bars), 'DESC')[1:5]), 6) AS mean_top5, coalesce(max(bars) FILTER (NOT done), 0) AS current_bars FROM s GROUP BY 1),
u AS (SELECT run_id, round(arg_max(drawdown, ts) * 100, 6) AS current_pct, round(avg(CASE WHEN drawdown < 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS under_water_pct FROM r GROUP BY 1)
SELECT u.run_id, longest_completed, second_completed, longest, p90, mean_top5, current_pct, coalesce(current_bars, 0) AS current_bars, under_water_pct, return_pct FROM u JOIN w USING (run_id) LEFT JOIN a USING (run_id)""")
def drawdown_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curves(spark, sf_dir)
    r = curves.recovery(c).join(curves.window_returns(c, "1997-01-01", "1997-12-31").drop("n"), "run_id")
    return r.select("run_id", "longest_completed", "second_completed", "longest", "current_bars", *[_r(x, x) for x in ("p90", "mean_top5", "current_pct", "under_water_pct", "return_pct")])


@_registered(f"""WITH {BRAND}, {GRID}, g AS (SELECT ts, coalesce(last_value(price IGNORE NULLS) OVER w / first_value(price IGNORE NULLS) OVER w, 1.0) AS grown FROM grid WINDOW w AS ({BY_MARKET} UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT ts, round(avg(grown), 6) AS value FROM g GROUP BY ts""")
def group_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.group_benchmark(panel.dense_grid(_panel(spark, sf_dir, "brand").select("ts", "market", "price"))).select("ts", _r("value", "value"))


@_registered(f"""WITH {BRAND}, {GRID}, g AS (SELECT ts, last_value(price IGNORE NULLS) OVER w AS p, first_value(price IGNORE NULLS) OVER w AS f FROM grid WHERE market = (SELECT min(market) FROM panel) WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT ts, round(p / f * 1000, 5) AS value FROM g WHERE p IS NOT NULL""")
def market_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market that is first by name."""
    grid = panel.dense_grid(_panel(spark, sf_dir, "brand").select("ts", "market", "price"))
    first = panel.read(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return curves.market_benchmark(grid, first, 1000.0).select("ts", F.round("value", 5).alias("value"))

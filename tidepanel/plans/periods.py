"""Registered queries of calendar periods, folds and trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar
from ..sources import panel
from .queries import CURVES, SIZE, TYPE, _curves, _r, _registered
from .transforms import GRID

P_MONTH = "(year(ts) - 1970) * 12 + month(ts) - 1"
LAST = f"m AS (SELECT market, {P_MONTH} AS p, arg_max(price, ts) AS v, avg(price) AS mean FROM panel GROUP BY 1, 2)"
WP = "PARTITION BY market ORDER BY p"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense_grid(panel.build_panel(spark, sf_dir, "size").select("ts", "market", "price", "volume"))


@_registered(f"""WITH {SIZE}, {GRID}, {LAST}, o AS (SELECT market, p, v / lag(v, 2) OVER ({WP}) - 1 AS same FROM m), q AS (SELECT market, p, lag(same) OVER ({WP}) AS nxt, same FROM o), k AS (SELECT *, {P_MONTH} AS p FROM grid)
SELECT k.ts, k.market, round(CASE WHEN k.price IS NOT NULL THEN q.nxt END, 6) AS delayed, round(CASE WHEN k.price IS NOT NULL THEN q.same END, 6) AS at_once FROM k LEFT JOIN q ON q.market = k.market AND q.p = k.p""")
def period_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = calendar.period_return(calendar.period_return(_grid(spark, sf_dir), "price", "month", 2, name="delayed"), "price", "month", 2, "same_period", "at_once")
    return g.select("ts", "market", _r("delayed", "delayed"), _r("at_once", "at_once"))


@_registered(f"""WITH {SIZE}, {GRID}, {LAST}, k AS (SELECT *, {P_MONTH} AS p FROM grid)
SELECT k.ts, k.market, round(CASE WHEN k.price IS NOT NULL THEN a.mean END, 6) AS at_once, round(CASE WHEN k.price IS NOT NULL THEN b.mean END, 6) AS next_month FROM k LEFT JOIN m a ON a.market = k.market AND a.p = k.p LEFT JOIN m b ON b.market = k.market AND b.p + 1 = k.p""")
def period_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = calendar.period_mean(calendar.period_mean(_grid(spark, sf_dir), "price", "month", "same_period", "at_once"), "price", "month", "next_period", "next_month")
    return g.select("ts", "market", _r("at_once", "at_once"), _r("next_month", "next_month"))


@_registered(f"""WITH {SIZE}, {GRID}, {LAST}, s AS (SELECT market, p, CASE WHEN row_number() OVER ({WP}) >= 4 THEN sum(v) OVER ({WP} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS v FROM m), k AS (SELECT *, {P_MONTH} AS p FROM grid)
SELECT k.ts, k.market, round(CASE WHEN k.price IS NOT NULL THEN s.v END, 4) AS period_sum FROM k LEFT JOIN s ON s.market = k.market AND s.p + 1 = k.p""")
def period_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.period_sum(_grid(spark, sf_dir), "price", "month", 4, 1).select("ts", "market", F.round("period_sum", 4).alias("period_sum"))


@_registered(f"""WITH {SIZE}, {GRID}, {LAST}, l AS (SELECT market, p, list_sort(list(v) OVER ({WP} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS h FROM m),
s AS (SELECT market, p, CASE WHEN len(h) = 6 THEN list_sum(h[2:5]) / 4 END AS t, CASE WHEN len(h) = 6 THEN (list_sum(h[2:5]) + h[2] + h[5]) / 6 END AS w FROM l), k AS (SELECT *, {P_MONTH} AS p FROM grid)
SELECT k.ts, k.market, round(CASE WHEN k.price IS NOT NULL THEN s.t END, 5) AS trimmed, round(CASE WHEN k.price IS NOT NULL THEN s.w END, 5) AS winsorized FROM k LEFT JOIN s ON s.market = k.market AND s.p + 1 = k.p""")
def period_robust_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = calendar.period_robust_mean(calendar.period_robust_mean(_grid(spark, sf_dir), "price", "month", 7, 1, name="trimmed"), "price", "month", 7, 1, 1, "winsorized", name="winsorized")
    return g.select("ts", "market", F.round("trimmed", 5).alias("trimmed"), F.round("winsorized", 5).alias("winsorized"))


@_registered(f"""WITH {SIZE}, {GRID}, {LAST}, k AS (SELECT *, {P_MONTH} AS p FROM grid), f AS (SELECT min(p) + 1 AS first FROM m), l AS (SELECT min(p) AS least FROM k)
SELECT k.ts, k.market, round(CASE WHEN k.price IS NOT NULL THEN a.v END, 6) AS held, round(b.v, 6) AS from_first FROM k, f, l
LEFT JOIN m a ON a.market = k.market AND a.p + 1 = k.p - k.p % 3 AND a.p + 1 >= l.least LEFT JOIN m b ON b.market = k.market AND b.p + 1 = k.p - (k.p - f.first % 3) % 3 AND b.p + 1 >= l.least""")
def period_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = calendar.period_hold(calendar.period_hold(_grid(spark, sf_dir), "price", "month", 3, name="held"), "price", "month", 3, first_valid=True, everywhere=True, name="from_first")
    return g.select("ts", "market", _r("held", "held"), _r("from_first", "from_first"))


@_registered(f"""WITH {TYPE}, sp AS (SELECT min(ts) AS a, max(ts) AS z FROM panel), f AS (SELECT CAST(unnest(generate_series(a + INTERVAL 24 MONTH, z::TIMESTAMP, INTERVAL 6 MONTH)) AS DATE) AS t, z FROM sp), n AS (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS fold, t, z FROM f), d AS (SELECT DISTINCT ts FROM panel)
SELECT fold, (SELECT min(ts) FROM d WHERE ts >= t - INTERVAL 24 MONTH) AS train_start, (SELECT min(ts) FROM d WHERE ts >= t) AS predict_start, coalesce((SELECT min(ts) FROM d WHERE ts >= t + INTERVAL 6 MONTH), z + 1) AS predict_end FROM n""")
def model_fold_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.fold_starts(panel.build_panel(spark, sf_dir, "type").select("ts"), 24, 6, 6)


@_registered(f"""WITH {CURVES}, w(name, months, covered) AS (VALUES ('3M', 3, true), ('6M', 6, true), ('1Y', 12, false), ('2Y', 24, false), ('3Y', 36, true), ('5Y', 60, true)), l AS (SELECT run_id, max(ts) AS z FROM cv GROUP BY 1),
i AS (SELECT cv.run_id, name, covered, CAST(z - to_months(months) AS DATE) AS since, ts, value FROM cv JOIN l USING (run_id), w WHERE ts >= z - to_months(months))
SELECT run_id, name AS "window", min(ts) AS start, round(CASE WHEN count(*) >= 2 AND NOT (covered AND datediff('day', since, min(ts)) > 7) THEN (arg_max(value, ts) / arg_min(value, ts) - 1) * 100 END, 6) AS return_pct FROM i GROUP BY run_id, name, covered, since""")
def trailing_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.trailing_windows(_curves(spark, sf_dir)).withColumn("return_pct", F.round("return_pct", 6))


@_registered(f"""WITH {TYPE} SELECT ts, market, round(price, 6) AS price, CAST(365.0 * 1440 / 240 AS DOUBLE) AS bars_a_year FROM panel WHERE ts BETWEEN DATE '1995-03-01' AND DATE '1997-08-31'""")
def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = calendar.between(panel.build_panel(spark, sf_dir, "type"), "1995-03-01", "1997-08-31")
    return p.select("ts", "market", _r("price", "price"), F.lit(calendar.per_year("240m")).alias("bars_a_year"))


@_registered("""SELECT event_id, ts, event_type FROM events WHERE hour(ts) IN (0, 6, 12, 18)""")
def events_at_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.read(spark, sf_dir, "events").where(calendar.at_hours(F.col("ts"), (0, 6, 12, 18))).select("event_id", "ts", "event_type")

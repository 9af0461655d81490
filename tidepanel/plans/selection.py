"""Registered queries of universe selection, table upkeep and research reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import research, rolling, tables, universe
from ..sources import panel
from .queries import SIZE, WM, _r, _registered
from .transforms import GRID, _panel

FACTOR = f"f AS (SELECT ts, market, round(price / lag(price, 3) OVER ({WM}) - 1, 8) AS factor, volume, round(lead(price) OVER ({WM}) / price - 1, 8) AS label FROM panel)"


def _factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("price")
    return _panel(spark, sf_dir, "size").select("ts", "market", F.round(rolling.simple_return(p, 3), 8).alias("factor"), "volume", F.round(F.lead(p).over(rolling.by_time()) / p - 1, 8).alias("label"))


def _selection_sql(second_over: str) -> str:
    return f"""WITH {SIZE}, {GRID}, b AS (SELECT *, market NOT IN ('1', '2') AND coalesce(lag(volume, 2) OVER ({WM}) >= 10, false) AND price IS NOT NULL AS base FROM grid),
a AS (SELECT *, base AND row_number() OVER (PARTITION BY ts, base ORDER BY volume DESC, market) <= 8 AS one FROM b),
c AS (SELECT *, {second_over} AND 1 + floor((row_number() OVER (PARTITION BY ts, {second_over} ORDER BY price, market) - 1) * 3 / count(*) OVER (PARTITION BY ts, {second_over})) IN (1, 2) AS two FROM a)
SELECT ts, market FROM c WHERE one AND two"""


def _selected(spark: SparkSession, sf_dir: str, sequential: bool) -> DataFrame:
    grid = panel.dense_grid(_panel(spark, sf_dir, "size").select("ts", "market", "price", "volume"))
    base = universe.listed(F.col("market"), exclude=("1", "2")) & universe.value_filter(F.col("volume"), "ge", 10, 2) & F.col("price").isNotNull()
    filters = [{"x": "volume", "top_n": 8}, {"x": "price", "quantiles": 3, "buckets": (1, 2), "descending": False}]
    # a market without a volume is never among the first by volume; its base is left out of both ranks alike
    return universe.stages(grid.withColumn("base", base), "base", filters, sequential).where("selected").select("ts", "market")


@_registered(_selection_sql("one"))
def sequential_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, True)


@_registered(_selection_sql("base"))
def parallel_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, False)


@_registered(f"""WITH {SIZE}, w AS (SELECT ts, market, CASE WHEN volume > 150 THEN volume / 1000 ELSE 0 END AS weight FROM panel), u AS (SELECT * FROM w WHERE market IN (SELECT market FROM w WHERE weight <> 0) AND ts >= (SELECT min(ts) FROM w WHERE weight <> 0))
SELECT ts, market, round(weight * 7 / count(*) OVER (PARTITION BY ts), 6) AS scaled FROM u""")
def active_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _panel(spark, sf_dir, "size").select("ts", "market", F.when(F.col("volume") > 150, F.col("volume") / 1000).otherwise(0.0).alias("weight"))
    return universe.per_listed(universe.ever_used(universe.from_first_active(w, "weight"), "weight"), "weight", 7.0).select("ts", "market", _r("scaled", "scaled"))


@_registered("""SELECT c_custkey, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC) = 1""")
def final_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = panel.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), panel.read(spark, sf_dir, "customer").select("c_custkey")
    preferred = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return tables.final_version(o.join(c, F.col("o_custkey") == F.col("c_custkey")), ["c_custkey"], preferred, F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", "o_orderkey", "o_orderstatus")


OLD_NEW = f"WITH {SIZE}, old AS (SELECT ts, market, volume FROM panel WHERE year(ts) < 1999), new AS (SELECT ts, market, CASE WHEN CAST(market AS INTEGER) % 7 = 0 THEN volume + 1 WHEN CAST(market AS INTEGER) % 7 <> 1 THEN volume END AS volume FROM panel WHERE year(ts) >= 1998)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, seventh = _panel(spark, sf_dir, "size").select("ts", "market", "volume"), F.col("market").cast("int") % 7
    return p.where(F.year("ts") < 1999), p.where(F.year("ts") >= 1998).withColumn("volume", F.when(seventh == 0, F.col("volume") + 1).when(seventh != 1, F.col("volume")))


@_registered(f"{OLD_NEW} SELECT ts, market, coalesce(new.volume, old.volume) AS volume FROM new FULL JOIN old USING (ts, market)")
def combined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return tables.combine_first(new, old, ["ts", "market"], ["volume"])


@_registered(f"{OLD_NEW} SELECT * FROM old WHERE ts NOT IN (SELECT ts FROM new) UNION ALL SELECT * FROM new")
def replaced_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.replace_groups(*_old_new(spark, sf_dir), ["ts"])


@_registered(f"{OLD_NEW} SELECT market, count(*) AS n_changed, min(ts) AS first_changed FROM old JOIN new USING (ts, market) WHERE new.volume IS DISTINCT FROM old.volume GROUP BY market")
def retroactive_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.changed_keys(*_old_new(spark, sf_dir), ["market", "ts"], "volume", "market")


@_registered(f"WITH {SIZE}, {FACTOR} SELECT market, max(ts) AS ts, arg_max(factor, ts) AS factor, arg_max(volume, ts) AS volume FROM f WHERE label IS NOT NULL GROUP BY market")
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest_snapshot(_factor(spark, sf_dir), "label", ["factor", "volume"])


@_registered(f"""WITH {SIZE}, l AS (SELECT ts, market, volume FROM panel QUALIFY row_number() OVER (PARTITION BY market ORDER BY ts DESC) = 1)
SELECT ts, market, volume FROM panel UNION ALL SELECT DATE '2001-11-10' AS ts, market, volume FROM l WHERE datediff('day', ts, DATE '2001-11-10') BETWEEN 1 AND 60""")
def extended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.extended_to(_panel(spark, sf_dir, "size").select("ts", "market", "volume"), F.to_date(F.lit("2001-11-10")), 60)


@_registered(f"""WITH {SIZE}, {FACTOR}, b AS (SELECT * FROM f WHERE factor IS NOT NULL AND label IS NOT NULL),
k AS (SELECT *, CAST(1 + floor((row_number() OVER (PARTITION BY ts ORDER BY factor, market) - 1) * 3 / count(*) OVER (PARTITION BY ts)) AS INTEGER) AS x_bucket, CAST(1 + floor((row_number() OVER (PARTITION BY ts ORDER BY volume, market) - 1) * 3 / count(*) OVER (PARTITION BY ts)) AS INTEGER) AS y_bucket FROM b),
s AS (SELECT CAST(x.x AS INTEGER) AS x_bucket, CAST(y.y AS INTEGER) AS y_bucket FROM range(1, 4) x(x), range(1, 4) y(y)), g AS (SELECT x_bucket, y_bucket, count(*) AS n, avg(label) AS m, median(label) AS d, avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) AS p FROM k GROUP BY 1, 2)
SELECT s.x_bucket, s.y_bucket, coalesce(n, 0) AS n, round(m, 6) AS mean_label, round(d, 6) AS median_label, round(p, 6) AS positive FROM s LEFT JOIN g USING (x_bucket, y_bucket)""")
def bucket_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = research.bucket_matrix(_factor(spark, sf_dir), "factor", "volume", "label", 3)
    return m.select("x_bucket", "y_bucket", "n", _r("mean_label", "mean_label"), _r("median_label", "median_label"), _r("positive", "positive"))


_CELL = lambda c, q: f"CAST(1 + floor((row_number() OVER (PARTITION BY ts ORDER BY {c}, market) - 1) * {q} / count(*) OVER (PARTITION BY ts)) AS INTEGER) AS {c}_bucket"


@_registered(f"""WITH {SIZE}, {FACTOR}, b AS (SELECT f.*, round(volume * factor, 8) AS amount_ FROM f WHERE factor IS NOT NULL AND label IS NOT NULL AND volume IS NOT NULL), k AS (SELECT label, {_CELL('factor', 3)}, {_CELL('volume', 2)}, {_CELL('amount_', 4)} FROM b),
s AS (SELECT CAST(x.x AS INTEGER) AS factor_bucket, CAST(y.y AS INTEGER) AS volume_bucket, CAST(z.z AS INTEGER) AS amount__bucket FROM range(1, 4) x(x), range(1, 3) y(y), range(1, 5) z(z)),
g AS (SELECT factor_bucket, volume_bucket, amount__bucket, count(*) AS n, avg(label) AS m, median(label) AS d, avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) AS p FROM k GROUP BY 1, 2, 3)
SELECT s.*, coalesce(n, 0) AS n, round(m, 6) AS mean_label, round(d, 6) AS median_label, round(p, 6) AS positive FROM s LEFT JOIN g USING (factor_bucket, volume_bucket, amount__bucket)""")
def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three axes."""
    f = _factor(spark, sf_dir).withColumn("amount_", F.round(F.col("volume") * F.col("factor"), 8))
    m = research.cell_summary(f, {"factor": 3, "volume": 2, "amount_": 4}, "label")
    return m.select("factor_bucket", "volume_bucket", "amount__bucket", "n", *[_r(c, c) for c in ("mean_label", "median_label", "positive")])


@_registered(f"""WITH {SIZE}, {FACTOR}, t AS (SELECT market, year(ts) % 2 AS family, round(1 / (1 + abs(avg(label) / stddev_samp(label)) * sqrt(count(*))), 8) AS p FROM f WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_samp(label) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS i, count(*) OVER (PARTITION BY family) AS m FROM t), h AS (SELECT *, p * m * list_sum(list_transform(range(1, m + 1), lambda v: 1.0::DOUBLE / v)) / i AS raw FROM k)
SELECT market, family, p, round(least(1.0, min(raw) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted FROM h""")
def adjusted_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    t = _factor(spark, sf_dir).where("label is not null").groupBy("market", (F.year("ts") % 2).alias("family")).agg(F.count("*").alias("n"), F.avg(label).alias("mean"), F.stddev_samp(label).alias("sd")).where("n >= 5 and sd > 0")
    t = t.select("market", "family", F.round(1 / (1 + F.abs(F.col("mean") / F.col("sd")) * F.sqrt("n")), 8).alias("p"))
    return research.adjusted_p(t, "p", ["family"]).select("market", "family", "p", _r("adjusted", "adjusted"))

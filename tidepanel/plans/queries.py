"""The registered panel queries and their SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..operators import asof, curves, research, rolling, sliding, universe, weights
from ..operators import cross_section as xs
from ..sources import panel
from ..streaming import bars as bars_

DIGITS = 6
SQL: dict[str, str] = {}
QUERIES: dict = {}


def _registered(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: Column | str, name: str) -> Column:
    return F.round(c, DIGITS).alias(name)


def _panel_sql(key: str) -> str:
    market = panel.MARKETS[key].replace("STRING", "VARCHAR")
    return f"""sums AS (
  SELECT CAST(l_shipdate AS DATE) AS ts, {market} AS market, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
panel AS (SELECT ts, market, amount / volume AS price, volume, amount FROM sums)"""


TYPE, BRAND, SIZE = (_panel_sql(k) for k in ("type", "brand", "size"))
WM = "PARTITION BY market ORDER BY ts"


@_registered(f"WITH {BRAND} SELECT market, min(ts) AS data_start, max(ts) AS data_end, count(*) AS n_rows FROM panel GROUP BY market")
def panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.coverage(panel.build_panel(spark, sf_dir, "brand"))


@_registered(f"""WITH {BRAND} SELECT ts, market, round(price, 6) AS price FROM panel QUALIFY row_number() OVER (PARTITION BY market ORDER BY ts DESC) <= 20""")
def per_market_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.tail_rows(panel.build_panel(spark, sf_dir, "brand"), 20).select("ts", "market", _r("price", "price"))


@_registered(f"""WITH {BRAND}, grid AS (SELECT t.ts, m.market, p.price FROM (SELECT DISTINCT ts FROM panel) t CROSS JOIN (SELECT DISTINCT market FROM panel) m LEFT JOIN panel p ON p.ts = t.ts AND p.market = m.market)
SELECT ts, market, round(CASE WHEN count(price) OVER w = 5 THEN sum(price) OVER w END, 6) AS sum5, round(price / lag(price, 1) OVER ({WM}) - 1, 6) AS ret1
FROM grid WINDOW w AS ({WM} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def preserve_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = panel.dense_grid(panel.build_panel(spark, sf_dir, "brand"))
    return grid.select("ts", "market", _r(rolling.rolling(F.col("price"), 5, "sum"), "sum5"), _r(rolling.simple_return(F.col("price")), "ret1"))


@_registered(f"""WITH {TYPE}, x AS (SELECT *, price / 1000 - 1.4 AS z FROM panel)
SELECT ts, market, round(abs(z), 6) AS abs_z, round(CASE WHEN z > 0 THEN ln(z) END, 6) AS log_z, round(CASE WHEN z >= 0 THEN ln(1 + z) END, 6) AS log1p_z,
  round(greatest(least(z, 0.2), -0.2), 6) AS clipped, round(z * exp(-z * z / 2), 6) AS gaussian, round(0.25 + greatest(least((z + 0.5) / 1.0, 1.0), 0.0) * 0.75, 6) AS ramp,
  round(floor(abs(z) / 0.05 + 1e-12) * 0.05, 6) AS steps, round(least(z, volume / 100), 6) AS lower_of, round(greatest(z, volume / 100), 6) AS higher_of,
  round(CASE WHEN z <> 0 THEN price / z END, 4) AS ratio, CASE WHEN z > 0 THEN volume END AS masked, CASE WHEN z > 0.1 THEN 1.0 ELSE 0.0 END AS above,
  CASE WHEN z > 0.1 OR volume > 500 THEN 1.0 ELSE 0.0 END AS either, round(0.7 * z + 0.3 * volume, 6) AS combined FROM x""")
def elementwise_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = panel.build_panel(spark, sf_dir, "type").withColumn("z", F.col("price") / 1000 - 1.4)
    z, v = F.col("z"), F.col("volume")
    above = ew.compare(z, F.lit(0.1), "gt")
    return x.select(
        "ts", "market", _r(F.abs(z), "abs_z"), _r(ew.log(z), "log_z"), _r(ew.log(z, "log1p"), "log1p_z"), _r(ew.clip(z, -0.2, 0.2), "clipped"), _r(ew.gaussian_signed(z), "gaussian"),
        _r(ew.linear_ramp(z, -0.5, 0.5, 0.25, 1.0), "ramp"), _r(ew.quantize(F.abs(z), 0.05), "steps"), _r(ew.pair_min(z, v / 100), "lower_of"), _r(ew.pair_max(z, v / 100), "higher_of"),
        F.round(ew.ratio(F.col("price"), z), 4).alias("ratio"), ew.mask_by(v, ew.compare(z, F.lit(0.0), "gt")).alias("masked"), above.alias("above"),
        ew.logical("or", above, ew.compare(v, F.lit(500.0), "gt")).alias("either"), _r(ew.weighted_sum([(z, 0.7), (v, 0.3)]), "combined"),
    )


def _full(value: str, n: int) -> str:
    return f"CASE WHEN count(price) OVER w{n} = {n} THEN {value} END"


@_registered(f"""WITH {BRAND}
SELECT ts, market, round(price - lag(price, 3) OVER ({WM}), 6) AS delta3, round(price / lag(price, 5) OVER ({WM}) - 1, 6) AS ret5, round(ln(price) - ln(lag(price, 20) OVER ({WM})), 6) AS mom20,
  round({_full('avg(price) OVER w20', 20)}, 6) AS mean20, round({_full('stddev_pop(price) OVER w20', 20)}, 6) AS std20, round({_full('max(price) OVER w20', 20)}, 6) AS max20,
  round(CASE WHEN count(price) OVER w20 = 20 AND stddev_pop(price) OVER w20 > 1e-12 THEN (price - avg(price) OVER w20) / stddev_pop(price) OVER w20 END, 6) AS z20,
  round(CASE WHEN count(price) OVER e >= 10 THEN stddev_pop(price) OVER e END, 6) AS estd, datediff('day', min(ts) OVER e, ts) AS age
FROM panel WINDOW w20 AS ({WM} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), e AS ({WM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("price")
    made = sliding.over_last(panel.build_panel(spark, sf_dir, "brand"), 20, "w", sliding.moments(("x", p)))
    made = sliding.rolling(made, "price", 20, "max", "high")
    return made.select(
        "ts", "market", _r(rolling.delta(p, 3), "delta3"), _r(rolling.simple_return(p, 5), "ret5"), _r(rolling.momentum(p, 20), "mom20"), _r(sliding.mean("w", 20), "mean20"),
        _r(sliding.std("w", 20), "std20"), _r("high", "max20"), _r(sliding.zscore("w", 20, p), "z20"), _r(rolling.expanding_std(p, 10), "estd"), rolling.age_days(p, F.col("ts")).cast("long").alias("age"),
    )


@_registered(f"""WITH {BRAND}, r AS (SELECT *, row_number() OVER ({WM}) AS i, abs(price - lag(price) OVER ({WM})) AS step, ln(price / lag(price) OVER ({WM})) AS lr FROM panel),
s AS (SELECT *, (sum(price * i) OVER w10 - (i - 10) * sum(price) OVER w10) / 55.0 AS wma, sum(step) OVER w10 AS path, price - lag(price, 10) OVER ({WM}) AS d10,
      sum(price * volume) OVER w10 / sum(volume) OVER w10 AS vw, count(*) OVER w10 AS n10, avg(least(lr, 0) * least(lr, 0)) OVER w10 AS down, count(lr) OVER w10 AS nlr,
      list(price) OVER w10 AS held
      FROM r WINDOW w10 AS ({WM} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT ts, market, round(CASE WHEN n10 = 10 THEN wma END, 6) AS wma10, round(CASE WHEN n10 = 10 THEN vw END, 6) AS vwma10, round(CASE WHEN path > 0 THEN abs(d10) / path END, 6) AS efficiency,
  round(CASE WHEN nlr = 10 THEN sqrt(down) END, 6) AS downside,
  round(CASE WHEN n10 = 10 THEN (len(list_filter(held, lambda v: v < price)) + (len(list_filter(held, lambda v: v = price)) + 1) / 2.0) / 10 END, 6) AS pct10
FROM s""")
def weighted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, v = F.col("price"), F.col("volume")
    return rolling.percentile_of_last(panel.build_panel(spark, sf_dir, "brand"), "price", 10, "pct10").select(
        "ts", "market", _r(rolling.wma(p, 10), "wma10"), _r(rolling.vwma(p, v, 10), "vwma10"), _r(rolling.efficiency_ratio(p, 10), "efficiency"), _r(rolling.downside_vol(p, 10), "downside"), _r("pct10", "pct10")
    )


@_registered(f"""WITH {TYPE}, r AS (SELECT *, row_number() OVER ({WM}) AS i FROM panel), k AS (SELECT 1 - 2.0 / 11 AS q)
SELECT ts, market, round(CASE WHEN i >= 10 THEN (2.0 / 11) * coalesce(sum(CASE WHEN i > 10 THEN price * pow(q, -i) END) OVER e, 0) * pow(q, i) + pow(q, i - 10) * sum(CASE WHEN i <= 10 THEN price END) OVER e / 10 END, 4) AS ewma10
FROM r, k WINDOW e AS ({WM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def seeded_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.ewma(panel.build_panel(spark, sf_dir, "type").select("ts", "market", "price"), "price", 10, "ewma10").select("ts", "market", F.round("ewma10", 4).alias("ewma10"))


@_registered(f"""WITH {TYPE}, m AS (SELECT ts, avg(price) AS ref FROM panel GROUP BY ts), j AS (SELECT p.ts, market, price, ref FROM panel p JOIN m USING (ts))
SELECT ts, market, round(CASE WHEN count(*) OVER w = 30 AND var_pop(ref) OVER w > 0 THEN covar_pop(price, ref) OVER w / var_pop(ref) OVER w END, 6) AS beta30
FROM j WINDOW w AS ({WM} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "type").withColumn("ref", F.avg("price").over(xs.at()))
    return sliding.beta(p, "price", "ref", 30).select("ts", "market", _r("beta", "beta30"))


@_registered(f"""WITH {TYPE} SELECT ts, market, round(CASE WHEN count(*) OVER w = 5 THEN lead(price, 5) OVER ({WM}) / price - 1 END, 6) AS fwd5,
  round(CASE WHEN count(*) OVER w = 5 THEN min(price) OVER w / price - 1 END, 6) AS low5, round(CASE WHEN count(*) OVER w = 5 THEN max(price) OVER w / price - 1 END, 6) AS high5
FROM panel WINDOW w AS ({WM} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def forward_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, lo, hi = rolling.path_ahead(F.col("price"), 5)
    return panel.build_panel(spark, sf_dir, "type").select("ts", "market", _r(f, "fwd5"), _r(lo, "low5"), _r(hi, "high5"))


@_registered(f"""WITH {SIZE}, s AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY price, market) AS up, row_number() OVER (PARTITION BY ts ORDER BY price DESC, market) AS down,
  count(*) OVER (PARTITION BY ts) AS n, rank() OVER (PARTITION BY ts ORDER BY price) AS lo, count(*) OVER (PARTITION BY ts, price) AS ties FROM panel)
SELECT ts, market, up AS rank_up, down AS rank_down, round(CASE WHEN n = 1 THEN 1.0 ELSE (up - 1) / (n - 1) END, 6) AS pct, CAST(1 + floor((up - 1) * 5 / n) AS INTEGER) AS bucket5, round((lo + (ties - 1) / 2.0) / n, 6) AS avg_pct FROM s""")
def cross_section_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("price")
    return panel.build_panel(spark, sf_dir, "size").select(
        "ts", "market", xs.rank(p).alias("rank_up"), xs.rank(p, descending=True).alias("rank_down"), _r(xs.percentile(p), "pct"), xs.quantile_bucket(p, 5).alias("bucket5"), _r(xs.average_percent_rank(p), "avg_pct")
    )


@_registered(f"""WITH {SIZE}, g AS (SELECT *, CAST(market AS INTEGER) % 5 AS grp FROM panel)
SELECT ts, market, grp, round(CASE WHEN count(*) OVER w >= 3 THEN price - avg(price) OVER w END, 6) AS demeaned, row_number() OVER (PARTITION BY ts, grp ORDER BY price, market) AS grp_rank FROM g WINDOW w AS (PARTITION BY ts, grp)""")
def group_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = panel.build_panel(spark, sf_dir, "size").withColumn("grp", F.col("market").cast("int") % 5)
    return g.select("ts", "market", "grp", _r(xs.group_demean(F.col("price"), "grp", 3), "demeaned"), xs.rank(F.col("price"), ("ts", "grp")).alias("grp_rank"))


@_registered(f"""WITH {SIZE}, r AS (SELECT ts, price / lag(price) OVER ({WM}) - 1 AS ret FROM panel)
SELECT ts, count(ret) AS n, round(quantile_cont(ret, 0.5), 6) AS med, round(stddev_samp(ret), 6) AS sd, round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END), 6) AS pos FROM r GROUP BY ts HAVING count(ret) >= 5""")
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = panel.build_panel(spark, sf_dir, "size").withColumn("ret", rolling.simple_return(F.col("price")))
    return xs.dispersion(r, "ret", 5).select("ts", "n", _r("med", "med"), _r("sd", "sd"), _r("pos", "pos"))


@_registered(f"""WITH {BRAND}, m AS (SELECT market, date_trunc('month', ts)::DATE AS p, arg_max(price, ts) AS last_price, avg(price) AS mean_price, sum(amount) AS amount FROM panel GROUP BY 1, 2)
SELECT market, p AS period, round(last_price / lag(last_price) OVER (PARTITION BY market ORDER BY p) - 1, 6) AS period_ret, round(mean_price, 6) AS mean_price,
  round(CASE WHEN count(*) OVER w = 3 THEN sum(amount) OVER w END, 2) AS sum3 FROM m WINDOW w AS (PARTITION BY market ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def calendar_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "brand").groupBy("market", F.trunc("ts", "month").alias("period")).agg(F.max_by("price", "ts").alias("last_price"), F.avg("price").alias("mean_price"), F.sum("amount").alias("amount"))
    w = Window.partitionBy("market").orderBy("period")
    three = w.rowsBetween(-2, 0)
    total = F.when(F.count("*").over(three) == 3, F.sum("amount").over(three))
    return p.select("market", "period", _r(F.col("last_price") / F.lag("last_price").over(w) - 1, "period_ret"), _r("mean_price", "mean_price"), F.round(total, 2).alias("sum3"))


@_registered(f"""WITH {BRAND}, m AS (SELECT market, date_trunc('month', ts)::DATE AS p, avg(price) AS mean_price FROM panel GROUP BY 1, 2)
SELECT panel.ts, panel.market, round(mean_price, 6) AS prev_mean FROM panel LEFT JOIN m ON m.market = panel.market AND m.p + INTERVAL 1 MONTH = date_trunc('month', panel.ts)""")
def calendar_next_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "brand").withColumn("period", F.trunc("ts", "month"))
    m = p.groupBy("market", F.add_months("period", 1).alias("period")).agg(F.avg("price").alias("m"))
    return p.join(m, ["market", "period"], "left").select("ts", "market", _r("m", "prev_mean"))


FLAGSHIP = f"""WITH {TYPE}, r AS (SELECT ts, market, price / lag(price) OVER ({WM}) - 1 AS ret FROM panel),
x AS (SELECT *, CASE WHEN ret IS NOT NULL THEN CASE WHEN count(ret) OVER (PARTITION BY ts) = 1 THEN 1.0 ELSE (row_number() OVER (PARTITION BY ts, ret IS NOT NULL ORDER BY ret, market) - 1) / (count(ret) OVER (PARTITION BY ts) - 1) END END AS pct FROM r),
m AS (SELECT market, date_trunc('month', ts)::DATE AS p, round(avg(pct), 8) AS score FROM x GROUP BY 1, 2),
days AS (SELECT min(ts) AS ts FROM panel GROUP BY date_trunc('month', ts)),
c AS (SELECT panel.ts, panel.market, score FROM panel JOIN days USING (ts) JOIN m ON m.market = panel.market AND m.p + INTERVAL 1 MONTH = date_trunc('month', panel.ts) WHERE score IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, market) AS position FROM c)
SELECT ts, market, round(score, 6) AS score, CAST(position AS INTEGER) AS position, round(1.0 / count(*) OVER (PARTITION BY ts), 6) AS weight FROM t WHERE position <= 3"""


@_registered(FLAGSHIP)
def rank_momentum_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: returns, their cross-section percentile, last month's mean of it, the best three on each month's first day, equally weighted."""
    p = panel.build_panel(spark, sf_dir, "type").withColumn("ret", rolling.simple_return(F.col("price"))).withColumn("pct", xs.percentile(F.col("ret"))).withColumn("period", F.trunc("ts", "month"))
    m = p.groupBy("market", F.add_months("period", 1).alias("period")).agg(F.round(F.avg("pct"), 8).alias("score"))
    scored = weights.rebalance_rows(p.select("ts", "market", "period"), "monthly").join(m.where("score is not null"), ["market", "period"])
    return weights.top_n(scored, "score", 3).select("ts", "market", _r("score", "score"), "position", _r(weights.equal(), "weight"))


@_registered(f"""WITH {SIZE}, d AS (SELECT min(ts) AS ts FROM panel GROUP BY date_trunc('month', ts)), s AS (SELECT panel.* FROM panel JOIN d USING (ts)),
k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, market) AS position FROM s),
t AS (SELECT *, CASE position WHEN 1 THEN 5.0 WHEN 2 THEN 3.0 WHEN 3 THEN 1.0 ELSE 1.0 END AS w FROM k WHERE position <= 4),
v AS (SELECT ts, market, CAST(position AS INTEGER) AS position, w / sum(w) OVER (PARTITION BY ts) AS weight FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY 0.4 / weight, market) AS i FROM v),
q AS (SELECT *, (sum(weight) OVER (PARTITION BY ts) - (i - 1) * 0.4) / sum(weight) OVER (PARTITION BY ts ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sc FROM o),
z AS (SELECT *, max(sc) OVER (PARTITION BY ts) AS scale FROM q)
SELECT ts, market, position, round(weight, 6) AS weight, round(least(weight, 0.4), 6) AS with_cash, round(least(0.4, weight * scale), 6) AS final FROM z""")
def capped_rank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = weights.top_n(weights.rebalance_rows(panel.build_panel(spark, sf_dir, "size"), "monthly"), "volume", 4)
    w = t.select("ts", "market", "position", weights.rank_weighted("position", (5, 3, 1, 1)).alias("weight"), F.lit(0.4).alias("cap"))
    return weights.redistribute(w, "weight", "cap").select("ts", "market", "position", _r("weight", "weight"), _r(weights.keep_cash(F.col("weight"), F.col("cap")), "with_cash"), _r("final", "final"))


@_registered(f"""WITH {SIZE}, c AS (SELECT * FROM panel QUALIFY count(*) OVER (PARTITION BY ts) >= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY price DESC, market) AS best, row_number() OVER (PARTITION BY ts ORDER BY price, market) AS worst FROM c),
s AS (SELECT ts, market, CASE WHEN best <= 3 THEN 1 WHEN worst <= 3 THEN -1 END AS side FROM k)
SELECT ts, market, side, round(side * 1.0 / 2 / count(*) OVER (PARTITION BY ts, side), 6) AS weight FROM s WHERE side IS NOT NULL""")
def long_short_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size").withColumn("n", F.count("*").over(xs.at())).where("n >= 8")
    return weights.long_short(p, "price", 3, 1.0).select("ts", "market", "side", _r("weight", "weight"))


@_registered(f"""WITH {TYPE}, s AS (SELECT ts, market, CASE WHEN price > 1500 THEN 1.0 ELSE 0.0 END AS target FROM panel),
g AS (SELECT t.ts, m.market, coalesce(s.target, 0.0) AS target FROM (SELECT DISTINCT ts FROM s) t CROSS JOIN (SELECT DISTINCT market FROM s) m LEFT JOIN s ON s.ts = t.ts AND s.market = m.market),
c AS (SELECT *, target IS DISTINCT FROM lag(target) OVER ({WM}) AS ch FROM g)
SELECT 'portfolio' AS scope, ts, market, target FROM c WHERE ts IN (SELECT ts FROM c WHERE ch) UNION ALL SELECT 'asset', ts, market, target FROM c WHERE ch""")
def change_only_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "type").select("ts", "market", (F.col("price") > 1500).cast("double").alias("target"))
    return weights.changes_only(p, "target").select(F.lit("portfolio").alias("scope"), "*").unionByName(weights.changes_only(p, "target", "asset").select(F.lit("asset").alias("scope"), "*"))


@_registered(f"""WITH {BRAND}, f AS (SELECT market, ts + INTERVAL 30 DAY AS at, price AS known_price FROM panel WHERE volume >= 100)
SELECT p.ts, p.market, round(p.price, 6) AS price, round(f.known_price, 6) AS known_price FROM panel p ASOF LEFT JOIN f ON p.market = f.market AND p.ts >= f.at""")
def asof_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "brand").select("ts", "market", "price", "volume")
    facts = p.where("volume >= 100").select("market", F.date_add("ts", 30).alias("at"), F.col("price").alias("known_price"))
    return asof.asof_join(p.select("ts", "market", "price"), facts, ["market"], "ts", "at", ["known_price"]).select("ts", "market", _r("price", "price"), _r("known_price", "known_price"))


@_registered("""WITH e AS (SELECT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT nation, ts, round(total, 2) AS total, round(sum(total) OVER (PARTITION BY nation ORDER BY ts RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW), 2) AS trailing FROM e""")
def trailing_event_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = panel.read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice"), panel.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    e = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("total"))
    return asof.trailing_sum(e, ["nation"], "ts", "total", 90).select("nation", "ts", F.round("total", 2).alias("total"), F.round("trailing", 2).alias("trailing"))


@_registered("""WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ), new AS (SELECT o_orderkey, 'N' AS o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'O')
SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new""")
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("N").alias("o_orderstatus"), F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"))
    return asof.upsert(o, new, ["o_orderkey"])


CURVES = f"""{TYPE}, cv AS (SELECT market AS run_id, ts, price AS value FROM panel), r AS (SELECT *, coalesce(value / lag(value) OVER (PARTITION BY run_id ORDER BY ts) - 1, 0) AS ret,
  value / max(value) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM cv)"""


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.build_panel(spark, sf_dir, "type").select(F.col("market").alias("run_id"), "ts", F.col("price").alias("value"))


@_registered(f"""WITH {CURVES}, q AS (SELECT run_id, quantile_cont(ret, 0.05) AS q05, count(*) AS n FROM r GROUP BY 1),
s AS (SELECT r.*, q05, row_number() OVER (PARTITION BY run_id ORDER BY drawdown, ts) <= ceil(n * 0.05) AS deep FROM r JOIN q USING (run_id))
SELECT run_id, count(*) AS n, round(pow(arg_max(value, ts) / arg_min(value, ts), 252.0 / (count(*) - 1)) - 1, 6) AS cagr, round(min(drawdown), 6) AS max_drawdown, round(avg(ret) / stddev_pop(ret) * sqrt(252), 6) AS sharpe,
  round(avg(ret) / sqrt(avg(least(ret, 0) * least(ret, 0))) * sqrt(252), 6) AS sortino, round(stddev_pop(ret) * sqrt(252), 6) AS vol, round(avg(ret) / abs(avg(CASE WHEN ret <= q05 THEN ret END)) * sqrt(252), 6) AS cvar_sharpe,
  round(sqrt(avg(drawdown * drawdown)) * 100, 6) AS ulcer, round(-avg(CASE WHEN deep THEN drawdown END) * 100, 6) AS cdar,
  round(CASE WHEN avg(ret) >= 0 THEN avg(ret) / stddev_pop(ret) * sqrt(252) ELSE avg(ret) * 252 * stddev_pop(ret) * sqrt(252) END, 6) AS modified_sharpe,
  round((pow(arg_max(value, ts) / arg_min(value, ts), 252.0 / (count(*) - 1)) - 1) / abs(min(drawdown)), 6) AS calmar, round((pow(arg_max(value, ts) / arg_min(value, ts), 252.0 / (count(*) - 1)) - 1) / sqrt(avg(drawdown * drawdown)), 6) AS martin FROM s GROUP BY run_id""")
def curve_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = curves.performance(_curves(spark, sf_dir), 252)
    return p.select("run_id", "n", *[_r(c, c) for c in p.columns[2:]])


@_registered(f"""WITH {CURVES}, k AS (SELECT *, sum(CASE WHEN drawdown >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak_no FROM r)
SELECT run_id, peak_no, min(ts) AS onset, max(ts) AS last_ts, count(*) AS bars, round(min(drawdown), 6) AS depth FROM k WHERE drawdown < 0 GROUP BY run_id, peak_no""")
def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.drawdown_episodes(_curves(spark, sf_dir)).withColumn("depth", F.round("depth", DIGITS))


@_registered(f"""WITH {CURVES}, first_run AS (SELECT min(run_id) AS b FROM r), j AS (SELECT r.run_id, r.ret, x.ret AS bench FROM r JOIN r x ON r.ts = x.ts JOIN first_run ON x.run_id = b AND r.run_id <> b)
SELECT run_id, count(*) AS n, round(avg(ret - bench) / stddev_pop(ret - bench) * sqrt(252), 6) AS information_ratio, round(covar_pop(ret, bench) / var_pop(bench), 6) AS beta,
  round((avg(ret) - covar_pop(ret, bench) / var_pop(bench) * avg(bench)) * 252, 6) AS alpha, round(stddev_pop(ret - bench) * sqrt(252), 6) AS tracking_error, round(avg(ret - bench) * 252, 6) AS annual_excess, round(pow(corr(ret, bench), 2), 6) AS r2 FROM j GROUP BY run_id""")
def benchmark_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curves(spark, sf_dir)
    first = c.agg(F.min("run_id").alias("run_id"))
    s = curves.against_benchmark(c, first, 252)
    return s.select("run_id", "n", *[_r(x, x) for x in s.columns[2:]])


@_registered(f"""WITH {SIZE}, f AS (SELECT ts, market, round(price / lag(price, 3) OVER ({WM}) - 1, 8) AS factor, round(lead(price) OVER ({WM}) / price - 1, 8) AS label FROM panel), b AS (SELECT * FROM f WHERE factor IS NOT NULL AND label IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY factor) + (count(*) OVER (PARTITION BY ts, factor) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY ts ORDER BY label) + (count(*) OVER (PARTITION BY ts, label) - 1) / 2.0 AS rl FROM b)
SELECT ts, count(*) AS n, round(corr(factor, label), 6) AS ic, round(corr(rf, rl), 6) AS rank_ic FROM k GROUP BY ts HAVING count(*) >= 6""")
def information_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size")
    f = p.select("ts", "market", F.round(rolling.simple_return(F.col("price"), 3), 8).alias("factor"), F.round(F.lead("price").over(rolling.by_time()) / F.col("price") - 1, 8).alias("label"))
    return research.row_ic(f, "factor", "label", 6).select("ts", "n", _r("ic", "ic"), _r("rank_ic", "rank_ic"))


@_registered(f"""WITH {SIZE}, f AS (SELECT ts, market, round(price / lag(price, 3) OVER ({WM}) - 1, 8) AS factor, round(lead(price) OVER ({WM}) / price - 1, 8) AS label FROM panel), b AS (SELECT * FROM f WHERE factor IS NOT NULL AND label IS NOT NULL),
k AS (SELECT *, CAST(1 + floor((row_number() OVER (PARTITION BY ts ORDER BY factor, market) - 1) * 4 / count(*) OVER (PARTITION BY ts)) AS INTEGER) AS bucket FROM b)
SELECT bucket, count(*) AS n, round(avg(label), 6) AS mean_label, round(quantile_cont(label, 0.5), 6) AS median_label FROM k GROUP BY bucket""")
def factor_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size")
    f = p.select("ts", "market", F.round(rolling.simple_return(F.col("price"), 3), 8).alias("factor"), F.round(F.lead("price").over(rolling.by_time()) / F.col("price") - 1, 8).alias("label"))
    return research.bucket_returns(f, "factor", "label", 4).select("bucket", "n", _r("mean_label", "mean_label"), _r("median_label", "median_label"))


SPLIT_RETURNS = f"""{TYPE}, r0 AS (SELECT ts, market AS candidate, round(price / lag(price) OVER ({WM}) - 1, 8) AS ret FROM panel), rr AS (SELECT * FROM r0 WHERE ret IS NOT NULL), dd AS (SELECT ts, CAST(floor((row_number() OVER (ORDER BY ts) - 1) * 6 / count(*) OVER ()) AS INTEGER) AS block FROM (SELECT DISTINCT ts FROM rr)),
rb AS (SELECT rr.*, block FROM rr JOIN dd USING (ts)), sp AS (SELECT m.split, b.block, CAST((m.split >> b.block) & 1 AS INTEGER) AS inside FROM (SELECT range AS split FROM range(64) WHERE bit_count(range) = 3) m, (SELECT CAST(range AS INTEGER) AS block FROM range(6)) b),
sc AS (SELECT split, inside, candidate, round(avg(ret) / stddev_pop(ret) * sqrt(252), 10) AS score FROM rb JOIN sp USING (block) GROUP BY 1, 2, 3),
bs AS (SELECT split, candidate, max(score) FILTER (inside = 1) AS ins, max(score) FILTER (inside = 0) AS outs FROM sc GROUP BY 1, 2),
kk AS (SELECT *, (rank() OVER (PARTITION BY split ORDER BY outs) + (count(*) OVER (PARTITION BY split, outs) - 1) / 2.0) / (count(*) OVER (PARTITION BY split) + 1) AS oos_rank, row_number() OVER (PARTITION BY split ORDER BY ins DESC, candidate) AS best FROM bs),
sel AS (SELECT split, candidate, ins, outs, oos_rank, ln(oos_rank / (1 - oos_rank)) AS logit FROM kk WHERE best = 1)"""


def _split_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "type")
    r = p.select("ts", F.col("market").alias("candidate"), F.round(rolling.simple_return(F.col("price")), 8).alias("ret")).where("ret is not null")
    return research.consecutive_blocks(r, 6)


@_registered(f"WITH {SPLIT_RETURNS} SELECT split, candidate, round(ins, 6) AS is_score, round(outs, 6) AS oos_score, round(oos_rank, 6) AS oos_rank, round(logit, 6) AS logit FROM sel")
def cscv_overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = research.cscv_selection(research.split_scores(_split_returns(spark, sf_dir), research.cscv_splits(spark, 6)))
    return s.select("split", "candidate", *[_r(c, c) for c in ("is_score", "oos_score", "oos_rank", "logit")])


@_registered(f"""WITH {BRAND}, cal AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM panel)), o AS (SELECT market, i, ts, lead(i) OVER (PARTITION BY market ORDER BY i) AS nxt FROM panel JOIN cal USING (ts))
SELECT o.market, a.ts AS gap_start, b.ts AS gap_end, nxt - o.i - 1 AS bars FROM o JOIN cal a ON a.i = o.i + 1 JOIN cal b ON b.i = nxt - 1 WHERE nxt > o.i + 1""")
def price_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = panel.dense_grid(panel.build_panel(spark, sf_dir, "brand").select("ts", "market", "price"))
    return universe.gaps(grid, "price")


@_registered("""SELECT date_trunc('hour', ts) AS ts, event_type AS market, arg_min(value, event_id_ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id_ts) AS close, round(sum(value), 6) AS total, count(*) AS n_ticks
FROM (SELECT *, CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id AS event_id_ts FROM events) GROUP BY 1, 2""")
def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_.bars(panel.read(spark, sf_dir, "events"), "ts", "event_type", "value", "60 minutes", "event_id").withColumn("total", F.round("total", DIGITS))


@_registered("""SELECT p_partkey, upper(trim(p_name)) AS name_key, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS snake, regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no,
 dense_rank() OVER (ORDER BY p_type) AS type_id FROM part""")
def key_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = panel.read(spark, sf_dir, "part")
    ids = part.select("p_type").distinct().withColumn("type_id", F.dense_rank().over(Window.orderBy("p_type")))  # over the labels, not the rows
    return part.join(ids, "p_type").select("p_partkey", F.upper(F.trim("p_name")).alias("name_key"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_").alias("snake"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("brand_no"), "type_id")


@_registered("""SELECT year(o_orderdate) AS yr, count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS duplicates, count(*) FILTER (o_totalprice IS NULL OR o_totalprice <= 0) AS bad_price, count(*) FILTER (c_custkey IS NULL) AS orphan
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def yearly_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = panel.read(spark, sf_dir, "orders"), panel.read(spark, sf_dir, "customer").select("c_custkey")
    bad, orphan = F.col("o_totalprice").isNull() | (F.col("o_totalprice") <= 0), F.col("c_custkey").isNull()
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.year("o_orderdate").alias("yr")).agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct("o_orderkey")).alias("duplicates"), F.count(F.when(bad, 1)).alias("bad_price"), F.count(F.when(orphan, 1)).alias("orphan")
    )


@_registered(f"""WITH {CURVES}, y AS (SELECT run_id, year(ts) AS yr, arg_max(value, ts) AS last_value, arg_min(value, ts) AS first_value FROM cv GROUP BY 1, 2)
SELECT run_id, yr, round(last_value / coalesce(lag(last_value) OVER (PARTITION BY run_id ORDER BY yr), first_value) - 1, 6) AS year_ret FROM y""")
def annual_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = curves.annual_returns(_curves(spark, sf_dir))
    return y.select("run_id", "yr", _r("year_ret", "year_ret"))


@_registered(f"""WITH {CURVES}, b AS (SELECT ts, avg(ret) AS bench FROM r GROUP BY ts)
SELECT run_id, r.ts, round(ret - bench, 6) AS excess, round(exp(sum(ln(1 + ret - bench)) OVER (PARTITION BY run_id ORDER BY r.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 5) AS relative FROM r JOIN b ON b.ts = r.ts WHERE ret - bench > -1""")
def excess_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves.excess(curves.with_returns(_curves(spark, sf_dir)))
    return c.select("run_id", "ts", _r("excess", "excess"), F.round("relative", 5).alias("relative"))


@_registered(f"""WITH {SIZE}, k AS (SELECT ts, market, row_number() OVER (PARTITION BY ts ORDER BY price, market) AS up, count(*) OVER (PARTITION BY ts) AS n FROM panel),
c AS (SELECT ts, market, CASE WHEN n = 1 THEN 1.0 ELSE (up - 1) / (n - 1) END AS pct FROM k), d AS (SELECT *, pct - lag(pct, 3) OVER ({WM}) AS change, lag(pct, 3) OVER ({WM}) AS old FROM c)
SELECT ts, market, round(pct, 6) AS pct, round(change, 6) AS change3 FROM d""")
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size").select("ts", "market", xs.percentile(F.col("price")).alias("pct"))
    return p.select("ts", "market", _r("pct", "pct"), _r(rolling.delta(F.col("pct"), 3), "change3"))


@_registered(f"""WITH {SIZE}, k AS (SELECT ts, market, row_number() OVER (PARTITION BY ts ORDER BY price, market) AS up FROM panel), o AS (SELECT *, lag(up) OVER ({WM}) AS old FROM k),
b AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY up) AS a, rank() OVER (PARTITION BY ts ORDER BY old) + (count(*) OVER (PARTITION BY ts, old) - 1) / 2.0 AS z FROM o WHERE old IS NOT NULL)
SELECT ts, count(*) AS n, round(CASE WHEN min(a) < max(a) AND min(z) < max(z) THEN corr(a, z) END, 6) AS autocorrelation FROM b GROUP BY ts HAVING count(*) >= 6""")
def rank_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size").select("ts", "market", xs.rank(F.col("price")).cast("double").alias("up")).withColumn("old", rolling.shift(F.col("up"), 1))
    return research.row_ic(p, "up", "old", 6).select("ts", "n", _r("rank_ic", "autocorrelation"))


@_registered(f"""WITH {SIZE}, d AS (SELECT min(ts) AS ts FROM panel GROUP BY date_trunc('month', ts)), h AS (SELECT ts, count(*) FILTER (volume >= 30) AS held FROM panel JOIN d USING (ts) GROUP BY ts)
SELECT count(*) AS rebalances, round(avg(held), 6) AS mean_held, min(held) AS least_held, max(held) AS most_held FROM h WHERE held > 0""")
def selection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weights.rebalance_rows(panel.build_panel(spark, sf_dir, "size"), "monthly").where("volume >= 30")
    return weights.selection_statistics(rows).withColumn("mean_held", F.round("mean_held", DIGITS))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

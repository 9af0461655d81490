"""Registered queries of universes, slots, grids and rows chosen by conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..operators import cross_section as xs
from ..operators import rolling, sliding, universe, weights
from ..sources import panel
from .queries import SIZE, TYPE, WM, _r, _registered
from .transforms import BY_MARKET, GRID


def _grid(spark: SparkSession, sf_dir: str, key: str = "size") -> DataFrame:
    return panel.dense_grid(panel.build_panel(spark, sf_dir, key).select("ts", "market", "price", "volume"))


SPEC = universe.Universe(exclude=("1", "2"), min_age_days=60, least_cross_section=8, values=(("volume", "ge", 10.0, 1),), ranks=(universe.Ranked("volume", top_n=12),), final=universe.Ranked("price", top_n=5, descending=False), signal_lag=1)


@_registered(f"""WITH {SIZE}, {GRID}, l AS (SELECT *, lag(volume) OVER ({WM}) AS v1, lag(price) OVER ({WM}) AS p1, min(CASE WHEN price IS NOT NULL THEN ts END) OVER (PARTITION BY market) AS f FROM grid),
b AS (SELECT *, market NOT IN ('1', '2') AND price IS NOT NULL AND coalesce(datediff('day', f, ts) >= 60, false) AND coalesce(v1 >= 10, false) AS base0 FROM l), g AS (SELECT min(ts) AS t FROM (SELECT ts FROM b WHERE base0 GROUP BY ts HAVING count(*) >= 8)),
c AS (SELECT b.*, base0 AND ts >= t AS base FROM b, g), d AS (SELECT *, base AND v1 IS NOT NULL AND row_number() OVER (PARTITION BY ts, base AND v1 IS NOT NULL ORDER BY v1 DESC, market) <= 12 AS one FROM c),
e AS (SELECT *, one AND p1 IS NOT NULL AND row_number() OVER (PARTITION BY ts, one AND p1 IS NOT NULL ORDER BY p1, market) <= 5 AS two FROM d)
SELECT ts, market, base, two AS selected FROM e WHERE base""")
def built_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.build(_grid(spark, sf_dir), SPEC).where("base").select("ts", "market", "base", "selected")


@_registered(f"""WITH RECURSIVE {SIZE}, {GRID}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM grid)),
u AS (SELECT run_id, ts, market, CASE run_id WHEN 'price' THEN price ELSE volume END AS score, price IS NOT NULL AS cand, coalesce(volume < 8, false) AS lv FROM grid CROSS JOIN (VALUES ('price'), ('volume')) v(run_id)),
d AS (SELECT run_id, i, any_value(u.ts) AS ts, coalesce(list(market ORDER BY score DESC, market) FILTER (cand AND score IS NOT NULL AND NOT lv), []) AS ready, coalesce(list(market) FILTER (lv), []) AS told FROM u JOIN t USING (ts) GROUP BY run_id, i),
s AS (SELECT run_id, CAST(0 AS BIGINT) AS i, NULL::DATE AS ts, []::STRUCT(m VARCHAR, "at" BIGINT)[] AS active, []::STRUCT(m VARCHAR, "at" BIGINT)[] AS barred FROM (SELECT DISTINCT run_id FROM d)
  UNION ALL SELECT run_id, i, ts, list_concat(kept, list_transform(list_filter(ready, lambda x: NOT list_contains(list_transform(kept, lambda a: a.m), x) AND NOT list_contains(list_transform(waits, lambda b: b.m), x))[1:5 - len(kept)], lambda x: {{'m': x, 'at': i}})), waits
  FROM (SELECT run_id, i, ts, ready, kept, list_concat(list_filter(barred, lambda b: b."at" > i), list_transform(gone, lambda a: {{'m': a.m, 'at': i + 3}})) AS waits
    FROM (SELECT d.run_id, d.i, d.ts, d.ready, s.barred, list_filter(s.active, lambda a: d.i - a."at" < 40 AND NOT list_contains(d.told, a.m)) AS kept, list_filter(s.active, lambda a: NOT (d.i - a."at" < 40 AND NOT list_contains(d.told, a.m))) AS gone FROM s JOIN d ON d.run_id = s.run_id AND d.i = s.i + 1)))
SELECT run_id, ts, unnest(list_transform(active, lambda a: a.m)) AS market FROM s WHERE i > 0""")
def slot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five slots in each of two runs that rank by price and by volume."""
    g = _grid(spark, sf_dir)
    runs = g.withColumn("run_id", F.explode(F.array(F.lit("price"), F.lit("volume"))))
    score = F.when(F.col("run_id") == "price", F.col("price")).otherwise(F.col("volume"))
    marked = runs.select("run_id", "ts", "market", F.col("price").isNotNull().alias("candidate"), F.lit(True).alias("eligible"), score.alias("score"), F.coalesce((F.col("volume") < 8).cast("double"), F.lit(0.0)).alias("leave"))
    return universe.held_slots(marked, 5, cooldown=2, longest=40).where("selected").select("run_id", "ts", "market")


@_registered(f"""WITH {SIZE}, {GRID}, i AS (SELECT market, min(ts) + 30 AS data_start, CASE WHEN CAST(market AS INTEGER) % 2 = 0 THEN max(ts) - 30 END AS data_end FROM panel GROUP BY market)
SELECT ts, market, coalesce(ts >= data_start AND (data_end IS NULL OR ts < data_end), false) AS usage_ok FROM grid JOIN i USING (market)""")
def lifecycle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    life = g.where("price is not null").groupBy("market").agg(F.date_add(F.min("ts"), 30).alias("data_start"), F.when(F.col("market").cast("int") % 2 == 0, F.date_sub(F.max("ts"), 30)).alias("data_end"))
    return universe.with_coverage(g, life).select("ts", "market", "usage_ok")


@_registered(f"""WITH {SIZE}, d AS (SELECT min(ts) AS ts FROM panel GROUP BY date_trunc('quarter', ts)), s AS (SELECT panel.ts, market, row_number() OVER (PARTITION BY panel.ts ORDER BY volume DESC, market) <= 4 AS selected FROM panel JOIN d USING (ts)),
n AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nxt FROM d), e AS (SELECT DISTINCT market FROM s WHERE selected)
SELECT p.ts, p.market, coalesce(max(CASE WHEN s.selected THEN 1 ELSE 0 END), 0) = 1 AS usable FROM panel p JOIN e USING (market) LEFT JOIN n ON p.ts >= n.ts AND (n.nxt IS NULL OR p.ts < n.nxt) LEFT JOIN s ON s.ts = n.ts AND s.market = p.market GROUP BY p.ts, p.market""")
def preselection_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size").select("ts", "market", "volume")
    screen = weights.rebalance_rows(p, "quarterly").withColumn("selected", xs.rank(F.col("volume"), descending=True) <= 4)
    return universe.screened(p, screen).select("ts", "market", "usable")


@_registered(f"""WITH {TYPE}, {GRID}, o AS (SELECT market, ts, row_number() OVER (ORDER BY ts) AS x FROM grid WHERE price IS NOT NULL), c AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM grid)),
p AS (SELECT market, i, lead(i) OVER (PARTITION BY market ORDER BY i) AS nxt FROM o JOIN c USING (ts)), g AS (SELECT p.market, a.ts AS gap_start, b.ts AS gap_end FROM p JOIN c a ON a.i = p.i + 1 JOIN c b ON b.i = nxt - 1 WHERE nxt > p.i + 1)
SELECT DISTINCT market FROM panel WHERE market NOT IN (SELECT market FROM g WHERE gap_start <= DATE '1996-03-31' AND gap_end >= DATE '1996-03-28')""")
def markets_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir, "type")
    clear = weights.without_overlaps(g, universe.gaps(g, "price"), F.lit("1996-03-28").cast("date"), F.lit("1996-03-31").cast("date"))
    return clear.select("market").distinct()


@_registered(f"""WITH {SIZE}, w AS (SELECT ts, market, price, CASE WHEN volume < 5 THEN 'CAUTION' WHEN volume > 20 THEN 'NONE' END AS warning FROM panel) SELECT ts, market FROM w WHERE coalesce(warning, 'NONE') <> 'CAUTION'""")
def unwarned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = panel.build_panel(spark, sf_dir, "size").withColumn("warning", F.when(F.col("volume") < 5, "CAUTION").when(F.col("volume") > 20, "NONE"))
    return w.where(universe.without_warnings(F.col("warning"), ("CAUTION",))).select("ts", "market")


@_registered("""SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%i%' AND o_totalprice >= 50000 AND o_totalprice <= 300000) WHERE place <= 10""".replace("SELECT * FROM (", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM ("))
def best_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", "o_orderstatus")
    found = universe.query_rows(o, {"o_orderstatus": "F"}, {"o_orderpriority": "I"}, {"o_totalprice": 50000}, {"o_totalprice": 300000}, ("o_totalprice", "o_orderkey"), group="o_orderpriority", top=10)
    return found.drop("o_orderstatus")


GRID_AXES = {"fast": [5, 10, 20], "slow": [10, 20, 40], "kind": ["a", "b"]}


@_registered(f"""WITH {SIZE}, a(fast) AS (VALUES (5), (10), (20)), b(slow) AS (VALUES (10), (20), (40)), k(kind) AS (VALUES ('a'), ('b')), g AS (SELECT fast, slow, kind, dense_rank() OVER (ORDER BY fast) AS i, dense_rank() OVER (ORDER BY slow) AS j FROM a, b, k WHERE fast < slow),
m AS (SELECT CAST(market AS INTEGER) AS m, round(avg(price), 6) AS price FROM panel GROUP BY market), r AS (SELECT g.*, coalesce(price, 0) AS metric FROM g LEFT JOIN m ON m.m = fast + slow + CASE kind WHEN 'a' THEN 0 ELSE 1 END)
SELECT x.fast, x.slow, x.kind, x.metric, round(avg(y.metric), 6) AS plateau, count(y.metric) AS neighbours FROM r x LEFT JOIN r y ON x.kind = y.kind AND abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 AND NOT (x.i = y.i AND x.j = y.j) GROUP BY ALL""")
def plateau_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    combos = universe.parameter_grid(spark, GRID_AXES, "fast < slow")
    means = panel.build_panel(spark, sf_dir, "size").groupBy(F.col("market").cast("long").alias("m")).agg(F.round(F.avg("price"), 6).alias("price"))
    key = F.col("fast") + F.col("slow") + F.when(F.col("kind") == "a", 0).otherwise(1)
    runs = combos.join(means, key == F.col("m"), "left").select("fast", "slow", "kind", F.coalesce("price", F.lit(0.0)).alias("metric"))
    return universe.plateau(runs, ["fast", "slow"], ["kind"], "metric").withColumn("plateau", F.round("plateau", 6))


@_registered(f"""WITH {SIZE}, g AS (SELECT *, CAST(market AS INTEGER) % 5 AS grp FROM panel), r AS (SELECT *, row_number() OVER (PARTITION BY ts, grp ORDER BY price, market) AS i, count(*) OVER (PARTITION BY ts, grp) AS n FROM g)
SELECT ts, market, CASE WHEN n >= 3 THEN i END AS grp_rank, round(CASE WHEN n >= 3 THEN CASE WHEN n = 1 THEN 1.0 ELSE (i - 1) / (n - 1) END END, 6) AS grp_pct FROM r""")
def group_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = panel.build_panel(spark, sf_dir, "size").withColumn("grp", F.col("market").cast("int") % 5)
    by, p = ("ts", "grp"), F.col("price")
    return g.select("ts", "market", xs.in_group(xs.rank(p, by), p, by, 3).alias("grp_rank"), _r(xs.in_group(xs.percentile(p, by), p, by, 3), "grp_pct"))


@_registered(f"""WITH {TYPE}, h AS (SELECT *, list(price) OVER ({BY_MARKET} 9 PRECEDING AND CURRENT ROW) AS l, stddev_samp(price / 1400) OVER ({BY_MARKET} 9 PRECEDING AND CURRENT ROW) AS v, ln(1 + volume) AS y FROM panel),
t AS (SELECT *, avg(y) OVER w AS my, stddev_samp(y) OVER w AS sy, avg(volume) OVER w AS mv, count(*) OVER w AS n FROM h WINDOW w AS ({BY_MARKET} 9 PRECEDING AND CURRENT ROW))
SELECT ts, market, round(CASE WHEN len(l) = 10 THEN list_min(list_transform(l, lambda x, i: x / list_max(l[1:i]) - 1)) END, 6) AS worst10, round(CASE WHEN v = 0 THEN 2.0 WHEN v > 0 THEN greatest(least(0.15 / sqrt(252) / v, 2.0), 0.1) END, 6) AS vol_weight,
  round(least(ceil(volume / 50 - 1e-12) * 0.05, 0.4), 6) AS up, round(CASE WHEN volume >= 100 - 1e-12 THEN 100 ELSE least(10 + floor((volume - 10) / 25 + 0.5 + 1e-12) * 25, 100) END, 6) AS near FROM t""")
def bounded_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sliding.worst_drawdown(panel.build_panel(spark, sf_dir, "type"), "price", 10, "worst10")
    w = Window.partitionBy("market").orderBy("ts").rowsBetween(-9, 0)
    vol = F.stddev_samp(F.col("price") / 1400).over(w)
    return p.select(
        "ts", "market", _r("worst10", "worst10"), _r(ew.target_vol(vol, 0.15, 252, 0.1, 2.0), "vol_weight"),
        _r(F.least(ew.quantize(F.col("volume") / 1000, 0.05, "ceil"), F.lit(0.4)), "up"), _r(ew.quantize(F.col("volume"), 25.0, "nearest", 10.0, 100.0), "near"),
    )


RET = f"{SIZE}, {GRID}, r AS (SELECT ts, market, price, volume, price / lag(price) OVER ({WM}) - 1 AS ret FROM grid)"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).withColumn("ret", rolling.simple_return(F.col("price")))


@_registered(f"""WITH {RET}, c AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM r)), x AS (SELECT i, market, ret FROM r JOIN c USING (ts)),
s AS (SELECT i AS e, market FROM (SELECT i, market, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS sd FROM x WINDOW w AS (PARTITION BY market ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n = 4 AND sd > 0),
p AS (SELECT a.e, a.market, b.market AS o, corr(y.ret, z.ret) AS c FROM s a JOIN s b ON a.e = b.e AND a.market < b.market JOIN x y ON y.market = a.market AND y.i BETWEEN a.e - 3 AND a.e JOIN x z ON z.market = b.market AND z.i = y.i GROUP BY 1, 2, 3)
SELECT ts, m AS markets, round(avg(p.c), 5) AS correlation FROM p JOIN (SELECT e, count(*) AS m FROM s GROUP BY e) k ON k.e = p.e JOIN c ON c.i = p.e WHERE m >= 3 GROUP BY ts, m""")
def average_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.average_correlation(_returns(spark, sf_dir), "ret", 4, 3).withColumn("correlation", F.round("correlation", 5))


@_registered(f"""WITH RECURSIVE {RET}, c AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM r)), x AS (SELECT i, market, ret, volume FROM r JOIN c USING (ts)), e AS (SELECT date_trunc('month', ts)::DATE AS period, max(i) AS e FROM c GROUP BY 1),
k AS (SELECT period, market, ret, x.i FROM e JOIN x ON x.i > e.e - 120 AND x.i <= e.e WHERE ret IS NOT NULL), n AS (SELECT a.period, a.market, b.market AS o FROM k a JOIN k b ON a.period = b.period AND a.i = b.i AND a.market <> b.market GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND corr(a.ret, b.ret) >= 0.5),
nl AS (SELECT period, market, list(o) AS near FROM n GROUP BY 1, 2), q AS (SELECT period, market, avg(volume) AS l FROM e JOIN x ON x.i > e.e - 60 AND x.i <= e.e GROUP BY 1, 2),
o AS (SELECT q.period, q.market, coalesce(near, []) AS near, row_number() OVER (PARTITION BY q.period ORDER BY l DESC NULLS LAST, q.market) AS p FROM q LEFT JOIN nl USING (period, market)),
pick AS (SELECT period, p, market, [market] AS kept, true AS sel FROM o WHERE p = 1
  UNION ALL SELECT o.period, o.p, o.market, CASE WHEN list_has_any(o.near, pick.kept) THEN pick.kept ELSE list_append(pick.kept, o.market) END, NOT list_has_any(o.near, pick.kept) FROM pick JOIN o ON o.period = pick.period AND o.p = pick.p + 1)
SELECT period, market FROM pick WHERE sel""")
def uncorrelated_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly picks."""
    return xs.greedy_uncorrelated(_returns(spark, sf_dir), "ret", "volume", 0.5, 120, 5, 60)


@_registered(f"""WITH {RET}, l AS (SELECT ts, market, round(lead(price, 5) OVER ({WM}) / price - 1, 8) AS label FROM grid), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY label DESC, market) AS i, count(*) OVER (PARTITION BY ts) AS n FROM l WHERE label IS NOT NULL)
SELECT ts, market, i AS place, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - (i - 1) / (n - 1) END, 6) AS share FROM k""")
def forward_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("price")
    l = _grid(spark, sf_dir).select("ts", "market", F.round(F.try_divide(F.lead(p, 5).over(rolling.by_time()), p) - 1, 8).alias("label")).where("label is not null")
    place, share = xs.forward_rank(F.col("label"))
    return l.select("ts", "market", place.alias("place"), _r(share, "share"))

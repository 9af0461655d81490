"""Registered queries of files: what they write is made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import weights
from ..sources import files, panel
from .queries import BRAND, CURVES, SIZE, TYPE, _curves, _r, _registered
from .transforms import GRID

BARS = "b AS (SELECT market, ts, price AS open, price * 1.01 AS high, price * 0.99 AS low, price AS close, volume, amount, CASE WHEN volume < 5 THEN 'CAUTION' END AS warning FROM panel)"


def _bars(spark: SparkSession, sf_dir: str, key: str = "brand") -> DataFrame:
    p, price = panel.build_panel(spark, sf_dir, key), F.col("price")
    return p.select("market", "ts", price.alias("open"), (price * 1.01).alias("high"), (price * 0.99).alias("low"), price.alias("close"), "volume", "amount", F.when(F.col("volume") < 5, "CAUTION").alias("warning"))


@_registered(f"WITH {BRAND}, {BARS} SELECT market, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, amount, warning FROM b")
def bar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as one CSV folder a market, and all of them read as one long table."""
    path = files.scratch(spark, "bars")
    files.write_table(_bars(spark, sf_dir).repartition("market").withColumn("folder", F.regexp_replace("market", "[^A-Za-z0-9]", "_")), path, "csv", by="folder")
    return files.read_bars(spark, f"{path}/folder=*").select("market", "ts", *[_r(c, c) for c in ("open", "high", "low", "close")], "volume", "amount", "warning")


@_registered(f"WITH {SIZE}, {BARS}, m AS (SELECT DISTINCT market FROM b ORDER BY market LIMIT 7) SELECT ts, market, round(close, 6) AS close FROM b WHERE market IN (SELECT market FROM m)")
def first_bar_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.write_table(_bars(spark, sf_dir, "size"), files.scratch(spark, "bars"), "csv")
    return files.read_bars(spark, path, ("close",), 7).withColumn("close", F.round("close", 6))


@_registered(f"WITH {TYPE} PIVOT (SELECT ts, market, round(price, 6) AS price FROM panel) ON market IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'PROMO') USING first(price) GROUP BY ts")
def wide_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.write_table(files.to_wide(panel.build_panel(spark, sf_dir, "type").select("ts", "market", _r("price", "price")), "price", ["ECONOMY", "SMALL", "MEDIUM", "LARGE", "STANDARD", "PROMO"]), files.scratch(spark, "wide"))
    return files.read_table(spark, path)


@_registered(f"""WITH {SIZE}, {GRID}, d AS (SELECT DISTINCT ts FROM grid ORDER BY ts DESC LIMIT 300) SELECT ts, market, round(price, 6) AS price FROM grid WHERE market IN ('3', '7', '11') AND ts IN (SELECT ts FROM d)""")
def wide_cache_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide cache of all markets, of which three columns and the last 300 times are read."""
    wide = files.to_wide(panel.build_panel(spark, sf_dir, "size").select("ts", "market", _r("price", "price")), "price")
    path = files.write_table(wide, files.scratch(spark, "wide"))
    return files.from_wide(files.read_table(spark, path), "price", ["3", "7", "11"], tail=300)


@_registered("""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS ts, upper(trim(o_orderpriority)) AS market, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders)
SELECT ts, market, max(price) AS price FROM r WHERE market IN (SELECT market FROM r WHERE price IS NOT NULL) AND market IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY ts, market""")
def imported_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panel.read(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    foreign = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Day"), F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("Name"), text.alias("Price"))
    return files.import_prices(foreign, "Day", "Name", "Price", ("1-URGENT", "2-HIGH", "5-LOW"))


@_registered(f"""WITH {SIZE}, {GRID}, q AS (SELECT ts, market, round(volume / 1000, 8) AS target_weight FROM panel WHERE volume >= 60 AND ts IN (SELECT min(ts) FROM panel GROUP BY date_trunc('month', ts)))
SELECT g.ts, g.market, CASE WHEN g.ts IN (SELECT ts FROM q) THEN coalesce(q.target_weight, 0) END AS target_weight FROM grid g LEFT JOIN q ON q.ts = g.ts AND q.market = g.market""")
def expanded_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size")
    requests = weights.rebalance_rows(p, "monthly").where("volume >= 60").select("ts", "market", F.round(F.col("volume") / 1000, 8).alias("target_weight"))
    read = files.read_table(spark, files.write_table(requests, files.scratch(spark, "weights"), "csv"), "csv", "ts date, market string, target_weight double")
    assert files.weight_format(read.columns) == "sparse"
    return files.expand_sparse(read, panel.dense_grid(p.select("ts", "market", "price")))


@_registered(f"WITH {CURVES} SELECT regexp_replace(run_id, '[^A-Za-z0-9]', '_', 'g') AS run_id, ts, round(value, 6) AS value FROM cv")
def curve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "curves")
    rows = _curves(spark, sf_dir).select(F.col("ts").alias("date"), "value", F.regexp_replace("run_id", "[^A-Za-z0-9]", "_").alias("run"))
    files.write_table(rows, path, "csv", by="run")
    read = files.read_curves(spark, f"{path}/run=*")
    return read.select(F.substring("run_id", 5, 1000).alias("run_id"), "ts", _r("value", "value"))


@_registered(f"""WITH {CURVES}, a AS (SELECT run_id, count(*) AS bars, round(max(value), 6) AS top FROM cv GROUP BY 1), b AS (SELECT market AS run_id, count(*) AS bars, round(min(price), 6) AS low FROM panel GROUP BY 1)
SELECT 'a' AS origin, run_id, CAST(bars AS DOUBLE) AS bars, top, NULL AS low FROM a UNION ALL SELECT 'b', run_id, CAST(bars AS DOUBLE), NULL, low FROM b""")
def collected_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports of different columns: one vertical (a row a figure), one plain."""
    c = _curves(spark, sf_dir)
    vertical = c.groupBy("run_id").agg(F.count("*").cast("double").alias("bars"), F.round(F.max("value"), 6).alias("top")).unpivot("run_id", ["bars", "top"], "key", "figure")
    read = files.read_table(spark, files.write_table(vertical, files.scratch(spark, "report"), "csv"), "csv", "run_id string, key string, figure double")
    a = files.collect_vertical(read, "run_id", "key", "figure", ["bars", "top"]).withColumn("origin", F.lit("a"))
    b = c.groupBy("run_id").agg(F.count("*").cast("double").alias("bars"), F.round(F.min("value"), 6).alias("low")).withColumn("origin", F.lit("b"))
    return files.collect_records([a, b]).select("origin", "run_id", "bars", "top", "low")


@_registered(f"""WITH {BRAND}, {BARS} SELECT market, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(warning, ts) FILTER (warning IS NOT NULL) AS warning, count(*) AS bars, count(warning) AS warned FROM b GROUP BY market""")
def bar_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of three tables, joined again from its files."""
    paths = files.build_cache(_bars(spark, sf_dir), files.scratch(spark, "cache"), ("close", "volume"))
    read = {k: files.read_table(spark, v) for k, v in paths.items()}
    counts = read["numbers"].groupBy("market").agg(F.count("*").alias("bars")).join(read["warnings"].groupBy("market").agg(F.count("*").alias("warned")), "market", "left")
    return read["markets"].join(counts, "market").select("market", "first_ts", "last_ts", "warning", "bars", F.coalesce("warned", F.lit(0)).alias("warned"))


@_registered(f"""WITH {TYPE}, c AS (SELECT CAST(ts AS DATE) AS ts, 'SMALL' AS market, max(value) AS heat FROM events GROUP BY 1 UNION ALL SELECT max(ts), 'NONE', 0.0 FROM panel), s AS (SELECT ts, price AS small FROM panel WHERE market = 'SMALL')
SELECT p.ts, p.market, round(p.price, 6) AS price, heat, round(small, 6) AS small FROM panel p LEFT JOIN c ON c.ts = p.ts AND c.market = p.market LEFT JOIN s ON s.ts = p.ts""")
def custom_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's field and one market's price beside each row."""
    p = panel.build_panel(spark, sf_dir, "type")
    own = panel.read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("ts")).agg(F.max("value").alias("heat")).select("ts", F.lit("SMALL").alias("market"), "heat")
    end = p.agg(F.max("ts").alias("ts")).select("ts", F.lit("NONE").alias("market"), F.lit(0.0).alias("heat"))
    both = files.with_source(p, own.unionByName(end), "heat")
    return files.with_market_series(both, "SMALL", "price", "small").select("ts", "market", _r("price", "price"), "heat", _r("small", "small"))

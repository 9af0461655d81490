"""Registered queries of facts over time, table checks, events, texts. A nation stands for a company, its orders for its filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions import text
from ..operators import blends, curves, research, rolling, statements, tables
from ..sources import panel
from .queries import CURVES, SIZE, TYPE, WM, _curves, _r, _registered
from .selection import FACTOR, _factor
from .transforms import GRID

EVENTS = """o AS (SELECT c_nationkey AS code, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders JOIN customer ON o_custkey = c_custkey),
ev AS (SELECT code, CAST(date_trunc('month', day) AS DATE) + 40 AS active, year(day) * 12 + month(day) AS period, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN CAST(sum(price) AS DOUBLE) END AS amount FROM o GROUP BY code, date_trunc('month', day), year(day), month(day)),
fy AS (SELECT code, year(day) AS fiscal_year, make_date(year(day), 12, 31) AS fiscal_end, make_date(year(day) + 1, 3, 31) AS active, CAST(sum(price) AS DOUBLE) AS amount, count(*) AS n FROM o GROUP BY code, year(day))"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = panel.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"), panel.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("code"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _orders(spark, sf_dir).groupBy("code", F.trunc("day", "month").alias("m")).agg(F.when(F.count(F.when(F.col("o_orderstatus") == "F", 1)) > 0, F.sum("price").cast("double")).alias("amount"))
    return by.select("code", F.date_add("m", 40).alias("active"), (F.year("m") * 12 + F.month("m")).alias("period"), "amount")


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _orders(spark, sf_dir).groupBy("code", F.year("day").alias("fiscal_year")).agg(F.sum("price").cast("double").alias("amount"), F.count("*").alias("n"))
    return by.select("code", "fiscal_year", F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("fiscal_end"), F.make_date(F.col("fiscal_year") + 1, F.lit(3), F.lit(31)).alias("active"), "amount", "n")


@_registered(f"""WITH {EVENTS}, cal AS (SELECT code, CAST(unnest(generate_series(DATE '1995-01-31', DATE '1998-12-31', INTERVAL 1 WEEK)) AS DATE) AS ts FROM (SELECT DISTINCT code FROM o)), k AS (SELECT * FROM ev WHERE amount IS NOT NULL)
SELECT cal.code, cal.ts, round(k.amount, 2) AS standing, round(e.amount, 2) AS cleared FROM cal ASOF LEFT JOIN k ON k.code = cal.code AND cal.ts >= k.active ASOF LEFT JOIN ev e ON e.code = cal.code AND cal.ts >= e.active""")
def events_on_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _monthly(spark, sf_dir)
    days = _orders(spark, sf_dir).select("code").distinct().withColumn("ts", F.explode(F.expr("sequence(date'1995-01-31', date'1998-12-31', interval 1 week)")))
    a, b = statements.on_calendar(e, days, "amount", name="standing"), statements.on_calendar(e, days, "amount", True, "period", "cleared")
    return a.join(b, ["code", "ts"]).select("code", "ts", F.round("standing", 2).alias("standing"), F.round("cleared", 2).alias("cleared"))


@_registered(f"""WITH {TYPE}, d AS (SELECT DISTINCT ts FROM panel WHERE dayofweek(ts) NOT IN (0, 6)), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, day, d.ts AS trade_date FROM o ASOF LEFT JOIN d ON o.day >= d.ts""")
def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = panel.build_panel(spark, sf_dir, "type").select("ts").distinct().where(~F.dayofweek("ts").isin(1, 7))
    o = panel.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return statements.trading_day(o, "day", days).select("o_orderkey", "day", "trade_date")


@_registered("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS claimed FROM lineitem), f AS (SELECT p_partkey AS l_partkey, p_size AS stated FROM part), j AS (SELECT c.*, stated, sum(CASE WHEN claimed = stated THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS m FROM c LEFT JOIN f USING (l_partkey))
SELECT l_orderkey, l_linenumber, l_partkey, claimed FROM j WHERE claimed = stated AND m = 1""")
def unique_share_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = panel.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("claimed"))
    f = panel.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("stated"))
    return statements.unique_matches(c, f, ["l_partkey"], ["l_orderkey"], "claimed", "stated").select("l_orderkey", "l_linenumber", "l_partkey", "claimed")


@_registered(f"""WITH {EVENTS}, pe AS (SELECT code, fiscal_year, fiscal_end, coalesce(lag(fiscal_end) OVER (PARTITION BY code ORDER BY fiscal_end), CAST(fiscal_end - INTERVAL 12 MONTH AS DATE)) AS since FROM fy WHERE fiscal_year % 2 = 0)
SELECT o.code, o_orderkey, day, fiscal_year, fiscal_end FROM o JOIN pe ON pe.code = o.code AND day > since AND day <= fiscal_end""")
def fiscal_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = _yearly(spark, sf_dir).where("fiscal_year % 2 = 0")
    return statements.in_fiscal_period(_orders(spark, sf_dir).select("code", "o_orderkey", "day"), periods, "day").select("code", "o_orderkey", "day", "fiscal_year", "fiscal_end")


@_registered(f"""WITH {EVENTS}, p AS (SELECT o.code, year(day) AS fiscal_year, day + 30 AS paid, CAST(price AS DOUBLE) / 1000 AS per_share, CASE WHEN o_orderstatus <> 'P' THEN 2.0 END AS shares FROM o),
b AS (SELECT code, fiscal_year, sum(per_share * shares) AS s, count(*) FILTER (shares IS NULL) AS op, max(paid) AS l, count(*) AS n FROM p GROUP BY 1, 2)
SELECT fy.code, fy.fiscal_year, round(CASE WHEN coalesce(op, 0) = 0 THEN coalesce(s, 0) END, 4) AS amount, coalesce(b.n, 0) AS payments, greatest(active, l) AS active FROM fy LEFT JOIN b USING (code, fiscal_year)""")
def dividend_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    pay = o.select("code", F.year("day").alias("fiscal_year"), F.date_add("day", 30).alias("paid"), (F.col("price").cast("double") / 1000).alias("per_share"), F.when(F.col("o_orderstatus") != "P", 2.0).alias("shares"))
    return statements.dividend_years(pay, _yearly(spark, sf_dir)).withColumn("amount", F.round("amount", 4))


@_registered(f"""WITH {EVENTS}, st AS (SELECT code, fiscal_year, CASE WHEN n % 3 > 0 THEN amount END AS revenue, n AS staff FROM fy), ve AS (SELECT code, fiscal_year, code * 100000 + fiscal_year * 10 + v AS filing, v = 2 AS is_final FROM fy, (VALUES (0), (1), (2)) t(v) WHERE code % 4 > 0),
fi AS (SELECT filing, round(filing / 7.0, 6) AS revenue FROM ve WHERE filing % 3 > 0)
SELECT st.code, st.fiscal_year, ve.filing, ve.is_final, round(CASE WHEN ve.filing IS NOT NULL AND NOT ve.is_final THEN fi.revenue ELSE coalesce(st.revenue, CASE WHEN ve.is_final THEN fi.revenue END) END, 4) AS revenue, CASE WHEN NOT (ve.filing IS NOT NULL AND NOT ve.is_final) THEN staff END AS staff
FROM st LEFT JOIN ve USING (code, fiscal_year) LEFT JOIN fi ON fi.filing = ve.filing WHERE NOT (ve.filing IS NOT NULL AND NOT ve.is_final) OR fi.filing IS NOT NULL""")
def filing_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = _yearly(spark, sf_dir)
    st = y.select("code", "fiscal_year", F.when(F.col("n") % 3 > 0, F.col("amount")).alias("revenue"), F.col("n").alias("staff"))
    ve = y.where("code % 4 > 0").select("code", "fiscal_year", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("v")).select("code", "fiscal_year", (F.col("code") * 100000 + F.col("fiscal_year") * 10 + F.col("v")).alias("filing"), (F.col("v") == 2).alias("is_final"))
    fi = ve.where("filing % 3 > 0").select("filing", F.round(F.col("filing") / 7, 6).alias("revenue"))
    return statements.overlaid(st, ve, fi, ["code", "fiscal_year"], ["revenue"], ["staff"]).withColumn("revenue", F.round("revenue", 4))


@_registered(f"""WITH {EVENTS}, re AS (SELECT code, fiscal_year, active, amount FROM fy UNION ALL SELECT code, fiscal_year, active + 200, amount * 1.1 FROM fy WHERE n % 2 = 0), k AS (SELECT code, fiscal_year + 1 AS fiscal_year, active, amount FROM re)
SELECT re.code, re.fiscal_year, re.active, round(re.amount, 2) AS amount, round(k.amount, 2) AS opening FROM re ASOF LEFT JOIN k ON k.code = re.code AND k.fiscal_year = re.fiscal_year AND re.active >= k.active""")
def opening_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = _yearly(spark, sf_dir)
    again = y.where("n % 2 = 0").select("code", "fiscal_year", F.date_add("active", 200).alias("active"), (F.col("amount") * 1.1).alias("amount"))
    e = y.select("code", "fiscal_year", "active", "amount").unionByName(again)
    out = statements.year_before(e, "amount", "opening")
    return out.select("code", "fiscal_year", "active", F.round("amount", 2).alias("amount"), F.round("opening", 2).alias("opening"))


@_registered(f"""WITH {EVENTS}, s AS (SELECT code, fiscal_year, CAST(n AS DOUBLE) AS issued, CASE WHEN n % 3 > 0 THEN n // 10 END AS tr, CASE WHEN n % 2 = 0 THEN n - n // 10 WHEN n % 5 = 0 THEN n + 5 END AS st FROM fy WHERE fiscal_year <> 1997),
k AS (SELECT *, CASE WHEN issued > 0 THEN CASE WHEN (tr IS NOT NULL AND st IS NOT NULL AND tr BETWEEN 0 AND issued AND st BETWEEN 0 AND issued AND issued - tr = st) OR (tr IS NULL AND st BETWEEN 0 AND issued) THEN st WHEN st IS NULL AND tr BETWEEN 0 AND issued THEN issued - tr END END AS o FROM s),
w AS (SELECT *, lag(issued) OVER (PARTITION BY code ORDER BY fiscal_year) AS b, lag(fiscal_year) OVER (PARTITION BY code ORDER BY fiscal_year) AS y FROM k)
SELECT code, fiscal_year, CAST(o AS DOUBLE) AS outstanding, round(CASE WHEN fiscal_year = y + 1 AND issued > 0 AND b > 0 THEN issued / b - 1 END, 6) AS change FROM w""")
def share_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    tenth = F.floor(n / 10).cast("double")
    s = _yearly(spark, sf_dir).where("fiscal_year <> 1997").select("code", "fiscal_year", n.cast("double").alias("issued"), F.when(n % 3 > 0, tenth).alias("tr"), F.when(n % 2 == 0, n - tenth).when(n % 5 == 0, n + 5.0).alias("st"))
    k = s.withColumn("outstanding", statements.outstanding(F.col("issued"), F.col("tr"), F.col("st")))
    return statements.supply_change(k, "issued").select("code", "fiscal_year", "outstanding", _r("change", "change"))


@_registered("""WITH n AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderpriority END AS label FROM orders) SELECT o_custkey, arg_max(label, o_orderkey) FILTER (trim(label) <> '') AS label FROM n GROUP BY o_custkey""")
def latest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = panel.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")).alias("label"))
    return tables.latest_non_empty(n, "o_custkey", "label", "o_orderkey")


@_registered("""WITH f AS (SELECT l_partkey AS p_partkey, arg_max(l_linestatus, (l_shipdate, l_linestatus)) AS mode FROM lineitem GROUP BY 1) SELECT p_partkey, coalesce(mode, CAST(p_partkey AS VARCHAR)) AS mode FROM part LEFT JOIN f USING (p_partkey)""")
def labelled_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = panel.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linestatus").alias("mode"), "l_shipdate")
    return tables.labelled(panel.read(spark, sf_dir, "part").select("p_partkey"), f, "p_partkey", ["mode"], "l_shipdate")


@_registered("""WITH a AS (SELECT c_nationkey AS code, c_name AS name, c_acctbal AS bal, 0 AS o FROM customer UNION ALL SELECT s_nationkey, s_name, s_acctbal, 1 FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY o, name, bal) AS i FROM a WHERE bal > 0) SELECT code, name, round(bal, 2) AS bal FROM k WHERE i = 1""")
def merged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = panel.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = panel.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return tables.merged_listings(a, b, "code", F.col("bal") > 0).withColumn("bal", F.round("bal", 2))


@_registered(f"""WITH {SIZE}, p AS (SELECT ts, market, price FROM panel WHERE CAST(market AS INTEGER) % 3 > 0), v AS (SELECT ts, market, volume FROM panel WHERE CAST(market AS INTEGER) % 4 > 0 AND volume > 10), u AS (SELECT DISTINCT market FROM panel WHERE CAST(market AS INTEGER) > 5), c AS (SELECT market FROM u WHERE market IN (SELECT market FROM p) AND market IN (SELECT market FROM v))
SELECT ts, market, round(price, 6) AS price, volume, round(price * volume, 4) AS amount, coalesce(price * volume > 0, false) AS available FROM p FULL JOIN v USING (ts, market) WHERE market IN (SELECT market FROM c)""")
def assembled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = panel.build_panel(spark, sf_dir, "size"), F.col("market").cast("int")
    a = tables.assembled(p.where(m > 5), p.where(m % 3 > 0), p.where((m % 4 > 0) & (F.col("volume") > 10)))
    return a.select("ts", "market", _r("price", "price"), "volume", F.round("amount", 4).alias("amount"), "available")


@_registered(f"""WITH {TYPE}, s AS (SELECT CAST(date_trunc('month', ts) AS DATE) + 3 AS ts, 1000 + month(ts) AS value FROM panel GROUP BY 1, 2), d AS (SELECT ts, median(volume) AS volume FROM panel GROUP BY ts), f AS (SELECT d.ts, d.volume, s.value FROM d ASOF LEFT JOIN s ON d.ts >= s.ts), g AS (SELECT * FROM f WHERE value IS NOT NULL)
SELECT ts, market, round(price, 6) AS price, volume FROM panel UNION ALL SELECT ts, 'FX', round(value / first_value(value) OVER (ORDER BY ts) * 100, 6), volume FROM g""")
def synthetic_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "type").select("ts", "market", "price", "volume")
    s = p.select(F.date_add(F.trunc("ts", "month"), 3).alias("ts"), (1000.0 + F.month("ts")).alias("value")).distinct()
    return tables.with_series_as_market(p, s, "FX", 100.0).select("ts", "market", _r("price", "price"), "volume")


@_registered(f"""WITH {SIZE}, i AS (SELECT market AS name, ts, CASE WHEN volume < 3 THEN -1 ELSE price END AS value FROM panel WHERE CAST(market AS INTEGER) <= 5 UNION ALL SELECT market, ts, price FROM panel WHERE CAST(market AS INTEGER) <= 5 AND volume > 45), d AS (SELECT DISTINCT ts FROM panel), f AS (SELECT name, min(ts) AS a, count(*) - count(DISTINCT ts) AS dup, count(*) FILTER (value <= 0) AS np FROM i GROUP BY 1)
SELECT name, dup AS duplicates, np AS not_positive, (SELECT count(*) FROM d WHERE d.ts > f.a AND d.ts NOT IN (SELECT ts FROM i WHERE i.name = f.name)) AS missing FROM f""")
def index_series_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size")
    few = p.where(F.col("market").cast("int") <= 5)
    i = few.select(F.col("market").alias("name"), "ts", F.when(F.col("volume") < 3, -1.0).otherwise(F.col("price")).alias("value")).unionByName(few.where("volume > 45").select(F.col("market").alias("name"), "ts", F.col("price").alias("value")))
    return tables.index_columns(p, i)[1]


@_registered("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS ts, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT *, lag(n) OVER (ORDER BY ts) AS before FROM d) SELECT ts, n, before, coalesce(n < before * 0.5, false) AS fell FROM k""")
def daily_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.daily_counts(panel.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("ts")), 0.5)


@_registered("""WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS common, count(*) FILTER (b.k IS NULL) AS only_first, count(*) FILTER (a.k IS NULL) AS only_second, count(*) FILTER (abs(CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE)) > 0.1 * abs(CAST(b.v AS DOUBLE))) AS apart FROM a FULL JOIN b ON a.k = b.k""")
def cross_source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = panel.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v"))
    b = panel.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("v"))
    return tables.cross_checked(a, b, ["k"], "v", 0.1)


@_registered(f"""WITH {TYPE}, x AS (SELECT market AS code, ts, round(price, 4) AS close, row_number() OVER ({WM}) AS i, round(lag(price) OVER ({WM}), 4) AS prv FROM panel), b AS (SELECT code, ts, close, CASE WHEN i % 50 = 0 THEN close - prv * 0.5 WHEN i % 70 = 0 THEN close + 1 ELSE close - prv END AS change, CASE WHEN i % 90 = 89 THEN 0 ELSE 10 END AS volume, CASE WHEN (i // 90) % 2 = 0 THEN 200.0 ELSE 100.0 END AS shares FROM x),
l AS (SELECT *, close - change AS base, lag(close) OVER w AS prev, lag(shares) OVER w / shares AS ratio, lag(volume) OVER w = 0 AS halted FROM b WINDOW w AS (PARTITION BY code ORDER BY ts)), f AS (SELECT *, CASE WHEN prev > 0 AND base > 0 THEN base / prev ELSE 1.0 END AS f0 FROM l),
g AS (SELECT *, coalesce(prev > 0 AND abs(f0 - 1) <= 1e-9 AND halted AND ratio >= 1.5 AND abs(close / prev - 1) > 0.0001, false) AS ov, coalesce(prev > 0 AND NOT base > 0, false) AS bad FROM f), h AS (SELECT *, CASE WHEN ov THEN ratio ELSE f0 END AS factor FROM g)
SELECT code, ts, round(factor, 6) AS factor, CASE WHEN bad THEN 'invalid_base' WHEN ov THEN 'share_ratio_override' WHEN abs(factor - 1) > 1e-9 THEN 'adjustment' END AS kind, round(ln(close) + coalesce(sum(ln(factor)) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 5) AS log_adjusted FROM h""")
def adjusted_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = rolling.by_time()
    x = panel.build_panel(spark, sf_dir, "type").withColumn("i", F.row_number().over(w)).withColumn("prv", F.round(F.lag("price").over(w), 4)).withColumn("close", F.round("price", 4))
    i = F.col("i")
    change = F.when(i % 50 == 0, F.col("close") - F.col("prv") * 0.5).when(i % 70 == 0, F.col("close") + 1).otherwise(F.col("close") - F.col("prv"))
    b = x.select(F.col("market").alias("code"), "ts", "close", change.alias("change"), F.when(i % 90 == 89, 0).otherwise(10).alias("volume"), F.when(F.floor(i / 90) % 2 == 0, 200.0).otherwise(100.0).alias("shares"))
    a = tables.adjusted_prices(b, 1.5, 0.0001)
    return a.select("code", "ts", _r("factor", "factor"), "kind", F.round(F.log("adjusted"), 5).alias("log_adjusted"))


@_registered(f"""WITH {TYPE}, s AS (SELECT ts, avg(price) AS value FROM panel GROUP BY ts), k AS (SELECT *, lag(value) OVER (ORDER BY ts) AS b FROM s) SELECT ts, round(value, 6) AS value, value < 1000 OR value > 1700 AS outside, coalesce(abs(value / b - 1) > 0.15, false) AS jumped FROM k WHERE value < 1000 OR value > 1700 OR coalesce(abs(value / b - 1) > 0.15, false)""")
def rate_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = panel.build_panel(spark, sf_dir, "type").groupBy("ts").agg(F.avg("price").alias("value"))
    return tables.rate_checks(s, 1000, 1700, 0.15).withColumn("value", F.round("value", 6))


@_registered(f"""WITH {SIZE}, a AS (SELECT DISTINCT ts FROM panel WHERE market = '10'), b AS (SELECT DISTINCT ts FROM panel WHERE market = '20') SELECT ts FROM a EXCEPT SELECT ts FROM b""")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size")
    return tables.missing_keys(p.where("market = '10'"), p.where("market = '20'"), ["ts"])


@_registered(f"""WITH {SIZE}, {FACTOR}, b AS (SELECT * FROM f WHERE factor IS NOT NULL AND label IS NOT NULL), c AS (SELECT ts, corr(factor, label) AS ic FROM b GROUP BY ts HAVING count(*) >= 4 AND stddev_pop(factor) > 0 AND stddev_pop(label) > 0)
SELECT year(ts) AS yr, count(ic) AS n, round(avg(ic), 5) AS mean, round(stddev_samp(ic), 5) AS std, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 5) AS positive, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 4) AS t_value FROM c GROUP BY 1
UNION ALL SELECT NULL, count(ic), round(avg(ic), 5), round(stddev_samp(ic), 5), round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 5), round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 4) FROM c""")
def ic_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    ics = research.row_ic(_factor(spark, sf_dir), "factor", "label", 4).where("ic is not null")
    s = research.ic_summary(ics)
    return s.select("yr", "n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "positive")], F.round("t_value", 4).alias("t_value"))


@_registered(f"""WITH {SIZE}, {FACTOR}, k AS (SELECT *, 1 + floor((row_number() OVER (PARTITION BY ts ORDER BY factor, market) - 1) * 2 / count(*) OVER (PARTITION BY ts)) AS b FROM f WHERE factor IS NOT NULL AND label IS NOT NULL)
SELECT ts, count(*) AS n, round(avg(label) FILTER (b = 2) - avg(label) FILTER (b = 1), 6) AS spread FROM k GROUP BY ts HAVING count(*) >= 2""")
def bucket_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.bucket_spread(_factor(spark, sf_dir), "factor", "label", 2, 2).withColumn("spread", F.round("spread", 6))


@_registered(f"""WITH {SIZE}, {FACTOR}, k AS (SELECT year(ts) AS yr, factor, CASE WHEN label > 0 THEN 1 ELSE 0 END AS y FROM f WHERE factor IS NOT NULL AND label IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY yr ORDER BY factor) + (count(*) OVER (PARTITION BY yr, factor) - 1) / 2.0 AS r FROM k)
SELECT yr, count(*) AS n, CAST(sum(y) AS BIGINT) AS ones, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM r GROUP BY yr""")
def regime_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _factor(spark, sf_dir).where("label is not null").select(F.year("ts").alias("yr"), "factor", (F.col("label") > 0).cast("int").alias("y"))
    return research.auc(f, "factor", "y", ["yr"]).withColumn("auc", F.round("auc", 6))


@_registered(f"""WITH {SIZE}, {FACTOR}, b AS (SELECT CAST(factor >= -0.2 AS INTEGER) + CAST(factor >= 0 AS INTEGER) + CAST(factor >= 0.2 AS INTEGER) AS x_band, CAST(volume >= 20 AS INTEGER) + CAST(volume >= 40 AS INTEGER) AS y_band, label FROM f WHERE factor IS NOT NULL AND label IS NOT NULL) SELECT x_band, y_band, count(*) AS n, round(avg(label), 6) AS mean_label FROM b GROUP BY 1, 2""")
def regime_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _factor(spark, sf_dir).where("label is not null")
    return research.crosstab(f, research.band(F.col("factor"), (-0.2, 0.0, 0.2)), research.band(F.col("volume"), (20, 40)), "label").withColumn("mean_label", F.round("mean_label", 6))


@_registered(f"""WITH {SIZE}, {FACTOR} SELECT 'factor' AS feature, round(avg(CASE WHEN factor IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM f UNION ALL SELECT 'volume', round(avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM f UNION ALL SELECT 'label', round(avg(CASE WHEN label IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM f""")
def missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.missing_summary(_factor(spark, sf_dir), ["factor", "volume", "label"]).withColumn("missing", F.round("missing", 6))


@_registered(f"""WITH {SIZE}, p AS (SELECT *, row_number() OVER ({WM}) AS i FROM panel), e AS (SELECT market, i AS e, market || ':' || i AS event_id FROM p WHERE volume > 49), r AS (SELECT event_id, CAST(i - e AS INTEGER) AS "offset", price, volume FROM e JOIN p USING (market) WHERE i BETWEEN e - 5 AND e), u AS (SELECT event_id, "offset", 'price' AS feature, price AS value FROM r UNION ALL SELECT event_id, "offset", 'volume', volume FROM r)
SELECT "offset", feature, count(*) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.25), 5) AS q25, round(median(value), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q75 FROM u GROUP BY 1, 2""")
def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "size")
    i = F.row_number().over(rolling.by_time())
    e = p.withColumn("event_id", F.concat_ws(":", "market", i.cast("string"))).where("volume > 49").select("event_id", "market", "ts")
    out = research.event_profile(research.around_events(p, e, ["price", "volume"], 5))
    return out.select("offset", "feature", "n", *[F.round(c, 5).alias(c) for c in ("mean", "q25", "median", "q75")])


@_registered(f"""WITH {CURVES}, k AS (SELECT *, sum(CASE WHEN drawdown >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM r), d AS (SELECT run_id, run_id || ':' || p AS event_id, min(ts) AS s, max(ts) AS e FROM k WHERE drawdown < 0 GROUP BY run_id, p),
a AS (SELECT * FROM d WHERE run_id <> 'SMALL'), m AS (SELECT * FROM d WHERE run_id = 'SMALL'), j AS (SELECT a.event_id AS own_id, m.event_id AS market_id, a.s >= m.s AND a.s <= m.e AS inside, datediff('day', a.s, m.s) AS days, m.s AS ms FROM a, m), n AS (SELECT *, row_number() OVER (PARTITION BY own_id ORDER BY inside DESC, CASE WHEN inside THEN ms END, abs(days), ms, market_id) AS i FROM j)
SELECT own_id, market_id, inside, CAST(days AS INTEGER) AS days FROM n WHERE i = 1""")
def drawdown_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = curves.drawdown_episodes(_curves(spark, sf_dir)).select("run_id", F.concat_ws(":", "run_id", F.col("peak_no").cast("string")).alias("event_id"), F.col("onset").alias("start"), F.col("last_ts").alias("end"))
    return research.overlapping_events(e.where("run_id <> 'SMALL'").drop("run_id"), e.where("run_id = 'SMALL'").drop("run_id"))


@_registered(f"""WITH {SIZE}, s AS (SELECT market AS run_id, round(avg(price), 6) AS gain, round(-stddev_samp(price), 6) AS calm FROM panel GROUP BY 1 HAVING count(*) >= 3), b AS (SELECT arg_min(gain, run_id) AS b FROM s WHERE run_id LIKE '1%'), n AS (SELECT *, (rank() OVER (ORDER BY gain) + (count(*) OVER (PARTITION BY gain) - 1) / 2.0) / count(*) OVER () AS gp, (rank() OVER (ORDER BY calm) + (count(*) OVER (PARTITION BY calm) - 1) / 2.0) / count(*) OVER () AS cp FROM s),
z AS (SELECT avg(gp) FILTER (gain > 1400) - avg(gp) FILTER (gain <= 1400) AS g, avg(cp) FILTER (gain > 1400) - avg(cp) FILTER (gain <= 1400) AS c FROM n), v AS (SELECT coalesce(greatest(g, 0) / nullif(greatest(g, 0) + greatest(c, 0), 0), 0.5) AS wg, coalesce(greatest(c, 0) / nullif(greatest(g, 0) + greatest(c, 0), 0), 0.5) AS wc FROM z)
SELECT run_id, round(gain / b, 6) AS relative, round(gp * 0.7 + cp * 0.3, 6) AS score, round(wg, 6) AS gain_weight, round(wc, 6) AS calm_weight FROM n, b, v""")
def preference_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = panel.build_panel(spark, sf_dir, "size").groupBy(F.col("market").alias("run_id")).agg(_r(F.avg("price"), "gain"), F.round(-F.stddev_samp("price"), 6).alias("calm"), F.count("*").alias("n")).where("n >= 3").drop("n")
    scored = tables.preference_scores(s, {"gain": 0.7, "calm": 0.3})
    rel = tables.relative_to_baseline(s, "gain", F.col("run_id").like("1%")).select("run_id", "relative")
    learned = tables.learned_weights(scored.select((F.col("gain") > 1400).cast("int").alias("liked"), F.col("gain_pct").alias("gain"), F.col("calm_pct").alias("calm")), ["gain", "calm"])
    w = learned.agg(F.max(F.when(F.col("metric") == "gain", F.col("weight"))).alias("gain_weight"), F.max(F.when(F.col("metric") == "calm", F.col("weight"))).alias("calm_weight"))
    return scored.join(rel, "run_id").crossJoin(w).select("run_id", _r("relative", "relative"), _r("score", "score"), _r("gain_weight", "gain_weight"), _r("calm_weight", "calm_weight"))  # one row beside





@_registered(r"""WITH t AS (SELECT p_partkey, p_name, p_type, CASE p_partkey % 3 WHEN 0 THEN '(' || format('{:,}', p_partkey) || ')' WHEN 1 THEN format('{:,}', p_partkey) ELSE '-' END AS money, 'KR7' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '00' || (p_partkey % 10) AS isin, '1995.' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey % 30 + 1 AS VARCHAR), 2, '0') AS day FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN -p_partkey WHEN 1 THEN p_partkey END::DOUBLE AS money, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS isin_code, TRY_CAST(replace(day, '.', '-') AS DATE) AS day, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '_pct' AS snake, array_to_string(list_filter([CASE WHEN regexp_matches(lower(p_type), 'small|promo') THEN 'cheap' END, CASE WHEN regexp_matches(lower(p_type), 'economy|promo') THEN 'plain' END], lambda v: v IS NOT NULL), '|') AS reasons,
 CASE WHEN lower(p_type) = 'large' THEN 'big' WHEN lower(p_type) IN ('small', 'medium') THEN 'little' ELSE 'other' END AS family, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 END AS category, p_type IN ('SMALL', 'PROMO') AS member FROM t""")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = panel.read(spark, sf_dir, "part"), F.col("p_partkey")
    commas = F.format_number(k, 0)
    money = F.when(k % 3 == 0, F.concat(F.lit("("), commas, F.lit(")"))).when(k % 3 == 1, commas).otherwise("-")
    isin = F.concat(F.lit("KR7"), F.lpad(k.cast("string"), 6, "0"), F.lit("00"), (k % 10).cast("string"))
    day = F.concat(F.lit("1995."), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((k % 30 + 1).cast("string"), 2, "0"))
    return p.select(
        "p_partkey", text.number(money).alias("money"), text.isin_code(isin).alias("isin_code"), text.digits_date(day).alias("day"), text.snake(F.concat("p_name", F.lit(" [%]"))).alias("snake"),
        text.reasons(F.col("p_type"), {"cheap": "small|promo", "plain": "economy|promo"}).alias("reasons"), text.family(F.col("p_type"), {"big": ("large",), "little": ("small", "medium")}).alias("family"),
        text.category(F.col("p_type"), {"SMALL": 1, "LARGE": 2}).alias("category"), F.col("p_type").isin("SMALL", "PROMO").alias("member"),
    )


@_registered(r"""WITH t AS (SELECT unnest(string_split(array_to_string(list_filter([CASE WHEN regexp_matches(lower(p_type), 'small|promo') THEN 'cheap' END, CASE WHEN regexp_matches(lower(p_type), 'economy|promo') THEN 'plain' END], lambda v: v IS NOT NULL), '|'), '|')) AS reason FROM part) SELECT reason, count(*) AS n FROM t WHERE reason <> '' GROUP BY reason""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.read(spark, sf_dir, "part").select(text.reasons(F.col("p_type"), {"cheap": "small|promo", "plain": "economy|promo"}).alias("reasons"))
    return text.reason_counts(p, "reasons")


@_registered("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS shown, CAST(isoyear(ts) AS VARCHAR) || '-' || CAST(week(ts) AS VARCHAR) AS iso_week FROM events""")
def display_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return panel.read(spark, sf_dir, "events").select("event_id", F.date_format(text.display_time(ts), "yyyy-MM-dd HH:mm:ss").alias("shown"), text.iso_week(ts).alias("iso_week"))


@_registered("""WITH n AS (SELECT o_orderstatus, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS counts FROM n GROUP BY 1""")
def winner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.counts_json(panel.read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@_registered(f"""WITH {TYPE}, {GRID}, r AS (SELECT ts, market, price, volume, round(1 / (1 + volume), 8) AS ratio FROM grid) SELECT ts, market, round(CASE WHEN price > 0 THEN volume * 100 / price END, 6) AS shares, round(volume * 100 * ratio, 6) AS outstanding_cap, price > 0 AND volume IS NOT NULL AS available FROM r WHERE price IS NOT NULL""")
def share_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.build_panel(spark, sf_dir, "type").withColumn("cap", F.col("volume") * 100).withColumn("ratio", F.round(1 / (1 + F.col("volume")), 8))
    return statements.share_frames(p, "price", "cap", "ratio").select("ts", "market", _r("shares", "shares"), _r("outstanding_cap", "outstanding_cap"), "available")


@_registered("""WITH l AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l.l_partkey, l.l_suppkey, n, returned FROM l LEFT JOIN r ON l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey""")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By two keys; a key with two right rows would raise."""
    lines = panel.read(spark, sf_dir, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    left = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    right = lines.where("l_returnflag = 'R'").groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("returned"))
    return statements.one_to_one(left, right, keys).select(*keys, "n", "returned")


@_registered(f"""WITH {CURVES}, e AS (SELECT run_id, min(ts) AS "start", max(ts) AS "end", count(*) AS observations, arg_max(value, ts) / arg_min(value, ts) AS g, stddev_pop(ret) * sqrt(252) AS vol, min(drawdown) AS mdd, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe,
  avg(ret) / sqrt(avg(least(ret, 0) * least(ret, 0))) * sqrt(252) AS sortino, sqrt(avg(drawdown * drawdown)) * 100 AS ulcer, avg(CASE WHEN drawdown < 0 THEN 1.0 ELSE 0.0 END) * 100 AS under, arg_max(drawdown, ts) * 100 AS now FROM r GROUP BY run_id)
SELECT run_id, 'held' AS mode, "start", "end", observations, round((g - 1) * 100, 5) AS total_return_pct, round((pow(g, 365.25 / datediff('day', "start", "end")) - 1) * 100, 5) AS cagr_pct, round(vol * 100, 5) AS volatility_pct, round(mdd * 100, 5) AS max_drawdown_pct, round(sharpe, 5) AS sharpe, round(sortino, 5) AS sortino,
  round(CASE WHEN mdd < 0 THEN (pow(g, 365.25 / datediff('day', "start", "end")) - 1) / abs(mdd) END, 5) AS calmar, round(ulcer, 5) AS ulcer_pct, round(now, 5) AS current_drawdown_pct, round(under, 5) AS under_water_pct, 0.0 AS turnover, run_id AS weights FROM e""")
def blend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each curve as a blend of itself alone; the recovery columns are those of drawdown_recovery."""
    c = _curves(spark, sf_dir)
    settings = c.select("run_id").distinct().select("run_id", F.lit("held").alias("mode"), F.col("run_id").alias("weights"), F.lit(0.0).alias("turnover"))
    s = blends.summary(c, settings, 252)
    return s.select("run_id", "mode", "start", "end", "observations", "turnover", "weights", *[F.round(c, 5).alias(c) for c in ("total_return_pct", "cagr_pct", "volatility_pct", "max_drawdown_pct", "sharpe", "sortino", "calmar", "ulcer_pct", "current_drawdown_pct", "under_water_pct")])

"""Statistics of equity curves: rows (run_id, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def run() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("ts")


def with_returns(curves: DataFrame) -> DataFrame:
    """ret (0 at the first row) and drawdown from the running high."""
    high = F.max("value").over(run().rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("value").over(run())
    return curves.withColumn("ret", F.coalesce(F.try_divide("value", before) - 1, F.lit(0.0))).withColumn("drawdown", F.try_divide("value", high) - 1)


def performance(curves: DataFrame, per_year: int, risk_free: DataFrame | None = None) -> DataFrame:
    """One row a run: return, volatility and drawdown measures; those over a 0 (a flat or one-row curve) are null. risk_free: ts and
    rate, by row, taken off the returns for the Sharpe ratios and Sortino's; none at a time: 0."""
    r = with_returns(curves)
    r = r.withColumn("over", F.col("ret")) if risk_free is None else r.join(risk_free, "ts", "left").withColumn("over", F.col("ret") - F.coalesce("rate", F.lit(0.0))).drop("rate")
    cut = r.groupBy("run_id").agg(F.percentile("ret", 0.05).alias("q05"))
    worst = Window.partitionBy("run_id").orderBy("drawdown", "ts")
    n = F.count("*").over(Window.partitionBy("run_id"))
    r = r.join(cut, "run_id").withColumn("deep", F.row_number().over(worst) <= F.ceil(n * F.lit(0.05)))
    year = per_year**0.5
    below = F.least("over", F.lit(0.0))
    moments = r.groupBy("run_id").agg(
        F.count("*").alias("n"), F.try_divide(F.max_by("value", "ts"), F.min_by("value", "ts")).alias("growth"), F.min("drawdown").alias("max_drawdown"), F.avg("ret").alias("mean"), F.avg("over").alias("over"),
        F.stddev_pop("ret").alias("std"), F.stddev_pop("over").alias("over_std"), F.sqrt(F.avg(below * below)).alias("down"), F.abs(F.avg(F.when(F.col("ret") <= F.col("q05"), F.col("ret")))).alias("tail"),
        (F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))) * 100).alias("ulcer"), (-F.avg(F.when(F.col("deep"), F.col("drawdown"))) * 100).alias("cdar"),
    )
    cagr = F.when((F.col("n") > 1) & (F.col("growth") > 0), F.pow("growth", F.try_divide(F.lit(float(per_year)), F.col("n") - 1)) - 1)
    sharpe, sigma = F.try_divide("over", "over_std") * year, F.col("over_std") * year
    modified = F.when(sigma > 0, F.when(F.col("over") >= 0, sharpe).otherwise(F.col("over") * per_year * sigma))
    return moments.select(
        "run_id", "n", cagr.alias("cagr"), "max_drawdown", sharpe.alias("sharpe"), (F.try_divide("over", "down") * year).alias("sortino"), modified.alias("modified_sharpe"), (F.col("std") * year).alias("vol"),
        (F.try_divide("mean", "tail") * year).alias("cvar_sharpe"), "ulcer", "cdar", F.try_divide(cagr, F.abs("max_drawdown")).alias("calmar"), F.try_divide(cagr, F.col("ulcer") / 100).alias("martin"),
    )


def anchored(curves: DataFrame, cash: float) -> DataFrame:
    """With each run's starting balance one row before its first, as far as the second is after it (a one-row run: a day)."""
    first, second = F.min("ts").over(Window.partitionBy("run_id")), F.lead("ts").over(run())
    gap = F.coalesce(F.datediff(second, "ts"), F.lit(1))
    starts = curves.withColumn("__f", first).withColumn("__gap", gap).where("ts = __f").select("run_id", F.date_sub("ts", F.col("__gap")).alias("ts"), F.lit(cash).alias("value"))
    return curves.select("run_id", "ts", "value").unionByName(starts)


def episode_table(curves: DataFrame, least: float = 0.0) -> DataFrame:
    """One row for each stretch below a high that is at least so deep: peak, onset, qualifying (first row so deep), trough and recovery
    (the next high; null while open), depth and rows."""
    r = with_returns(curves)
    so_far, backwards = run().rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("run_id").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    high = F.when(F.col("drawdown") >= 0, F.col("ts"))
    rows = r.withColumn("peak", F.last(high, ignorenulls=True).over(so_far)).withColumn("recovery", F.last(high, ignorenulls=True).over(backwards)).where("drawdown < 0")
    by = rows.groupBy("run_id", "peak").agg(
        F.min("ts").alias("onset"), F.min(F.when(F.col("drawdown") <= -least, F.col("ts"))).alias("qualifying"), F.min_by("ts", F.struct("drawdown", "ts")).alias("trough"), F.first("recovery").alias("recovery"),
        F.min("drawdown").alias("depth"), F.count("*").alias("bars"),
    )
    return by.where(F.col("depth") <= -least)


def drawdown_episodes(curves: DataFrame) -> DataFrame:
    """One row for each stretch below a high: peak, depth and length in rows."""
    r = with_returns(curves)
    peaks = F.sum((F.col("drawdown") >= 0).cast("int")).over(run().rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("peak_no", peaks).where("drawdown < 0").groupBy("run_id", "peak_no").agg(F.min("ts").alias("onset"), F.max("ts").alias("last_ts"), F.count("*").alias("bars"), F.min("drawdown").alias("depth"))


def against_benchmark(curves: DataFrame, benchmark: DataFrame, per_year: int) -> DataFrame:
    """Information ratio, tracking error, beta, alpha and R2 of each run against one run (benchmark: run_id, one row) on common
    times; those over a deviation of 0 are null."""
    r = with_returns(curves)
    is_bench = r.join(F.broadcast(benchmark.select(F.col("run_id").alias("__b")).limit(1)), F.col("run_id") == F.col("__b"), "left")  # one row
    b = is_bench.where("__b is not null").select("ts", F.col("ret").alias("bench"))
    both = is_bench.where("__b is null").drop("__b").join(b, "ts").withColumn("excess", F.col("ret") - F.col("bench"))
    beta, error = F.try_divide(F.covar_pop("ret", "bench"), F.var_pop("bench")), F.stddev_pop("excess")
    r2 = F.pow(F.try_divide(F.covar_pop("ret", "bench"), F.stddev_pop("ret") * F.stddev_pop("bench")), 2)
    return both.groupBy("run_id").agg(
        F.count("*").alias("n"), (F.try_divide(F.avg("excess"), error) * per_year**0.5).alias("information_ratio"), (error * per_year**0.5).alias("tracking_error"), beta.alias("beta"),
        ((F.avg("ret") - beta * F.avg("bench")) * per_year).alias("alpha"), (F.avg("excess") * per_year).alias("annual_excess"), r2.alias("r2"),
    )


def annual_returns(curves: DataFrame) -> DataFrame:
    """By run and calendar year: the last value over the last one of the year before; the first year starts at its first value."""
    y = curves.groupBy("run_id", F.year("ts").alias("yr")).agg(F.max_by("value", "ts").alias("last_value"), F.min_by("value", "ts").alias("first_value"))
    before = F.lag("last_value").over(Window.partitionBy("run_id").orderBy("yr"))
    return y.withColumn("year_ret", F.try_divide("last_value", F.coalesce(before, "first_value")) - 1)


def excess(returns: DataFrame) -> DataFrame:
    """excess: ret less the mean of all runs at that time; relative: the product of 1 + excess so far. Rows at -1 or below are left out."""
    mean = returns.groupBy("ts").agg(F.avg("ret").alias("bench"))
    out = returns.join(mean, "ts").withColumn("excess", F.col("ret") - F.col("bench")).where("excess > -1")
    return out.withColumn("relative", F.exp(F.sum(F.log1p("excess")).over(run().rowsBetween(Window.unboundedPreceding, 0))))


def rolling_information_ratio(excess_returns: DataFrame, n: int, per_year: int) -> DataFrame:
    """information_ratio over the last n rows of excess."""
    w = run().rowsBetween(-(n - 1), 0)
    std = F.stddev_pop("excess").over(w)
    ratio = F.when((F.count("excess").over(w) == n) & (std > 1e-12), F.avg("excess").over(w) / F.nullif(std, F.lit(0.0)) * per_year**0.5)
    return excess_returns.withColumn("information_ratio", ratio)


def summarize(df: DataFrame, x: str) -> DataFrame:
    """By run: mean, deviation, quartiles, share above zero and extremes of x."""
    return df.where(F.col(x).isNotNull()).groupBy("run_id").agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.percentile(x, 0.25).alias("q25"), F.percentile(x, 0.5).alias("median"),
        F.percentile(x, 0.75).alias("q75"), F.avg((F.col(x) > 0).cast("double")).alias("positive"), F.min(x).alias("least"), F.max(x).alias("most"),
    )


def window_returns(curves: DataFrame, start: str, end: str) -> DataFrame:
    """Last over first value inside the dates, both included, in percent."""
    inside = curves.where(F.col("ts").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return inside.groupBy("run_id").agg(F.count("*").alias("n"), ((F.try_divide(F.max_by("value", "ts"), F.min_by("value", "ts")) - 1) * 100).alias("return_pct"))


def recovery(curves: DataFrame) -> DataFrame:
    """By run, in rows between one high and the next (an equal high is a high): the longest and second longest completed ones, and
    with the one still open (current_bars) the longest, 90th percentile and mean of the five longest; the drawdown now; and the
    percentage of rows under water."""
    r = with_returns(curves).withColumn("__i", F.row_number().over(run())).withColumn("__n", F.count("*").over(Window.partitionBy("run_id")))
    highs = r.where("drawdown >= 0").withColumn("__next", F.lead("__i").over(run()))
    gap = F.coalesce(F.col("__next"), F.col("__n")) - F.col("__i")
    spans = highs.select("run_id", gap.alias("bars"), F.col("__next").isNotNull().alias("done")).where((F.col("done") & (F.col("bars") > 1)) | (~F.col("done") & (F.col("bars") > 0)))
    longest = Window.partitionBy("run_id").orderBy(F.desc("bars"))
    done = F.when(F.col("done"), F.col("bars"))
    ranked = spans.withColumn("__k", F.row_number().over(longest)).withColumn("__d", F.row_number().over(Window.partitionBy("run_id", "done").orderBy(F.desc("bars"))))
    lengths = ranked.groupBy("run_id").agg(
        F.max(done).alias("longest_completed"), F.max(F.when(F.col("__d") == 2, done)).alias("second_completed"), F.max("bars").alias("longest"), F.percentile("bars", 0.9).alias("p90"),
        F.avg(F.when(F.col("__k") <= 5, F.col("bars"))).alias("mean_top5"), F.max(F.when(~F.col("done"), F.col("bars"))).alias("__open"),
    )
    now = r.groupBy("run_id").agg((F.max_by("drawdown", "ts") * 100).alias("current_pct"), (F.avg((F.col("drawdown") < 0).cast("double")) * 100).alias("under_water_pct"))
    return now.join(lengths, "run_id", "left").select("run_id", "longest_completed", "second_completed", "longest", "p90", "mean_top5", "current_pct", F.coalesce("__open", F.lit(0)).alias("current_bars"), "under_water_pct")


def group_benchmark(prices: DataFrame) -> DataFrame:
    """Equal cash in every market, held; cash until a market's first price, its last price where it has none. Rows: a dense grid."""
    w = Window.partitionBy("market").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.try_divide(F.last("price", ignorenulls=True).over(w), F.first("price", ignorenulls=True).over(w))
    return prices.withColumn("__g", F.coalesce(grown, F.lit(1.0))).groupBy("ts").agg(F.avg("__g").alias("value"))


def market_benchmark(prices: DataFrame, market: str, cash: float) -> DataFrame:
    """ts, value: the cash grown as one market's price since its first known one; a missing price keeps the last. A dense grid."""
    own = prices.where(F.col("market") == market).select("ts", "price")
    so_far = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # one market
    held = own.withColumn("__p", F.last("price", ignorenulls=True).over(so_far)).withColumn("__f", F.first("price", ignorenulls=True).over(so_far))
    return held.where("__p is not null").select("ts", (F.try_divide("__p", "__f") * cash).alias("value"))

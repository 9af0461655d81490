"""Transforms across the markets of one time, whole or by group. Ties go by market, ascending, in both directions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import products

def at() -> WindowSpec:
    return Window.partitionBy("ts")


def exact_sum(x: Column) -> Column:
    """A sum that is the same in any order: of decimals with twelve places."""
    return F.sum(x.cast("decimal(28,12)"))


def rank(x: Column, by: tuple[str, ...] = ("ts",), descending: bool = False) -> Column:
    known = x.isNotNull()
    order = Window.partitionBy(*by, known).orderBy(x.desc() if descending else x.asc(), F.col("market").asc())
    return F.when(known, F.row_number().over(order))


def size(x: Column, by: tuple[str, ...] = ("ts",)) -> Column:
    return F.count(x).over(Window.partitionBy(*by))


def percentile(x: Column, by: tuple[str, ...] = ("ts",), descending: bool = False) -> Column:
    n = size(x, by)
    return F.when(n == 1, F.when(x.isNotNull(), F.lit(1.0))).otherwise((rank(x, by, descending) - 1) / (n - 1))


def quantile_bucket(x: Column, q: int, by: tuple[str, ...] = ("ts",)) -> Column:
    return (1 + F.floor((rank(x, by) - 1) * q / size(x, by))).cast("int")


def average_percent_rank(x: Column) -> Column:
    known = x.isNotNull()
    least = F.rank().over(Window.partitionBy("ts", known).orderBy(x))
    ties = F.count(x).over(Window.partitionBy("ts", x))
    return F.when(known, (least + (ties - 1) / 2) / size(x))


def group_demean(x: Column, group: str, min_size: int) -> Column:
    w = Window.partitionBy("ts", group)
    return F.when(F.count(x).over(w) >= min_size, x - F.avg(x).over(w))


def dispersion(df: DataFrame, x: str, min_count: int) -> DataFrame:
    """By time: median, standard deviation and share above zero of x across markets."""
    c = F.col(x)
    out = df.groupBy("ts").agg(F.count(c).alias("n"), F.percentile(c, 0.5).alias("med"), F.stddev_samp(c).alias("sd"), F.avg(F.when(c.isNotNull(), (c > 0).cast("double"))).alias("pos"))
    return out.where(F.col("n") >= min_count)


def percentile_bucket(pct: Column, n: int) -> Column:
    return F.greatest(F.least(F.ceil(pct * n), F.lit(n)), F.lit(1)).cast("int")


def breadth(driver: Column, signal: Column, n: int | None = None, quantiles: int = 0, buckets: tuple[int, ...] = (), descending: bool = True) -> Column:
    """Share with a signal other than 0 among the n best by the driver, or among those in the given quantile buckets; the
    same for every market of that time. None selected: 0; no market with both known: null."""
    both = F.when(signal.isNotNull(), driver)
    place, known = rank(both, descending=descending), size(both)
    chosen = place <= n if n else (1 + F.floor((place - 1) * quantiles / known)).isin(*buckets)
    share = F.avg(F.when(chosen, (signal != 0).cast("double"))).over(at())
    return F.when(known > 0, F.coalesce(share, F.lit(0.0)))


def in_group(value: Column, x: Column, by: tuple[str, ...], min_size: int) -> Column:
    """A value of x's group, null where the group has fewer than min_size known x."""
    return F.when(size(x, by) >= min_size, value)


def average_correlation(df: DataFrame, x: str, n: int, least: int) -> DataFrame:
    """ts, correlation: mean correlation of x over all pairs of markets that are complete in the last n times (a dense grid),
    where they are at least so many. From one identity: the standardised values' sum over markets has as variance the sum of
    all correlations, so no pairs are made."""
    calendar = df.select("ts").distinct().withColumn("__i", F.row_number().over(Window.orderBy("ts")))  # a calendar
    rows = df.join(calendar, "ts").select("__i", "market", F.col(x).alias("__x"))
    w = Window.partitionBy("market").orderBy("__i").rowsBetween(-(n - 1), 0)
    stats = rows.select("market", F.col("__i").alias("__e"), F.count("__x").over(w).alias("__c"), F.avg("__x").over(w).alias("__m"), F.stddev_samp("__x").over(w).alias("__s")).where((F.col("__c") == n) & (F.col("__s") > 0))
    spread = rows.withColumn("__e", F.explode(F.sequence(F.col("__i"), F.col("__i") + n - 1))).join(stats, ["market", "__e"])
    sums = spread.groupBy("__e", "__i").agg(F.sum((F.col("__x") - F.col("__m")) / F.col("__s")).alias("__z"), F.count("*").alias("__k"))
    m = F.max("__k")
    out = sums.groupBy("__e").agg(m.alias("markets"), ((F.sum(F.col("__z") * F.col("__z")) / (n - 1) - m) / F.nullif(m * (m - 1), F.lit(0))).alias("correlation")).where((F.col("markets") >= least) & (F.col("markets") > 1))
    return out.join(calendar, F.col("__e") == F.col("__i")).select("ts", "markets", "correlation")


def forward_rank(label: Column, by: tuple[str, ...] = ("ts",)) -> tuple[Column, Column]:
    """Rank of a label, the best first, and the same as a share that is 1 for the best and 0 for the worst (one alone: 1)."""
    place, n = rank(label, by, descending=True), size(label, by)
    return place, F.when(label.isNotNull(), F.when(n == 1, 1.0).otherwise(1 - (place - 1) / F.nullif(n - 1, F.lit(0))))


def greedy_uncorrelated(df: DataFrame, ret: str, liquidity: str, threshold: float, window: int, least: int, liquidity_window: int, unit: str = "month") -> DataFrame:
    """period, market: who is kept at each period's last time. By mean liquidity, the greatest first (ties by market), a market is kept
    if its correlation with none that are kept is the threshold or more, over the times of the window at which both are known,
    at least so many. Pairs over the threshold come from products of blocks; the pick of one period is one group of its markets."""
    days = df.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")))  # a calendar
    ends = days.groupBy(F.trunc("ts", unit).alias("period")).agg(F.max("i").alias("e"))
    rows = df.join(days, "ts").select("i", "market", F.col(ret).alias("x"), F.col(liquidity).alias("__l"))
    close = products.moments(products.packed(ends, rows, window, ["period"]), window, ["period"], threshold, least)
    near = close.groupBy("period", "market").agg(F.flatten(F.collect_list("others")).alias("near"))
    spans = ends.select("period", F.explode(F.sequence(F.col("e") - liquidity_window + 1, F.col("e"))).alias("i"))
    ordered = spans.join(rows, "i").groupBy("period", "market").agg(F.avg("__l").alias("liquidity")).join(near, ["period", "market"], "left")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: set[str] = set()
        for m, others in pdf.assign(low=-pdf["liquidity"]).sort_values(["low", "market"], na_position="last")[["market", "near"]].itertuples(index=False):
            if others is None or not kept.intersection(others):
                kept.add(m)
        return pdf.loc[pdf["market"].isin(kept), ["period", "market"]]

    return ordered.groupBy("period").applyInPandas(pick, "period date, market string")

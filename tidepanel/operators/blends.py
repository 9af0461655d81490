"""Curves beside each other: alignment, risk-free rates, blends of curves, walk-forward segments, contributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .curves import performance, recovery, run, with_returns
from .weights import period_key


def aligned(curves: DataFrame) -> DataFrame:
    """Only times that every run has, each rebased to 1 at the first of them."""
    kinds = curves.select("run_id").distinct().count()
    common = curves.where("value is not null").groupBy("ts").agg(F.countDistinct("run_id").alias("__c")).where(F.col("__c") == kinds).select("ts")
    kept = curves.join(common, "ts", "left_semi")
    return kept.withColumn("value", F.try_divide("value", F.first("value").over(run().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def aligned_union(curves: DataFrame) -> DataFrame:
    """All times of any run inside the window in which every run has begun and none has ended; a run without a row keeps its last value."""
    spans = curves.groupBy("run_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    window = spans.agg(F.max("a").alias("__a"), F.min("z").alias("__z"))
    times = curves.select("ts").distinct()
    grid = times.crossJoin(spans.select("run_id")).join(curves, ["ts", "run_id"], "left")  # the grid of runs by times is the result
    filled = grid.withColumn("value", F.last("value", ignorenulls=True).over(run().rowsBetween(Window.unboundedPreceding, 0)))
    return filled.join(F.broadcast(window), (F.col("ts") >= F.col("__a")) & (F.col("ts") <= F.col("__z"))).drop("__a", "__z")  # one row


def risk_free(times: DataFrame, rates: DataFrame, per_year: int) -> DataFrame:
    """times: ts. rates: ts, annual (percent). ts, rate by row: of the rate known at the time before (the first: its own)."""
    both = rates.select("ts", "annual", F.lit(0).alias("__s")).unionByName(times.select("ts", F.lit(None).cast("double").alias("annual"), F.lit(1).alias("__s")))
    known = both.withColumn("annual", F.last("annual", ignorenulls=True).over(Window.orderBy("ts", "__s").rowsBetween(Window.unboundedPreceding, 0))).where("__s = 1")  # a calendar of rates
    held = F.coalesce(F.lag("annual").over(Window.orderBy("ts")), "annual")
    return known.select("ts", (F.pow(1 + held / 100, F.lit(1.0 / per_year)) - 1).alias("rate"))


def drifting(curves: DataFrame, weights: dict[str, float]) -> DataFrame:
    """ts, value: the runs bought once by weight and held; curves start at 1."""
    share = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return curves.where(F.col("run_id").isin(*weights)).groupBy("ts").agg(F.sum(F.col("value") * share[F.col("run_id")]).alias("value"))


def rebalanced(curves: DataFrame, weights: dict[str, float], every: str = "monthly", fee_bps: float = 0.0) -> DataFrame:
    """ts, value, turnover so far: the runs brought back to their weights at the first time of each period, before its return, for a fee
    on half the value moved.

    Inside a period each run's growth since the last time before it is a ratio of values, and the period's turnover and growth
    follow from those alone; the portfolio is the running product of the periods' growth.
    """
    total = sum(weights.values())
    share = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("run_id")]
    rows = curves.where(F.col("run_id").isin(*weights)).withColumn("__p", period_key(F.col("ts"), every)).withColumn("__w", share)
    ends = rows.groupBy("run_id", "__p").agg(F.max_by("value", "ts").alias("__end"), F.min("ts").alias("__t")).withColumn("__base", F.lag("__end").over(Window.partitionBy("run_id").orderBy("__t")))
    first = Window.partitionBy("run_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = rows.withColumn("__start", F.first("value").over(first)).join(ends.select("run_id", "__p", "__base", "__end"), ["run_id", "__p"])
    base = F.coalesce("__base", "__start")
    grown = joined.withColumn("__g", F.col("__w") * F.try_divide("value", base)).withColumn("__ge", F.col("__w") * F.try_divide("__end", base))
    # shares at a period's end, of which the next one's turnover is made
    close = grown.select("run_id", "__p", "__w", "__ge").distinct().withColumn("__sum", F.sum("__ge").over(Window.partitionBy("__p")))
    by_period = close.groupBy("__p").agg((F.first("__sum") / total).alias("growth"), (F.sum(F.abs(F.col("__w") - F.col("__ge") / F.col("__sum") * F.lit(total))) / (2 * total)).alias("after")).join(rows.groupBy("__p").agg(F.min("ts").alias("__t")), "__p")
    before = Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)  # one row a period
    turnover = F.coalesce(F.lag("after").over(Window.orderBy("__t")), F.lit(0.0))
    kept = F.greatest(F.lit(0.0), 1 - F.col("turnover") * (fee_bps / 10_000))
    periods = by_period.withColumn("turnover", turnover).withColumn("kept", kept).withColumn("__at", F.coalesce(F.exp(F.sum(F.log(F.col("growth") * F.col("kept"))).over(before)), F.lit(1.0)) * F.col("kept")).withColumn("turnover", F.sum("turnover").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return grown.groupBy("ts", "__p").agg(F.sum("__g").alias("__v")).join(periods.select("__p", "__at", "turnover"), "__p").select("ts", (F.col("__v") * F.col("__at")).alias("value"), "turnover")


def trend_exposed(curves: DataFrame, weights: dict[str, float], lookback: int, exposure: float, fee_bps: float = 0.0) -> DataFrame:
    """ts, value, turnover: as rebalanced() by month, with a run's weight times `exposure` in months after its month-end value was not
    above that of `lookback` months before; the rest is cash. The first month has the weights themselves.

    A month's shares at its end follow from its targets and its growth alone, so its turnover does not depend on the value before:
    the value is a running product over the months, one row each, and no month waits for the one before.
    """
    share = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("run_id")]
    rows = curves.where(F.col("run_id").isin(*weights)).select("ts", "run_id", "value", (F.year("ts") * 12 + F.month("ts")).alias("m"))
    ends = rows.groupBy("run_id", "m").agg(F.max_by("value", "ts").alias("end"), F.min_by("value", "ts").alias("start"))
    of_run = Window.partitionBy("run_id").orderBy("m")
    late = lambda k, c: ends.select("run_id", (F.col("m") + k).alias("m"), F.col("end").alias(c))
    before = F.lag("end").over(of_run)
    joined = ends.withColumn("before", before).join(late(1, "__last"), ["run_id", "m"], "left").join(late(1 + lookback, "__old"), ["run_id", "m"], "left")
    off = F.col("before").isNotNull() & F.coalesce(F.try_divide("__last", "__old") - 1 <= 0, F.lit(False))
    months = joined.select("run_id", "m", F.coalesce("before", "start").alias("base"), (share * F.when(off, exposure).otherwise(1.0)).alias("target"), "end")
    months = months.withColumn("grown", F.col("target") * F.try_divide("end", "base")).withColumn("rest", F.greatest(F.lit(0.0), 1 - F.sum("target").over(Window.partitionBy("m"))))
    months = months.withColumn("growth", F.sum("grown").over(Window.partitionBy("m")) + F.col("rest"))
    months = months.withColumn("__moved", F.abs(F.col("target") - F.lag(F.col("grown") / F.col("growth")).over(of_run)))
    by_month = months.groupBy("m").agg(F.first("rest").alias("rest"), F.first("growth").alias("growth"), F.sum("__moved").alias("moved"))
    in_order = Window.orderBy("m")  # one row a month
    turn = F.coalesce((F.col("moved") + F.abs(F.col("rest") - F.lag(F.col("rest") / F.col("growth")).over(in_order))) / 2, F.lit(0.0))
    kept = F.greatest(F.lit(0.0), 1 - F.col("turn") * (fee_bps / 10_000))
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    levels = by_month.withColumn("turn", turn).withColumn("kept", kept).withColumn("at", F.coalesce(F.exp(F.sum(F.log(F.col("growth") * F.col("kept"))).over(earlier)), F.lit(1.0)) * F.col("kept"))
    levels = levels.select("m", F.col("rest").alias("cash"), "at", F.sum("turn").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("turnover"))
    held = rows.join(months.select("run_id", "m", "base", "target"), ["run_id", "m"]).join(levels, "m")
    return held.groupBy("ts").agg(((F.sum(F.col("target") * F.try_divide("value", "base")) + F.first("cash")) * F.first("at")).alias("value"), F.first("turnover").alias("turnover"))


def summary(curves: DataFrame, settings: DataFrame, per_year: int) -> DataFrame:
    """One row a blend: curves (run_id, ts, value) and settings (run_id, mode, weights, turnover). Growth a year is by calendar days, and so is
    Calmar's ratio; the rest is as performance() and recovery() have it, in percent where a name says so."""
    ends = curves.groupBy("run_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("observations"), F.try_divide(F.max_by("value", "ts"), F.min_by("value", "ts")).alias("__g"))
    days = F.datediff("end", "start")
    cagr = F.when((days > 0) & (F.col("__g") > 0), F.pow("__g", 365.25 / days) - 1)
    made = ends.join(performance(curves, per_year).drop("n", "cagr", "calmar"), "run_id").join(recovery(curves), "run_id").join(settings, "run_id", "left")
    return made.select(
        "run_id", "mode", "start", "end", "observations", ((F.col("__g") - 1) * 100).alias("total_return_pct"), (cagr * 100).alias("cagr_pct"), (F.col("vol") * 100).alias("volatility_pct"), (F.col("max_drawdown") * 100).alias("max_drawdown_pct"),
        "sharpe", "sortino", F.when(F.col("max_drawdown") < 0, cagr / F.abs("max_drawdown")).alias("calmar"), F.col("ulcer").alias("ulcer_pct"), F.col("longest_completed").alias("longest_recovery_bars"), F.col("longest").alias("longest_bars"),
        F.col("p90").alias("p90_bars"), F.col("current_pct").alias("current_drawdown_pct"), "under_water_pct", "turnover", "weights",
    )


def fold_winners(scores: DataFrame, metric: str = "inside") -> DataFrame:
    """Of each fold (fold, candidate, inside, outside): the candidate with the best inside score, ties by name."""
    best = Window.partitionBy("fold").orderBy(F.col(metric).desc_nulls_last(), "candidate")
    return scores.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def candidate_summary(scores: DataFrame, winners: DataFrame) -> DataFrame:
    """By candidate: folds, median inside and outside scores, share of outside scores above 0, wins and their share of folds."""
    folds = winners.agg(F.count("*").alias("__f"))
    wins = winners.groupBy("candidate").agg(F.count("*").alias("wins"))
    out = scores.groupBy("candidate").agg(F.count("*").alias("folds"), F.percentile("inside", 0.5).alias("median_inside"), F.percentile("outside", 0.5).alias("median_outside"), F.avg((F.col("outside") > 0).cast("double")).alias("positive"))
    return out.join(wins, "candidate", "left").crossJoin(F.broadcast(folds)).withColumn("wins", F.coalesce("wins", F.lit(0))).withColumn("win_share", F.try_divide("wins", "__f")).drop("__f")  # one row


def deployment(winners: DataFrame) -> DataFrame:
    """fold, candidate, deploy_start, deploy_end: a winner's outside window, cut where the next one's starts; empty ones go."""
    following = F.lead("start").over(Window.orderBy("start", "fold"))  # one row a fold
    end = F.least("end", F.coalesce(following, "end"))
    return winners.select("fold", "candidate", F.col("start").alias("deploy_start"), end.alias("deploy_end")).where("deploy_end > deploy_start")


def stitched(returns: DataFrame, segments: DataFrame, cash: float = 1.0) -> DataFrame:
    """ts, fold, candidate, value: the segments' returns one after the other; each segment's first return is 0."""
    inside = returns.join(segments, "candidate").where((F.col("ts") >= F.col("deploy_start")) & (F.col("ts") < F.col("deploy_end")))
    first = F.col("ts") == F.min("ts").over(Window.partitionBy("fold"))
    rows = inside.withColumn("ret", F.when(first, 0.0).otherwise(F.col("ret"))).groupBy("ts").agg(F.first("fold").alias("fold"), F.first("candidate").alias("candidate"), F.first("ret").alias("ret"))
    grown = F.exp(F.sum(F.log1p("ret")).over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))  # one curve
    return rows.select("ts", "fold", "candidate", (grown * cash).alias("value"))


def contributions(trades: DataFrame, key: str, pnl: str) -> DataFrame:
    """By key: net, count, place, its share of all net profit (null unless that is above 0) and of the positive keys' sum, in percent."""
    by = trades.groupBy(key).agg(F.sum(pnl).alias("net"), F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row a key
    total, positive = F.sum("net").over(every), F.sum(F.greatest("net", F.lit(0.0))).over(every)
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("net"), key))).withColumn("net_share", F.when(total > 0, F.col("net") / total * 100)).withColumn("positive_share", F.try_divide(F.greatest("net", F.lit(0.0)) * 100, positive))


def concentration(shares: DataFrame, tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row of contributions(): the net share of the first 1, 5 and 10 positive keys, and the first 5's of the positive sum."""
    return shares.agg(*[F.sum(F.when((F.col("place") <= k) & (F.col("net") > 0), F.col("net_share"))).alias(f"top{k}_net") for k in tops], F.sum(F.when((F.col("place") <= 5) & (F.col("net") > 0), F.col("positive_share"))).alias("top5_positive"))


def reconciled(trades: DataFrame, pnl: str, curves: DataFrame, cash: float) -> DataFrame:
    """One row: trades' net, the curve's, their difference, and whether it is next to nothing."""
    a, b = trades.agg(F.sum(pnl).alias("trade_net")), curves.agg((F.max_by("value", "ts") - cash).alias("account_net"))
    gap = F.col("trade_net") - F.col("account_net")
    return a.crossJoin(b).withColumn("difference", gap).withColumn("reconciled", F.abs(gap) <= 1e-6 + 1e-9 * F.abs("account_net"))  # one row each


def strategy_returns(curves: DataFrame) -> DataFrame:
    return with_returns(curves).select(F.col("run_id").alias("candidate"), "ts", "ret")

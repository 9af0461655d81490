"""Keeping tables current: versions, merges of old and new rows, and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def final_version(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def combine_first(new: DataFrame, old: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Cell by cell the new value, or the old one where there is no new one."""
    a, b = new.select(*keys, *[F.col(v).alias(f"__new_{v}") for v in values]), old.select(*keys, *values)
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(f"__new_{v}", v).alias(v) for v in values])


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Every group that is in new comes whole from new."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def changed_keys(old: DataFrame, new: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    """By `by`: how many rows common to both have another value in new, and the first of them by the last key."""
    both = old.select(*keys, F.col(value).alias("__old")).join(new.select(*keys, value), keys)
    return both.where(~F.col(value).eqNullSafe(F.col("__old"))).groupBy(by).agg(F.count("*").alias("n_changed"), F.min(keys[-1]).alias("first_changed"))


def changed_after(old: DataFrame, new: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """key, anchor, before, after: keys whose first value in new after old's last row (the anchor) differs from the anchor's."""
    anchor = old.groupBy(key).agg(F.max(ts).alias("anchor"), F.max_by(value, ts).alias("before"))
    later = new.join(anchor, key).where(F.col(ts) > F.col("anchor")).groupBy(key, "anchor", "before").agg(F.min_by(value, ts).alias("after"))
    return later.where(~F.col("before").eqNullSafe(F.col("after")))


def latest_snapshot(df: DataFrame, anchor: str, columns: list[str]) -> DataFrame:
    """Each market's row at the last time with a known anchor."""
    row = F.max_by(F.struct("ts", *columns), F.when(F.col(anchor).isNotNull(), F.col("ts")))
    return df.where(F.col(anchor).isNotNull()).groupBy("market").agg(row.alias("__r")).select("market", "__r.*")


def extended_to(df: DataFrame, until: Column, longest: int) -> DataFrame:
    """Each market's last row again at a later day, unless it is more than so many days old."""
    last = Window.partitionBy("market").orderBy(F.desc("ts"))
    gap = F.datediff(until, "ts")
    copies = df.withColumn("__n", F.row_number().over(last)).where((F.col("__n") == 1) & (gap > 0) & (gap <= longest)).drop("__n")
    return df.unionByName(copies.withColumn("ts", until))


def missing_keys(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of expected that present lacks."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def latest_non_empty(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key: its last value that is neither null nor blank."""
    known = F.when(F.trim(value) != "", F.col(order))
    return df.groupBy(key).agg(F.max_by(F.when(F.trim(value) != "", F.col(value)), known).alias(value))


def labelled(codes: DataFrame, facts: DataFrame, key: str, names: list[str], order: str) -> DataFrame:
    """Every code with its latest names, or itself where it has none."""
    last = facts.groupBy(key).agg(*[F.max_by(n, F.struct(order, n)).alias(n) for n in names])
    return codes.select(key).distinct().join(last, key, "left").select(key, *[F.coalesce(n, F.col(key).cast("string")).alias(n) for n in names])


def merged_listings(first: DataFrame, second: DataFrame, key: str, keep: Column) -> DataFrame:
    """Two listings of one layout, those kept only; of a key in both, the first's row."""
    both = first.withColumn("__o", F.lit(0)).unionByName(second.withColumn("__o", F.lit(1)), allowMissingColumns=True).where(keep)
    rest = [c for c in both.columns if c not in (key, "__o")]
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__o", *rest))).where("__n = 1").drop("__n", "__o")


def assembled(universe: DataFrame, prices: DataFrame, volumes: DataFrame) -> DataFrame:
    """ts, market, price, volume, amount, available: markets in all three, on all days of either table."""
    common = universe.select("market").distinct().join(prices.select("market").distinct(), "market", "left_semi").join(volumes.select("market").distinct(), "market", "left_semi")
    both = prices.select("ts", "market", "price").join(volumes.select("ts", "market", "volume"), ["ts", "market"], "full").join(common, "market", "left_semi")
    amount = F.col("price") * F.col("volume")
    return both.withColumn("amount", amount).withColumn("available", F.coalesce(amount > 0, F.lit(False))).select("ts", "market", "price", "volume", "amount", "available")


def with_series_as_market(panel: DataFrame, series: DataFrame, market: str, base: float) -> DataFrame:
    """panel: ts, market, price, volume. One more market: the series (ts, value) filled forward on the panel's days, rebased to base at
    its first; its volume is the median of the day's markets."""
    days = panel.groupBy("ts").agg(F.percentile("volume", 0.5).alias("volume"))
    both = days.select("ts", "volume", F.lit(1).alias("__s"), F.lit(None).cast("double").alias("value")).unionByName(series.select("ts", F.lit(None).cast("double").alias("volume"), F.lit(0).alias("__s"), F.col("value").cast("double")))
    w = Window.orderBy("ts", "__s")  # a calendar
    filled = both.withColumn("value", F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__s = 1 and value is not null")
    start = F.first("value").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return panel.select("ts", "market", "price", "volume").unionByName(filled.select("ts", F.lit(market).alias("market"), (F.col("value") / start * base).alias("price"), "volume"))


def index_columns(days: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """index: name, ts, value. Every day with every name's value, not filled; and by name: duplicate days, values not above 0, and days
    without a value after its first."""
    values = index.groupBy("name", "ts").agg(F.max("value").alias("value"), F.count("*").alias("__c"))
    grid = days.select("ts").distinct().crossJoin(index.select("name").distinct()).join(values, ["ts", "name"], "left")  # the grid is the result
    checks = index.groupBy("name").agg((F.count("*") - F.countDistinct("ts")).alias("duplicates"), F.count(F.when(F.col("value") <= 0, 1)).alias("not_positive"), F.min("ts").alias("__first"))
    holes = grid.join(checks.select("name", "__first"), "name").where((F.col("ts") > F.col("__first")) & F.col("value").isNull()).groupBy("name").agg(F.count("*").alias("missing"))
    return grid.select("ts", "name", "value"), checks.join(holes, "name", "left").select("name", "duplicates", "not_positive", F.coalesce("missing", F.lit(0)).alias("missing"))


def quality_by_year(df: DataFrame, ts: str, key: str, checks: dict[str, Column]) -> DataFrame:
    """By year: rows, repeated keys, and how many rows each check marks."""
    return df.groupBy(F.year(ts).alias("yr")).agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct(key)).alias("duplicates"), *[F.count(F.when(c, 1)).alias(n) for n, c in checks.items()])


def daily_counts(df: DataFrame, drop: float) -> DataFrame:
    """ts, n, before, fell: days whose row count is below (1 - drop) of the day before."""
    w = Window.orderBy("ts")  # one row a day
    return df.groupBy("ts").agg(F.count("*").alias("n")).withColumn("before", F.lag("n").over(w)).withColumn("fell", F.coalesce(F.col("n") < F.col("before") * (1 - drop), F.lit(False)))


def cross_checked(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: keys in both, only in the one, only in the other, and values further apart than the tolerance (relative)."""
    both = a.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__x")).join(b.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__y")), keys, "full")
    apart = F.abs(F.col("__a") - F.col("__b")) > tolerance * F.abs("__b")
    one = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return both.agg(one(F.col("__x").isNotNull() & F.col("__y").isNotNull(), "common"), one(F.col("__y").isNull(), "only_first"), one(F.col("__x").isNull(), "only_second"), one(apart, "apart"))


def adjusted_prices(bars: DataFrame, least_ratio: float = 1.5, limit: float = 0.3) -> DataFrame:
    """bars: code, ts, close, change, volume, shares, a row a traded day. Adds base (close less change), factor (base over the close
    before; 1 without both), kind of event (invalid_base, share_ratio_override, adjustment or null) and adjusted: the close times
    all later factors. A factor of 1 (to 1e-9) gives way to the ratio of the share counts where trading was halted the day before, that ratio
    is least_ratio or more and the close moved by more than limit."""
    w = Window.partitionBy("code").orderBy("ts")
    previous, base = F.lag("close").over(w), F.col("close") - F.col("change")
    linked = previous > 0
    factor = F.when(linked & (base > 0), F.try_divide(base, previous)).otherwise(1.0)
    ratio = F.try_divide(F.lag("shares").over(w), F.col("shares"))
    halted = F.lag("volume").over(w) == 0
    moved = F.abs(F.try_divide(F.col("close"), previous) - 1) > limit
    rows = bars.withColumn("base", base).withColumn("__f", factor).withColumn("__r", ratio).withColumn("__o", F.coalesce(linked & (F.abs(factor - 1) <= 1e-9) & halted & (ratio >= least_ratio) & moved, F.lit(False))).withColumn("__bad", F.coalesce(linked & ~(base > 0), F.lit(False)))
    rows = rows.withColumn("factor", F.when(F.col("__o"), F.col("__r")).otherwise(F.col("__f")))
    later = F.sum(F.log("factor")).over(Window.partitionBy("code").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1))  # running from the end
    kind = F.when(F.col("__bad"), "invalid_base").when(F.col("__o"), "share_ratio_override").when(F.abs(F.col("factor") - 1) > 1e-9, "adjustment")
    return rows.withColumn("kind", kind).withColumn("adjusted", F.col("close") * F.exp(F.coalesce(later, F.lit(0.0)))).drop("__f", "__r", "__o", "__bad")


def rate_checks(series: DataFrame, low: float, high: float, jump: float) -> DataFrame:
    """Rows of a rate series (ts, value) outside the bounds or further from the one before than jump (relative)."""
    before = F.lag("value").over(Window.orderBy("ts"))  # one series
    out = series.withColumn("outside", (F.col("value") < low) | (F.col("value") > high)).withColumn("jumped", F.coalesce(F.abs(F.try_divide(F.col("value"), before) - 1) > jump, F.lit(False)))
    return out.where("outside or jumped")


def relative_to_baseline(runs: DataFrame, metric: str, baseline: Column, higher: bool = True) -> DataFrame:
    """relative: a run's metric over the baseline run's (the lowest id among those marked), turned round where lower is better."""
    base = runs.where(baseline).agg(F.min_by(metric, "run_id").alias("__b"))
    joined = runs.crossJoin(F.broadcast(base))  # one row
    return joined.withColumn("relative", F.try_divide(F.col(metric), F.col("__b")) if higher else F.try_divide(F.col("__b"), F.col(metric))).drop("__b")


def preference_scores(runs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """place of each metric among all runs (average rank over n) and score: their weighted sum; runs whose metrics are all equal to
    another's are one, the lowest id."""
    once = runs.groupBy(*weights).agg(F.min("run_id").alias("run_id"))
    out, score = once, F.lit(0.0)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    for m, w in weights.items():
        ties = F.count("*").over(Window.partitionBy(m))
        out = out.withColumn(f"{m}_pct", (F.rank().over(Window.orderBy(m)) + (ties - 1) / 2) / n)  # one row a run
        score = score + F.col(f"{m}_pct") * w
    return out.withColumn("score", score)


def learned_weights(choices: DataFrame, metrics: list[str]) -> DataFrame:
    """choices: liked (1 or 0) and percentile metrics. metric, weight: what liked runs have more of than the others on average, none
    below 0, as shares of the sum."""
    gap = [(F.avg(F.when(F.col("liked") == 1, F.col(m))) - F.avg(F.when(F.col("liked") == 0, F.col(m)))).alias(m) for m in metrics]
    long = choices.agg(*gap).unpivot([], metrics, "metric", "gap").withColumn("gap", F.greatest(F.coalesce("gap", F.lit(0.0)), F.lit(0.0)))
    return long.withColumn("weight", F.coalesce(F.try_divide("gap", F.sum("gap").over(Window.partitionBy(F.lit(0)))), F.lit(1.0 / len(metrics)))).drop("gap")

"""Universe selection and target weights over a long panel."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import dense_grid
from . import cross_section as xs


def top_n(df: DataFrame, score: str, n: int) -> DataFrame:
    return df.withColumn("position", xs.rank(F.col(score), descending=True)).where(F.col("position") <= n)


def period_key(ts: Column, every: str) -> Column:
    """What the rows of one rebalance period share: daily, weekly (Monday), monthly, quarterly, semiannual, or Nd and Nd+K, buckets of
    N days counted from Monday 1970-01-05, K days later."""
    if days := re.fullmatch(r"([1-9][0-9]*)d(?:\+([1-9][0-9]*))?", every):
        n, shift = int(days[1]), int(days[2] or 0)
        if shift >= n:
            raise ValueError(f"the shift of {every} must be below its days")
        return F.floor((F.datediff(ts, F.lit("1970-01-05").cast("date")) - shift) / n)
    if every == "semiannual":
        return F.year(ts) * 2 + F.floor((F.month(ts) - 1) / 6)
    return F.date_trunc({"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}[every], ts)


def rebalance_rows(df: DataFrame, every: str) -> DataFrame:
    """Rows of the first observed time in each period; every_bar keeps all."""
    if every == "every_bar":
        return df
    first = df.groupBy(period_key(F.col("ts"), every).alias("__p")).agg(F.min("ts").alias("ts")).drop("__p")
    return df.join(first, "ts", "left_semi")


def equal(gross: float = 1.0) -> Column:
    return gross / F.count("*").over(xs.at())


def rank_weighted(position: str, weights: tuple[float, ...]) -> Column:
    """Weights by position, scaled to those that are there."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col(position).cast("int"))
    return w / F.sum(w).over(xs.at())


def long_short(df: DataFrame, score: str, n: int, gross: float) -> DataFrame:
    """The n best long and the n worst short, each side with half the gross; a market on both sides raises."""
    ranked = df.withColumn("best", xs.rank(F.col(score), descending=True)).withColumn("worst", xs.rank(F.col(score)))
    both = F.when((F.col("best") <= n) & (F.col("worst") <= n), F.raise_error(F.lit("a market is on both sides")).cast("int"))
    side = F.coalesce(both, F.when(F.col("best") <= n, 1).when(F.col("worst") <= n, -1))
    picked = ranked.withColumn("side", side).where("side is not null")
    return picked.withColumn("weight", F.col("side") * gross / 2 / F.count("*").over(Window.partitionBy("ts", "side")))


def keep_cash(weight: Column, cap: Column) -> Column:
    return F.least(weight, cap)


def cap_scale(w: Column, c: Column) -> Column:
    """What a time's weights are multiplied by so that, with those above their caps cut, nothing is lost: the largest over its rows."""
    order = Window.partitionBy("ts").orderBy(F.try_divide(c, w).asc_nulls_last(), F.col("market"))
    capped_before = F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    backwards = Window.partitionBy("ts").orderBy(F.try_divide(c, w).desc_nulls_first(), F.desc("market"))
    rest = F.sum(w).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(w != 0, F.try_divide(F.sum(w).over(xs.at()) - capped_before, rest))


def redistribute(df: DataFrame, weight: str, cap: str) -> DataFrame:
    """Excess over the caps is shared by weight among the rest until no cap is passed: closed form by cap / weight. Markets of no
    weight get none."""
    w, c = F.col(weight), F.col(cap)
    out = df.withColumn("__scale", cap_scale(w, c)).withColumn("__scale", F.max("__scale").over(xs.at()))
    return out.withColumn("final", F.coalesce(F.least(c, w * F.col("__scale")), F.lit(0.0))).drop("__scale")


def rescale_to(weight: Column, total: float) -> Column:
    """All weights of a time times what makes their sum the total; a sum of 0 stays."""
    held = xs.exact_sum(weight).over(xs.at()).cast("double")
    return F.when(held > 0, F.try_divide(weight * total, held)).otherwise(weight)


def changes_only(targets: DataFrame, weight: str, scope: str = "portfolio") -> DataFrame:
    """targets: rows (ts, market, weight); a market without a row at a time has the target 0. Rows to request: with scope
    portfolio, every market's at the times at which any target differs from the time before; with asset, those that differ
    themselves (an exit is a 0). At the first time always."""
    dense = dense_grid(targets.select("ts", "market", weight)).withColumn(weight, F.coalesce(weight, F.lit(0.0)))
    # every market has a row at every time, so the row before is that of the time before
    before = F.lag(weight).over(Window.partitionBy("market").orderBy("ts"))
    changed = (before.isNull() | (F.col(weight) != before)).cast("int")
    if scope == "asset":
        return dense.withColumn("__c", changed).where("__c = 1").drop("__c")
    return dense.withColumn("__c", changed).withColumn("__c", F.max("__c").over(xs.at())).where("__c = 1").drop("__c")


def selection_statistics(selected: DataFrame) -> DataFrame:
    """Over the times with a selection: how many there are, and the mean, least and most markets held."""
    held = selected.groupBy("ts").agg(F.count("*").alias("held"))
    return held.agg(F.count("*").alias("rebalances"), F.avg("held").alias("mean_held"), F.min("held").alias("least_held"), F.max("held").alias("most_held"))


def start_gate(df: DataFrame, eligible: Column, least: int) -> DataFrame:
    """Rows from the first time on at which so many markets are eligible."""
    first = df.where(eligible).groupBy("ts").agg(F.count("*").alias("n")).where(F.col("n") >= least).agg(F.min("ts").alias("__first"))
    return df.join(F.broadcast(first), F.col("ts") >= F.col("__first")).drop("__first")  # one row


def min_age(df: DataFrame, days: int) -> DataFrame:
    """Rows at least so many days after their market's first."""
    return df.withColumn("__age", F.datediff("ts", F.min("ts").over(Window.partitionBy("market")))).where(F.col("__age") >= days).drop("__age")


def listed_fixed(listed: str = "ts", gross: float = 1.0) -> Column:
    """The gross over the number of markets listed so far; rows need first_ts (the market's first time) on a dense grid."""
    return F.when(F.col("first_ts") <= F.col(listed), gross / F.count(F.when(F.col("first_ts") <= F.col(listed), 1)).over(xs.at()))


def feature_value(score: Column, selected: Column, scale: float, low: float = -1.0, high: float = 1.0, gross: float = 1.0) -> Column:
    """The selected markets' clipped score / scale, times the gross over how many of them are above 0; none is: 0."""
    clipped = F.when(selected & score.isNotNull(), F.greatest(F.least(score / scale, F.lit(high)), F.lit(low))).otherwise(0.0)
    active = F.sum((clipped > 0).cast("int")).over(xs.at())
    return F.coalesce(F.try_divide(clipped * gross, active), F.lit(0.0))


def fixed(selected: Column, weight: float, score: Column | None = None, lag: int = 0) -> Column:
    """One weight for each selected market, times its score some rows ago (unknown: 0); else 0."""
    if score is None:
        return F.when(selected, F.lit(weight)).otherwise(0.0)
    held = F.lag(score, lag).over(Window.partitionBy("market").orderBy("ts")) if lag else score
    return F.when(selected, weight * F.coalesce(held, F.lit(0.0))).otherwise(0.0)


def common_scale(df: DataFrame, feature: str, lag: int = 0, low: float = 0.0, high: float = 1.0, neutral: float | None = None) -> DataFrame:
    """ts, scale: the one value that a time's markets share (more than one raises), so many times ago, clipped, 0 if unknown.
    With neutral it is a multiplier: not clipped, neutral if unknown, and a negative one raises."""
    spread = F.max(feature) - F.min(feature)
    same = F.when(spread > 1e-9 + 1e-9 * F.abs(F.max(feature)), F.raise_error(F.lit("markets differ in the exposure feature")).cast("double")).otherwise(F.max(feature))
    scale = F.col("__s")
    out = df.groupBy("ts").agg(same.alias("__s"))
    if lag:  # one row a time: a calendar, not the panel
        out = out.withColumn("__s", F.lag("__s", lag).over(Window.orderBy("ts")))
    if neutral is not None:
        wrong = F.raise_error(F.lit("negative exposure multiplier")).cast("double")
        return out.select("ts", F.when(scale < 0, wrong).otherwise(F.coalesce(scale, F.lit(neutral))).alias("scale"))
    return out.select("ts", F.coalesce(F.greatest(F.least(scale, F.lit(high)), F.lit(low)), F.lit(0.0)).alias("scale"))


def scaled_by(targets: DataFrame, weight: str, scale: DataFrame) -> DataFrame:
    """Targets times the scale of their time; times without one get 0."""
    return targets.join(scale, "ts", "left").withColumn(weight, F.col(weight) * F.coalesce("scale", F.lit(0.0))).drop("scale")


def side_weights(df: DataFrame, side: Column, gross: float, share: Column | None = None, long_share: float = 0.5, scale_long: Column | None = None, scale_short: Column | None = None) -> DataFrame:
    """weight: the gross is dealt to the long (side > 0) and the short side by long_share and the sides' multipliers, and within a
    side equally or by share (negative ones raise; all 0: equally)."""
    at_side = Window.partitionBy("ts", "__side")
    out = df.withColumn("__side", F.signum(side).cast("int")).where("__side <> 0")
    part = F.lit(1.0) / F.count("*").over(at_side)
    if share is not None:
        wrong = F.raise_error(F.lit("negative weight feature")).cast("double")
        own = F.when(share < 0, wrong).otherwise(F.coalesce(share, F.lit(0.0)))
        part = F.coalesce(F.try_divide(own, F.sum(own).over(at_side)), part)
    one = F.lit(1.0)
    budget = F.when(F.col("__side") > 0, gross * long_share * (one if scale_long is None else scale_long)).otherwise(gross * (1 - long_share) * (one if scale_short is None else scale_short))
    return out.withColumn("weight", F.col("__side") * budget * part).withColumnRenamed("__side", "side")


def defensive(targets: DataFrame, weight: str, risk_on: DataFrame, listed: DataFrame, gross: float = 1.0) -> DataFrame:
    """At times that have targets but no risk_on flag (ts, flag; 0 or unknown is off), the whole row becomes equal weights on
    the defensive markets listed by then (listed: market, first_ts), summing to gross; none listed: all 0."""
    rows = targets.join(risk_on.select("ts", F.coalesce(F.col("flag") != 0, F.lit(False)).alias("__on")), "ts", "left").withColumn("__on", F.coalesce("__on", F.lit(False)))
    rows = rows.join(F.broadcast(listed.select("market", F.col("first_ts").alias("__first"))), "market", "left")  # the sleeve's own markets, a parameter
    rows = rows.withColumn("__in", F.coalesce(F.col("__first") <= F.col("ts"), F.lit(False)))
    n = F.sum(F.col("__in").cast("int")).over(xs.at())
    sleeve = F.when(F.col("__in"), F.try_divide(F.lit(gross), n)).otherwise(0.0)
    return rows.withColumn(weight, F.when(F.col("__on"), F.col(weight)).otherwise(sleeve)).drop("__on", "__first", "__in")


def held_targets(grid: DataFrame, weight: str) -> DataFrame:
    """A dense grid's targets, each standing until the next one; 0 before the first."""
    so_far = Window.partitionBy("market").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn(weight, F.coalesce(F.last(weight, ignorenulls=True).over(so_far), F.lit(0.0)))


def with_hedge(targets: DataFrame, weight: str, beta: str | None, hedge: str, ratio: float = 1.0) -> DataFrame:
    """One more row a time: the hedge market at -ratio times the sum of weight times beta (a null one raises), or of weight alone."""
    known = F.lit(1.0) if beta is None else F.when(F.col(beta).isNull() & (F.col(weight) != 0), F.raise_error(F.lit("a held market has no beta")).cast("double")).otherwise(F.coalesce(beta, F.lit(0.0)))
    leg = targets.groupBy("ts").agg((F.lit(0.0) - xs.exact_sum(F.col(weight) * known).cast("double") * ratio).alias(weight)).withColumn("market", F.lit(hedge))
    return targets.select("ts", "market", weight).unionByName(leg.select("ts", "market", weight)).groupBy("ts", "market").agg(F.sum(weight).alias(weight))


def combined_sleeves(requests: DataFrame, weight: str, capitals: dict[str, float]) -> DataFrame:
    """requests: ts, sleeve, market, weight (a row is a request). A market is requested when any of its sleeves does; the
    request is the sum of each sleeve's capital times its latest target there, 0 before its first."""
    capital = F.create_map(*[F.lit(x) for pair in capitals.items() for x in pair])
    asked = requests.select("ts", "market").distinct()
    owners = requests.select("sleeve", "market").distinct()
    rows = asked.join(owners, "market").join(requests, ["ts", "sleeve", "market"], "left")
    so_far = Window.partitionBy("sleeve", "market").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(F.last(weight, ignorenulls=True).over(so_far), F.lit(0.0)) * capital[F.col("sleeve")]
    return rows.withColumn("__h", held).groupBy("ts", "market").agg(F.sum("__h").alias(weight))


def ewm_targets(df: DataFrame, target: str, span: int) -> DataFrame:
    """average: each market's targets over the schedule with exponential weights, alpha = 2 / (span + 1), the first one as start.
    Folded over the market's schedule, which is as long as the calendar's periods."""
    alpha = 2 / (span + 1)
    rows = df.groupBy("market").agg(F.array_sort(F.collect_list(F.struct("ts", F.col(target).alias("x")))).alias("rows"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.expr("cast(array() as array<struct<ts:date,average:double>>)").alias("out"))

    def step(a, r):
        now = F.coalesce(a["last"] * (1 - alpha) + r["x"] * alpha, r["x"])
        return F.struct(now.alias("last"), F.concat(a["out"], F.array(F.struct(r["ts"].cast("date").alias("ts"), now.alias("average")))).alias("out"))

    return rows.select("market", F.explode(F.aggregate("rows", start, step)["out"]).alias("r")).select("r.ts", "market", "r.average")


def target_average(df: DataFrame, target: str, k: int) -> DataFrame:
    """average: mean of the market's last k targets; before the k-th, the first one stands in for those missing."""
    w = Window.partitionBy("market").orderBy("ts")
    held, first = w.rowsBetween(-(k - 1), 0), F.first(target).over(w.rowsBetween(Window.unboundedPreceding, 0))
    missing = k - F.count(target).over(held)
    return df.withColumn("average", (F.sum(target).over(held) + missing * first) / k)


def latest_targets(df: DataFrame, target: str, at: Column) -> DataFrame:
    """Each market's last target at or before a time."""
    return df.where(F.col("ts") <= at).groupBy("market").agg(F.max("ts").alias("ts"), F.max_by(target, "ts").alias(target))


def monthly_union(df: DataFrame, score: str, n: int, eligible: Column | None = None) -> DataFrame:
    """Rows of the markets that were among a month's n best by mean score in any month, over eligible rows only if that is given; a
    month's best count from the next on."""
    means = (df if eligible is None else df.where(eligible)).groupBy("market", F.trunc("ts", "month").alias("ts")).agg(F.round(F.avg(score), 8).alias("__s"))
    chosen = means.withColumn("__r", xs.rank(F.col("__s"), descending=True)).where(F.col("__r") <= n)
    since = chosen.groupBy("market").agg(F.add_months(F.min("ts"), 1).alias("__since"))
    return df.join(since, "market").where(F.col("ts") >= F.col("__since")).drop("__since")


def drop_idle_times(df: DataFrame, *activity: str) -> DataFrame:
    """Without the times at which nothing was active in any market."""
    total = sum((F.coalesce(F.sum(F.abs(c)).over(xs.at()), F.lit(0.0)) for c in activity), F.lit(0.0))
    return df.withColumn("__a", total).where("__a > 0").drop("__a")


def without_overlaps(df: DataFrame, intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Without the markets that have an interval (market, gap_start, gap_end) touching the window from start to end."""
    touching = intervals.where((F.col("gap_start") <= end) & (F.col("gap_end") >= start)).select("market").distinct()
    return df.join(touching, "market", "left_anti")


def sparse_rows(dense: DataFrame, weight: str) -> DataFrame:
    """ts, market, place, target_weight, gross_exposure of the markets held at the times at which the book changed; a time at which
    nothing is held has one row, of the first market, without a place and with 0."""
    book = changes_only(dense, weight)
    sums = book.withColumn("gross_exposure", F.sum(weight).over(xs.at())).withColumn("__n", F.sum((F.col(weight) > 0).cast("int")).over(xs.at())).withColumn("__first", F.min("market").over(xs.at()))
    place = F.row_number().over(Window.partitionBy("ts", F.col(weight) > 0).orderBy("market"))
    held = sums.withColumn("__p", place).where((F.col(weight) > 0) | ((F.col("__n") == 0) & (F.col("market") == F.col("__first"))))
    return held.select("ts", "market", F.when(F.col("__n") > 0, F.col("__p")).alias("place"), F.when(F.col("__n") > 0, F.col(weight)).otherwise(0.0).alias("target_weight"), F.when(F.col("__n") > 0, F.col("gross_exposure")).otherwise(0.0).alias("gross_exposure"))


def window_requests(requests: DataFrame, weight: str, start: str) -> DataFrame:
    """A sleeve's requests inside a window: only of markets that it ever holds, from their first weight on; at the start each of them
    stands with its latest target by then."""
    at = F.lit(start).cast("date")
    since = requests.where(F.col(weight) != 0).groupBy("market").agg(F.min("ts").alias("__since"))
    own = requests.join(since, "market").where(F.col("ts") >= F.col("__since")).drop("__since")
    state = latest_targets(own, weight, at).select(at.alias("ts"), "market", weight)
    return own.where(F.col("ts") > at).select("ts", "market", weight).unionByName(state)


def listed_shares(grid: DataFrame, shares: dict[str, float], price: str = "price") -> DataFrame:
    """weight: the fixed shares, among the markets listed by then."""
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("market")]
    rows = grid.where(F.col("market").isin(*shares)).withColumn("__on", F.min(F.when(F.col(price).isNotNull(), F.col("ts"))).over(Window.partitionBy("market")) <= F.col("ts"))
    on = F.coalesce(F.col("__on"), F.lit(False))
    return rows.withColumn("weight", F.when(on, F.try_divide(share, F.sum(F.when(on, share)).over(xs.at()))).otherwise(0.0)).drop("__on")


def seeded_window(targets: DataFrame, weight: str, start: str) -> DataFrame:
    """Rows from a start on; where the first time of the window has no target, each market's latest one before stands there."""
    at = F.lit(start).cast("date")
    so_far = Window.partitionBy("market").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = targets.withColumn("__held", F.last(weight, ignorenulls=True).over(so_far)).where(F.col("ts") >= at)
    first = F.col("ts") == F.min("ts").over(Window.partitionBy("market"))
    return rows.withColumn(weight, F.coalesce(weight, F.when(first, F.col("__held")))).drop("__held")

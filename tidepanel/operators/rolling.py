"""Window transforms over one market's rows in time order.

`skip` transforms run over the observed rows of a panel; on a dense grid the same expressions count grid rows (preserve).
Windows are full or null. Sums and extremes given as columns are taken anew for each row, which is right for short windows;
sliding.py has them in constant work a row, and what needs moments, drawdowns or medians of a window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import sliding


def by_time() -> WindowSpec:
    return Window.partitionBy("market").orderBy("ts")


def last(n: int) -> WindowSpec:
    return by_time().rowsBetween(-(n - 1), 0)


def full(x: Column, value: Column, n: int) -> Column:
    return F.when(F.count(x).over(last(n)) == n, value)


def shift(x: Column, n: int) -> Column:
    return F.lag(x, n).over(by_time()) if n >= 0 else F.lead(x, -n).over(by_time())


def delta(x: Column, n: int) -> Column:
    return x - shift(x, n)


def simple_return(x: Column, n: int = 1) -> Column:
    before = shift(x, n)
    return F.when(before != 0, x / before - 1)


def momentum(x: Column, n: int) -> Column:
    safe = F.when(x > 0, F.log(x))
    return safe - shift(safe, n)


def rolling(x: Column, n: int, kind: str) -> Column:
    f = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[kind]
    return full(x, f(x).over(last(n)), n)


def expanding_std(x: Column, min_periods: int) -> Column:
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(x).over(w) >= min_periods, F.stddev_pop(x).over(w))


def wma(x: Column, n: int) -> Column:
    """Linear weights 1..n: from the sums of i x and x, with i the row number."""
    i = F.row_number().over(by_time())
    first = i - n
    return full(x, (F.sum(x * i).over(last(n)) - first * F.sum(x).over(last(n))) / (n * (n + 1) / 2), n)


def vwma(x: Column, volume: Column, n: int) -> Column:
    both = F.when(volume < 0, F.raise_error(F.lit("negative volume")).cast("double")).otherwise(x * volume)
    total = F.sum(F.when(both.isNotNull(), volume)).over(last(n))
    return F.when((F.count(both).over(last(n)) == n) & (total != 0), F.sum(both).over(last(n)) / total)


def efficiency_ratio(x: Column, n: int) -> Column:
    path = F.sum(F.abs(delta(x, 1))).over(last(n))
    return F.when(path > 0, F.abs(delta(x, n)) / path)


def downside_vol(x: Column, n: int, per_year: float | None = None) -> Column:
    """With per_year, annualised by its root."""
    r = F.when((x > 0) & (shift(x, 1) > 0), F.log(x / shift(x, 1)))
    return full(r, F.sqrt(F.avg(F.least(r, F.lit(0.0)) * F.least(r, F.lit(0.0))).over(last(n))) * (per_year or 1.0) ** 0.5, n)


def age_days(x: Column, ts: Column) -> Column:
    return F.datediff(ts, F.min(F.when(x.isNotNull(), ts)).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))


def ewma(df: DataFrame, x: str, n: int, name: str = "ewma") -> DataFrame:
    """alpha = 2 / (n + 1) over the known rows, seeded with the mean of the first n.

    Within a block of rows the sum of q^-i x, times q^i, is one running window; blocks are short enough for q^-i to stay far from
    overflow. From block to block one value is carried, which is folded over the market's blocks, one row each.
    """
    keep = 1 - 2 / (n + 1)
    length = max(1, min(10_000, int(-50 / math.log(keep)))) if keep > 0 else 1
    known = df.where(F.col(x).isNotNull()).select("ts", "market", F.col(x).cast("double").alias("__x")).withColumn("__j", F.row_number().over(by_time()) - n - 1)  # 0 after the seed
    seed = known.where("__j < 0").groupBy("market").agg(F.avg("__x").alias("__seed"), F.count("*").alias("__c"), F.max("ts").alias("__last")).where(F.col("__c") == n)
    rows = known.where("__j >= 0").withColumn("__b", F.floor(F.col("__j") / length).cast("long")).withColumn("__k", (F.col("__j") % length).cast("double"))
    within = Window.partitionBy("market", "__b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.sum((1 - keep) * F.pow(F.lit(keep), -F.col("__k") - 1) * F.col("__x")).over(within) * F.pow(F.lit(keep), F.col("__k") + 1))
    ends = rows.groupBy("market", "__b").agg(F.max_by("__own", "__k").alias("own"), F.max("__k").alias("k")).groupBy("market").agg(F.array_sort(F.collect_list(F.struct(F.col("__b").alias("b"), "own", "k"))).alias("blocks"))
    start = F.struct(F.col("__seed").alias("carry"), F.expr("cast(array() as array<struct<b:bigint,carry:double>>)").alias("out"))

    def step(a, r):
        return F.struct((a["carry"] * F.pow(F.lit(keep), r["k"] + 1) + r["own"]).alias("carry"), F.concat(a["out"], F.array(F.struct(r["b"].alias("b"), a["carry"].alias("carry")))).alias("out"))

    carried = ends.join(seed, "market").select("market", F.explode(F.aggregate("blocks", start, step)["out"]).alias("c")).select("market", F.col("c.b").alias("__b"), F.col("c.carry").alias("__carry"))
    later = rows.join(carried, ["market", "__b"]).select("market", "ts", (F.col("__own") + F.col("__carry") * F.pow(F.lit(keep), F.col("__k") + 1)).alias(name))
    return df.join(later.unionByName(seed.select("market", F.col("__last").alias("ts"), F.col("__seed").alias(name))), ["market", "ts"], "left")


BASE = 16


def order_counts(df: DataFrame, x: str, n: int | None = None) -> DataFrame:
    """Adds less, equal and held: how many of the market's known values so far (or of the last n) are below x, equal to it, and in
    all; null where x is null.

    Values become dense ranks, written in as many digits of BASE as the longest market needs. Those below a rank share its first digits up to one, where they
    are lower: for each digit, one running count by lower digit over the rows that share the digits before it. A value that
    leaves a window of n counts -1 from then on. So nothing is gathered, and the work is n log n.
    """
    known = df.where(F.col(x).isNotNull()).select("market", "ts", F.col(x).alias("__x"))
    by_value = Window.partitionBy("market").orderBy("__x")
    rows = known.withColumn("__r", (F.dense_rank().over(by_value) - 1).cast("long")).withColumn("__i", F.row_number().over(by_time())).withColumn("__add", F.lit(1))
    if n is not None:
        rows = rows.unionByName(rows.withColumn("__i", F.col("__i") + n).withColumn("__add", F.lit(-1)))
    so_far = Window.partitionBy("market").orderBy("__i", "__add").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("held", F.sum("__add").over(so_far)).withColumn("less", F.lit(0).cast("long"))
    for place in range(sliding.digits(df, x, BASE) - 1, -1, -1):
        unit = BASE**place
        digit = F.floor(F.col("__r") / unit).cast("int") % BASE
        shared = Window.partitionBy("market", F.floor(F.col("__r") / (unit * BASE))).orderBy("__i", "__add").rowsBetween(Window.unboundedPreceding, 0)
        counts = [F.sum(F.when(F.col("__d") == d, F.col("__add")).otherwise(0)).over(shared) for d in range(BASE)]
        rows = rows.withColumn("__d", digit).withColumn("__c", F.array(*counts))
        rows = rows.withColumn("less", F.col("less") + F.aggregate(F.slice("__c", 1, F.col("__d")), F.lit(0).cast("long"), lambda a, c: a + c))
        if place == 0:
            rows = rows.withColumn("equal", F.get("__c", F.col("__d")))
    found = rows.where("__add = 1").select("market", "ts", "less", "equal", "held")
    return df.join(found, ["market", "ts"], "left")


def percentile_of_last(df: DataFrame, x: str, n: int, name: str = "percentile") -> DataFrame:
    """Average rank of x among the last n known values, over n; null until they are n."""
    out = order_counts(df, x, n)
    return out.withColumn(name, F.when(F.col("held") == n, (F.col("less") + (F.col("equal") + 1) / 2) / n)).drop("less", "equal", "held")


def path_ahead(x: Column, n: int) -> tuple[Column, Column, Column]:
    """Return, lowest and highest relative value over the n rows ahead; null unless all are there."""
    w = by_time().rowsBetween(1, n)
    ok = F.count(x).over(w) == n
    return tuple(F.when(ok, F.try_divide(value, x) - 1) for value in (F.lead(x, n).over(by_time()), F.min(x).over(w), F.max(x).over(w)))


def win_rate(x: Column, n: int, threshold: float = 0.0) -> Column:
    """Share of the window's rows with a return over the threshold; a row without a return is none."""
    wins = F.coalesce((simple_return(x) > threshold).cast("double"), F.lit(0.0))
    return F.when(F.count(F.lit(1)).over(last(n)) == n, F.avg(wins).over(last(n)))


def weighted_momentum(x: Column, turnover: Column, n: int) -> Column:
    """Sum of returns weighted by turnover, over the turnover's sum."""
    part, total = simple_return(x) * turnover, F.sum(turnover).over(last(n))
    return full(part, F.when(total != 0, F.sum(part).over(last(n)) / total), n)


def next_open_label(x: Column, horizon: int) -> Column:
    """The return from the row after to horizon rows after that."""
    return F.try_divide(F.lead(x, horizon + 1).over(by_time()), F.lead(x, 1).over(by_time())) - 1


def mid_rank(df: DataFrame, x: str, n: int, least: int, name: str = "mid") -> DataFrame:
    """Share of the last n known values below x and half of those equal to it, once least values are there."""
    out = order_counts(df, x, n)
    return out.withColumn(name, F.when(F.col("held") >= least, F.try_divide(F.col("less") + F.col("equal") / 2, "held"))).drop("less", "equal", "held")


def turnover_scores(df: DataFrame, x: str, n: int, ratio: str = "turn_ratio", z: str = "turn_z") -> DataFrame:
    """Adds log1p of x over its window mean, and as a z-score with the sample deviation."""
    y = F.log1p(x)
    made = sliding.over_last(df, n, "__w", sliding.moments(("x", y)))
    mean, std = sliding.mean("__w", n), sliding.std("__w", n, sample=True)
    return made.select(*df.columns, F.when(mean != 0, y / mean).alias(ratio), F.when(std > 0, (y - mean) / std).alias(z))


def expanding_percentile(df: DataFrame, x: str, least: int, name: str = "percentile") -> DataFrame:
    """Average rank of x among the market's values so far, over their number, once least values are there."""
    out = order_counts(df, x)
    return out.withColumn(name, F.when(F.col("held") >= least, F.try_divide(F.col("less") + (F.col("equal") + 1) / 2, "held"))).drop("less", "equal", "held")


def holding_state(df: DataFrame, entry: str, leave: str, cooldown: int = 0, longest: int | None = None) -> DataFrame:
    """held: 1 from an entry flag to an exit flag, else 0, over grid rows.

    A row with an unknown flag is null and keeps the state. After an exit, cooldown known rows pass before an entry counts.
    A holding of longest rows ends on its own; the entry flag must then have been 0 before it counts again. Each market's
    rows (as many as the calendar's) are one group, which goes from holding to holding, not from row to row.
    """
    schema = StructType([*df.schema.fields, StructField("held", DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        return pdf.assign(held=holdings(pdf[entry].to_numpy(float), pdf[leave].to_numpy(float), cooldown, longest)[0])

    return nan_to_null(df.groupBy("market").applyInPandas(run, schema), "held")


def holdings(entry: np.ndarray, leave: np.ndarray, cooldown: int, longest: int | None) -> tuple[np.ndarray, int]:
    """held, and the row from which on the rest comes out the same without the rows before it: the start of a holding that is not over
    and free of its conditions yet, or the end of the rows."""
    n = len(entry)
    known = ~(np.isnan(entry) | np.isnan(leave))
    places, opens, closes, resets = (np.flatnonzero(m) for m in (known, known & (entry != 0), known & (leave != 0), entry == 0))
    out = np.where(known, 0.0, np.nan)

    def first_from(where: np.ndarray, at: int) -> int:
        k = int(np.searchsorted(where, at))
        return int(where[k]) if k < len(where) else n

    start, resume = first_from(opens, 0), n
    while start < n:
        limit = n if longest is None else start + longest
        end = min(first_from(closes, start + 1), limit, n)
        out[start:end][known[start:end]] = 1.0
        after = int(np.searchsorted(places, end, "right")) + cooldown  # so many known rows pass after the end
        free = int(places[after]) if after < len(places) else n
        if end < n and end == limit:
            out[end] = 0.0
            if entry[end] != 0:
                free = max(free, first_from(resets, end + 1))
        resume = start if free == n else n
        start = first_from(opens, free)
    return out, resume


def nan_to_null(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def turnover_percentile(df: DataFrame, x: str, n: int, log1p: bool = True, name: str = "turnover_percentile") -> DataFrame:
    """Average rank of the turnover among its last n known values, over n."""
    made = df.withColumn("__t", F.log1p(x) if log1p else F.col(x))
    return percentile_of_last(made, "__t", n, name).drop("__t")

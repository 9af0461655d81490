"""Seeded resampling of return series: moving and stationary blocks, and what is tested with them.

Draws come from a hash of (seed, replicate, position), so they are the same in every run and on every executor, and all replicates
of all series are one job: a table of positions joined to the returns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def block_mean(df: DataFrame, x: str, block: int, reps: int, seed: int, by: str = "run_id") -> DataFrame:
    """By series: n, mean, its 2.5 % and 97.5 % bounds and two-sided p by moving blocks. A replicate is the mean of ceil(n / block)
    overlapping blocks, drawn evenly; fewer than two blocks of data (or three values) give nulls."""
    order = Window.partitionBy(by).orderBy("ts")
    known = df.where(F.col(x).isNotNull()).select(by, "ts", F.col(x).alias("__x")).withColumn("__i", F.row_number().over(order) - 1)
    size = known.groupBy(by).agg(F.count("*").alias("n"), F.avg("__x").alias("mean"))
    ahead = order.rowsBetween(0, block - 1)
    blocks = known.withColumn("__m", F.avg("__x").over(ahead)).withColumn("__c", F.count("*").over(ahead)).where(F.col("__c") == block).select(by, "__i", "__m")
    usable = size.where((F.col("n") >= 3) & (F.col("n") >= 2 * block))
    draws = usable.select(by, "n", "mean", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))
    picked = draws.withColumn("__i", F.floor(uniform(seed, F.col("rep"), F.col("k")) * (F.col("n") - block + 1)).cast("int")).join(blocks, [by, "__i"])
    means = picked.groupBy(by, "rep").agg(F.avg("__m").alias("m"), F.first("mean").alias("mean"))
    far = F.count(F.when(F.abs(F.col("m") - F.col("mean")) >= F.abs("mean"), 1))
    stats = means.groupBy(by).agg(F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper"), ((far + 1) / (reps + 1)).alias("p"))
    return size.join(stats, by, "left")


def stationary_positions(n: DataFrame, block: int, reps: int, seed: int) -> DataFrame:
    """n: one row with the column n. rep, k, pos: a replicate's k-th row is row pos; with chance 1 / block a new run starts at an even
    draw, otherwise the row after (from the last to the first)."""
    cells = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    fresh = (F.col("k") == 0) | (uniform(seed, "start", F.col("rep"), F.col("k")) < 1.0 / block)
    start = F.when(fresh, F.struct(F.floor(uniform(seed, "at", F.col("rep"), F.col("k")) * F.col("n")).alias("at"), F.col("k").alias("k0")))
    so_far = Window.partitionBy("rep").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    run = F.last(start, ignorenulls=True).over(so_far)
    return cells.withColumn("__r", run).select("rep", "k", F.pmod(F.col("__r.at") + F.col("k") - F.col("__r.k0"), F.col("n")).cast("int").alias("pos"))


def block_positions(n: DataFrame, block: int, reps: int, seed: int, wrap: bool) -> DataFrame:
    """As stationary_positions, in blocks of one length: with wrap they start anywhere and go on at the first row after the last
    (circular), else they start where they fit (moving)."""
    cells = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    starts = F.col("n") if wrap else F.greatest(F.lit(1), F.col("n") - block + 1)
    at = F.floor(uniform(seed, "block", F.col("rep"), F.floor(F.col("k") / block)) * starts)
    return cells.select("rep", "k", F.pmod(at + F.col("k") % block, F.col("n")).cast("int").alias("pos"))


def positions_of(kind: str, n: DataFrame, block: int, reps: int, seed: int) -> DataFrame:
    """Positions of the replicates by kind: stationary, circular or moving."""
    if kind == "stationary":
        return stationary_positions(n, block, reps, seed)
    if kind not in ("circular", "moving"):
        raise ValueError(f"no bootstrap of kind {kind}")
    return block_positions(n, block, reps, seed, kind == "circular")


LAG_BLOCK = 4096


def lag_products(df: DataFrame, x: str, by: str) -> DataFrame:
    """by, n, lag, cross, head, tail: of each series less its mean, the sum of products lag rows apart, and the sums of squares of its
    first and last lag + 1 rows, for lags up to sqrt(n) and a few more. Rows are dealt in blocks with the rows before them that
    they need, so a task holds a block, and the work is rows times lags without a row for each."""
    order = Window.partitionBy(by).orderBy("ts")
    known = df.where(F.col(x).isNotNull()).select(by, "ts", F.col(x).cast("double").alias("__x"))
    size = known.groupBy(by).agg(F.count("*").alias("n"), F.avg("__x").alias("__mean"))
    size = size.withColumn("most", F.ceil(F.sqrt("n")) + F.greatest(F.lit(5), F.floor(F.log10("n"))))
    rows = known.withColumn("i", F.row_number().over(order) - 1).join(size, by).withColumn("e", F.col("__x") - F.col("__mean"))
    length = F.greatest(F.lit(LAG_BLOCK), F.col("most"))
    own = F.floor(F.col("i") / length)
    late = F.col("i") % length >= length - F.col("most")
    dealt = rows.select(by, "n", "most", "i", "e", own.alias("own"), F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        e, mine = pdf["e"].to_numpy(), (pdf["own"] == pdf["block"]).to_numpy()
        n, most = int(pdf["n"].iloc[0]), int(pdf["most"].iloc[0])
        at = pdf["i"].to_numpy()
        now, first = np.flatnonzero(mine), int(at[0])
        cross = np.zeros(most + 1)
        for lag in range(min(most, n - 1) + 1) if len(now) else []:
            here = now[at[now] - lag >= first]
            cross[lag] = e[here] @ e[here - lag]
        lags = np.arange(most + 1)
        ends = [np.bincount(places[mine & (places <= most)], e[mine & (places <= most)] ** 2, minlength=most + 1) for places in (at, n - 1 - at)]
        return pd.DataFrame({by: pdf[by].iloc[0], "n": n, "lag": lags, "cross": cross, "head": ends[0], "tail": ends[1]})

    parts = dealt.groupBy(by, "block").applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, n long, lag int, cross double, head double, tail double")
    sums = parts.groupBy(by, "n", "lag").agg(*[F.sum(c).alias(c) for c in ("cross", "head", "tail")])
    so_far = Window.partitionBy(by).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumns({c: F.sum(c).over(so_far) for c in ("head", "tail")})


def block_lengths(df: DataFrame, x: str, by: str = "run_id") -> DataFrame:
    """by, n, lags, stationary, circular: the block lengths that make the error of a bootstrap's variance least, from the series'
    own autocovariances (Politis and White, with Patton's correction): a flat-top window of twice the first lag after which a run of
    lags is insignificant. Series of fewer than ten values or without variance get nulls."""
    w = Window.partitionBy(by)
    lags = lag_products(df, x, by).where(F.col("n") >= 10)
    square = F.max(F.when(F.col("lag") == 0, F.col("cross"))).over(w)
    run = F.greatest(F.lit(5), F.floor(F.log10("n")))
    rho = F.try_divide(F.abs("cross"), F.sqrt((square - F.col("head")) * (square - F.col("tail"))))
    rows = lags.withColumn("small", (rho < 2 * F.sqrt(F.log10("n") / F.col("n"))).cast("int")).withColumn("run", run.cast("int")).withColumn("most", F.max("lag").over(w))
    counted = rows.withColumn("__s", F.sum("small").over(w.orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.when(F.col("lag") == F.col("run"), F.lit(0)).otherwise(F.col("__b"))
    # how many of the run lags right before this one are small
    earlier = counted.select(by, (F.col("lag") + F.col("run")).alias("lag"), F.coalesce("__s", F.lit(0)).alias("__b"))
    starts = counted.join(earlier, [by, "lag"]).where(F.col("__s") - before == F.col("run")).groupBy(by).agg(F.min(F.col("lag") - F.col("run")).alias("first"))
    chosen = rows.join(starts, by, "left").withColumn("lags", F.when(F.col("first").isNull(), F.col("most")).otherwise(F.least(F.col("most"), 2 * F.greatest(F.col("first"), F.lit(1)))))
    ratio = F.col("lag") / F.col("lags")
    weight = F.when(F.col("lag") > F.col("lags"), 0.0).when(ratio <= 0.5, 1.0).otherwise(2 * (1 - ratio))
    cov = F.col("cross") / F.col("n")
    sums = chosen.groupBy(by, "n", "lags").agg(F.sum(2 * weight * F.col("lag") * cov).alias("g"), F.sum(F.when(F.col("lag") == 0, cov).otherwise(2 * weight * cov)).alias("long_run"))
    limit = F.ceil(F.least(3 * F.sqrt("n"), F.col("n") / 3)).cast("double")
    best = lambda c: F.when(F.col("long_run") != 0, F.least(limit, F.pow(F.try_divide(2 * F.col("g") * F.col("g"), c * F.col("long_run") * F.col("long_run")), 1 / 3) * F.pow(F.col("n").cast("double"), 1 / 3)))
    made = sums.select(by, "n", F.col("lags").cast("int").alias("lags"), best(F.lit(2.0)).alias("stationary"), best(F.lit(4.0) / 3).alias("circular"))
    every = df.groupBy(by).agg(F.count(x).alias("n"))
    return every.join(made.drop("n"), by, "left")


def chosen_block(df: DataFrame, x: str, block: int | str, by: str, kind: str = "stationary") -> int:
    """block itself, or for "auto" the median of the series' best lengths for that kind, 1 at least: one number for all of them."""
    if block != "auto":
        return int(block)
    length = block_lengths(df, x, by).agg(F.percentile("stationary" if kind == "stationary" else "circular", 0.5)).first()[0]
    return max(1, round(length or 1))


def _numbered(returns: DataFrame, series: str) -> DataFrame:
    """Only times at which every series has a return, numbered from 0."""
    kinds = returns.select(series).distinct().count()
    full = returns.groupBy("ts").agg(F.count("*").alias("__c")).where(F.col("__c") == kinds).select("ts").withColumn("pos", F.row_number().over(Window.orderBy("ts")) - 1)  # a calendar
    return returns.join(full, "ts")


def uncertainty(pairs: DataFrame, block: int | str, reps: int, seed: int, per_year: int, kind: str = "stationary") -> DataFrame:
    """pairs: run_id, ts, strategy, benchmark (returns). By run over replicates of one kind: 5 % quantiles of growth a year and of its
    excess, the share below the benchmark, and 95 % quantiles of the worst drawdown and of the longest time below a high."""
    block = chosen_block(pairs, "strategy", block, "run_id", kind)
    order = Window.partitionBy("run_id").orderBy("ts")
    rows = pairs.withColumn("pos", F.row_number().over(order) - 1)
    sizes = rows.groupBy("run_id").agg(F.count("*").alias("n"))
    positions = None
    for r in sizes.select("n").distinct().collect():  # as many as there are lengths of history
        one = positions_of(kind, sizes.where(F.col("n") == r.n).select("n").distinct(), block, reps, seed).withColumn("n", F.lit(r.n))
        positions = one if positions is None else positions.unionByName(one)
    drawn = sizes.join(positions, "n").join(rows, ["run_id", "pos"]).select("run_id", "n", "rep", "k", "strategy", "benchmark")
    so_far = Window.partitionBy("run_id", "rep").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    curve = drawn.withColumn("level", F.exp(F.sum(F.log1p("strategy")).over(so_far))).withColumn("high", F.greatest(F.lit(1.0), F.max("level").over(so_far)))
    peak = F.col("level") >= F.col("high") * (1 - 1e-15)
    last_peak = F.coalesce(F.max(F.when(peak, F.col("k"))).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    gap = F.when(peak & (F.col("k") - F.col("__p") > 1), F.col("k") - F.col("__p")).when(~peak, F.col("k") - F.col("__p")).otherwise(0)
    curve = curve.withColumn("__p", last_peak)
    year = F.lit(float(per_year)) / F.first("n")
    by_rep = curve.groupBy("run_id", "rep").agg(
        ((F.exp(F.sum(F.log1p("strategy")) * year) - 1) * 100).alias("cagr"), ((F.exp(F.sum(F.log1p("benchmark")) * year) - 1) * 100).alias("bench"),
        (F.max(1 - F.col("level") / F.col("high")) * 100).alias("mdd"), F.max(gap).alias("longest"), (F.sum(F.log1p("strategy")) < F.sum(F.log1p("benchmark"))).cast("double").alias("below"),
    )
    return by_rep.groupBy("run_id").agg(
        F.percentile("cagr", 0.05).alias("cagr_p05"), F.percentile(F.col("cagr") - F.col("bench"), 0.05).alias("excess_p05"), (F.avg("below") * 100).alias("under_pct"),
        F.percentile("mdd", 0.95).alias("mdd_p95"), F.percentile("longest", 0.95).alias("longest_p95"),
    )


def bootstrap_means(returns: DataFrame, block: int | str, reps: int, seed: int, kind: str = "stationary") -> tuple[DataFrame, DataFrame]:
    """returns: candidate, ts, d. (candidate, n, mean, omega) over the common times, and (candidate, rep, m): the means of the
    replicates (stationary, circular or moving), which take the same rows of all candidates; omega is sqrt(n) times their
    deviation. The block may be "auto"."""
    block = chosen_block(returns, "d", block, "candidate", kind)
    rows = _numbered(returns, "candidate")
    stats = rows.groupBy("candidate").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    positions = positions_of(kind, stats.agg(F.max("n").alias("n")), block, reps, seed)
    # a replicate takes some rows more than once: their counts come first, so the join is smaller
    times = positions.groupBy("rep", "pos").agg(F.count("*").alias("__t"))
    means = rows.select("candidate", "pos", "d").join(times, "pos").groupBy("candidate", "rep").agg((F.sum(F.col("d") * F.col("__t")) / F.sum("__t")).alias("m"))
    spread = means.groupBy("candidate").agg(F.stddev_pop("m").alias("__s"))
    return stats.join(spread, "candidate").withColumn("omega", F.col("__s") * F.sqrt("n")).drop("__s"), means


def superior_ability(returns: DataFrame, block: int | str, reps: int, seed: int, kind: str = "stationary") -> DataFrame:
    """One row: the studentised maximum of sqrt(n) mean / omega over candidates and its p-values by three recentrings of the
    replicates: lower (negative means stay), consistent (means far below 0 stay), upper (all are centred)."""
    stats, means = bootstrap_means(returns, block, reps, seed, kind)
    stats = stats.where("omega > 0")
    t = F.sqrt("n") * F.col("mean") / F.col("omega")
    far = F.col("mean") < -F.col("omega") / F.sqrt("n") * F.sqrt(2 * F.log(F.log("n")))
    centres = stats.withColumn("lower", F.greatest("mean", F.lit(0.0))).withColumn("consistent", F.when(far, 0.0).otherwise(F.col("mean"))).withColumn("upper", F.col("mean"))
    observed = stats.agg(F.greatest(F.max(t), F.lit(0.0)).alias("statistic"), F.count("*").alias("candidates"))
    kinds = ("lower", "consistent", "upper")
    z = [F.greatest(F.max(F.sqrt("n") * (F.col("m") - F.col(k)) / F.col("omega")), F.lit(0.0)).alias(k) for k in kinds]
    best = means.join(centres.select("candidate", "n", "omega", *kinds), "candidate").groupBy("rep").agg(*z)
    return best.crossJoin(observed).groupBy("candidates", "statistic").agg(*[F.avg((F.col(k) > F.col("statistic")).cast("double")).alias(f"p_{k}") for k in kinds])  # one row beside


def stepwise_superior(returns: DataFrame, block: int | str, reps: int, seed: int, size: float = 0.05, kind: str = "stationary") -> DataFrame:
    """Candidates whose mean is above 0 by step-down tests: in each step those beyond the (1 - size) quantile of the largest
    studentised deviation of the candidates left are taken out; superior, and step (1, 2, ...) for those.

    The table of candidates by replicate is written once; a step is one pass over it, and every step but the last takes one
    candidate out at least.
    """
    from ..sources.files import read_table, scratch, write_table

    stats, means = bootstrap_means(returns, block, reps, seed, kind)
    spark = returns.sparkSession
    stats = read_table(spark, write_table(stats.where("omega > 0"), scratch(spark, "step-stats")))
    z = means.join(stats, "candidate").select("candidate", "rep", (F.sqrt("n") * (F.col("m") - F.col("mean")) / F.col("omega")).alias("z"))
    z = read_table(spark, write_table(z, scratch(spark, "step-means")))
    left, found, step = stats.withColumn("t", F.sqrt("n") * F.col("mean") / F.col("omega")).select("candidate", "t"), None, 0
    while True:
        step += 1
        critical = z.join(left.select("candidate"), "candidate", "left_semi").groupBy("rep").agg(F.max("z").alias("z")).agg(F.percentile("z", 1 - size).alias("c")).first().c
        if critical is None:
            break
        out = left.where(F.col("t") > critical).withColumn("step", F.lit(step))
        if not out.head(1):
            break
        found = out if found is None else found.unionByName(out)
        left = left.where(F.col("t") <= critical)
    marks = found.select("candidate", "step") if found is not None else stats.select("candidate", F.lit(None).cast("int").alias("step")).where("false")
    return stats.select("candidate", "mean").join(marks, "candidate", "left").withColumn("superior", F.col("step").isNotNull())


def without_twins(returns: DataFrame) -> DataFrame:
    """Of candidates with the same returns at all times, the first by name."""
    digest = F.sum(F.xxhash64("ts", "d").cast("decimal(38,0)"))
    keys = returns.groupBy("candidate").agg(F.count("*").alias("__n"), digest.alias("__h"))
    first = keys.groupBy("__n", "__h").agg(F.min("candidate").alias("candidate"))
    return returns.join(first.select("candidate"), "candidate", "left_semi")


def confidence_set(returns: DataFrame, block: int | str, reps: int, seed: int, kind: str = "stationary", method: str = "max") -> DataFrame:
    """candidate, mean, order, p: candidates leave one by one, and p is the share of replicates with a deviation as large as theirs, and never
    less than that of one that left before. Who has p above a level is in the set of that level; the last one has p = 1.
    By "max" the one furthest below the mean of those left goes, by studentised deviations from it; by "R" the one with the largest
    studentised distance to another that is better, tested by the range over all pairs left.

    Both need only the candidates' products over the replicates, K x K numbers of K candidates (a matrix of one task, so the
    candidates are as many as its memory takes): they fix the order in which candidates leave. One pass over the replicates then
    gives all steps' deviations at once, and a running maximum the p. So it is one written table and one action, however many candidates leave.
    """
    from ..sources.files import written

    stats, means = bootstrap_means(returns, block, reps, seed, kind)
    centred = means.join(stats.select("candidate", "mean"), "candidate").select("candidate", "rep", "mean", (F.col("m") - F.col("mean")).alias("c"))
    vectors = centred.groupBy("candidate").agg(F.first("mean").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("rep", "c"))), lambda x: x["c"]).alias("held"))
    vectors = written(vectors, "set-vectors")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("candidate", ignore_index=True)
        deviations, average = np.stack(pdf["held"]).T, pdf["mean"].to_numpy()
        order, largest, observed = (_leave_by_mean if method == "max" else _leave_by_range)(deviations, average)
        p = np.maximum.accumulate(np.r_[(largest >= observed).mean(0) if len(order) > 1 else [], 1.0])
        return pd.DataFrame({"candidate": pdf["candidate"].to_numpy()[order], "mean": average[order], "order": np.arange(1, len(order) + 1, dtype=np.int32), "p": p})

    return vectors.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(run, "candidate string, mean double, `order` int, p double")


def _leave_by_mean(dev: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dev: replicates by candidates. The order of leaving; for each step but the last the replicates' largest deviation, and the
    observed one. Sums over those left are kept up, so a step costs one row of the products."""
    reps, k = dev.shape
    gram = dev.T @ dev / reps
    left, row, total, means = np.ones(k, bool), gram.sum(1), gram.sum(), mean.sum()
    own, sums, order = np.diag(gram).copy(), dev.sum(1), []
    largest, observed = np.zeros((reps, max(0, k - 1))), np.zeros(max(0, k - 1))
    for step in range(k - 1):
        n = k - step
        spread = np.sqrt(np.maximum(own - 2 * row / n + total / (n * n), 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(left & (spread > 0), (means / n - mean) / spread, -np.inf)
            z = (sums[:, None] / n - dev[:, left]) / spread[left]
        out = int(np.argmax(t)) if np.isfinite(t).any() else int(np.flatnonzero(left)[0])
        largest[:, step], observed[step] = np.nanmax(np.where(np.isfinite(z), z, -np.inf), axis=1), t[out]
        order.append(out)
        left[out] = False
        total += own[out] - 2 * row[out]
        row, means, sums = row - gram[out], means - mean[out], sums - dev[:, out]
    return np.array([*order, *np.flatnonzero(left)]), largest, observed


def _leave_by_range(dev: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _leave_by_mean, by the range over pairs: a pair's spread does not change when others leave, so each pair's largest deviation is
    taken once, and pairs leave with their members."""
    reps, k = dev.shape
    gram = dev.T @ dev / reps
    own = np.diag(gram)
    spread = np.sqrt(np.maximum(own[:, None] + own[None, :] - 2 * gram, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(spread > 0, (mean[None, :] - mean[:, None]) / spread, -np.inf)  # row below column
    left, order = np.ones(k, bool), []
    for _ in range(k - 1):
        here = np.where(left[:, None] & left[None, :], t, -np.inf)
        out = int(np.argmax(here.max(1))) if np.isfinite(here).any() else int(np.flatnonzero(left)[0])
        order.append(out)
        left[out] = False
    order = np.array([*order, *np.flatnonzero(left)])
    # from the last to the first: a step's pairs are those of the step after and those of the one that leaves
    largest, observed = np.zeros((reps, max(0, k - 1))), np.zeros(max(0, k - 1))
    high, seen = np.zeros(reps), 0.0
    for step in range(k - 2, -1, -1):
        one, others = order[step], order[step + 1 :]
        ok = spread[one, others] > 0
        if ok.any():
            high = np.maximum(high, np.abs((dev[:, others[ok]] - dev[:, [one]]) / spread[one, others[ok]]).max(1))
            seen = max(seen, float((np.abs(mean[others[ok]] - mean[one]) / spread[one, others[ok]]).max()))
        largest[:, step], observed[step] = high, seen
    return order, largest, observed

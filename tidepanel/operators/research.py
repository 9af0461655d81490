"""Research over many candidates at once: information coefficients, bucket returns, cross-validation of selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import asof
from . import cross_section as xs


def _correlation(x: str, y: str) -> Column:
    """Null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def row_ic(df: DataFrame, factor: str, label: str, min_count: int) -> DataFrame:
    """Pearson and rank correlation of factor and label across markets, by time."""
    both = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    ranked = both.withColumn("__f", xs.average_percent_rank(F.col(factor))).withColumn("__l", xs.average_percent_rank(F.col(label)))
    out = ranked.groupBy("ts").agg(F.count("*").alias("n"), _correlation(factor, label).alias("ic"), _correlation("__f", "__l").alias("rank_ic"))
    return out.where(F.col("n") >= min_count)


def bucket_returns(df: DataFrame, factor: str, label: str, q: int) -> DataFrame:
    both = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    return both.withColumn("bucket", xs.quantile_bucket(F.col(factor), q)).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(label).alias("mean_label"), F.percentile(label, 0.5).alias("median_label"))


def consecutive_blocks(returns: DataFrame, blocks: int) -> DataFrame:
    """block: 0 .. blocks - 1, equal runs of the calendar's times."""
    days = returns.select("ts").distinct()
    place = F.row_number().over(Window.orderBy("ts")) - 1  # a calendar
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    return returns.join(days.select("ts", F.floor(place * blocks / n).cast("int").alias("block")), "ts")


def cscv_splits(spark: SparkSession, blocks: int, max_splits: int = 0, seed: int = 0) -> DataFrame:
    """split, block, inside: each half of the blocks as the sample, by bit masks counted by Spark. With max_splits (even), so many
    at most: pairs of complements, picked by a hash."""
    if blocks % 2 or max_splits % 2:
        raise ValueError("blocks and max_splits must be even")
    masks = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2)
    if max_splits:
        pair = F.least("id", F.lit((1 << blocks) - 1) - F.col("id"))
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), pair.cast("string")).cast("binary"))
        masks = masks.withColumn("__o", order).orderBy("__o", "id").limit(max_splits).drop("__o")
    return masks.select(F.col("id").alias("split"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("inside", F.getbit("split", F.col("block")).cast("int"))


METRICS = ("sharpe", "cvar_sharpe", "log_return", "simple_return", "martin", "calmar")


def split_scores(returns: DataFrame, splits: DataFrame, metric: str = "sharpe", per_year: int = 252) -> DataFrame:
    """returns: candidate, block, ts, ret. split, inside, candidate, score. Blocks are summed once, as count, mean and sum of squared
    deviations, which merge without cancelling; metrics that need the returns in order join them."""
    by = ["split", "inside", "candidate"]
    year = per_year**0.5
    if metric in ("sharpe", "log_return", "simple_return"):
        stats = returns.groupBy("candidate", "block").agg(F.count("*").cast("double").alias("n"), F.avg("ret").alias("mean"), (F.var_pop("ret") * F.count("*")).alias("m2"), F.sum(F.log1p("ret")).alias("logs"))
        held = stats.join(F.broadcast(splits) if splits.limit(100_001).count() <= 100_000 else splits, "block").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("block", "n", "mean", "m2"))).alias("parts"), F.sum("logs").alias("logs"))
        zero = F.lit(0.0)

        def merge(a, p):
            n, gap = a["n"] + p["n"], p["mean"] - a["mean"]
            return F.struct(n.alias("n"), (a["mean"] + gap * p["n"] / n).alias("mean"), (a["m2"] + p["m2"] + gap * gap * a["n"] * p["n"] / n).alias("m2"))

        whole = F.aggregate("parts", F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("m2")), merge)
        merged = held.withColumn("__w", whole)
        score = {"sharpe": F.try_divide(F.col("__w.mean"), F.sqrt(F.col("__w.m2") / F.col("__w.n"))) * year, "log_return": F.col("logs"), "simple_return": F.expm1("logs")}[metric]
        return merged.select(*by, score.alias("score"))
    rows = returns.join(splits, "block").select(*by, "ts", "ret")
    if metric == "cvar_sharpe":
        low = rows.groupBy(*by).agg(F.percentile("ret", 0.05).alias("__q"))
        tail = F.abs(F.avg(F.when(F.col("ret") <= F.col("__q"), F.col("ret"))))
        return rows.join(low, by).groupBy(*by).agg((F.try_divide(F.avg("ret"), tail) * year).alias("score"))
    so_far = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.withColumn("__l", F.exp(F.sum(F.log1p("ret")).over(so_far))).withColumn("__d", F.col("__l") / F.greatest(F.lit(1.0), F.max("__l").over(so_far)) - 1)
    risk = F.sqrt(F.avg(F.col("__d") * F.col("__d"))) if metric == "martin" else F.abs(F.min("__d"))
    return curve.groupBy(*by).agg(F.try_divide(F.expm1(F.sum(F.log1p("ret")) * per_year / F.count("*")), risk).alias("score"))


def cscv_selection(scores: DataFrame) -> DataFrame:
    """For each split, the best candidate in sample (ties by name), its rank out of sample over n + 1 (average rank, 1 / (n + 1) the
    worst), and the rank's log odds. An undefined score raises."""
    sound = F.when(F.col("score").isNull(), F.raise_error(F.lit("undefined score")).cast("double")).otherwise(F.round("score", 10))
    by_split = scores.withColumn("score", sound).groupBy("split", "candidate").agg(F.max(F.when(F.col("inside") == 1, F.col("score"))).alias("inside"), F.max(F.when(F.col("inside") == 0, F.col("score"))).alias("outside"))
    at = Window.partitionBy("split")
    ties = F.count("*").over(Window.partitionBy("split", "outside"))
    place = (F.rank().over(at.orderBy("outside")) + (ties - 1) / 2) / (F.count("*").over(at) + 1)
    best = F.row_number().over(at.orderBy(F.desc("inside"), F.asc("candidate")))
    picked = by_split.withColumn("oos_rank", place).withColumn("__b", best).where("__b = 1")
    return picked.select("split", "candidate", F.col("inside").alias("is_score"), F.col("outside").alias("oos_score"), "oos_rank", F.log(F.col("oos_rank") / (1 - F.col("oos_rank"))).alias("logit"))


def overfitting(selection: DataFrame) -> DataFrame:
    """By candidate: splits won, their share, and mean scores; with the probability of overfitting (share of all splits with log odds
    of 0 or below) and of a loss out of sample beside each."""
    every = selection.agg(F.count("*").alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg((F.col("oos_score") < 0).cast("double")).alias("loss"))
    own = selection.groupBy("candidate").agg(F.count("*").alias("wins"), F.avg("is_score").alias("is_score"), F.avg("oos_score").alias("oos_score"))
    return own.crossJoin(F.broadcast(every)).withColumn("win_share", F.col("wins") / F.col("splits"))  # one row


def ic_summary(ics: DataFrame, ic: str = "ic") -> DataFrame:
    """By year and over all (year null): n, mean, deviation, t-value and share above 0 of an information coefficient."""
    stats = [F.count(ic).alias("n"), F.avg(ic).alias("mean"), F.stddev_samp(ic).alias("std"), F.avg((F.col(ic) > 0).cast("double")).alias("positive")]
    out = ics.groupBy(F.year("ts").alias("yr")).agg(*stats).unionByName(ics.agg(*stats).withColumn("yr", F.lit(None).cast("int")))
    return out.withColumn("t_value", F.try_divide("mean", "std") * F.sqrt("n"))


def bucket_spread(df: DataFrame, factor: str, label: str, q: int, least: int) -> DataFrame:
    """By time with so many markets: the top bucket's mean label less the bottom one's."""
    both = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    placed = both.withColumn("__b", xs.quantile_bucket(F.col(factor), q))
    out = placed.groupBy("ts").agg(F.count("*").alias("n"), (F.avg(F.when(F.col("__b") == q, F.col(label))) - F.avg(F.when(F.col("__b") == 1, F.col(label)))).alias("spread"))
    return out.where(F.col("n") >= least)


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Chance that a row labelled 1 has a higher score than one labelled 0, ties half: from average ranks."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ties = F.count("*").over(Window.partitionBy(*by, score))
    rank = F.rank().over(Window.partitionBy(*by).orderBy(score)) + (ties - 1) / 2
    out = known.withColumn("__r", rank).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("ones"), F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("__s"))
    ones, zeros = F.col("ones"), F.col("n") - F.col("ones")
    return out.select(*by, "n", ones.cast("long").alias("ones"), F.try_divide(F.col("__s") - ones * (ones + 1) / 2, ones * zeros).alias("auc"))


def band(x: Column, edges: tuple[float, ...]) -> Column:
    """Which of the bands between the edges x lies in, from 0; an edge belongs to the band above."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return F.when(x.isNotNull(), out)


def crosstab(df: DataFrame, x: Column, y: Column, label: str) -> DataFrame:
    """Rows, and mean label, by two bands."""
    return df.withColumn("x_band", x).withColumn("y_band", y).where("x_band is not null and y_band is not null").groupBy("x_band", "y_band").agg(F.count("*").alias("n"), F.avg(label).alias("mean_label"))


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, missing: the share of rows without it, of all columns in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "missing")


def around_events(panel: DataFrame, events: DataFrame, features: list[str], before: int) -> DataFrame:
    """event_id, offset (-before .. 0), feature, value: the rows up to each event (event_id, market, ts), by place in the market's rows."""
    placed = panel.withColumn("__i", F.row_number().over(Window.partitionBy("market").orderBy("ts")))
    at = events.join(placed.select("market", "ts", "__i"), ["market", "ts"]).select("event_id", "market", F.col("__i").alias("__e"), F.explode(F.sequence(F.lit(-before), F.lit(0))).alias("offset"))
    rows = at.withColumn("__i", F.col("__e") + F.col("offset")).join(placed, ["market", "__i"])
    return rows.select("event_id", "offset", *features).unpivot(["event_id", "offset"], features, "feature", "value")


def event_profile(rows: DataFrame) -> DataFrame:
    """By offset and feature: how many, mean, quartiles and median over events."""
    return rows.where("value is not null").groupBy("offset", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.25).alias("q25"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.75).alias("q75"))


def overlapping_events(own: DataFrame, market: DataFrame) -> DataFrame:
    """own and market: event_id, start, end. Each own event with the first market event that contains its start (inside), or else the one
    whose start is nearest (ties: the earlier), and how many days that lies away."""
    points = market.select(F.col("event_id").alias("market_id"), F.col("start").alias("at"), F.col("end").alias("until"))
    first = points.groupBy("at").agg(F.min("market_id").alias("market_id"))
    # of the market's events by start, only those that end later than all before can be the first to contain a time
    longest = points.groupBy("at").agg(F.max("until").alias("until")).groupBy("until").agg(F.min("at").alias("at"))
    record = longest.withColumn("__m", F.max("until").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))).where("__m is null or until > __m")  # one market's events
    owner = points.join(record.select("at", "until"), ["at", "until"]).groupBy("at", "until").agg(F.min("market_id").alias("market_id"))
    asks = own.select(F.col("event_id").alias("own_id"), "start")
    found = asof.around(asof.around(asof.around(asks, owner, "start", "until", "__in", later=True), first, "start", "at", "__before"), first, "start", "at", "__after", later=True)
    inside = F.coalesce(F.col("__in.at") <= F.col("start"), F.lit(False))
    back, ahead = F.datediff("start", "__before.at"), F.datediff("__after.at", "start")
    near = F.when(back.isNull() | (ahead < back), F.col("__after")).otherwise(F.col("__before"))
    made = found.withColumn("inside", inside).withColumn("__near", near)
    return made.select("own_id", F.when(inside, F.col("__in.market_id")).otherwise(F.col("__near.market_id")).alias("market_id"), "inside", F.datediff(F.when(inside, F.col("__in.at")).otherwise(F.col("__near.at")), "start").alias("days")).where("market_id is not null")


def bucket_matrix(df: DataFrame, x: str, y: str, label: str, q: int) -> DataFrame:
    """Mean and median label, share above zero and count by the buckets of x and of y; empty cells are kept."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(label).isNotNull())
    placed = both.withColumn("x_bucket", xs.quantile_bucket(F.col(x), q)).withColumn("y_bucket", xs.quantile_bucket(F.col(y), q))
    cells = placed.groupBy("x_bucket", "y_bucket").agg(F.count("*").alias("n"), F.avg(label).alias("mean_label"), F.percentile(label, 0.5).alias("median_label"), F.avg((F.col(label) > 0).cast("double")).alias("positive"))
    sides = df.sparkSession.range(1, q + 1).select(F.col("id").cast("int").alias("x_bucket"), F.explode(F.sequence(F.lit(1), F.lit(q))).alias("y_bucket"))
    return sides.join(cells, ["x_bucket", "y_bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cell_summary(df: DataFrame, axes: dict[str, int], label: str) -> DataFrame:
    """Mean and median label, share above zero and count by the buckets of any number of columns (column: how many), named by the column with
    _bucket behind; the rows know all the columns and the label. Empty cells are kept: the cells are the product of the axes."""
    known = df.where(F.col(label).isNotNull())
    for c in axes:
        known = known.where(F.col(c).isNotNull())
    names = [f"{c}_bucket" for c in axes]
    placed = known.withColumns({f"{c}_bucket": xs.quantile_bucket(F.col(c), q) for c, q in axes.items()})
    cells = placed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean_label"), F.percentile(label, 0.5).alias("median_label"), F.avg((F.col(label) > 0).cast("double")).alias("positive"))
    every = df.sparkSession.range(1)
    for c, q in axes.items():
        every = every.withColumn(f"{c}_bucket", F.explode(F.sequence(F.lit(1), F.lit(q))))
    return every.drop("id").join(cells, names, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def adjusted_p(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    """adjusted: Benjamini-Yekutieli within each family; ties by p share the same value."""
    w = Window.partitionBy(*family)
    m = F.count(p).over(w)
    harmonic = F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda a, k: a + 1 / k)
    raw = F.col(p) * m * harmonic / F.row_number().over(w.orderBy(p))
    placed = df.withColumn("__raw", raw)
    from_above = w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # the least of those with as large a p or a larger one
    return placed.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__raw").over(from_above)))).drop("__raw")

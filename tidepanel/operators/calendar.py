"""Calendar periods: values by period mapped to rows, schedules, blocks and folds. Periods are counted in the calendar, holes included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = {"month": 1, "quarter": 3, "year": 12}


def start_value(df: DataFrame, x: str, unit: str) -> DataFrame:
    """start_value: the market's x at exactly the first day of the row's period, if observed then."""
    opening = df.where(F.col("ts") == F.trunc("ts", unit)).select("market", F.col("ts").alias("__p"), F.col(x).alias("start_value"))
    return df.withColumn("__p", F.trunc("ts", unit)).join(opening, ["market", "__p"], "left").drop("__p")


def rolling_median(df: DataFrame, x: str, unit: str, periods: int, kind: str = "last", least: int = 1) -> DataFrame:
    """median: of the last, sum or mean of x over the periods before the row's own. A period with fewer than least values is
    a hole, and a window with a hole is null."""
    made = {"last": F.max_by(x, F.when(F.col(x).isNotNull(), F.col("ts"))), "sum": F.sum(x), "mean": F.avg(x)}[kind]
    by = df.groupBy("market", F.trunc("ts", unit).alias("__p")).agg(F.when(F.count(x) >= least, made).alias("__v")).where("__v is not null")
    # the place in the calendar, so that a window of periods is a range of places and holes show in its count
    place = F.floor(F.months_between("__p", F.lit("1970-01-01")).cast("double") / MONTHS[unit] + 0.5)
    seen = by.withColumn("__i", F.explode(F.sequence(place + 1, place + periods)))
    stats = seen.groupBy("market", "__i").agg(F.count("*").alias("__n"), F.median("__v").alias("median")).where(F.col("__n") == periods).drop("__n")
    own = F.floor(F.months_between(F.trunc("ts", unit), F.lit("1970-01-01")).cast("double") / MONTHS[unit] + 0.5)
    return df.withColumn("__i", own).join(stats, ["market", "__i"], "left").drop("__i")


def snapshot_dates(df: DataFrame, unit: str) -> DataFrame:
    """Each market's last observed day in each period."""
    return df.groupBy("market", F.trunc("ts", unit).alias("period")).agg(F.max("ts").alias("snapshot"))


def month_blocks(df: DataFrame, months: int) -> DataFrame:
    """Blocks of so many months from the first month on that lie inside the data and hold two rows or more."""
    span = df.agg(F.trunc(F.min("ts"), "month").alias("first"), F.max("ts").alias("last"))
    starts = span.select("last", F.explode(F.sequence("first", "last", F.expr(f"interval {months} months"))).alias("block_start"))
    blocks = starts.withColumn("block_end", F.add_months("block_start", months)).where("block_end <= date_add(last, 1)").drop("last")
    # the blocks are as many as the months of the calendar at most
    inside = df.join(F.broadcast(blocks), (F.col("ts") >= F.col("block_start")) & (F.col("ts") < F.col("block_end")))
    return inside.groupBy("block_start", "block_end").agg(F.countDistinct("ts").alias("n_days"), F.count("*").alias("n_rows")).where("n_rows >= 2")


def walk_forward(df: DataFrame, inside: int, outside: int, step: int, expanding: bool = False) -> DataFrame:
    """Folds in months: train_start, test_start, test_end (exclusive), as long as the test ends inside the data."""
    span = df.agg(F.trunc(F.min("ts"), "month").alias("first"), F.max("ts").alias("last"))
    folds = span.select("first", "last", F.posexplode(F.sequence(F.add_months("first", inside), "last", F.expr(f"interval {step} months"))).alias("fold", "test_start"))
    train = F.col("first") if expanding else F.add_months("test_start", -inside)
    out = folds.select("fold", train.alias("train_start"), "test_start", F.add_months("test_start", outside).alias("test_end"), "last")
    return out.where("test_end <= date_add(last, 1)").drop("last")


def every(n: int) -> Column:
    """True on each market's first row and every n-th after it."""
    return (F.row_number().over(Window.partitionBy("market").orderBy("ts")) - 1) % n == 0


def place(ts: Column, unit: str) -> Column:
    """A period's number in the calendar: 0 is the day, month, quarter or year of 1970-01-01; weeks start on Mondays, and 1 is its week."""
    months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    if unit == "day":
        return F.datediff(ts, F.lit("1970-01-01").cast("date"))
    if unit == "week":
        return F.floor(F.datediff(ts, F.lit("1969-12-29").cast("date")) / 7).cast("int") + 1
    return F.floor(months / MONTHS[unit]).cast("int")


def by_period(df: DataFrame, x: str, unit: str, kind: str = "last") -> DataFrame:
    """market, p, v: the last value or the mean of the known x in each observed period."""
    known = df.where(F.col(x).isNotNull())
    return known.groupBy("market", place(F.col("ts"), unit).alias("p")).agg({"last": F.max_by(x, "ts"), "mean": F.avg(x)}[kind].alias("v"))


def mapped(df: DataFrame, x: str, values: DataFrame, unit: str, timing: str, name: str) -> DataFrame:
    """name: the value of the row's own period (same_period) or of the one before it in the calendar (next_period), where x is known."""
    later = {"same_period": 0, "next_period": 1}[timing]
    moved = values.select(F.col("market").alias("__m"), (F.col("p") + later).alias("__p"), F.col("v").alias("__v"))
    joined = df.join(moved, (F.col("market") == F.col("__m")) & (place(F.col("ts"), unit) == F.col("__p")), "left")
    return joined.withColumn(name, F.when(F.col(x).isNotNull(), F.col("__v"))).drop("__m", "__p", "__v")


def _observed() -> Window:
    return Window.partitionBy("market").orderBy("p")


def period_return(df: DataFrame, x: str, unit: str, periods: int = 1, timing: str = "next_period", name: str = "period_return") -> DataFrame:
    """Last value of a period over that so many observed periods before, less 1; with next_period, as of the observed period before."""
    change = F.try_divide(F.col("v"), F.lag("v", periods).over(_observed())) - 1
    values = by_period(df, x, unit).withColumn("v", change)
    if timing == "next_period":
        values = values.withColumn("v", F.lag("v").over(_observed()))
    return mapped(df, x, values, unit, "same_period", name)


def period_mean(df: DataFrame, x: str, unit: str, timing: str = "next_period", name: str = "period_mean") -> DataFrame:
    return mapped(df, x, by_period(df, x, unit, "mean"), unit, timing, name)


def period_sum(df: DataFrame, x: str, unit: str, periods: int, skip: int = 0, timing: str = "next_period", name: str = "period_sum") -> DataFrame:
    """Sum of the last values of so many observed periods, without the latest skip of them."""
    if not 0 <= skip < periods:
        raise ValueError("skip must be below periods")
    frame = _observed().rowsBetween(-(periods - 1), -skip)
    values = by_period(df, x, unit).withColumn("v", F.when(F.row_number().over(_observed()) >= periods, F.sum("v").over(frame)))
    return mapped(df, x, values, unit, timing, name)


def period_robust_mean(df: DataFrame, x: str, unit: str, periods: int, skip: int = 0, trim: int = 1, mode: str = "trimmed", timing: str = "next_period", name: str = "robust_mean") -> DataFrame:
    """Mean of the last values of so many observed periods (without the latest skip), of which the trim lowest and highest are left
    out (trimmed) or take the nearest value kept (winsorized)."""
    size = periods - skip
    if not 0 <= skip < periods or trim * 2 >= size or mode not in ("trimmed", "winsorized"):
        raise ValueError("no such window")
    held = F.sort_array(F.collect_list("v").over(_observed().rowsBetween(-(periods - 1), -skip)))
    middle = F.aggregate(F.slice("__h", trim + 1, size - 2 * trim), F.lit(0.0), lambda a, v: a + v)
    ends = trim * (F.get("__h", F.lit(trim)) + F.get("__h", F.lit(size - trim - 1)))
    mean = middle / (size - 2 * trim) if mode == "trimmed" else (middle + ends) / size
    values = by_period(df, x, unit).withColumn("__h", held).withColumn("v", F.when(F.size("__h") == size, mean)).drop("__h")
    return mapped(df, x, values, unit, timing, name)


def period_hold(df: DataFrame, x: str, unit: str, periods: int, timing: str = "next_period", first_valid: bool = False, everywhere: bool = False, name: str = "held_value") -> DataFrame:
    """The last value of every periods-th period, held for so many. Which periods count is by their place in the calendar, or from
    the first one with a value (of any market) on. everywhere: also where x is not known."""
    later = {"same_period": 0, "next_period": 1}[timing]
    values = by_period(df, x, unit).withColumn("p", F.col("p") + later)
    own = place(F.col("ts"), unit)
    bounds = df.agg(F.min(own).alias("__least")).crossJoin(values.agg(F.min("p").alias("__first")))  # one row each
    phase = F.pmod("__first", F.lit(periods)) if first_valid else F.lit(0)
    rows = df.crossJoin(F.broadcast(bounds)).withColumn("__u", own - F.pmod(own - phase, F.lit(periods)))
    moved = values.select(F.col("market").alias("__m"), F.col("p").alias("__p"), F.col("v").alias("__v"))
    joined = rows.join(moved, (F.col("market") == F.col("__m")) & (F.col("__u") == F.col("__p")) & (F.col("__u") >= F.col("__least")), "left")
    value = F.col("__v") if everywhere else F.when(F.col(x).isNotNull(), F.col("__v"))
    return joined.withColumn(name, value).drop("__m", "__p", "__v", "__u", "__least", "__first")


def between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both included; an open side is not bounded."""
    out = df if start is None else df.where(F.col("ts") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("ts") <= F.lit(end).cast("date"))


def at_hours(ts: Column, hours: tuple[int, ...]) -> Column:
    return F.hour(ts).isin(*hours)


def fold_starts(df: DataFrame, train: int, predict: int, step: int) -> DataFrame:
    """Folds of a model in months: each fold's training start, first prediction and its end, every one the first observed time at
    or after its target (an end past the data is the day after the last)."""
    span = df.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    folds = span.select("first", "last", F.posexplode(F.sequence(F.add_months("first", train), "last", F.expr(f"interval {step} months"))).alias("fold", "target"))
    wanted = folds.select("fold", "last", F.explode(F.array(*[F.struct(F.lit(k).alias("which"), c.alias("at")) for k, c in (("train_start", F.add_months("target", -train)), ("predict_start", F.col("target")), ("predict_end", F.add_months("target", predict)))])).alias("w"))
    days = df.select("ts").distinct()
    found = wanted.join(days, F.col("ts") >= F.col("w.at"), "left").groupBy("fold", "w.which").agg(F.coalesce(F.min("ts"), F.date_add(F.first("last"), 1)).alias("ts"))  # folds x the calendar
    return found.groupBy("fold").pivot("which", ["train_start", "predict_start", "predict_end"]).agg(F.first("ts"))


TRAILING = {"3M": 3, "6M": 6, "1Y": 12, "2Y": 24, "3Y": 36, "5Y": 60}
COVERED = ("3M", "6M", "3Y", "5Y")


def trailing_windows(curves: DataFrame, max_gap: int = 7) -> DataFrame:
    """run_id, window, start, return_pct: from the first row at or after the last one less the window. Windows that must be covered
    are null where that row is more than max_gap days late; null, too, where fewer than two rows are inside."""
    names = F.array(*[F.struct(F.lit(k).alias("window"), F.lit(m).alias("months"), F.lit(k in COVERED).alias("covered")) for k, m in TRAILING.items()])
    rows = curves.withColumn("__last", F.max("ts").over(Window.partitionBy("run_id"))).withColumn("w", F.explode(names))
    inside = rows.withColumn("__from", F.add_months("__last", -F.col("w.months"))).where("ts >= __from")
    out = inside.groupBy("run_id", "w.window", "w.covered", "__from").agg(F.min("ts").alias("start"), F.count("*").alias("__n"), F.try_divide(F.max_by("value", "ts"), F.min_by("value", "ts")).alias("__g"))
    late = F.col("covered") & (F.datediff("start", "__from") > max_gap)
    return out.select("run_id", "window", "start", F.when((F.col("__n") >= 2) & ~late, (F.col("__g") - 1) * 100).alias("return_pct"))


def per_year(timeframe: str) -> float:
    """Rows a year of a time frame: 252 days, or 365 days of bars of so many minutes."""
    if timeframe in ("day", "days", "1d", "daily"):
        return 252.0
    digits = "".join(c for c in timeframe if c.isdigit())
    return 365.0 * 1440 / (int(digits) * (60 if timeframe.rstrip("s").endswith(("h", "hour")) else 1))

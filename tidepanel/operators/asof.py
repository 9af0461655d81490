"""Point-in-time joins: each left row gets the latest right row at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], tie: str | None = None) -> DataFrame:
    """One union and one sort by key and time, instead of a range join; `tie` orders right rows of equal time."""
    seq = F.col(tie).cast("string") if tie else F.lit("")
    rows = right.select(*by, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), seq.alias("__tie"), F.struct(F.col(right_ts).alias("__at"), *values).alias("__v"), F.lit(None).cast(left.schema.simpleString()).alias("__row"))
    asks = left.select(*by, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit("").alias("__tie"), F.lit(None).cast(rows.schema["__v"].dataType).alias("__v"), F.struct(*left.columns).alias("__row"))
    order = Window.partitionBy(*by).orderBy("__ts", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(asks).withColumn("__v", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    return seen.select("__row.*", *[F.col(f"__v.{v}").alias(v) for v in values], F.col("__v.__at").alias("matched_ts"))


def trailing_sum(events: DataFrame, by: list[str], ts: str, value: str, days: int) -> DataFrame:
    """Sum of value over (ts - days, ts], by key, at each event time."""
    day = F.datediff(F.col(ts), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*by).orderBy(day).rangeBetween(-(days - 1), 0)
    return events.withColumn("trailing", F.sum(value).over(w))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def drop_superseded(events: DataFrame, by: list[str], ts: str, period: str) -> DataFrame:
    """Drops events whose period is below one already seen for the key."""
    before = Window.partitionBy(*by).orderBy(ts, period).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(period).over(before)
    return events.withColumn("__m", seen).where(F.col("__m").isNull() | (F.col(period) >= F.col("__m"))).drop("__m")


def around(asks: DataFrame, points: DataFrame, at: str, t: str, name: str, later: bool = False, unit: str = "month") -> DataFrame:
    """Adds to each row of asks the struct `name`: the last of the points with t <= at, or with later the first with t >= at; null if there
    is none. Points have one row a time t. There is no key to deal rows by, so time itself is: within a unit of time by a running window,
    from unit to unit by a table of one row each."""
    order = (lambda c: F.desc(c)) if later else (lambda c: F.asc(c))
    point = F.struct(*points.columns)
    marks = points.select(F.col(t).alias("__t"), F.lit(0).alias("__side"), point.alias("__p"), F.lit(None).cast(asks.schema.simpleString()).alias("__row"))
    rows = marks.unionByName(asks.select(F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(marks.schema["__p"].dataType).alias("__p"), F.struct(*asks.columns).alias("__row")))
    rows = rows.withColumn("__u", F.date_trunc(unit, "__t"))
    inside = F.last("__p", ignorenulls=True).over(Window.partitionBy("__u").orderBy(order("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0))
    edge = (F.min_by if later else F.max_by)("__p", F.when(F.col("__side") == 0, F.col("__t")))
    units = rows.groupBy("__u").agg(edge.alias("__e"))
    carried = units.select("__u", F.last("__e", ignorenulls=True).over(Window.orderBy(order("__u")).rowsBetween(Window.unboundedPreceding, -1)).alias("__c"))  # one row a unit
    found = rows.withColumn("__p", inside).where("__side = 1").join(carried, "__u", "left")
    return found.select("__row.*", F.coalesce("__p", "__c").alias(name))

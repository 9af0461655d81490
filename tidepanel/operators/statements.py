"""Company facts as they were known: events on a calendar, fiscal periods, share counts, dividends, filing versions.

Keys: code (the instrument), active (the day an event becomes known), period (its fiscal period).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import drop_superseded


def on_calendar(events: DataFrame, calendar: DataFrame, value: str, keep_missing: bool = False, period: str | None = None, name: str = "value") -> DataFrame:
    """calendar: code, ts. name: the value of the latest event at or before each day. A missing value leaves the older one standing,
    or clears it with keep_missing; with period, events of a period older than one already known are left out, and of one day's
    events the newest period counts (without, the greatest value, so that ties are settled)."""
    known = events.where(F.col("active").isNotNull())
    if period:
        known = drop_superseded(known, ["code"], "active", period)
    if not keep_missing:
        known = known.where(F.col(value).isNotNull())
    newest = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*([period] if period else []), F.col(value)))
    day = known.groupBy("code", "active").agg(newest.alias("__e"))
    both = day.select("code", F.col("active").alias("ts"), F.lit(0).alias("__s"), "__e").unionByName(calendar.select("code", "ts", F.lit(1).alias("__s"), F.lit(None).cast(day.schema["__e"].dataType).alias("__e")))
    last = F.last("__e", ignorenulls=True).over(Window.partitionBy("code").orderBy("ts", "__s").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__l", last).where("__s = 1").select("code", "ts", F.col("__l.v").alias(name))


def trading_day(dates: DataFrame, day: str, calendar: DataFrame, name: str = "trade_date") -> DataFrame:
    """The last calendar day at or before a date; a date before them all has none. One look-up by day for as many dates as there are
    distinct ones."""
    asked = dates.select(F.col(day).alias("__d")).distinct()
    both = asked.select(F.col("__d").alias("__t"), F.lit(1).alias("__s")).unionByName(calendar.select(F.col("ts").alias("__t"), F.lit(0).alias("__s")).distinct())
    seen = F.last(F.when(F.col("__s") == 0, F.col("__t")), ignorenulls=True).over(Window.orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, 0))  # distinct days
    found = both.withColumn(name, seen).where("__s = 1").select(F.col("__t").alias("__d"), name)
    return dates.join(found, dates[day] == found["__d"], "left").drop("__d")


def unique_matches(candidates: DataFrame, facts: DataFrame, on: list[str], group: list[str], claimed: str, stated: str) -> DataFrame:
    """Of each group's candidates, the one whose claimed number equals the stated one of its facts; groups with none or more than one
    are left out."""
    same = F.coalesce(F.col(claimed) == F.col(stated), F.lit(False))
    joined = candidates.join(facts, on, "left").withColumn("__m", same)
    return joined.withColumn("__c", F.sum(F.col("__m").cast("int")).over(Window.partitionBy(*group))).where("__m and __c = 1").drop("__m", "__c")


def in_fiscal_period(payments: DataFrame, periods: DataFrame, date: str) -> DataFrame:
    """payments: code, date; periods: code, fiscal_year, fiscal_end. Each payment with the period whose end is the first at or after it
    and whose start, the end before (a year earlier for the first), lies before it; others are left out."""
    before = F.lag("fiscal_end").over(Window.partitionBy("code").orderBy("fiscal_end"))
    spans = periods.select("code", "fiscal_year", "fiscal_end", F.coalesce(before, F.add_months("fiscal_end", -12)).alias("__from"))
    marks = spans.select("code", F.col("fiscal_end").alias("__t"), F.lit(1).alias("__s"), F.struct("fiscal_year", "fiscal_end", "__from").alias("__p"), F.lit(None).cast(payments.schema.simpleString()).alias("__row"))
    asks = payments.select("code", F.col(date).alias("__t"), F.lit(0).alias("__s"), F.lit(None).cast(marks.schema["__p"].dataType).alias("__p"), F.struct(*payments.columns).alias("__row"))
    following = F.last("__p", ignorenulls=True).over(Window.partitionBy("code").orderBy(F.desc("__t"), F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0))  # running from the end
    found = marks.unionByName(asks).withColumn("__f", following).where((F.col("__s") == 0) & (F.col("__t") > F.col("__f.__from")))
    return found.select("__row.*", F.col("__f.fiscal_year").alias("fiscal_year"), F.col("__f.fiscal_end").alias("fiscal_end"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that raises where a key has more than one right row."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = right.withColumn("__ok", F.assert_true(n == 1, F.lit("a key has more than one row")))
    return left.join(checked, keys, "left").where("__ok is null").drop("__ok")


def overlaid(statements: DataFrame, versions: DataFrame, filed: DataFrame, keys: list[str], items: list[str], others: list[str] = ()) -> DataFrame:
    """Each filing version of a statement. versions: keys, filing, is_final; filed: filing and the items as that filing gave them. The
    final version has the statement's values, missing ones from its own filing; an earlier one has only what it filed and goes
    if it filed nothing; other values are the final version's alone. A statement without filings stays as it is."""
    own = filed.select("filing", *[F.col(i).alias(f"__{i}") for i in items], F.lit(True).alias("__has"))
    rows = statements.join(versions, keys, "left").join(own, "filing", "left")
    earlier = F.col("filing").isNotNull() & ~F.coalesce("is_final", F.lit(False))
    values = [F.when(earlier, F.col(f"__{i}")).otherwise(F.coalesce(i, F.when(F.col("is_final"), F.col(f"__{i}")))).alias(i) for i in items]
    values += [F.when(~earlier, F.col(o)).alias(o) for o in others]
    return rows.where(~earlier | F.col("__has")).select(*keys, "filing", "is_final", *values)


def year_before(events: DataFrame, value: str, name: str) -> DataFrame:
    """events: code, fiscal_year, active. name: the value of the fiscal year before, as the latest event by then gave it."""
    facts = events.select("code", (F.col("fiscal_year") + 1).alias("fiscal_year"), "active", F.lit(0).alias("__s"), F.struct(F.col(value).alias("v")).alias("__v"), F.lit(None).cast(events.schema.simpleString()).alias("__row"))
    asks = events.select("code", "fiscal_year", "active", F.lit(1).alias("__s"), F.lit(None).cast(facts.schema["__v"].dataType).alias("__v"), F.struct(*events.columns).alias("__row"))
    order = Window.partitionBy("code", "fiscal_year").orderBy("active", "__s").rowsBetween(Window.unboundedPreceding, 0)
    return facts.unionByName(asks).withColumn("__l", F.last("__v", ignorenulls=True).over(order)).where("__s = 1").select("__row.*", F.col("__l.v").alias(name))


def supply_change(periods: DataFrame, shares: str) -> DataFrame:
    """change: shares over those of the fiscal year right before, less 1; null unless the years are consecutive and both are above 0."""
    w = Window.partitionBy("code").orderBy("fiscal_year")
    before, year = F.lag(shares).over(w), F.lag("fiscal_year").over(w)
    ok = (F.col("fiscal_year") == year + 1) & (F.col(shares) > 0) & (before > 0)
    return periods.withColumn("change", F.when(ok, F.try_divide(F.col(shares), before) - 1)).withColumn("available", F.coalesce(ok, F.lit(False)))


def outstanding(issued: Column, treasury: Column, stated: Column) -> Column:
    """Outstanding shares: as stated, if that and the treasury shares add up to those issued or the latter are not known; issued less
    treasury, if only that is known; parts outside 0 .. issued are no parts."""
    inside = lambda c: (c >= 0) & (c <= issued)
    both = treasury.isNotNull() & stated.isNotNull() & inside(treasury) & inside(stated) & (issued - treasury == stated)
    return F.when(issued > 0, F.when(both | (treasury.isNull() & inside(stated)), stated).when(stated.isNull() & inside(treasury), issued - treasury))


def dividend_years(payments: DataFrame, reports: DataFrame) -> DataFrame:
    """payments: code, fiscal_year, paid, per_share, shares (at the record date, may be missing); reports: code, fiscal_year, active. One
    row a reported year: the cash paid, null unless every payment's amount is known, no payment is 0; active: the later of the
    report and the last payment."""
    amount = F.col("per_share") * F.col("shares")
    by = payments.groupBy("code", "fiscal_year").agg(F.sum(amount).alias("__sum"), F.count(F.when(amount.isNull(), 1)).alias("__open"), F.max("paid").alias("__last"), F.count("*").alias("payments"))
    rows = reports.join(by, ["code", "fiscal_year"], "left")
    cash = F.when(F.coalesce("__open", F.lit(0)) == 0, F.coalesce("__sum", F.lit(0.0)))
    return rows.select("code", "fiscal_year", cash.alias("amount"), F.coalesce("payments", F.lit(0)).alias("payments"), F.greatest("active", "__last").alias("active"))


def share_frames(panel: DataFrame, price: str, cap: str, outstanding_ratio: str) -> DataFrame:
    """Adds shares (split-adjusted: cap over price), outstanding_cap and whether both are known."""
    shares = F.try_divide(F.col(cap), F.col(price))
    out = panel.withColumn("shares", F.when(F.col(price) > 0, shares)).withColumn("outstanding_cap", F.col(cap) * F.col(outstanding_ratio))
    return out.withColumn("available", F.col("shares").isNotNull() & F.col("outstanding_cap").isNotNull())

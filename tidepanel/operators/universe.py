"""Universe selection: lists, warnings, value filters on earlier rows, and rank filters one after the other or side by side.

Every function takes and returns rows (ts, market, ...) of a dense grid; `base` is 1 for a market that may be chosen.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import written
from . import cross_section as xs
from .rolling import shift


def listed(market: Column, allow: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """In the allowed markets (none given: all) and not in the excluded ones."""
    inside = market.isin(*allow) if allow else F.lit(True)
    return inside & ~market.isin(*exclude) if exclude else inside


def without_warnings(warning: Column, excluded: tuple[str, ...]) -> Column:
    """A missing warning counts as NONE."""
    return ~F.coalesce(warning, F.lit("NONE")).isin(*excluded)


def value_filter(x: Column, op: str, bound: float, lag: int = 0) -> Column:
    """x, so many grid rows ago, against the bound; unknown is false."""
    held = shift(x, lag) if lag else x
    test = {"gt": held > bound, "ge": held >= bound, "lt": held < bound, "le": held <= bound}[op]
    return F.coalesce(test, F.lit(False))


def rank_filter(x: Column, among: Column, top_n: int | None = None, quantiles: int = 0, buckets: tuple[int, ...] = (), descending: bool = True) -> Column:
    """Among the markets that hold: the n first by x, or those in the given quantile buckets."""
    inside = F.when(among, x)
    place = xs.rank(inside, descending=descending)
    chosen = place <= top_n if top_n else (1 + F.floor((place - 1) * quantiles / xs.size(inside))).isin(*buckets)
    return F.coalesce(chosen, F.lit(False))


def stages(df: DataFrame, base: str, filters: list[dict], sequential: bool = True) -> DataFrame:
    """selected: base after all rank filters (each a dict of rank_filter's arguments, x a column's name). Sequential filters
    rank what those before have left; otherwise each ranks the base, and all must hold."""
    out = df.withColumn("selected", F.col(base))
    for f in filters:
        how = {k: v for k, v in f.items() if k != "x"}
        out = out.withColumn("__f", rank_filter(F.col(f["x"]), F.col("selected" if sequential else base), **how)).withColumn("selected", F.col("selected") & F.col("__f")).drop("__f")
    return out


def from_first_active(df: DataFrame, weight: str) -> DataFrame:
    """Rows from the first time with any weight on."""
    first = df.where(F.col(weight) != 0).agg(F.min("ts").alias("__first"))
    return df.join(F.broadcast(first), F.col("ts") >= F.col("__first")).drop("__first")  # one row


def ever_used(df: DataFrame, weight: str) -> DataFrame:
    """Rows of the markets with a weight at any time."""
    return df.join(df.where(F.col(weight) != 0).select("market").distinct(), "market", "left_semi")


def per_listed(df: DataFrame, weight: str, per: float) -> DataFrame:
    """scaled: weight times per over the number of markets with a row at that time."""
    return df.withColumn("scaled", F.col(weight) * per / F.count("*").over(xs.at()))


@dataclass(frozen=True)
class Ranked:
    """A rank filter: the top_n best of x, or its quantile buckets, so many grid rows ago."""

    x: str
    top_n: int | None = None
    quantiles: int = 0
    buckets: tuple[int, ...] = ()
    descending: bool = True
    lag: int = 0
    everyone: bool = False  # rank the base population, not those that are left


@dataclass(frozen=True)
class Universe:
    """Which markets may be chosen (base) and which are (selected), on a dense grid with one row for each (ts, market)."""

    allow: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_warnings: tuple[str, ...] = ()
    min_age_days: int = 0
    least_cross_section: int = 0
    values: tuple[tuple[str, str, float, int], ...] = ()  # column, operator, bound, lag
    ranks: tuple[Ranked, ...] = ()
    final: Ranked | None = None
    signal_lag: int = 0

    def lagged(self) -> Universe:
        """The same with signal_lag added to the lags of all ranks."""
        more = lambda r: replace(r, lag=r.lag + self.signal_lag)
        return replace(self, ranks=tuple(more(r) for r in self.ranks), final=more(self.final) if self.final else None, signal_lag=0)


def build(grid: DataFrame, spec: Universe, price: str = "price", warning: str | None = None) -> DataFrame:
    """Adds base and selected. Lists, warnings, age and values make the base; it is empty before the first time at which enough
    markets are in it; the ranks then narrow it one after the other, and the final rank picks."""
    spec = spec.lagged()
    base = listed(F.col("market"), spec.allow, spec.exclude) & F.col(price).isNotNull()
    if warning and spec.exclude_warnings:
        base = base & without_warnings(F.col(warning), spec.exclude_warnings)
    if spec.min_age_days:
        first = F.min(F.when(F.col(price).isNotNull(), F.col("ts"))).over(Window.partitionBy("market"))
        base = base & F.coalesce(F.datediff("ts", first) >= spec.min_age_days, F.lit(False))
    for column, op, bound, lag in spec.values:
        base = base & value_filter(F.col(column), op, bound, lag)
    out = grid.withColumn("base", base)
    if spec.least_cross_section:
        enough = out.groupBy("ts").agg(F.count(F.when(F.col("base"), 1)).alias("__n")).where(F.col("__n") >= spec.least_cross_section).agg(F.min("ts").alias("__since"))
        out = out.crossJoin(F.broadcast(enough)).withColumn("base", F.coalesce(F.col("base") & (F.col("ts") >= F.col("__since")), F.lit(False))).drop("__since")  # one row
    out = out.withColumn("selected", F.col("base"))
    for r in (*spec.ranks, *((spec.final,) if spec.final else ())):
        held = shift(F.col(r.x), r.lag) if r.lag else F.col(r.x)
        out = out.withColumn("__x", held)
        chosen = rank_filter(F.col("__x"), F.col("base" if r.everyone else "selected"), r.top_n, r.quantiles, r.buckets, r.descending)
        out = out.withColumn("__f", chosen).withColumn("selected", F.col("selected") & F.col("__f")).drop("__f", "__x")
    return out


def covered(ts: Column, start: Column, end: Column) -> Column:
    """From the start on and before the end; a market without a start is not covered, one without an end stays so."""
    return F.coalesce(start.isNotNull() & (ts >= start) & (end.isNull() | (ts < end)), F.lit(False))


def with_coverage(panel: DataFrame, instruments: DataFrame, most: int = 100_000) -> DataFrame:
    """usage_ok by the instruments' (market, data_start, data_end) life; they are broadcast if they are at most so many."""
    side = instruments.select("market", "data_start", "data_end")
    side = F.broadcast(side) if instruments.limit(most + 1).count() <= most else side
    return panel.join(side, "market", "left").withColumn("usage_ok", covered(F.col("ts"), F.col("data_start"), F.col("data_end"))).drop("data_start", "data_end")


SLOT_TIMES = 2000
SLOT_STATE = "run_id {run}, market string, entered long, free long"


def held_slots(df: DataFrame, slots: int, descending: bool = True, cooldown: int = 0, longest: int | None = None, times: int | None = None) -> DataFrame:
    """selected: who holds one of the slots. df: run_id, ts, market, candidate, eligible, score, leave, every market at every time.

    Those who hold stay until they are told to leave, are no longer eligible, or have held longest times; then they wait cooldown
    times more. Free slots go to the best scores, ties by market. The state is of all markets together, so a run goes through time in
    ranges of `times` times: a range of a run is one group, which gets the state that the range before has left (a row a market) and
    leaves its own. Each range is written, so a lost executor costs a range; runs are dealt out.
    """
    length = times or SLOT_TIMES
    calendar = df.select("run_id", "ts").distinct().withColumn("__i", F.row_number().over(Window.partitionBy("run_id").orderBy("ts")) - 1)  # a run's times
    rows = written(df.join(calendar, ["run_id", "ts"]).withColumn("__r", F.floor(F.col("__i") / length).cast("int")), "slot-ranges")
    run_type, ts_type = df.schema["run_id"].dataType.simpleString(), df.schema["ts"].dataType.simpleString()
    fields = f"run_id {run_type}, ts {ts_type}, market string, selected boolean, entered long, free long"
    state = df.sparkSession.createDataFrame([], SLOT_STATE.format(run=run_type))
    last = rows.agg(F.max("__r")).first()[0]
    parts = []
    for r in range((last if last is not None else -1) + 1):  # each range needs the one before
        now = rows.where(F.col("__r") == r).groupBy("run_id").cogroup(state.groupBy("run_id")).applyInPandas(_slot_range(slots, descending, cooldown, longest), fields)
        now = written(now, "slots")
        parts.append(now.where("selected is not null").select("run_id", "ts", "market", "selected"))
        state = now.where("selected is null").select("run_id", "market", "entered", "free")
    if not parts:
        return df.select("run_id", "ts", "market", F.lit(False).alias("selected"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _slot_range(slots: int, descending: bool, cooldown: int, longest: int | None):
    """One run's range of times: rows with selected, and at last a row a market with its state (entered: the time's number, -1 for none;
    free: the number from which on it may enter)."""

    def run(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):  # a run of fewer times is over
            return before.assign(ts=None, selected=None)[["run_id", "ts", "market", "selected", "entered", "free"]].iloc[:0]
        markets = sorted({*pdf["market"], *before["market"]})
        wide = {c: pdf.pivot(index="__i", columns="market", values=c).reindex(columns=markets) for c in ("candidate", "eligible", "score", "leave")}
        eligible, leave = (wide["eligible"] == True).to_numpy(), wide["leave"].to_numpy(float)  # noqa: E712
        order = wide["score"].to_numpy(float) * (-1 if descending else 1)
        ready = (wide["candidate"] == True).to_numpy() & eligible & np.isfinite(order) & (leave == 0)  # noqa: E712
        held = before.set_index("market").reindex(markets)
        entered, free = held["entered"].fillna(-1).to_numpy(np.int64), held["free"].fillna(0).to_numpy(np.int64)
        taken, numbers = np.zeros(ready.shape, bool), wide["score"].index.to_numpy(np.int64)
        for k, t in enumerate(numbers.tolist()):
            inside = entered >= 0
            over = inside & (t - entered >= longest) if longest is not None else np.zeros(len(markets), bool)
            if (inside & ~over & eligible[k] & ~np.isfinite(leave[k])).any():
                raise ValueError("a held market has no leave signal")
            out = inside & (over | ~eligible[k] | (leave[k] != 0))
            entered[out], free[out] = -1, t + cooldown + 1
            room = slots - int((entered >= 0).sum())
            if room > 0:
                able = np.flatnonzero(ready[k] & (entered < 0) & (free <= t))
                entered[able[np.argsort(order[k][able], kind="stable")][:room]] = t
            taken[k] = entered >= 0
        days = pdf.drop_duplicates("__i").set_index("__i")["ts"].reindex(numbers).to_numpy()
        rows = pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "ts": np.repeat(days, len(markets)), "market": np.tile(markets, len(days)), "selected": taken.ravel(), "entered": -1, "free": 0})
        left = pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "ts": None, "market": markets, "selected": None, "entered": entered, "free": free})
        return pd.concat([rows.astype({"selected": object, "ts": object}), left.astype({"selected": object, "ts": object})], ignore_index=True)

    return run


def screened(panel: DataFrame, screen: DataFrame) -> DataFrame:
    """screen: ts, market, selected, at the times of a schedule; it stands until the next one. usable: the standing screen (false
    before the first). Only markets that are ever selected stay."""
    times = screen.select("ts").distinct().withColumn("__next", F.lead("ts").over(Window.orderBy("ts")))  # a schedule's times
    ever = screen.where("selected").select("market").distinct()
    standing = screen.where("selected").join(times, "ts").select("market", F.col("ts").alias("__from"), "__next")
    rows = panel.join(ever, "market", "left_semi")
    inside = rows.select("ts", "market").join(standing, "market").where((F.col("ts") >= F.col("__from")) & (F.col("__next").isNull() | (F.col("ts") < F.col("__next")))).select("ts", "market", F.lit(True).alias("usable"))
    return rows.join(inside, ["ts", "market"], "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def gaps(grid: DataFrame, x: str) -> DataFrame:
    """market, gap_start, gap_end, bars: the runs of missing x between known ones, on a dense grid."""
    w = Window.partitionBy("market").orderBy("ts")
    seen, every = F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.count(x).over(Window.partitionBy("market"))
    inside = grid.withColumn("island", seen).withColumn("__n", every).where(F.col(x).isNull() & (F.col("island") > 0) & (F.col("island") < F.col("__n")))
    return inside.groupBy("market", "island").agg(F.min("ts").alias("gap_start"), F.max("ts").alias("gap_end"), F.count("*").alias("bars")).drop("island")


def query_rows(df: DataFrame, equals: dict | None = None, contains: dict | None = None, least: dict | None = None, most: dict | None = None, order: tuple[str, ...] = (), descending: bool = True, group: str | None = None, top: int | None = None) -> DataFrame:
    """Rows by equal values, texts inside (in any case), and bounds; sorted by the order, ties by the last of its columns, which should
    be a key; the first `top` of all or of each group."""
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        df = df.where(F.lower(c).contains(v.lower()))
    for c, v in (least or {}).items():
        df = df.where(F.col(c) >= v)
    for c, v in (most or {}).items():
        df = df.where(F.col(c) <= v)
    by = [F.col(c).desc_nulls_last() if descending and k < len(order) - 1 else F.col(c).asc_nulls_last() for k, c in enumerate(order)]
    if group:
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("__n") <= (top or 1)).drop("__n")
    return df.orderBy(*by).limit(top) if top else df.orderBy(*by) if by else df


def parameter_grid(spark: SparkSession, axes: dict[str, list], constraint: str | None = None) -> DataFrame:
    """Every combination of the axes' values that meets the constraint, an SQL condition over their names."""
    out = None
    for name, values in axes.items():
        side = spark.createDataFrame([(v,) for v in values], [name]).coalesce(1)
        out = side if out is None else out.crossJoin(side)  # the product is what is asked for
    return out.where(F.expr(constraint)) if constraint else out


def plateau(grid: DataFrame, numeric: list[str], categories: list[str], metric: str) -> DataFrame:
    """plateau: mean metric of the neighbours: the same categories, on each numeric axis the same value or the next one on
    either side, the row itself left out. neighbours: how many."""
    grid = written(grid, "grid")  # read for each axis and on both sides of the join
    placed = grid
    for c in numeric:
        axis = grid.select(c).distinct().withColumn(f"__{c}", F.dense_rank().over(Window.orderBy(c)))  # an axis's values
        placed = placed.join(axis, c)
    placed = placed.withColumn("__id", F.struct(*numeric, *categories))
    # each row goes to the cells next to it, so the join is by equal keys
    near = placed.select(F.col("__id").alias("__from"), metric, *categories, *[F.explode(F.array(*[F.col(f"__{c}") + d for d in (-1, 0, 1)])).alias(f"__{c}") if c == numeric[0] else F.col(f"__{c}") for c in numeric])
    for c in numeric[1:]:
        near = near.withColumn(f"__{c}", F.explode(F.array(*[F.col(f"__{c}") + d for d in (-1, 0, 1)])))
    keys = [f"__{c}" for c in numeric] + categories
    stats = placed.select("__id", *keys).join(near.withColumnRenamed(metric, "__m"), keys).where("__id <> __from").groupBy("__id").agg(F.avg("__m").alias("plateau"), F.count("*").alias("neighbours"))
    return placed.join(stats, "__id", "left").drop("__id", *[f"__{c}" for c in numeric]).withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))

"""Windows of the last n rows in constant work a row, whatever n.

A market's rows are cut into blocks of n. A window is the end of one block and the beginning of the next, so it is the merge
of two states: the running state of its own block up to the row, and the running state, from the end backwards, of the block
before, taken n - 1 rows back. Any state with an associative merge will do; nothing is ever taken out of a state, so a
large value that has left the window leaves no error behind.

Rows of one market meet in one shuffle; within it the running states are streamed, and no window is gathered or summed anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    """fields(window) are the running state's columns by name, in steps: those of a later step may read the columns of the ones before
    by the function that they get, which also tells if the rows come from the "front". merge(earlier, later) is the state of both, field by field; names are its fields."""

    steps: tuple[Callable[[WindowSpec, Callable[[str], Column]], dict[str, Column]], ...]
    merge: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]
    names: tuple[str, ...]


def over_last(df: DataFrame, n: int, name: str, state: State, by: tuple[str, ...] = ("market",), order: str = "ts") -> DataFrame:
    """Adds the struct `name`: the state of the last n rows; null where there are fewer."""
    if n < 1:
        raise ValueError("a window has one row at least")
    i, b = f"__{name}_i", f"__{name}_b"
    rows = df.withColumn(i, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    rows = rows.withColumn(b, F.floor(F.col(i) / n).cast("long"))
    block = Window.partitionBy(*by, b)
    ways = {"pre": block.orderBy(i).rowsBetween(Window.unboundedPreceding, 0), "suf": block.orderBy(F.desc(i)).rowsBetween(Window.unboundedPreceding, 0)}
    for way, w in ways.items():
        if way == "suf" and n == 1:
            continue
        of = lambda field, way=way: F.lit(way == "pre") if field == "front" else F.col(f"__{name}_{way}_{field}")
        for step in state.steps:
            made = step(w, of)
            rows = rows.withColumns({f"__{name}_{way}_{f}": c for f, c in made.items()})
    whole = F.struct(*[F.col(f"__{name}_pre_{f}").alias(f) for f in state.names])
    if n > 1:
        late = f"__{name}_late"
        rows = rows.withColumn(late, F.lag(F.struct(*[F.col(f"__{name}_suf_{f}").alias(f) for f in state.names]), n - 1).over(Window.partitionBy(*by).orderBy(i)))
        both = state.merge(lambda f: F.col(late)[f], lambda f: F.col(f"__{name}_pre_{f}"))
        merged = F.struct(*[both[f].alias(f) for f in state.names])
        whole = F.when(F.col(i) % n == n - 1, whole).when(F.col(i) >= n - 1, merged)
    return rows.select(*df.columns, whole.alias(name))


def moments(*pairs: tuple[str, Column], squares: tuple[str, ...] | None = None, cross: tuple[tuple[str, str], ...] = ()) -> State:
    """n, the rows in which all the named columns are known (the others count for nothing); for each column mean_, for those in
    squares (all, if not said) m2_, the sum of squared deviations; for each pair of names cross_a_b."""
    known = F.lit(True)
    for _, x in pairs:
        known = known & x.isNotNull()
    seen = {k: F.when(known, x.cast("double")) for k, x in pairs}
    squared = list(seen) if squares is None else list(squares)

    def anchor(w: WindowSpec, _: Callable[[str], Column]) -> dict[str, Column]:
        return {f"at_{k}": F.first(x, ignorenulls=True).over(w) for k, x in seen.items()}  # so that equal values have them as their mean, to the last bit

    def first(w: WindowSpec, of: Callable[[str], Column]) -> dict[str, Column]:
        out = {"n": F.count(F.when(known, 1)).over(w)} | {f"mean_{k}": of(f"at_{k}") + F.avg(x - of(f"at_{k}")).over(w) for k, x in seen.items()}
        return out | {f"var_{k}": F.var_pop(seen[k]).over(w) for k in squared} | {f"cov_{a}_{b}": F.covar_pop(seen[a], seen[b]).over(w) for a, b in cross}

    def then(w: WindowSpec, of: Callable[[str], Column]) -> dict[str, Column]:
        return {f"m2_{k}": of(f"var_{k}") * of("n") for k in squared} | {f"cross_{a}_{b}": of(f"cov_{a}_{b}") * of("n") for a, b in cross}

    def merge(a: Callable[[str], Column], b: Callable[[str], Column]) -> dict[str, Column]:
        n = a("n") + b("n")
        step = {k: b(f"mean_{k}") - a(f"mean_{k}") for k in seen}
        share = a("n") * b("n") / n
        choose = lambda f, both: F.when(a("n") == 0, b(f)).when(b("n") == 0, a(f)).otherwise(both)
        out = {"n": n} | {f"mean_{k}": choose(f"mean_{k}", a(f"mean_{k}") + d * b("n") / n) for k, d in step.items()}
        out |= {f"m2_{k}": choose(f"m2_{k}", a(f"m2_{k}") + b(f"m2_{k}") + step[k] * step[k] * share) for k in squared}
        return out | {f"cross_{x}_{y}": choose(f"cross_{x}_{y}", a(f"cross_{x}_{y}") + b(f"cross_{x}_{y}") + step[x] * step[y] * share) for x, y in cross}

    fields = ["n", *[f"mean_{k}" for k in seen], *[f"m2_{k}" for k in squared], *[f"cross_{a}_{b}" for a, b in cross]]
    return State((anchor, first, then), merge, tuple(fields))


def totals(x: Column) -> State:
    """n and total of the known rows."""

    def first(w: WindowSpec, _: Callable[[str], Column]) -> dict[str, Column]:
        return {"n": F.count(x).over(w), "total": F.coalesce(F.sum(x).over(w), F.lit(0.0))}

    return State((first,), lambda a, b: {"n": a("n") + b("n"), "total": a("total") + b("total")}, ("n", "total"))


def extremes(x: Column) -> State:
    """n, high and low of the known rows."""

    def first(w: WindowSpec, _: Callable[[str], Column]) -> dict[str, Column]:
        return {"n": F.count(x).over(w), "high": F.max(x).over(w), "low": F.min(x).over(w)}

    def merge(a: Callable[[str], Column], b: Callable[[str], Column]) -> dict[str, Column]:
        return {"n": a("n") + b("n"), "high": F.greatest(a("high"), b("high")), "low": F.least(a("low"), b("low"))}

    return State((first,), merge, ("n", "high", "low"))


def drawdown(x: Column) -> State:
    """n, high, low, and worst: the lowest x / running high - 1 within the rows."""
    x = x.cast("double")

    def first(w: WindowSpec, _: Callable[[str], Column]) -> dict[str, Column]:
        return {"n": F.count(x).over(w), "high": F.max(x).over(w), "low": F.min(x).over(w)}

    def then(w: WindowSpec, of: Callable[[str], Column]) -> dict[str, Column]:
        # from the front, the row is the last: x against the high so far; from the end, it is the first: the low from it on against x
        return {"worst": F.min(F.when(of("front"), x / of("high")).otherwise(of("low") / x)).over(w) - 1}

    def merge(a: Callable[[str], Column], b: Callable[[str], Column]) -> dict[str, Column]:
        return {"n": a("n") + b("n"), "high": F.greatest(a("high"), b("high")), "low": F.least(a("low"), b("low")), "worst": F.least(a("worst"), b("worst"), b("low") / a("high") - 1)}

    return State((first, then), merge, ("n", "high", "low", "worst"))


def _full(w: str, n: int, value: Column) -> Column:
    return F.when(F.col(w)["n"] == n, value)


def _of(w: str, field: str) -> Column:
    return F.col(w)[field]


def std(w: str, n: int, k: str = "x", sample: bool = False) -> Column:
    return _full(w, n, F.sqrt(_of(w, f"m2_{k}") / (n - 1 if sample else n)))


def mean(w: str, n: int, k: str = "x") -> Column:
    return _full(w, n, _of(w, f"mean_{k}"))


def zscore(w: str, n: int, x: Column, k: str = "x") -> Column:
    return F.when(std(w, n, k) > 1e-12, (x - mean(w, n, k)) / std(w, n, k))


def slope(w: str, n: int, x: str = "x", ref: str = "ref") -> Column:
    """Beta of x on ref; null where ref does not move."""
    return _full(w, n, F.when(_of(w, f"m2_{ref}") > 0, _of(w, f"cross_{x}_{ref}") / _of(w, f"m2_{ref}")))


def rolling(df: DataFrame, x: str, n: int, kind: str, name: str) -> DataFrame:
    """Adds the mean, sum, std, max or min of the last n rows; null unless all are known."""
    state = {"mean": totals, "sum": totals, "max": extremes, "min": extremes}.get(kind, lambda c: moments(("x", c)))(F.col(x))
    made = over_last(df, n, "__w", state)
    field = {"mean": lambda: _of("__w", "total") / n, "sum": lambda: _of("__w", "total"), "max": lambda: _of("__w", "high"), "min": lambda: _of("__w", "low"), "std": lambda: std("__w", n)}[kind]
    return made.select(*df.columns, _full("__w", n, field()).alias(name))


def standardised(df: DataFrame, x: str, n: int, name: str = "zscore") -> DataFrame:
    """Adds x less its window mean, over the window's deviation."""
    made = over_last(df, n, "__w", moments(("x", F.col(x))))
    return made.select(*df.columns, zscore("__w", n, F.col(x)).alias(name))


def beta(df: DataFrame, x: str, ref: str, n: int, name: str = "beta") -> DataFrame:
    """Adds the beta of x on ref over the last n rows, all of which must hold both."""
    state = moments(("x", F.col(x)), ("ref", F.col(ref)), squares=("ref",), cross=(("x", "ref"),))
    return over_last(df, n, "__w", state).select(*df.columns, slope("__w", n).alias(name))


def residual(df: DataFrame, x: str, ref: str, n: int, name: str = "residual") -> DataFrame:
    """Adds x less its window beta times ref."""
    made = beta(df, x, ref, n, "__beta")
    return made.select(*df.columns, (F.col(x) - F.col("__beta") * F.col(ref)).alias(name))


def worst_drawdown(df: DataFrame, x: str, n: int, name: str = "worst_drawdown") -> DataFrame:
    """Adds the lowest x / running high - 1 of the last n rows, the running high inside the window; null unless all are known."""
    made = over_last(df, n, "__w", drawdown(F.col(x)))
    return made.select(*df.columns, _full("__w", n, _of("__w", "worst")).alias(name))


def trend_quality(df: DataFrame, x: str, n: int, name: str = "trend") -> DataFrame:
    """Adds the slope of the log of x by row, times the fit's R2."""
    rows = df.withColumn("__y", F.when(F.col(x) > 0, F.log(x))).withColumn("__k", F.row_number().over(Window.partitionBy("market").orderBy("ts")))
    made = over_last(rows, n, "__w", moments(("y", F.col("__y")), ("k", F.col("__k")), squares=("y",), cross=(("y", "k"),)))
    m2_k = n * (n * n - 1) / 12
    both, m2_y = _of("__w", "cross_y_k"), _of("__w", "m2_y")
    return made.select(*df.columns, _full("__w", n, F.when(m2_y > 0, both / m2_k * both * both / (m2_k * m2_y))).alias(name))


def kth_of_last(df: DataFrame, x: str, n: int, ks: tuple[int, ...], name: str) -> DataFrame:
    """Adds the mean of the k-th smallest values (k from 1) of x among the last n rows, for k in ks; null unless all n are known.

    Values become dense ranks written in digits. A row asks for its k-th value digit by digit: among the values that share the
    digits found so far, one running count by the next digit, in which a value counts 1 when it comes and -1 when it has left,
    tells the next digit. The rows that ask stand in the same windows as the values, so all steps are one shuffle by market.
    """
    base = 16
    numbered = df.select("market", "ts", F.col(x).alias("__x")).withColumn("__i", F.row_number().over(Window.partitionBy("market").orderBy("ts")))
    ranked = numbered.withColumn("__r", F.when(F.col("__x").isNotNull(), F.dense_rank().over(Window.partitionBy("market").orderBy(F.asc_nulls_last("__x"))) - 1).cast("long"))
    known, none = F.col("__r").isNotNull(), F.lit(None).cast("long")
    event = lambda i, order, add, k: F.struct(i.alias("i"), F.lit(order).alias("order"), F.lit(add).alias("add"), k.alias("k"))
    events = F.concat(F.when(known, F.array(event(F.col("__i") + n, 0, -1, none), event(F.col("__i"), 1, 1, none))).otherwise(F.array()), F.array(*[event(F.col("__i"), 2, 0, F.lit(k).cast("long")) for k in ks]))
    rows = ranked.select("market", "ts", "__x", "__r", F.explode(events).alias("e")).select("market", "ts", "__x", F.when(F.col("e.order") < 2, F.col("__r")).alias("__r"), F.col("e.i").alias("__i"), F.col("e.order").alias("__order"), F.col("e.add").alias("__add"), F.col("e.k").alias("__k"))
    asks, mine = F.col("__order") == 2, F.col("__order") == 1
    rows = rows.withColumn("__found", F.lit(0).cast("long"))
    places = digits(df, x, base)
    for place in range(places - 1, -1, -1):
        unit = base**place
        rows = rows.withColumn("__node", F.when(asks, F.col("__found")).otherwise(F.floor(F.col("__r") / (unit * base)).cast("long")))
        w = Window.partitionBy("market", "__node").orderBy("__i", "__order").rowsBetween(Window.unboundedPreceding, 0)
        digit = F.floor(F.col("__r") / unit) % base
        rows = rows.withColumn("__c", F.array(*[F.sum(F.when(digit <= d, F.col("__add")).otherwise(0)).over(w) for d in range(base)]))
        if place == places - 1:
            rows = rows.withColumn("__held", F.get("__c", F.lit(base - 1)))
        chosen = sum(((F.get("__c", F.lit(d)) < F.col("__k")).cast("long") for d in range(base)), F.lit(0))  # the counts do not fall from digit to digit
        below = F.when(chosen > 0, F.get("__c", (chosen - 1).cast("int"))).otherwise(0)
        rows = rows.withColumns({"__found": F.when(asks, F.col("__found") * base + chosen), "__k": F.when(asks, F.col("__k") - below)})
    value = F.max(F.when(mine, F.col("__x"))).over(Window.partitionBy("market", F.when(asks, F.col("__found")).otherwise(F.col("__r"))))
    rows = rows.withColumn("__value", value).where(asks)
    found = rows.groupBy("market", "ts").agg(F.when(F.max("__held") == n, F.avg("__value")).alias(name))
    return df.join(found, ["market", "ts"], "left")


def digits(df: DataFrame, x: str, base: int) -> int:
    """How many digits of the base the dense ranks of x within any market have at most: one number is brought to the driver."""
    most = df.groupBy("market").agg(F.count(F.col(x)).alias("n")).agg(F.max("n")).first()[0] or 1
    places = 1
    while base**places < most:
        places += 1
    return places


def median(df: DataFrame, x: str, n: int, name: str = "median") -> DataFrame:
    """Adds the median of the last n rows of x; null unless all are known."""
    return kth_of_last(df, x, n, (n // 2 + 1,) if n % 2 else (n // 2, n // 2 + 1), name)


def median_return(df: DataFrame, x: str, n: int, name: str = "median_return") -> DataFrame:
    """Adds the median of the last n rows' returns of x."""
    before = F.lag(x).over(Window.partitionBy("market").orderBy("ts"))
    returns = df.withColumn("__ret", F.when(before != 0, F.col(x) / before - 1))
    return median(returns, "__ret", n, name).drop("__ret")


def consistency(df: DataFrame, x: str, n: int, least: float = 1e-12, name: str = "consistency", median_name: str | None = None) -> DataFrame:
    """Adds the median return over the size of the mean return, and the median itself if it is named."""
    before = F.lag(x).over(Window.partitionBy("market").orderBy("ts"))
    returns = df.withColumn("__ret", F.when(before != 0, F.col(x) / before - 1))
    made = over_last(median(returns, "__ret", n, "__med"), n, "__w", moments(("x", F.col("__ret")), squares=()))
    size = F.abs(mean("__w", n))
    also = [F.col("__med").alias(median_name)] if median_name else []
    return made.select(*df.columns, F.when(size > least, F.col("__med") / size).alias(name), *also)

"""Elementwise transforms: Column to Column, null where the input is outside the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log(x: Column, mode: str = "log") -> Column:
    return F.when(x > 0, F.log(x)) if mode == "log" else F.when(x >= 0, F.log1p(x))


def clip(x: Column, lower: float, upper: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(upper)), F.lit(lower)))


def gaussian_signed(x: Column) -> Column:
    return x * F.exp(-x * x / 2)


def linear_ramp(x: Column, start: float, end: float, low: float, high: float) -> Column:
    return low + clip((x - start) / (end - start), 0.0, 1.0) * (high - low)


def target_vol(vol: Column, target_annual: float, per_year: int, low: float, high: float) -> Column:
    """The target over the volatility, inside the bounds; no volatility gives the highest, a negative one raises."""
    per_row = F.lit(target_annual / per_year**0.5)
    wrong = F.raise_error(F.lit("negative volatility")).cast("double")
    return F.when(vol < 0, wrong).when(vol == 0, F.lit(high)).when(vol > 0, clip(F.try_divide(per_row, vol), low, high))


def quantize(x: Column, step: float, rounding: str = "floor", low: float = 0.0, high: float | None = None) -> Column:
    """x in steps from low; at or above high it is high itself."""
    place = (x - low) / step
    steps = {"floor": F.floor(place + 1e-12), "ceil": F.ceil(place - 1e-12), "nearest": F.floor(place + 0.5 + 1e-12)}[rounding]
    out = low + steps * step
    return out if high is None else F.when(x >= high - 1e-12, F.lit(high)).otherwise(F.least(out, F.lit(high)))


def pair_min(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def pair_max(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def mask_by(x: Column, mask: Column) -> Column:
    return F.when(mask.isNotNull() & (mask != 0), x)


def compare(a: Column, b: Column, op: str) -> Column:
    """1.0 or 0.0; null if either side is."""
    test = {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b, "eq": a == b, "ne": a != b}[op]
    return test.cast("double")


def logical(op: str, *flags: Column) -> Column:
    """and, or, not over 0/1 columns; null if any input is."""
    known, out = flags[0].isNotNull(), flags[0] != 0
    for f in flags[1:]:
        known, out = known & f.isNotNull(), (out & (f != 0)) if op == "and" else (out | (f != 0))
    return F.when(known, (~out if op == "not" else out).cast("double"))


def weighted_sum(parts: list[tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for c, w in parts:
        total = total + c * w
    return total


def stepped_cap(x: Column, start: float, end: float, least: float, steps: int) -> Column:
    """1 up to start, then down to least at end in equal steps."""
    step = clip(F.ceil((x - start) / ((end - start) / steps)).cast("double"), 0.0, float(steps))
    return 1 - step / steps * (1 - least)


def hump_steps(x: Column, entry: float, peak: float, end: float, least: float, last: float, steps: int) -> Column:
    """0 up to entry, steps up from least towards peak, steps down from 1 to last at end, and last beyond."""
    up, down = F.floor((x - entry) / ((peak - entry) / steps)), F.floor((x - peak) / ((end - peak) / steps))
    falls = 1 - down / steps * (1 - last)
    return F.when(x <= entry, 0.0).when(x < peak, least + up / steps * (1 - least)).when(x < end, falls).when(x >= end, F.lit(last))


def true_range(high: Column, low: Column, close_before: Column) -> Column:
    """The widest of high - low and both distances from the close before; unknown ones are skipped."""
    return F.greatest(high - low, F.abs(high - close_before), F.abs(low - close_before))


def by_state(state: Column, values: dict[float, Column], default: Column | None = None) -> Column:
    """The column of the state's value; a null state is null, an unlisted one takes the default."""
    out = F.when(state.isNull(), None)
    for key, value in values.items():
        out = out.when(state == key, value)
    return out if default is None else out.otherwise(default)


def safe_ratio(a: Column, b: Column) -> Column:
    """Over positive denominators only."""
    return F.when(b > 0, a / b)


def all_true(flags: list[Column]) -> Column:
    """1 if every flag is known and not 0, else 0."""
    out = F.lit(True)
    for c in flags:
        out = out & F.coalesce(c != 0, F.lit(False))
    return out.cast("double")


def market_score(market: Column, rules: dict[str, list[tuple[Column, float]]], otherwise: list[tuple[Column, float]]) -> Column:
    """A weighted sum of flags under the market's own rule; a missing flag counts as 0."""
    def total(parts: list[tuple[Column, float]]) -> Column:
        return weighted_sum([(F.coalesce(c, F.lit(0.0)), w) for c, w in parts])

    out = F.when(F.lit(False), F.lit(0.0))
    for name, parts in rules.items():
        out = out.when(market == name, total(parts))
    return out.otherwise(total(otherwise))

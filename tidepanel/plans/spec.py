"""Strategies as JSON: templates and presets are filled in, checked, and applied to a panel as calls of the operators.

A spec holds `features` (a list, each from columns or features before it), `universe`, `weights`, and may hold `presets` (named lists
of features with parameters). A string "{name}" takes the parameter's value with its type; inside a longer string, its text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..operators import calendar, rolling, sliding, universe, weights
from ..operators import cross_section as xs


@dataclass(frozen=True)
class Transform:
    """make(column, **params) gives a column, or with whole=True make(df, input, name, **params) a DataFrame; bars(params): rows of
    history that one value needs besides its own; columns: the parameters that name columns or features."""

    make: Callable
    bars: Callable[[dict], int] = lambda p: 0
    whole: bool = False
    columns: tuple[str, ...] = ()


_window = lambda p: p["n"] - 1
_back = lambda p: p["n"]
TRANSFORMS: dict[str, Transform] = {
    "abs": Transform(F.abs), "log": Transform(ew.log), "clip": Transform(ew.clip), "linear_ramp": Transform(ew.linear_ramp), "quantize": Transform(ew.quantize), "target_vol": Transform(ew.target_vol),
    "shift": Transform(rolling.shift, _back), "delta": Transform(rolling.delta, _back), "simple_return": Transform(rolling.simple_return, _back), "momentum": Transform(rolling.momentum, _back),
    "rolling": Transform(lambda df, x, name, n, kind: sliding.rolling(df, x, n, kind, name), _window, True), "zscore": Transform(lambda df, x, name, n: sliding.standardised(df, x, n, name), _window, True), "wma": Transform(rolling.wma, _window), "efficiency_ratio": Transform(rolling.efficiency_ratio, _back), "downside_vol": Transform(rolling.downside_vol, _back),
    "worst_drawdown": Transform(lambda df, x, name, n: sliding.worst_drawdown(df, x, n, name), _window, True), "median": Transform(lambda df, x, name, n: sliding.median(df, x, n, name), _window, True), "cross_rank": Transform(xs.rank), "cross_percentile": Transform(xs.percentile), "quantile_bucket": Transform(xs.quantile_bucket),
    "percentile_of_last": Transform(lambda df, x, name, n: rolling.percentile_of_last(df, x, n, name), _window, True), "ewma": Transform(lambda df, x, name, n: rolling.ewma(df, x, n, name), lambda p: 8 * p["n"], True),
    "period_mean": Transform(lambda df, x, name, unit, timing="next_period": calendar.period_mean(df, x, unit, timing, name), lambda p: 2 * 31 * calendar.MONTHS.get(p["unit"], 1), True),
    "period_return": Transform(lambda df, x, name, unit, periods=1, timing="next_period": calendar.period_return(df, x, unit, periods, timing, name), lambda p: (p.get("periods", 1) + 2) * 31 * calendar.MONTHS.get(p["unit"], 1), True),
}
TRANSFORMS |= {
    "gaussian_signed": Transform(ew.gaussian_signed), "stepped_cap": Transform(ew.stepped_cap), "hump_steps": Transform(ew.hump_steps),
    "mask_by": Transform(lambda x, by: ew.mask_by(x, F.col(by)), columns=("by",)), "smaller_of": Transform(lambda x, other: ew.pair_min(x, F.col(other)), columns=("other",)), "larger_of": Transform(lambda x, other: ew.pair_max(x, F.col(other)), columns=("other",)),
    "less": Transform(lambda x, other: x - F.col(other), columns=("other",)), "times": Transform(lambda x, other: x * F.col(other), columns=("other",)), "over": Transform(lambda x, other: ew.ratio(x, F.col(other)), columns=("other",)), "over_positive": Transform(lambda x, other: ew.safe_ratio(x, F.col(other)), columns=("other",)),
    "expanding_std": Transform(rolling.expanding_std, lambda p: 1 << 30), "age_days": Transform(lambda x: rolling.age_days(x, F.col("ts")), lambda p: 1 << 30), "win_rate": Transform(rolling.win_rate, _back), "next_open_label": Transform(rolling.next_open_label),
    "vwma": Transform(lambda x, n, volume: rolling.vwma(x, F.col(volume), n), _window, columns=("volume",)), "weighted_momentum": Transform(lambda x, n, turnover: rolling.weighted_momentum(x, F.col(turnover), n), _back, columns=("turnover",)),
    "average_percent_rank": Transform(xs.average_percent_rank), "percentile_bucket": Transform(xs.percentile_bucket), "cross_mean": Transform(lambda x: F.avg(x).over(xs.at())), "breadth": Transform(lambda x, signal, **how: xs.breadth(x, F.col(signal), **{k: tuple(v) if isinstance(v, list) else v for k, v in how.items()}), columns=("signal",)),
    "group_demean": Transform(lambda x, group, min_size=1: xs.group_demean(x, group, min_size), columns=("group",)), "group_rank": Transform(lambda x, group, min_size=1, descending=False: xs.in_group(xs.rank(x, ("ts", group), descending), x, ("ts", group), min_size), columns=("group",)),
    "group_percentile": Transform(lambda x, group, min_size=1, descending=False: xs.in_group(xs.percentile(x, ("ts", group), descending), x, ("ts", group), min_size), columns=("group",)),
    "beta": Transform(lambda df, x, name, n, ref: sliding.beta(df, x, ref, n, name), _window, True, ("ref",)), "residual": Transform(lambda df, x, name, n, ref: sliding.residual(df, x, ref, n, name), _window, True, ("ref",)), "trend_quality": Transform(lambda df, x, name, n: sliding.trend_quality(df, x, n, name), _window, True),
    "median_return": Transform(lambda df, x, name, n: sliding.median_return(df, x, n, name), _back, True), "consistency": Transform(lambda df, x, name, n, least=1e-12: sliding.consistency(df, x, n, least, name), _back, True),
    "expanding_percentile": Transform(lambda df, x, name, least: rolling.expanding_percentile(df, x, least, name), lambda p: 1 << 30, True), "mid_rank": Transform(lambda df, x, name, n, least: rolling.mid_rank(df, x, n, least, name), _window, True), "turnover_percentile": Transform(lambda df, x, name, n, log1p=True: rolling.turnover_percentile(df, x, n, log1p, name), _window, True),
    "holding": Transform(lambda df, x, name, leave, cooldown=0, longest=None: rolling.holding_state(df, x, leave, cooldown, longest).withColumnRenamed("held", name), lambda p: 1 << 30, True, ("leave",)),
    "period_sum": Transform(lambda df, x, name, **p: calendar.period_sum(df, x, name=name, **p), lambda p: (p["periods"] + p.get("skip", 0) + 2) * 31 * calendar.MONTHS.get(p["unit"], 1), True), "period_robust_mean": Transform(lambda df, x, name, **p: calendar.period_robust_mean(df, x, name=name, **p), lambda p: (p["periods"] + p.get("skip", 0) + 2) * 31 * calendar.MONTHS.get(p["unit"], 1), True),
    "period_hold": Transform(lambda df, x, name, **p: calendar.period_hold(df, x, name=name, **p), lambda p: (p["periods"] + 2) * 31 * calendar.MONTHS.get(p["unit"], 1), True),
}


def register(name: str, make: Callable, bars: Callable[[dict], int] = lambda p: 0, whole: bool = False, columns: tuple[str, ...] = ()) -> None:
    """A transform of the user's own, by a new name."""
    if name in TRANSFORMS:
        raise ValueError(f"{name} is taken")
    TRANSFORMS[name] = Transform(make, bars, whole, columns)


def filled(value, params: dict):
    """value with all templates filled in; an unknown parameter raises."""
    if isinstance(value, dict):
        return {str(filled(k, params)): filled(v, params) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v, params) for v in value]
    if not isinstance(value, str):
        return value
    if alone := re.fullmatch(r"\{(\w+)\}", value):
        return params[alone[1]]
    return re.sub(r"\{(\w+)\}", lambda m: str(params[m[1]]), value)


def load(text: str, **params) -> dict:
    """A spec from JSON, presets expanded, templates filled, names checked."""
    raw = json.loads(text)
    presets = raw.pop("presets", {})
    features = []
    for f in raw.get("features", []):
        if "preset" in f:
            features += [filled(g, params | filled(f.get("params", {}), params)) for g in presets[f["preset"]]]
        else:
            features.append(filled(f, params))
    spec = filled({k: v for k, v in raw.items() if k != "features"}, params) | {"features": features}
    names: set[str] = set()
    for f in features:
        if f["name"] in names:
            raise ValueError(f"feature {f['name']} is defined twice")
        for s in f.get("steps", []):
            if s["op"] not in TRANSFORMS:
                raise ValueError(f"no transform {s['op']}")
        names.add(f["name"])
    return spec


def _compare(df: DataFrame, f: dict) -> Column:
    other = F.col(f["other"]) if isinstance(f["other"], str) else F.lit(float(f["other"]))
    return ew.compare(F.col(f["input"]), other, f["compare"])


def with_features(df: DataFrame, spec: dict) -> DataFrame:
    """The panel with a column for each feature, in the spec's order."""
    for f in spec["features"]:
        name = f["name"]
        if "compare" in f:
            df = df.withColumn(name, _compare(df, f))
        elif "logical" in f:
            df = df.withColumn(name, ew.logical(f["logical"], *[F.col(c) for c in f["inputs"]]))
        elif "sum" in f:
            df = df.withColumn(name, ew.weighted_sum([(F.col(c), float(w)) for c, w in f["sum"].items()]))
        else:
            df = df.withColumn(name, F.col(f["input"]))
            for s in f.get("steps", []):
                how, params = TRANSFORMS[s["op"]], {k: v for k, v in s.items() if k != "op"}
                if how.whole:
                    df = how.make(df.withColumnRenamed(name, "__x"), "__x", name, **params).drop("__x")
                else:
                    df = df.withColumn(name, how.make(F.col(name), **params))
    return df


def history(spec: dict) -> dict[str, int]:
    """Rows of history that each feature needs: its own steps', one after the other, beyond the longest of what it is made of."""
    need: dict[str, int] = {}
    for f in spec["features"]:
        inputs = f.get("inputs") or list(f.get("sum", {})) or [f["input"], *([f["other"]] if isinstance(f.get("other"), str) else [])]
        inputs = [*inputs, *[s[c] for s in f.get("steps", []) for c in TRANSFORMS[s["op"]].columns if c in s]]
        own = sum(TRANSFORMS[s["op"]].bars({k: v for k, v in s.items() if k != "op"}) for s in f.get("steps", []))
        need[f["name"]] = own + max(need.get(c, 0) for c in inputs)
    return need


def wanted_universe(spec: dict, name: Callable[[str], str] = lambda c: c) -> universe.Universe:
    """The spec's universe, with its columns under other names."""
    u = spec.get("universe", {})

    def ranked(r: dict) -> universe.Ranked:
        made = {k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}
        return universe.Ranked(**made | {"x": name(r["x"])})

    plain = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in u.items() if k not in ("ranks", "final", "values")}
    values = tuple((name(c), *rest) for c, *rest in u.get("values", []))
    return universe.Universe(**plain, values=values, ranks=tuple(ranked(r) for r in u.get("ranks", [])), final=ranked(u["final"]) if "final" in u else None)


def weigh(w: dict, selected: str, step: Callable[[Column, tuple[str, ...]], str], name: Callable[[str], str] = lambda c: c, price: str = "price") -> str:
    """The column with the target weight of every row of a dense grid by the spec's weights: 0 where nothing is wanted. The kinds are
    equal, fixed, feature_value, rank_fixed, listed_fixed, long_short and sides; then cap, rescale and exposure, if given.
    step(column, the columns that it reads) adds a column to the grid and says its name."""
    on, kind, gross = F.col(selected), w.get("kind", "equal"), float(w.get("gross", 1.0))
    given = name(w["score"]) if "score" in w else None
    score, reads = F.col(given) if given else None, (selected, *([given] if given else []))
    if kind == "equal":
        weight = F.when(on, F.try_divide(F.lit(gross), F.sum(on.cast("int")).over(xs.at()))).otherwise(0.0)
    elif kind == "fixed":
        weight = weights.fixed(on, float(w["weight"]), score)
    elif kind == "feature_value":
        weight = weights.feature_value(score, on, float(w["scale"]), float(w.get("low", -1)), float(w.get("high", 1)), gross)
    elif kind == "rank_fixed":
        shares = [float(x) for x in w["shares"]]
        place = xs.rank(F.when(on, score), descending=w.get("descending", True))
        share = step(F.when(place <= len(shares), F.element_at(F.array(*[F.lit(x) for x in shares]), place.cast("int"))), reads)
        weight, reads = F.coalesce(F.try_divide(F.col(share) * gross, F.sum(share).over(xs.at())), F.lit(0.0)), (share,)
    elif kind == "listed_fixed":
        known = step(F.coalesce(F.min(F.when(F.col(price).isNotNull(), F.col("ts"))).over(Window.partitionBy("market")) <= F.col("ts"), F.lit(False)), (price,))
        weight, reads = F.when(on & F.col(known), F.try_divide(F.lit(gross), F.sum(F.col(known).cast("int")).over(xs.at()))).otherwise(0.0), (*reads, known)
    elif kind in ("long_short", "sides"):
        if kind == "long_short":
            n, held = int(w["n"]), F.when(on, score)
            best, worst = xs.rank(held, descending=True) <= n, xs.rank(held) <= n
            side = F.when(best & worst, F.raise_error(F.lit("a market is on both sides")).cast("int")).when(best, 1).when(worst, -1)
        else:
            side = F.when(on, F.signum(score).cast("int"))
        side = step(F.coalesce(side, F.lit(0)), reads)
        long_share = float(w.get("long_share", 0.5))
        budget = F.when(F.col(side) > 0, gross * long_share).otherwise(gross * (1 - long_share))
        weight, reads = F.when(F.col(side) != 0, F.col(side) * budget / F.count(F.lit(1)).over(Window.partitionBy("ts", side))).otherwise(0.0), (side,)
    else:
        raise ValueError(f"no weights of kind {kind}")
    out = step(weight, reads)
    if "cap" in w:
        cap = F.lit(float(w["cap"]))
        if w.get("over_cap", "keep_cash") == "keep_cash":
            out = step(F.least(F.col(out), cap), (out,))
        else:
            each = step(weights.cap_scale(F.col(out), cap), (out,))
            scale = step(F.max(each).over(xs.at()), (each,))
            out = step(F.coalesce(F.least(cap, F.col(out) * F.col(scale)), F.lit(0.0)), (out, scale))
    if "rescale" in w:
        out = step(weights.rescale_to(F.col(out), float(w["rescale"])), (out,))
    if "exposure" in w:
        e = w["exposure"]
        feature = name(e["feature"])
        mood = step(F.max(feature).over(xs.at()), (feature,))
        held = rolling.shift(F.col(mood), e["lag"]) if e.get("lag") else F.col(mood)
        scale = step(F.coalesce(F.greatest(F.least(held, F.lit(float(e.get("high", 1.0)))), F.lit(float(e.get("low", 0.0)))), F.lit(0.0)), (mood,))
        out = step(F.col(out) * F.col(scale), (out, scale))
    return out


def targets(panel: DataFrame, spec: dict) -> DataFrame:
    """Target weights of a dense grid by the spec's universe and weights, at its rebalance times: ts, market, weight."""
    w, made = spec["weights"], universe.build(with_features(panel, spec), wanted_universe(spec))

    def step(column: Column, reads: tuple[str, ...]) -> str:
        nonlocal made
        made = made.withColumn(f"__w{len(made.columns)}", column)
        return made.columns[-1]

    weight = weigh(w, "selected", step)
    out = weights.rebalance_rows(made, w["every"]).select("ts", "market", F.col(weight).alias("weight"))
    return weights.changes_only(out, "weight") if w.get("change_only") else out

"""Many specs as one plan: their features become a graph in which equal parts are one node, over one scan of the panel.

A node is a transform with its parameters and inputs, named by a digest of these, so the same step over the same inputs is one
node whichever candidate asks for it, down to single steps of a chain. Only nodes that some universe or weights use are computed, level
by level: those of one level are columns of one select, which share their windows' sorts. Filters, ranks and weights are nodes
too, so candidates that differ in how many they pick share the rank. At the end a row is turned to one for each candidate.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..operators import cross_section as xs
from ..operators import universe, weights
from . import spec as specs


@dataclass(frozen=True)
class Node:
    """op is a transform's name, or compare, logical or sum; params its other parameters as JSON; inputs: nodes or panel columns. Of
    op "column", params is the expression's text."""

    op: str
    params: str
    inputs: tuple[str, ...]

    @property
    def name(self) -> str:
        return "f_" + hashlib.sha256(repr((self.op, self.params, self.inputs)).encode()).hexdigest()[:20]


@dataclass
class Graph:
    nodes: dict[str, Node] = field(default_factory=dict)
    levels: dict[str, int] = field(default_factory=dict)
    columns: dict[str, Column] = field(default_factory=dict)
    makers: dict[str, Callable[[DataFrame, str], DataFrame]] = field(default_factory=dict)

    def add(self, op: str, params: dict, inputs: tuple[str, ...]) -> str:
        node = Node(op, json.dumps(params, sort_keys=True), inputs)
        self.nodes[node.name] = node
        self.levels[node.name] = 1 + max((self.levels.get(i, 0) for i in inputs), default=0)
        return node.name

    def column(self, made: Column, inputs: tuple[str, ...]) -> str:
        """A node of any expression over the inputs."""
        name = self.add("column", {"text": str(made)}, inputs)
        self.columns[name] = made
        return name

    def frame(self, key: object, make: Callable[[DataFrame, str], DataFrame], inputs: tuple[str, ...]) -> str:
        """A node that needs the whole frame."""
        name = self.add("frame", {"key": repr(key)}, inputs)
        self.makers[name] = make
        return name

    def features(self, spec: dict, columns: list[str]) -> Callable[[str], str]:
        """Adds the spec's features, in whatever order they are listed; returns where each is. A circle, or a name that is neither
        a feature nor a column, raises."""
        wanted, found, open_ = {f["name"]: f for f in spec.get("features", [])}, {}, []

        def place(name: str) -> str:
            if name in found:
                return found[name]
            if name not in wanted:
                if name in columns:
                    return name
                raise ValueError(f"no feature or column {name}")
            if name in open_:
                raise ValueError(f"{' of '.join([*open_[open_.index(name):], name])}: a circle")
            open_.append(name)
            found[name] = self._feature(wanted[name], place)
            open_.pop()
            return found[name]

        return place

    def _feature(self, f: dict, place: Callable[[str], str]) -> str:
        if "compare" in f:
            other = f["other"]
            named = isinstance(other, str)
            return self.add("compare", {"op": f["compare"]} | ({} if named else {"bound": float(other)}), (place(f["input"]), *([place(other)] if named else [])))
        if "logical" in f:
            return self.add("logical", {"op": f["logical"]}, tuple(place(c) for c in f["inputs"]))
        if "sum" in f:
            return self.add("sum", {"shares": [float(x) for x in f["sum"].values()]}, tuple(place(c) for c in f["sum"]))
        now = place(f["input"])
        for s in f.get("steps", []):
            how = specs.TRANSFORMS[s["op"]]
            others = [c for c in how.columns if c in s]
            now = self.add(s["op"], {k: v for k, v in s.items() if k != "op" and k not in others} | {"columns": others}, (now, *(place(s[c]) for c in others)))
        return now

    def used(self, ends: set[str]) -> list[str]:
        """The nodes below the ends, by level."""
        todo, seen = list(ends), set()
        while todo:
            if (name := todo.pop()) in self.nodes and name not in seen:
                seen.add(name)
                todo += self.nodes[name].inputs
        return sorted(seen, key=lambda n: (self.levels[n], n))

    def computed(self, panel: DataFrame, ends: set[str]) -> DataFrame:
        """The panel with a column for each node that the ends need."""
        for _, group in itertools.groupby(self.used(ends), key=self.levels.get):
            plain, whole = {}, []
            for name in group:
                op = self.nodes[name].op
                if op == "frame" or op in specs.TRANSFORMS and specs.TRANSFORMS[op].whole:
                    whole.append(name)
                else:
                    plain[name] = self._column(self.nodes[name])
            panel = panel.withColumns(plain) if plain else panel
            for name in whole:
                node = self.nodes[name]
                if node.op == "frame":
                    panel = self.makers[name](panel, name)
                    continue
                params = json.loads(node.params)
                params |= dict(zip(params.pop("columns"), node.inputs[1:], strict=True))
                panel = specs.TRANSFORMS[node.op].make(panel, node.inputs[0], name, **params)
        return panel

    def _column(self, node: Node) -> Column:
        if node.op == "column":
            return self.columns[node.name]
        params, inputs = json.loads(node.params), [F.col(c) for c in node.inputs]
        if node.op == "compare":
            return ew.compare(inputs[0], inputs[1] if len(inputs) > 1 else F.lit(params["bound"]), params["op"])
        if node.op == "logical":
            return ew.logical(params["op"], *inputs)
        if node.op == "sum":
            return ew.weighted_sum(list(zip(inputs, params["shares"], strict=True)))
        params |= dict(zip(params.pop("columns"), node.inputs[1:], strict=True))
        return specs.TRANSFORMS[node.op].make(inputs[0], **params)


def grid(text: str, axes: dict[str, list], allowed: Callable[[dict], bool] = lambda p: True, **fixed) -> list[dict]:
    """The specs of all allowed combinations of the axes' values, with their parameters under `params`."""
    every = [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]
    return [specs.load(text, **fixed, **p) | {"params": p} for p in every if allowed(p)]


def selected(graph: Graph, wanted: universe.Universe, price: str = "price") -> str:
    """The node of universe.build's selected."""
    wanted = wanted.lagged()
    base = universe.listed(F.col("market"), wanted.allow, wanted.exclude) & F.col(price).isNotNull()
    if wanted.exclude_warnings:
        base = base & universe.without_warnings(F.col("warning"), wanted.exclude_warnings)
    if wanted.min_age_days:
        first = graph.column(F.min(F.when(F.col(price).isNotNull(), F.col("ts"))).over(Window.partitionBy("market")), (price,))
        base = base & F.coalesce(F.datediff("ts", first) >= wanted.min_age_days, F.lit(False))
    tests = [graph.column(universe.value_filter(F.col(c), op, bound, lag), (c,)) for c, op, bound, lag in wanted.values]
    for t in tests:
        base = base & F.col(t)
    now = graph.column(base, (price, *tests, *([first] if wanted.min_age_days else [])))
    if wanted.least_cross_section:

        def since(df: DataFrame, name: str, held: str = now) -> DataFrame:
            enough = df.groupBy("ts").agg(F.count(F.when(F.col(held), 1)).alias("__n")).where(F.col("__n") >= wanted.least_cross_section).agg(F.min("ts").alias("__since"))
            return df.crossJoin(F.broadcast(enough)).withColumn(name, F.coalesce(F.col(held) & (F.col("ts") >= F.col("__since")), F.lit(False))).drop("__since")  # one row

        now = graph.frame((now, wanted.least_cross_section), since, (now,))
    everyone = now
    for r in (*wanted.ranks, *((wanted.final,) if wanted.final else ())):
        held = graph.column(universe.shift(F.col(r.x), r.lag), (r.x,)) if r.lag else r.x
        among = everyone if r.everyone else now
        inside = graph.column(F.when(F.col(among), F.col(held)), (among, held))
        place = graph.column(xs.rank(F.col(inside), descending=r.descending), (inside,))
        if r.top_n:
            chosen, reads = F.col(place) <= r.top_n, ()
        else:
            size = graph.column(xs.size(F.col(inside)), (inside,))
            chosen, reads = (1 + F.floor((F.col(place) - 1) * r.quantiles / F.col(size))).isin(*r.buckets), (size,)
        now = graph.column(F.col(now) & F.coalesce(chosen, F.lit(False)), (now, place, *reads))
    return now


def first_of_period(graph: Graph, every: str) -> str:
    """The node of the rows at the first time of each period. The grid is dense, so a market's row before is that of the time before."""
    if every == "every_bar":
        return graph.column(F.lit(True), ())
    period = weights.period_key(F.col("ts"), every)
    before = F.lag(period).over(Window.partitionBy("market").orderBy("ts"))
    return graph.column(before.isNull() | (before != period), ())


def compiled(candidates: list[dict], columns: list[str], price: str = "price") -> tuple[Graph, list[tuple[str, str]]]:
    """The graph of all candidates, and for each its nodes of the weight and of the rows at which it stands."""
    graph, ends = Graph(), []
    for s in candidates:
        place = graph.features(s, columns)
        weight = specs.weigh(s["weights"], selected(graph, specs.wanted_universe(s, place), price), graph.column, place, price)
        ends.append((weight, first_of_period(graph, s["weights"]["every"])))
    return graph, ends


def targets(panel: DataFrame, candidates: list[dict], price: str = "price") -> DataFrame:
    """candidate (its place in the list), ts, market, weight: what spec.targets gives for each of the specs. panel is a dense grid:
    all its markets have a row at all its times."""
    graph, ends = compiled(candidates, panel.columns, price)
    rows = graph.computed(panel, {n for pair in ends for n in pair})
    sparse = [bool(s["weights"].get("change_only")) for s in candidates]
    asked = [F.struct(F.lit(k).alias("candidate"), F.col(w).alias("weight"), F.col(at).alias("at"), F.lit(only).alias("sparse")) for k, ((w, at), only) in enumerate(zip(ends, sparse, strict=True))]
    out = rows.select("ts", "market", F.explode(F.array(*asked)).alias("c")).select("c.*", "ts", "market").where("at")
    if any(sparse):
        out = out.withColumn("__b", F.lag("weight").over(Window.partitionBy("candidate", "market").orderBy("ts")))
        moved = F.max((F.col("__b").isNull() | (F.col("weight") != F.col("__b"))).cast("int")).over(Window.partitionBy("candidate", "ts"))
        out = out.withColumn("__m", moved).where(~F.col("sparse") | (F.col("__m") == 1))
    return out.select("candidate", "ts", "market", "weight")

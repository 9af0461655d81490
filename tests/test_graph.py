"""Many specs in one plan against each of them alone."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidepanel.plans import graph, spec
from tidepanel.plans.strategies import AXES, GRID_SPEC


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    rows = [(f"2020-{1 + t // 28:02d}-{1 + t % 28:02d}", m, float(10 + (t * (k + 3) * 7 % 23) + k) if (t + k) % 17 else None, float((t * 5 + k * 11) % 60), "ab"[k % 2]) for t in range(100) for k, m in enumerate("pqrstuv")]
    path = str(tmp_path_factory.mktemp("grid") / "grid")
    spark.createDataFrame(rows, "ts string, market string, price double, volume double, sector string").withColumn("ts", F.to_date("ts")).write.parquet(path)
    return spark.read.parquet(path)


def got_and_alone(panel, candidates):
    got = {(r.candidate, r.ts, r.market): r.weight for r in graph.targets(panel, candidates).collect()}
    alone = {(k, r.ts, r.market): r.weight for k, s in enumerate(candidates) for r in spec.targets(panel, s).collect()}
    return got, alone


def test_sixteen_candidates_equal_sixteen_runs(panel):
    text = GRID_SPEC.replace('{"name": "score", "input": "ret", "steps": [{"op": "shift", "n": 1}]},', "").replace('"lively"', '"score", "input": "ret", "steps": [{"op": "shift", "n": 1}]}, {"name": "lively"', 1)
    ordered = graph.grid(text, AXES)  # spec.targets wants its features in order
    assert [s["params"] for s in ordered][:2] == [{"n": 2, "k": 2}, {"n": 2, "k": 3}]
    got, alone = got_and_alone(panel, ordered)
    assert got == pytest.approx(alone) and len({k for k, _, _ in got}) == 16 and any(got.values())
    same = {(r.candidate, r.ts, r.market): r.weight for r in graph.targets(panel, graph.grid(GRID_SPEC, AXES)).collect()}
    assert same == pytest.approx(got)


def test_one_scan_and_shared_nodes(panel):
    candidates = graph.grid(GRID_SPEC, AXES)
    plan = graph.targets(panel, candidates)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    g, ends = graph.compiled(candidates, panel.columns)
    # the mean, its comparison, the filter, the base and the month once; return, shift, the values inside and their rank for each n; the pick and the weight for each candidate
    assert len(g.nodes) == 5 + 4 * 4 + 16 * 2 and len(set(ends)) == 16


def test_one_plan_takes_less_than_half_of_sixteen(panel):
    candidates = graph.grid(GRID_SPEC.replace('{"name": "score", "input": "ret", "steps": [{"op": "shift", "n": 1}]},', "").replace('"x": "score"', '"x": "ret", "lag": 1'), AXES)
    took = []
    for run in (lambda: graph.targets(panel, candidates), None):
        began = time.time()
        if run:
            run().write.format("noop").mode("overwrite").save()
        else:
            for s in candidates:
                spec.targets(panel, s).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[0] < took[1] / 2, took


KINDS = [
    {"kind": "fixed", "weight": 0.2}, {"kind": "fixed", "weight": 0.2, "score": "ret"}, {"kind": "feature_value", "score": "ret", "scale": 0.5},
    {"kind": "rank_fixed", "score": "ret", "shares": [0.5, 0.3, 0.2]}, {"kind": "listed_fixed"}, {"kind": "long_short", "score": "ret", "n": 2}, {"kind": "sides", "score": "ret", "long_share": 0.7},
    {"kind": "equal", "cap": 0.15}, {"kind": "rank_fixed", "score": "ret", "shares": [0.7, 0.2, 0.1], "cap": 0.4, "over_cap": "redistribute"}, {"kind": "equal", "rescale": 0.5},
    {"kind": "equal", "exposure": {"feature": "mood", "lag": 1}}, {"kind": "equal", "change_only": True}, {"kind": "equal", "every": "14d+3"}, {"kind": "equal", "every": "every_bar"},
]


def base(w, **universe):
    return spec.load(json.dumps({
        "features": [{"name": "ret", "input": "price", "steps": [{"op": "simple_return", "n": 3}]}, {"name": "mood", "input": "ret", "steps": [{"op": "cross_mean"}, {"op": "clip", "lower": -1, "upper": 1}]}],
        "universe": {"ranks": [{"x": "volume", "top_n": 6}], "final": {"x": "ret", "top_n": 4}} | universe, "weights": {"every": "monthly", "gross": 0.9} | w,
    }))


def test_all_kinds_of_weights(panel):
    candidates = [base(w) for w in KINDS]
    got, alone = got_and_alone(panel, candidates)
    assert got == pytest.approx(alone)
    for k in range(len(KINDS)):
        assert any(v for (c, _, _), v in got.items() if c == k), KINDS[k]


def test_universes(panel):
    candidates = [base({}), base({}, least_cross_section=6), base({}, allow=["p", "q", "r"]), base({}, min_age_days=20), base({}, signal_lag=2), base({}, values=[["mood", "gt", 0.0, 1]])]
    got, alone = got_and_alone(panel, candidates)
    assert got == pytest.approx(alone)


STEPS = [
    [{"op": "beta", "n": 5, "ref": "volume"}], [{"op": "residual", "n": 5, "ref": "volume"}], [{"op": "median", "n": 4}], [{"op": "worst_drawdown", "n": 6}], [{"op": "trend_quality", "n": 6}], [{"op": "zscore", "n": 6}], [{"op": "ewma", "n": 4}],
    [{"op": "mask_by", "by": "volume"}], [{"op": "group_percentile", "group": "sector"}], [{"op": "group_demean", "group": "sector"}], [{"op": "vwma", "n": 4, "volume": "volume"}], [{"op": "breadth", "signal": "volume", "n": 3}], [{"op": "percentile_of_last", "n": 6}, {"op": "shift", "n": 2}],
    [{"op": "over", "other": "volume"}, {"op": "log"}, {"op": "cross_rank"}], [{"op": "period_sum", "unit": "month", "periods": 1}], [{"op": "age_days"}, {"op": "linear_ramp", "start": 0, "end": 90, "low": 0, "high": 1}], [{"op": "median_return", "n": 5}], [{"op": "mid_rank", "n": 9, "least": 3}],
]


def test_transforms_give_the_same_columns_as_one_after_the_other(panel):
    text = {"features": [{"name": f"x{k}", "input": "price", "steps": s} for k, s in enumerate(STEPS)], "weights": {}}
    loaded = spec.load(json.dumps(text))
    g = graph.Graph()
    place = g.features(loaded, panel.columns)
    names = {f["name"]: place(f["name"]) for f in loaded["features"]}
    made = g.computed(panel, set(names.values()))
    got = {(r.ts, r.market): [r[c] for c in names.values()] for r in made.collect()}
    for k, s in enumerate(STEPS):
        one = spec.with_features(panel, {"features": [{"name": "x", "input": "price", "steps": s}]})
        want = {(r.ts, r.market): r.x for r in one.select("ts", "market", "x").collect()}
        assert {key: v[k] for key, v in got.items()} == pytest.approx(want, nan_ok=True), s
        assert any(v is not None for v in want.values()), s


def test_circles_and_unknown_names_raise(panel):
    a = {"name": "a", "sum": {"b": 1.0}}
    for features, message in (([a, {"name": "b", "sum": {"a": 1.0}}], "circle"), ([a], "no feature or column b")):
        with pytest.raises(ValueError, match=message):
            graph.Graph().features({"features": features}, panel.columns)("a")


def test_a_users_own_transform(panel):
    spec.TRANSFORMS.pop("mine", None)
    spec.register("mine", lambda x, other, k: x * k + F.col(other), columns=("other",))
    made = spec.load('{"features": [{"name": "a", "input": "price", "steps": [{"op": "mine", "other": "volume", "k": 2}]}], "weights": {}}')
    g = graph.Graph()
    name = g.features(made, panel.columns)("a")
    assert g.computed(panel, {name}).where(F.col(name) != F.col("price") * 2 + F.col("volume")).count() == 0


def test_constraints_on_the_grid():
    assert len(graph.grid(GRID_SPEC, AXES, lambda p: p["k"] < p["n"])) == 10

"""Windows of constant work against plain ones, for windows shorter and longer than the rows, with nulls and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import rolling, sliding


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = [(m, t, None if rng.random() < 0.05 else float(rng.integers(1, 40)), float(rng.normal())) for m in "abc" for t in range(150)]
    rows += [("flat", t, 3.0, 2.0) for t in range(30)] + [("one", 0, 1.0, 1.0), ("none", 0, None, None)]
    return pd.DataFrame(rows, columns=["market", "ts", "x", "r"]), spark.createDataFrame(rows, "market string, ts int, x double, r double").repartition(3)


def by_market(frame, f):
    return pd.concat([f(d) for _, d in frame.sort_values(["market", "ts"]).groupby("market")]).to_numpy(float)


def values(df, name):
    return df.select("market", "ts", name).toPandas().sort_values(["market", "ts"])[name].to_numpy(float)


@pytest.mark.parametrize("n", [1, 2, 7, 10, 149, 200])
def test_equal_to_plain_windows(panel, n):
    pdf, df = panel
    plain = lambda f: by_market(pdf, lambda d: f(d.x.astype(float).rolling(n)))
    for kind in ("mean", "sum", "max", "min"):
        assert np.allclose(values(sliding.rolling(df, "x", n, kind, "y"), "y"), plain(lambda w, k=kind: getattr(w, k)()), equal_nan=True)
    assert np.allclose(values(sliding.rolling(df, "x", n, "std", "y"), "y"), plain(lambda w: w.std(ddof=0)), equal_nan=True, atol=1e-6)
    assert np.allclose(values(sliding.median(df, "x", n, "y"), "y"), plain(lambda w: w.median()), equal_nan=True)
    worst = lambda a: np.nan if np.isnan(a).any() else (a / np.maximum.accumulate(a) - 1).min()
    assert np.allclose(values(sliding.worst_drawdown(df, "x", n, "y"), "y"), plain(lambda w: w.apply(worst, raw=True)), equal_nan=True)


@pytest.mark.parametrize("n", [2, 7, 149])
def test_beta_equals_plain(panel, n):
    pdf, df = panel

    def beta(d):
        out = []
        for k in range(len(d)):
            w = d.iloc[max(0, k - n + 1) : k + 1]
            full = len(w) == n and w.x.notna().all() and w.r.notna().all() and w.r.std() > 0
            out.append(np.cov(w.x.astype(float), w.r, ddof=0)[0, 1] / w.r.var(ddof=0) if full else np.nan)
        return pd.Series(out)

    assert np.allclose(values(sliding.beta(df, "x", "r", n, "y"), "y"), by_market(pdf, beta), equal_nan=True)


def test_a_large_value_leaves_no_error_behind(spark):
    x = [1e12, *[1.0 + k % 3 for k in range(40)]]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "market string, ts int, x double")
    got = values(sliding.rolling(df, "x", 6, "std", "y"), "y")
    assert got[12:] == pytest.approx(np.std([1.0, 2.0, 3.0, 1.0, 2.0, 3.0]), rel=1e-12)


def test_constant_reference_has_no_beta(spark):
    df = spark.createDataFrame([("a", t, float(t), 0.1) for t in range(20)], "market string, ts int, x double, r double")
    assert all(np.isnan(values(sliding.beta(df, "x", "r", 5, "y"), "y")))


def test_plan_gathers_nothing_and_shuffles_once(panel):
    _, df = panel
    made = sliding.worst_drawdown(sliding.beta(df, "x", "r", 50), "x", 50)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_digits_follow_the_data(panel):
    _, df = panel
    assert sliding.digits(df, "x", 16) == 2 and sliding.digits(df.where("market = 'flat'"), "x", 2) == 5 and sliding.digits(df.where("false"), "x", 16) == 1


def test_percentile_of_last_against_plain(panel):
    pdf, df = panel
    known = pdf[pdf.x.notna()]
    want = by_market(known, lambda d: d.x.astype(float).rolling(9).rank(pct=True))
    got = rolling.percentile_of_last(df.where(F.col("x").isNotNull()), "x", 9, "y")
    assert np.allclose(values(got, "y"), want, equal_nan=True)

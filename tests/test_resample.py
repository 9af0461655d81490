"""Block lengths, kinds of blocks and confidence sets against plain versions."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import resample


def day(k):
    return date(2020, 1, 1) + timedelta(days=k)


def series(n, phi, seed):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = phi * x[t - 1] + rng.normal()
    return x


def plain_length(x):
    """The published rule, lag by lag."""
    n, e = len(x), x - x.mean()
    run = max(5, int(math.log10(n)))
    most = math.ceil(math.sqrt(n)) + run
    cov = [float(e[k:] @ e[: n - k]) / n for k in range(most + 1)]
    rho = [abs(cov[k]) * n / math.sqrt(float(e[k + 1 :] @ e[k + 1 :]) * float(e[: -(k + 1)] @ e[: -(k + 1)])) for k in range(most + 1)]
    bound = 2 * math.sqrt(math.log10(n) / n)
    first = next((k - run for k in range(run, most + 1) if all(r < bound for r in rho[k - run : k])), None)
    m = most if first is None else min(most, 2 * max(first, 1))
    lam = [1 if k / m <= 0.5 else 2 * (1 - k / m) for k in range(m + 1)]
    g, lr = sum(2 * lam[k] * k * cov[k] for k in range(1, m + 1)), cov[0] + sum(2 * lam[k] * cov[k] for k in range(1, m + 1))
    top = math.ceil(min(3 * math.sqrt(n), n / 3))
    return m, *[min(top, (2 * g * g / (c * lr * lr)) ** (1 / 3) * n ** (1 / 3)) for c in (2, 4 / 3)]


@pytest.mark.parametrize("block", [4096, 64])
def test_block_lengths_equal_the_published_rule(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "LAG_BLOCK", block)
    made = {"white": series(500, 0.0, 1), "ar": series(700, 0.6, 2), "long": series(1000, 0.95, 3), "short": series(12, 0.2, 4), "down": series(333, -0.4, 5)}
    rows = [(k, day(t), float(v)) for k, x in made.items() for t, v in enumerate(x)] + [("few", day(0), 1.0), ("flat", day(0), None)] + [("flat", day(t), 2.0) for t in range(1, 40)]
    got = {r.run_id: r for r in resample.block_lengths(spark.createDataFrame(rows, "run_id string, ts date, x double"), "x").collect()}
    for k, x in made.items():
        m, sb, cb = plain_length(x)
        assert got[k].n == len(x) and got[k].lags == m and got[k].stationary == pytest.approx(sb) and got[k].circular == pytest.approx(cb), k
    assert got["few"].stationary is None and got["flat"].stationary is None and got["flat"].n == 39


def test_automatic_block_is_the_median_of_all_series(spark):
    xs = [series(400, phi, k) for k, phi in enumerate((0.2, 0.5, 0.8))]
    df = spark.createDataFrame([(str(k), day(t), float(v)) for k, x in enumerate(xs) for t, v in enumerate(x)], "candidate string, ts date, d double")
    assert resample.chosen_block(df, "d", "auto", "candidate") == round(float(np.median([plain_length(x)[1] for x in xs])))
    assert resample.chosen_block(df, "d", "auto", "candidate", "circular") == round(float(np.median([plain_length(x)[2] for x in xs])))
    assert resample.chosen_block(df, "d", 7, "candidate") == 7
    got = resample.superior_ability(df, "auto", 20, 1).first()
    assert got.candidates == 3 and got.p_lower <= got.p_consistent <= got.p_upper


@pytest.mark.parametrize("kind", ["circular", "moving"])
def test_blocks_of_one_length(spark, kind):
    at = resample.positions_of(kind, spark.createDataFrame([(50,)], "n long"), 7, 40, 3).toPandas()
    assert (at.groupby("rep").size() == 50).all() and at["pos"].between(0, 49).all()
    wraps = 0
    for _, rows in at.groupby("rep"):
        pos = rows.sort_values("k")["pos"].to_numpy()
        for lo in range(0, 50, 7):
            step = np.diff(pos[lo : lo + 7])
            assert set(step) <= ({1, -49} if kind == "circular" else {1})
            wraps += (step == -49).sum()
    assert (wraps > 0) == (kind == "circular")
    with pytest.raises(ValueError, match="no bootstrap"):
        resample.positions_of("other", spark.createDataFrame([(5,)], "n long"), 2, 2, 1)


def data(k, n=60):
    rng = np.random.default_rng(5)
    return rng.normal(size=(n, k)) + np.linspace(-0.6, 0.6, k)[rng.permutation(k)]


def boot_means(spark, x, block, reps, seed, kind="stationary"):
    at = resample.positions_of(kind, spark.createDataFrame([(len(x),)], "n long"), block, reps, seed).toPandas()
    return np.stack([x[at[at["rep"] == r].sort_values("k")["pos"]].mean(0) for r in range(reps)])


def plain_set(x, boot, method):
    left, floor, out = list(range(x.shape[1])), 0.0, []
    while len(left) > 1:
        m = x[:, left].mean(0)
        dev = boot[:, left] - m
        if method == "max":
            dev = dev - dev.mean(1, keepdims=True)
            sd = np.sqrt((dev**2).mean(0))
            t = -(m - m.mean()) / sd
            largest, seen, worst = (-dev / sd).max(1), t.max(), int(t.argmax())
        else:
            pair = dev[:, :, None] - dev[:, None, :]
            sd = np.sqrt((pair**2).mean(0))
            np.fill_diagonal(sd, np.inf)
            t = (m[None, :] - m[:, None]) / sd
            largest, seen, worst = np.abs(pair / sd).max((1, 2)), np.abs(t).max(), int(t.max(1).argmax())
        floor = max(floor, (largest >= seen).mean())
        out.append((left.pop(worst), floor))
    return [*out, (left[0], 1.0)]


@pytest.mark.parametrize(("method", "kind"), [("max", "stationary"), ("max", "circular"), ("R", "stationary"), ("R", "moving")])
def test_confidence_set_equals_plain_versions(spark, method, kind):
    x = data(9)
    df = spark.createDataFrame([(f"c{k}", day(t), float(x[t, k])) for t in range(60) for k in range(9)], "candidate string, ts date, d double")
    got = resample.confidence_set(df, 5, 50, 1, kind, method).orderBy("order").collect()
    want = plain_set(x, boot_means(spark, x, 5, 50, 1, kind), method)
    assert [r.candidate for r in got] == [f"c{k}" for k, _ in want] and [r.p for r in got] == pytest.approx([p for _, p in want])


def test_confidence_set_takes_no_more_jobs_for_more_candidates(spark):
    jobs = []
    for k in (3, 30):
        x = data(k, 40)
        df = spark.createDataFrame([(f"c{i:02d}", day(t), float(x[t, i])) for t in range(40) for i in range(k)], "candidate string, ts date, d double").repartition(2)
        spark.sparkContext.setJobGroup(f"set{k}", "")
        assert resample.confidence_set(df, 4, 30, 1).count() == k
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"set{k}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 2  # adaptive execution may cut an action into one job more


def test_one_candidate_alone(spark):
    df = spark.createDataFrame([("a", day(t), float(t % 3)) for t in range(30)], "candidate string, ts date, d double")
    assert [(r.candidate, r.order, r.p) for r in resample.confidence_set(df, 3, 10, 1).collect()] == [("a", 1, 1.0)]
    assert resample.block_lengths(df.where("false").withColumn("run_id", F.lit("a")), "d").count() == 0

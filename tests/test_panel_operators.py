"""Operators that no SQL states, against plain versions; and files, streams and specs by hand."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import text
from tidepanel.operators import blends, calendar, covariance, resample, rolling, statements, tables, universe, weights
from tidepanel.operators import cross_section as xs
from tidepanel.plans import spec
from tidepanel.sources import files
from tidepanel.streaming import bars, state

DAY = date(2024, 1, 1)


def day(k: int) -> date:
    return DAY + timedelta(days=k)


def test_slots_equal_a_plain_loop(spark):
    rng = random.Random(4)
    markets, n, cooldown, longest, slots = "abcdef", 60, 2, 9, 2
    rows = [("r", t, m, rng.random() < 0.8, rng.random() < 0.95, rng.choice([None, 1.0, 2.0, 3.0]), 1.0 if rng.random() < 0.1 else 0.0) for t in range(n) for m in markets]
    df = spark.createDataFrame(rows, "run_id string, ts int, market string, candidate boolean, eligible boolean, score double, leave double")
    one, many = ({(r.ts, r.market) for r in universe.held_slots(df, slots, cooldown=cooldown, longest=longest, times=k).where("selected").collect()} for k in (None, 7))
    at, since, rest, want = {(t, m): x for _, t, m, *x in rows}, {}, {}, set()
    for t in range(n):
        for m in list(since):
            _, ok, _, out = at[t, m]
            if not ok or out or t - since[m] >= longest:
                del since[m]
                rest[m] = t + cooldown + 1
        free = sorted((-at[t, m][2], m) for m in markets if m not in since and rest.get(m, 0) <= t and at[t, m][0] and at[t, m][1] and at[t, m][2] is not None and not at[t, m][3])
        for _, m in free[: slots - len(since)]:
            since[m] = t
        want |= {(t, m) for m in since}
    assert one == many == want and want
    assert universe.held_slots(df.where("false"), slots).count() == 0


def test_greedy_pick_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=70)
    series = {m: base * w + rng.normal(size=70) * (1 - w) for m, w in zip("abcde", (0.9, 0.8, 0.1, 0.7, 0.0), strict=True)}
    size = dict(zip("abcde", (5.0, 9.0, 1.0, 7.0, 3.0), strict=True))
    rows = [(day(t), m, float(series[m][t]) if (t + ord(m)) % 9 else None, size[m]) for t in range(70) for m in "abcde"]
    df = spark.createDataFrame(rows, "ts date, market string, ret double, vol double")
    got = {(r.period, r.market) for r in xs.greedy_uncorrelated(df, "ret", "vol", 0.5, 40, 10, 20).collect()}
    wide = df.toPandas().pivot(index="ts", columns="market", values="ret").sort_index()
    wide.index = pd.to_datetime(wide.index)
    want = set()
    for period, part in wide.groupby(wide.index.to_period("M")):
        end = wide.index.get_loc(part.index[-1])
        corr = wide.iloc[max(0, end - 39) : end + 1].corr(min_periods=10)
        kept = []
        for m in sorted(size, key=lambda m: (-size[m], m)):
            if not (corr.loc[m, kept] >= 0.5).any():
                kept.append(m)
        want |= {(period.start_time.date(), m) for m in kept}
    assert got == want


def _books(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 5)) @ rng.normal(size=(5, 5)) * 0.02
    rows = [(day(t), m, float(x[t, k])) for t in range(50) for k, m in enumerate("abcde")]
    returns = spark.createDataFrame(rows, "ts date, market string, ret double")
    book = spark.createDataFrame([(day(49), m, w) for m, w in zip("abcde", (0.1, 0.2, 0.3, 0.3, 0.1), strict=True)], "ts date, market string, weight double")
    return x, returns, book


def test_risk_parity_equals_a_plain_version(spark):
    x, returns, book = _books(spark)
    got = {r.market: r.weight for r in covariance.risk_parity_tree(book, covariance.pair_moments(returns, book, 40), 10).collect()}
    cov, corr = np.cov(x[10:], rowvar=False), np.corrcoef(x[10:], rowvar=False)
    parts = [[k] for k in range(5)]
    ids = list(range(5))
    while len(parts) > 1:  # single linkage: the two parts with the nearest members
        d, i, j = min((min(math.sqrt(max(0, (1 - corr[a, b]) / 2)) for a in parts[i] for b in parts[j]), i, j) for i in range(len(parts)) for j in range(i))
        lo, hi = (i, j) if ids[i] < ids[j] else (j, i)
        joined = parts[lo] + parts[hi]
        keep = [k for k in range(len(parts)) if k not in (i, j)]
        parts, ids = [parts[k] for k in keep] + [joined], [ids[k] for k in keep] + [max(ids) + 10]

    def risk(p):
        w = 1 / np.diag(cov)[p]
        w /= w.sum()
        return w @ cov[np.ix_(p, p)] @ w

    def share(p):
        if len(p) == 1:
            return {p[0]: 1.0}
        a, b = p[: len(p) // 2], p[len(p) // 2 :]
        alpha = 1 - risk(a) / (risk(a) + risk(b))
        return {k: v * alpha for k, v in share(a).items()} | {k: v * (1 - alpha) for k, v in share(b).items()}

    want = share(parts[0])
    assert got == pytest.approx({m: want[k] for k, m in enumerate("abcde")}) and sum(got.values()) == pytest.approx(1)


def test_volatility_scale_equals_a_plain_version(spark):
    x, returns, book = _books(spark)
    moments = covariance.pair_moments(returns, book, 40, before=True)
    w = np.array([0.1, 0.2, 0.3, 0.3, 0.1])
    risk = math.sqrt(w @ np.cov(x[9:49], rowvar=False) @ w * 252)
    target = risk * 0.637
    assert covariance.volatility_scale(book, moments, target, 252, 10, step=0.1).first().multiplier == pytest.approx(0.6)
    assert covariance.volatility_scale(book, moments, target, 252, 10).first().multiplier == pytest.approx(0.637)
    assert covariance.volatility_scale(book, moments, target, 252, 41, high=0.9).first().multiplier == 0.9


def _curves(spark, n=200):
    rng = random.Random(3)
    value, rows = {"x": 1.0, "y": 1.0}, []
    for t in range(n):
        for r in value:
            rows.append((r, day(t), value[r]))
            value[r] *= 1 + rng.uniform(-0.03, 0.031)
    return spark.createDataFrame(rows, "run_id string, ts date, value double"), rows


def _blend(rows, share, every_month, fee, lookback=None, exposure=1.0):
    wide = pd.DataFrame(rows, columns=["r", "ts", "v"]).pivot(index="ts", columns="r", values="v")
    wide.index = pd.to_datetime(wide.index)
    months, ret = wide.index.to_period("M"), wide.pct_change().fillna(0.0)
    ends = wide.groupby(months).last()
    held, cash, out, moved = pd.Series(share), max(0.0, 1 - sum(share.values())), [], 0.0
    for k in range(len(wide)):
        if k and months[k] != months[k - 1] and every_month:
            want = pd.Series(share)
            if lookback:
                before = list(ends.index).index(months[k - 1])
                if before >= lookback:
                    want = want.where(ends.iloc[before] / ends.iloc[before - lookback] > 1, want * exposure)
            total = held.sum() + cash
            rest = max(0.0, 1 - want.sum())
            turn = ((want * total - held).abs().sum() + abs(rest * total - cash)) / (2 * total)
            moved += turn
            total *= 1 - turn * fee / 10_000
            held, cash = want * total, rest * total
        held = held * (1 + ret.iloc[k])
        out.append((wide.index[k].date(), held.sum() + cash, moved))
    return out


def test_blends_equal_plain_loops(spark):
    c, rows = _curves(spark)
    share = {"x": 0.6, "y": 0.4}
    for got, want in ((blends.rebalanced(c, share, "monthly", 20.0), _blend(rows, share, True, 20)), (blends.trend_exposed(c, share, 2, 0.3, 20.0), _blend(rows, share, True, 20, 2, 0.3))):
        found = sorted((r.ts, r.value, r.turnover) for r in got.collect())
        assert [f[0] for f in found] == [w[0] for w in want]
        assert [f[1] for f in found] == pytest.approx([w[1] for w in want]) and [f[2] for f in found] == pytest.approx([w[2] for w in want])
    assert [v for _, v in sorted((r.ts, r.value) for r in blends.drifting(c, share).collect())] == pytest.approx([w[1] for w in _blend(rows, share, False, 0)])


def test_byte_order_marks_do_no_harm(spark, tmp_path):
    head = "market,ts,open,high,low,close,volume,amount,warning\n"
    (tmp_path / "a.csv").write_text("﻿" + head + "a,2024-01-02,1,2,0.5,1.5,10,15,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(head + "b,2024-01-01,1,2,0.5,1.5,,15,CAUTION\n", encoding="utf-8")
    got = sorted(files.read_bars(spark, f"{tmp_path}/*.csv").collect(), key=lambda r: r.market)
    assert [(r.market, r.close, r.volume, r.warning) for r in got] == [("a", 1.5, 10.0, None), ("b", 1.5, None, "CAUTION")]


def test_a_custom_source_that_ends_early_raises(spark):
    p = spark.createDataFrame([(day(0), "a", 1.0), (day(3), "a", 2.0)], "ts date, market string, price double")
    own = spark.createDataFrame([(day(2), "a", 5.0)], "ts date, market string, v double")
    with pytest.raises(Exception, match="ends before"):
        files.with_source(p, own, "v").collect()
    assert files.with_source(p, own.unionByName(spark.createDataFrame([(day(3), "b", 1.0)], own.schema)), "v").count() == 2


def test_one_to_one_raises_on_two(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="more than one"):
        statements.one_to_one(a, b, ["k"]).collect()
    assert {(r.k, r.v) for r in statements.one_to_one(a, b.limit(1), ["k"]).collect()} == {(1, "x"), (2, None)}


def test_exposure_must_be_common_to_a_time(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.6)], "ts int, market string, x double")
    with pytest.raises(Exception, match="differ"):
        weights.common_scale(df, "x").collect()
    with pytest.raises(Exception, match="negative"):
        weights.common_scale(df.where("market = 'a'").withColumn("x", -F.col("x")), "x", neutral=1.0).collect()


def test_watermark_withholds_open_windows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(at + timedelta(minutes=m), "k", float(m), m) for m in (5, 50, 70, 95, 121)], "ts timestamp, event_type string, value double, event_id int").coalesce(1).write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema("ts timestamp, event_type string, value double, event_id int").parquet(str(tmp_path / "in"))
    made = bars.bars(ticks, "ts", "event_type", "value", "60 minutes", "event_id", late="10 minutes")
    made.writeStream.format("memory").queryName("open_windows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    # the mark stands at 111 minutes: the first hour is closed, the second is not
    assert [(r.ts, r.close, r.n_ticks) for r in spark.table("open_windows").collect()] == [(at, 50.0, 2)]


@pytest.mark.parametrize("how", [{}, {"cooldown": 2}, {"longest": 4}, {"cooldown": 3, "longest": 5}])
def test_streamed_holdings_equal_those_of_the_table(spark, tmp_path, how):
    rng = random.Random(8)
    flag = lambda p: None if rng.random() < 0.1 else float(rng.random() < p)
    rows = [(m, datetime(2024, 1, 1) + timedelta(days=t), flag(0.4), flag(0.2)) for t in range(40) for m in "ab"]
    schema = "market string, ts timestamp, entry double, leave double"
    for k in range(0, 80, 16):
        spark.createDataFrame(rows[k : k + 16], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = "held_" + "_".join(how) + "x"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state.stream_holdings(stream, **how).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    null = lambda x: None if x is None or math.isnan(x) else x
    got = sorted((r.market, r.ts, str(null(r.held))) for r in spark.table(name).collect())
    want = sorted((r.market, r.ts, str(r.held)) for r in rolling.holding_state(spark.createDataFrame(rows, schema), "entry", "leave", **how).collect())
    assert got == want


def test_specs_are_checked_and_history_adds_up():
    s = spec.load('{"features": [{"name": "a", "input": "price", "steps": [{"op": "simple_return", "n": "{k}"}]}, {"name": "b_{k}", "input": "a", "steps": [{"op": "rolling", "n": 5, "kind": "mean"}]}], "weights": {"every": "monthly"}}', k=3)
    assert [f["name"] for f in s["features"]] == ["a", "b_3"] and spec.history(s) == {"a": 3, "b_3": 7}
    for bad in ('{"features": [{"name": "a", "input": "p"}, {"name": "a", "input": "p"}]}', '{"features": [{"name": "a", "input": "p", "steps": [{"op": "nothing"}]}]}'):
        with pytest.raises(ValueError):
            spec.load(bad)
    with pytest.raises(KeyError):
        spec.load('{"features": [{"name": "{what}", "input": "p"}]}')


def test_users_register_their_own_transforms(spark):
    spec.TRANSFORMS.pop("doubled", None)
    spec.register("doubled", lambda x: x * 2)
    df = spark.createDataFrame([(1, "a", 2.0)], "ts int, market string, price double")
    s = spec.load('{"features": [{"name": "d", "input": "price", "steps": [{"op": "doubled"}]}]}')
    assert spec.with_features(df, s).first().d == 4.0
    with pytest.raises(ValueError):
        spec.register("abs", F.abs)


def test_numbers_and_dates_in_texts(spark):
    df = spark.createDataFrame([("1,234.5",), ("(1,000)",), ("-",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(text.number(F.col("x"))).collect()] == [1234.5, -1000.0, None, None, None]
    d = spark.createDataFrame([("2024-03-05x",), ("2024.13.01",), ("20",), (None,)], "x string")
    assert [r[0] for r in d.select(text.digits_date(F.col("x"))).collect()] == [date(2024, 3, 5), None, None, None]


def test_adjustments_by_hand(spark):
    rows = [("a", 1, 100.0, 0.0, 10, 100.0), ("a", 2, 50.0, 0.0, 10, 100.0), ("a", 3, 55.0, 5.0, 0, 100.0), ("a", 4, 110.0, 55.0, 10, 50.0), ("a", 5, 1.0, 3.0, 10, 50.0)]
    got = sorted(tables.adjusted_prices(spark.createDataFrame(rows, "code string, ts int, close double, change double, volume int, shares double")).collect(), key=lambda r: r.ts)
    # day 2: the base is 50 against 100 before; day 4: halted before, half the shares, doubled; day 5: no base above 0
    assert [r.kind for r in got] == [None, "adjustment", None, "share_ratio_override", "invalid_base"]
    assert [r.factor for r in got] == [1.0, 0.5, 1.0, 2.0, 1.0] and [r.adjusted for r in got] == pytest.approx([100.0, 100.0, 110.0, 110.0, 1.0])


def test_calendar_places():
    assert calendar.per_year("240m") == 365 * 6 and calendar.per_year("day") == 252 and calendar.per_year("4h") == 365 * 6


def test_confidence_set_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)) + np.array([0.0, 0.5, -0.4, 0.45])
    df = spark.createDataFrame([(c, day(t), float(x[t, k])) for t in range(60) for k, c in enumerate("abcd")], "candidate string, ts date, d double")
    got = {r.candidate: (r.order, r.p) for r in resample.confidence_set(df, 5, 30, 1).collect()}
    at = resample.stationary_positions(spark.createDataFrame([(60,)], "n long"), 5, 30, 1).toPandas()
    boot = np.stack([x[at[at["rep"] == r].sort_values("k")["pos"]].mean(0) for r in range(30)])
    left, floor, want = [0, 1, 2, 3], 0.0, {}
    while len(left) > 1:
        dev = boot[:, left] - x[:, left].mean(0)
        dev = dev - dev.mean(1, keepdims=True)
        gap, sd = x[:, left].mean(0) - x[:, left].mean(), np.sqrt((dev**2).mean(0))
        t = -gap / sd
        floor = max(floor, ((-dev / sd).max(1) >= t.max()).mean())
        out = left.pop(int(t.argmax()))
        want["abcd"[out]] = (4 - len(left), floor)
    want["abcd"[left[0]]] = (4, 1.0)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and [got[k][1] for k in "abcd"] == pytest.approx([want[k][1] for k in "abcd"])
    counts = at.groupby("rep").size()
    assert (counts == 60).all() and at["pos"].between(0, 59).all()

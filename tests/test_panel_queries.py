"""Every registered panel query against its SQL, over the smallest tables; and hand-made cases of single operators."""

import math
import random
from datetime import date

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import elementwise as ew
from tidepanel.operators import asof, curves, rolling, sliding, weights
from tidepanel.operators import cross_section as xs
from tidepanel.plans import queries as q
from tidepanel.streaming.bars import bars

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if isinstance(x, float) or x is pd.NaT:
            return None if pd.isna(x) else f"{x:.5g}"
        return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)

    frame = df[sorted(df.columns)].astype(object)
    return sorted([tuple("~" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else plain(float(v) if isinstance(v, int) else v) for v in r) for r in frame.itertuples(index=False)], key=str)


#: Queries without SQL, each tested against a plain version in test_panel_operators.py.
WITHOUT_SQL = {"risk_parity_weights", "volatility_scales"}


def test_all_other_queries_have_sql():
    assert set(q.QUERIES) - set(q.SQL) == WITHOUT_SQL and set(q.SQL) <= set(q.QUERIES)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = q.QUERIES[name](spark, SF).toPandas(), con.execute(q.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def frame(spark, data, schema="market string, ts int, x double"):
    return spark.createDataFrame(data, schema)


def test_skip_and_full_windows(spark):
    df = frame(spark, [("a", t, float(v)) for t, v in enumerate([1, 2, 4, 8])])
    got = df.select("ts", rolling.simple_return(F.col("x")).alias("r"), rolling.rolling(F.col("x"), 3, "sum").alias("s")).orderBy("ts").collect()
    assert [r.r for r in got] == [None, 1.0, 1.0, 1.0] and [r.s for r in got] == [None, None, 7.0, 14.0]


def test_rolling_is_causal(spark):
    data = [("a", t, float((t * 7) % 11 + 1)) for t in range(40)]

    def run(n):
        return [r[1] for r in rolling.ewma(frame(spark, data[:n]), "x", 5).select("ts", "ewma").orderBy("ts").collect()]

    assert run(40)[4:25] == pytest.approx(run(25)[4:])


def test_ewma_by_hand(spark):
    x = [3.0, 5.0, 4.0, 8.0, 1.0, 9.0]
    want, state = [None, None], sum(x[:3]) / 3
    want.append(state)
    for v in x[3:]:
        state = state / 2 + v / 2
        want.append(state)
    got = [r.e for r in rolling.ewma(frame(spark, [("a", t, v) for t, v in enumerate(x)]), "x", 3, "e").orderBy("ts").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx(want[2:])


def test_worst_drawdown_inside_window(spark):
    got = [r.d for r in frame(spark, [("a", t, v) for t, v in enumerate([10.0, 5.0, 8.0, 4.0, 6.0])]).transform(lambda df: sliding.worst_drawdown(df, "x", 3, "d")).orderBy("ts").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([-0.5, -0.5, -0.5])


def test_ranks_tie_by_market_and_ignore_nulls(spark):
    df = frame(spark, [("b", 1, 2.0), ("a", 1, 2.0), ("c", 1, None), ("d", 1, 1.0), ("z", 2, 5.0)])
    got = {(r.market, r.ts): (r.up, r.down, r.p) for r in df.select("market", "ts", xs.rank(F.col("x")).alias("up"), xs.rank(F.col("x"), descending=True).alias("down"), xs.percentile(F.col("x")).alias("p")).collect()}
    assert got[("a", 1)] == (2, 1, 0.5) and got[("b", 1)] == (3, 2, 1.0) and got[("d", 1)][0] == 1 and got[("c", 1)] == (None, None, None) and got[("z", 2)][2] == 1.0


def test_logic_needs_all_inputs(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 0.0), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(ew.logical("or", F.col("a"), F.col("b"))).collect()] == [None, 1.0, 0.0]


def test_redistribute_holds_caps(spark):
    df = spark.createDataFrame([(1, "a", 0.7, 0.4), (1, "b", 0.2, 0.4), (1, "c", 0.1, 0.4)], "ts int, market string, w double, cap double")
    got = {r.market: r.final for r in weights.redistribute(df, "w", "cap").collect()}
    assert got == pytest.approx({"a": 0.4, "b": 0.4, "c": 0.2})


def test_long_short_overlap_raises(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "ts int, market string, x double")
    with pytest.raises(Exception, match="both sides"):
        weights.long_short(df, "x", 2, 1.0).collect()


def test_changes_only(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5), (3, "a", 0.6), (1, "b", 0.5), (2, "b", 0.5), (3, "b", 0.5)], "ts int, market string, w double")
    assert sorted((r.ts, r.market) for r in weights.changes_only(df, "w").collect()) == [(1, "a"), (1, "b"), (3, "a"), (3, "b")]
    # a market that vanishes is an exit; a new one with the target 0 is no change
    gone = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5), (3, "a", 0.5), (3, "c", 0.0)], "ts int, market string, w double")
    assert sorted((r.ts, r.market, r.w) for r in weights.changes_only(gone, "w").collect() if r.ts > 1) == [(2, "a", 0.5), (2, "b", 0.0), (2, "c", 0.0)]
    assert sorted((r.ts, r.market, r.w) for r in weights.changes_only(gone, "w", "asset").collect() if r.ts > 1) == [(2, "b", 0.0)]


def test_asof_takes_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", date(2024, 1, 5)), ("a", date(2024, 1, 1)), ("b", date(2024, 1, 5))], "k string, ts date")
    right = spark.createDataFrame([("a", date(2024, 1, 2), 1), ("a", date(2024, 1, 5), 2), ("a", date(2024, 1, 6), 3)], "k string, at date, v int")
    got = {(r.k, r.ts.day): r.v for r in asof.asof_join(left, right, ["k"], "ts", "at", ["v"]).collect()}
    assert got == {("a", 5): 2, ("a", 1): None, ("b", 5): None}


def test_superseded_periods_go(spark):
    df = spark.createDataFrame([("a", 1, 2020), ("a", 2, 2021), ("a", 3, 2020), ("a", 4, 2021)], "k string, ts int, p int")
    assert sorted(r.ts for r in asof.drop_superseded(df, ["k"], "ts", "p").collect()) == [1, 2, 4]


def test_drawdown_episodes(spark):
    df = spark.createDataFrame([("r", t, v) for t, v in enumerate([1.0, 0.9, 1.0, 1.2, 0.6, 0.8])], "run_id string, ts int, value double")
    got = sorted((r.onset, r.bars, round(r.depth, 6)) for r in curves.drawdown_episodes(df).collect())
    assert got == [(1, 1, -0.1), (4, 2, -0.5)]


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    run = bars(ticks, "ts", "event_type", "value", "60 minutes", "event_id", late="60 days").writeStream.format("memory").queryName("bars_out").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    columns = ["ts", "market", "open", "high", "low", "close", "n_ticks"]
    got = sorted(spark.table("bars_out").select(columns).collect())
    assert got == sorted(bars(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "60 minutes", "event_id").select(columns).collect()) and got


def test_holding_state_counts_rows_and_waits(spark):
    n = None
    entry = [0.0, 1.0, 1.0, n, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0]
    leave = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    df = spark.createDataFrame([("a", t, e, x) for t, (e, x) in enumerate(zip(entry, leave))], "market string, ts int, entry double, leave double")

    def held(**how):
        return [r.held for r in rolling.holding_state(df, "entry", "leave", **how).orderBy("ts").collect()]

    assert held() == [0.0, 1.0, 1.0, n, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0]
    # the end at row 4 comes with the entry flag still set: it must be 0 once (row 6) before row 7 enters
    assert held(longest=3) == [0.0, 1.0, 1.0, n, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    # three known rows (5 to 7) pass after the end; an entry counts before an exit where nothing is held
    assert held(longest=3, cooldown=3) == [0.0, 1.0, 1.0, n, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0]


def test_intervals_that_touch_a_window_exclude_their_market(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "market string, ts int")
    gaps = spark.createDataFrame([("a", 5, 9), ("b", 1, 3), ("b", 2, 2)], "market string, gap_start int, gap_end int")
    assert sorted(r.market for r in weights.without_overlaps(df, gaps, F.lit(4), F.lit(5)).collect()) == ["b", "c"]


def test_flat_short_and_zero_inputs_give_nulls(spark):
    c = spark.createDataFrame([("flat", t, 2.0) for t in range(4)] + [("one", 0, 1.0), ("zero", 0, 0.0), ("zero", 1, 1.0)], "run_id string, ts int, value double")
    got = {r.run_id: r for r in curves.performance(c, 252).collect()}
    assert got["flat"].cagr == 0 and got["flat"].sharpe is None and got["flat"].calmar is None and got["one"].cagr is None and got["zero"].cagr is None
    bench = spark.createDataFrame([("flat",)], "run_id string")
    assert {r.beta for r in curves.against_benchmark(c, bench, 252).collect()} == {None}
    w = spark.createDataFrame([(1, "a", 0.0, 0.5), (1, "b", 1.0, 0.5), (1, "c", 0.5, 2.0)], "ts int, market string, w double, cap double")
    assert {r.market: r.final for r in weights.redistribute(w, "w", "cap").collect()} == pytest.approx({"a": 0.0, "b": 0.5, "c": 1.0})
    p = frame(spark, [("a", t, v) for t, v in enumerate([0.0, 1.0, 2.0])])
    assert [r.f for r in p.select("ts", rolling.path_ahead(F.col("x"), 1)[0].alias("f")).orderBy("ts").collect()] == [None, 1.0, None]


def test_recovery_counts_rows_between_highs(spark):
    c = spark.createDataFrame([("r", t, v) for t, v in enumerate([1.0, 0.9, 1.0, 1.2, 0.6, 0.8, 1.3, 1.1])], "run_id string, ts int, value double")
    r = curves.recovery(c).first()
    assert (r.longest_completed, r.second_completed, r.longest, r.current_bars) == (3, 2, 3, 1) and r.under_water_pct == 50.0 and r.mean_top5 == 2.0


def test_feature_values_share_by_positive_scores(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True), (1, "b", -3.0, True), (1, "c", 0.2, True), (1, "d", 9.0, False)], "ts int, market string, s double, sel boolean")
    got = {r.market: r.w for r in df.select("market", weights.feature_value(F.col("s"), F.col("sel"), 1.0, -1.0, 0.5).alias("w")).collect()}
    assert got == pytest.approx({"a": 0.25, "b": -0.5, "c": 0.1, "d": 0.0})


def test_negative_volatility_raises(spark):
    with pytest.raises(Exception, match="negative volatility"):
        frame(spark, [("a", 1, -1.0)]).select(ew.target_vol(F.col("x"), 0.1, 252, 0.0, 2.0)).collect()


def test_order_counts_equal_a_plain_count(spark):
    rng = random.Random(1)
    data = [(m, t, rng.choice([None, *map(float, range(40))])) for m in "ab" for t in range(90)]
    for n in (None, 7):
        got = {(r.market, r.ts): (r.less, r.equal, r.held) for r in rolling.order_counts(frame(spark, data), "x", n).collect()}
        for m in "ab":
            seen = []
            for _, t, v in [d for d in data if d[0] == m]:
                if v is not None:
                    seen.append(v)
                    held = seen[-(n or len(seen)) :]
                    assert got[m, t] == (sum(h < v for h in held), held.count(v), len(held))
                else:
                    assert got[m, t] == (None, None, None)

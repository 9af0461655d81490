"""Events against events, and lookups around a time, against plain loops."""

import random
from datetime import date, timedelta

from tidepanel.operators import asof, research, statements, universe


def day(k):
    return date(2020, 1, 1) + timedelta(days=k)


def test_overlapping_events_equal_all_pairs(spark):
    rng = random.Random(0)
    for size in (0, 1, 40):
        own = [(k, day(rng.randint(0, 900)), day(1000)) for k in range(60)]
        market = [(100 + k, day(s := rng.randint(100, 800)), day(s + rng.choice([0, 3, 30, 200]))) for k in range(size)]
        want = set()
        for k, s, _ in own:
            inside = [(a, m) for m, a, b in market if a <= s <= b]
            near = min(inside, default=None) if inside else min(((abs((a - s).days), a, m) for m, a, _ in market), default=None)
            if near:
                want.add((k, near[-1], bool(inside), (near[-2] - s).days))
        schema = "event_id int, start date, end date"
        found = research.overlapping_events(spark.createDataFrame(own, schema), spark.createDataFrame(market, schema))
        assert {tuple(r) for r in found.collect()} == want
        assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_around_looks_both_ways_across_empty_months(spark):
    points = spark.createDataFrame([(day(k), k) for k in (5, 6, 300, 301, 640)], "t date, v int")
    asks = spark.createDataFrame([(day(k), k) for k in (0, 5, 7, 250, 300, 500, 700)], "at date, k int")
    back = {r.k: r.p and r.p.v for r in asof.around(asks, points, "at", "t", "p").collect()}
    ahead = {r.k: r.p and r.p.v for r in asof.around(asks, points, "at", "t", "p", later=True).collect()}
    assert back == {0: None, 5: 5, 7: 6, 250: 6, 300: 300, 500: 301, 700: 640} and ahead == {0: 5, 5: 5, 7: 300, 250: 300, 300: 300, 500: 640, 700: None}


def test_runs_of_missing_values_of_a_long_market_take_no_quadratic_time(spark):
    import time

    rows = [("a", k, 1.0 if k % 3 else None) for k in range(60_000)]
    began = time.time()
    assert universe.gaps(spark.createDataFrame(rows, "market string, ts int, x double"), "x").count() == 19_999
    assert time.time() - began < 30


def test_fiscal_periods_of_one_company_of_many_payments(spark):
    periods = spark.createDataFrame([("c", 2000 + k, date(2000 + k, 12, 31)) for k in range(100)], "code string, fiscal_year int, fiscal_end date")
    payments = spark.createDataFrame([("c", date(2000, 1, 1) + timedelta(days=k % 36_000), k) for k in range(40_000)], "code string, paid date, k int")
    got = statements.in_fiscal_period(payments, periods, "paid")
    assert got.where("year(paid) = fiscal_year").count() == got.count() == 40_000

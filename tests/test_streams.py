"""Streams whose rows come late, and tables that batches are merged into, against tables worked out at once."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import rolling
from tidepanel.streaming import buckets, state

SCHEMA = "market string, ts timestamp, entry double, leave double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, state.ROCKSDB)
    yield spark
    spark.conf.set(PROVIDER, before)


def parts(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def flags(rng, n, markets):
    flag = lambda p: None if rng.random() < 0.1 else float(rng.random() < p)
    return [(m, datetime(2024, 1, 1) + timedelta(hours=t), flag(0.4), flag(0.2)) for t in range(n) for m in markets]


def held_of(df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    null = lambda x: None if x is None or math.isnan(x) else x
    return sorted((r.market, r.ts, str(null(r.held))) for r in df.sparkSession.table(name).collect())


@pytest.mark.parametrize("how", [{}, {"cooldown": 3, "longest": 5}])
def test_shuffled_batches_give_the_states_of_the_table(rocks, tmp_path, how):
    rng = random.Random(3)
    rows = flags(rng, 60, "ab")
    late = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.randint(0, 20)))  # up to 20 hours late
    stream = parts(rocks, str(tmp_path / "in"), [late[k : k + 24] for k in range(0, 120, 24)])
    got = held_of(state.late_holdings(stream, "21 hours", **how), f"late_{len(how)}")
    want = sorted((r.market, r.ts, str(r.held)) for r in rolling.holding_state(rocks.createDataFrame(rows, SCHEMA), "entry", "leave", **how).collect())
    mark = max(r[1] for r in rows) - timedelta(hours=21)
    assert got == [w for w in want if w[1] < mark] and len(got) >= 70


def test_rows_later_than_the_mark_are_left_out(rocks, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [[("a", at(0), 1.0, 0.0), ("a", at(1), 0.0, 0.0), ("a", at(10), 0.0, 0.0)], [("a", at(11), 0.0, 0.0)], [("a", at(2), 0.0, 1.0), ("a", at(30), 0.0, 0.0)]]
    got = held_of(state.late_holdings(parts(rocks, str(tmp_path / "in"), batches), "2 hours"), "too_late")
    assert got == [("a", at(h), "1.0") for h in (0, 1, 10, 11)]  # the exit at 2 came when 8 was passed


def test_rows_out_of_order_raise_where_order_is_needed(spark, tmp_path):
    rows = flags(random.Random(1), 10, "a")
    stream = parts(spark, str(tmp_path / "in"), [rows[5:], rows[:5]])
    with pytest.raises(Exception, match="out of order"):
        held_of(state.stream_holdings(stream), "disorder")


def test_late_rows_need_the_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        state.late_holdings(spark.createDataFrame([], SCHEMA), "1 hour")


ROW = "k int, v int, o int"


def table(spark, path):
    return {(r.k, r.v) for r in buckets.read(spark, path, ROW).collect()}


def test_merges_equal_a_dict_and_write_what_the_batch_touches(spark, tmp_path):
    path, rng, want = str(tmp_path / "t"), random.Random(2), {}
    sizes = [400, 3, 0, 40, 1]
    for number, size in enumerate(sizes):
        rows = [(rng.randint(0, 300), rng.randint(0, 10**6), o) for o in range(size)]
        batch = spark.createDataFrame(rows, ROW)
        touched = buckets.merge(batch, path, ["k"], "o", number, 16)
        want |= {k: v for k, v, _ in rows}
        assert table(spark, path) == set(want.items())
        assert len(touched) == len({r[0] for r in batch.select(buckets.bucket_of(["k"], 16)).distinct().collect()}) <= size
        if number == 4:
            written = spark.read.parquet(f"{path}/data/v=4").count()
            assert len(touched) == 1 and written < len(want) / 4  # one bucket of sixteen
    assert buckets.versions(spark, path) == [3, 4]  # older ones are gone


def test_a_batch_run_again_gives_the_same(spark, tmp_path):
    path = str(tmp_path / "t")
    for number in (0, 1, 1):
        buckets.merge(spark.createDataFrame([(number, number, 0), (7, number, 0)], ROW), path, ["k"], "o", number, 4)
    assert table(spark, path) == {(0, 0), (1, 1), (7, 1)}
    assert {(r.k, r.v) for r in buckets.read(spark, path, ROW, 0).collect()} == {(0, 0), (7, 0)}


def test_files_no_map_names_are_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    for number in range(6):
        buckets.merge(spark.createDataFrame([(1, number, 0)], ROW), path, ["k"], "o", number, 4)
    kept = sorted(p.name for p in (tmp_path / "t" / "data").iterdir())
    assert kept == ["v=4", "v=5"] and table(spark, path) == {(1, 5)}
    buckets.rebucket(spark, path, ROW, str(tmp_path / "u"), ["k"], 9)
    assert table(spark, str(tmp_path / "u")) == {(1, 5)}
    with pytest.raises(ValueError, match="9 buckets"):
        buckets.merge(spark.createDataFrame([(1, 1, 0)], ROW), str(tmp_path / "u"), ["k"], "o", 1, 4)


def test_composite_keys_and_late_rows_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([("a", 1, 5.0), ("b", 1, 6.0)], [("a", 2, 7.0), ("a", 1, 8.0)]):
        spark.createDataFrame(rows, "m string, t int, x double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("m string, t int, x double").option("maxFilesPerTrigger", 1).parquet(source)
    buckets.keep_current(stream, str(tmp_path / "t"), ["m", "t"], "x", str(tmp_path / "c"), 4).awaitTermination()
    got = buckets.read(spark, str(tmp_path / "t"), "m string, t int, x double")
    assert {tuple(r) for r in got.collect()} == {("a", 1, 8.0), ("b", 1, 6.0), ("a", 2, 7.0)}
    assert got.where(F.col("m") == "none").count() == 0

"""Registered queries that run a stream to its end over files made from the tables, and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rolling
from ..sources import files, panel
from ..streaming import bars as bars_
from ..streaming import buckets, state
from .queries import TYPE, _r, _registered
from .transforms import BY_MARKET, GRID


def _in_parts(df: DataFrame, name: str, order: str, parts: int) -> tuple[DataFrame, str]:
    """df as a stream of so many batches, in order; and a folder for the stream's own files."""
    spark = df.sparkSession
    path = files.scratch(spark, name)
    df.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/dealt")
    folder = f"{path}/in"
    for k in range(parts):  # files are taken in the order in which they were written
        spark.read.schema(df.schema).parquet(f"{path}/dealt/part={k}").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), path


@_registered("""WITH e AS (SELECT *, max(ts) OVER () - INTERVAL 10 MINUTE AS mark FROM events)
SELECT date_trunc('hour', ts) AS ts, event_type AS market, round(max(value), 6) AS high, round(min(value), 6) AS low, count(*) AS n_ticks FROM e GROUP BY date_trunc('hour', ts), event_type, mark HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark""")
def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: only windows that the watermark has closed."""
    ticks = panel.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    stream, path = _in_parts(ticks, "ticks", "ts", 3)
    made = bars_.bars(stream, "ts", "event_type", "value", "60 minutes", "event_id", late="10 minutes")
    made.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "market", _r("high", "high"), _r("low", "low"), "n_ticks")


@_registered("""WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM k WHERE i = 1""")
def streamed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of rows, of which later ones replace earlier ones of the same key."""
    stream, path = _in_parts(panel.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "orders", "o_orderkey", 3)
    buckets.keep_current(stream, f"{path}/out", ["o_custkey"], "o_orderkey", f"{path}/state", 8).awaitTermination()
    return buckets.read(spark, f"{path}/out", stream._jdf.schema().toDDL())


@_registered(f"""WITH {TYPE}, {GRID}, f AS (SELECT ts, market, CASE WHEN price > 1500 THEN 1 WHEN price < 1300 THEN 0 END AS mark, price FROM grid)
SELECT CAST(ts AS TIMESTAMP) AS ts, market, CASE WHEN price IS NOT NULL THEN coalesce(CAST(last_value(mark IGNORE NULLS) OVER ({BY_MARKET} UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 0.0) END AS held FROM f""")
def streamed_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "type").select("ts", "market", "price"))
    flags = g.select("market", F.col("ts").cast("timestamp").alias("ts"), (F.col("price") > 1500).cast("double").alias("entry"), (F.col("price") < 1300).cast("double").alias("leave"))
    stream, path = _in_parts(flags, "flags", "ts", 3)
    held = state.stream_holdings(stream)
    held.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return rolling.nan_to_null(spark.read.schema(held.schema).parquet(f"{path}/out"), "held").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "market", "held")


@_registered(f"""WITH {TYPE}, {GRID}, f AS (SELECT ts, market, CASE WHEN price > 1500 THEN 1 WHEN price < 1300 THEN 0 END AS mark, price FROM grid), h AS (SELECT ts, market, CASE WHEN price IS NOT NULL THEN coalesce(CAST(last_value(mark IGNORE NULLS) OVER ({BY_MARKET} UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 0.0) END AS held FROM f)
SELECT CAST(ts AS TIMESTAMP) AS ts, market, held FROM h WHERE ts < (SELECT max(ts) FROM grid) - INTERVAL 400 DAY""")
def late_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to three batches by a hash, so that they come up to a year late; the states of all times that the watermark has passed."""
    g = panel.dense_grid(panel.build_panel(spark, sf_dir, "type").select("ts", "market", "price"))
    flags = g.select("market", F.col("ts").cast("timestamp").alias("ts"), (F.col("price") > 1500).cast("double").alias("entry"), (F.col("price") < 1300).cast("double").alias("leave"))
    late = flags.withColumn("come", F.datediff("ts", F.lit("1970-01-01").cast("date")) + F.pmod(F.xxhash64("ts", "market"), F.lit(380)).cast("int"))
    stream, path = _in_parts(late, "late", "come", 3)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    try:
        held = state.late_holdings(stream.drop("come"), "400 days")
        held.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return rolling.nan_to_null(spark.read.schema(held.schema).parquet(f"{path}/out"), "held").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "market", "held")


@_registered(f"""WITH {TYPE} SELECT market, CAST(max(ts) AS TIMESTAMP) AS ts, arg_max(volume, ts) AS volume FROM panel GROUP BY market""")
def published_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = panel.build_panel(spark, sf_dir, "type").select(F.col("ts").cast("timestamp").alias("ts"), "market", "volume")
    stream, path = _in_parts(t, "targets", "ts", 2)
    state.publish_latest(stream, f"{path}/out", "volume", f"{path}/state").awaitTermination()
    return state.read_version(spark, f"{path}/out", 1).select("market", F.col("ts").cast("timestamp_ntz").alias("ts"), "volume")

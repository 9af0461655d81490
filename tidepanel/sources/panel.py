"""Long panels (ts, market, fields) from fact tables, their dense grids and lifecycle masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKETS = {"type": "p_type", "brand": "p_brand", "size": "cast(p_size AS string)"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_panel(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Daily price, volume and amount by market; the market is an attribute of the part sold."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.expr(MARKETS[key]).alias("market"))
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    money, count = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), F.sum(F.col("l_quantity").cast("decimal(18,2)"))  # exact in any order
    sums = joined.groupBy(F.to_date("l_shipdate").alias("ts"), "market").agg(money.cast("double").alias("amount"), count.cast("double").alias("volume"))
    return sums.select("ts", "market", (F.col("amount") / F.col("volume")).alias("price"), "volume", "amount")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def dense_grid(panel: DataFrame) -> DataFrame:
    """Every (ts, market) of the calendar and the markets; unobserved fields are null. Both sides are distinct keys, and the
    product is the grid itself: as many rows as the result."""
    calendar, markets = panel.select("ts").distinct(), panel.select("market").distinct()
    return calendar.crossJoin(markets).join(panel, ["ts", "market"], "left")


def coverage(panel: DataFrame) -> DataFrame:
    """First and last observation by market."""
    return panel.groupBy("market").agg(F.min("ts").alias("data_start"), F.max("ts").alias("data_end"), F.count("*").alias("n_rows"))


def tail_rows(panel: DataFrame, n: int) -> DataFrame:
    """The last n observed rows of each market."""
    from pyspark.sql import Window

    order = Window.partitionBy("market").orderBy(F.desc("ts"))
    return panel.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")

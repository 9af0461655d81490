"""Files in and out: bars as CSV or Parquet, wide frames, weights, curves, reports. Executors write only to shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a bar file, in order.
BAR = "market string, ts date, open double, high double, low double, close double, volume double, amount double, warning string"
_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local session without one gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-panel-", dir="/tmp"))
        folder = _own[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: what is read more than once is computed once, and lost executors cost no more than a read."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, form: str = "parquet", by: str | None = None) -> str:
    """Parquet (zstd) or CSV with a header (nulls empty, numbers to the last digit)."""
    out = df.write.partitionBy(by) if by else df.write
    if form == "parquet":
        out.option("compression", "zstd").parquet(path)
    else:
        out.option("header", True).csv(path)
    return path


def read_table(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    if form == "parquet":
        return reader.parquet(path)
    return reader.option("header", True).option("inferSchema", schema is None).option("enforceSchema", True).csv(path)


def read_bars(spark: SparkSession, path: str, columns: tuple[str, ...] = (), markets: int | None = None) -> DataFrame:
    """All bar files under a path or glob as one long table. The schema is given, so a byte order mark before the header does no
    harm; only the first so many markets by name, and only the columns asked for."""
    bars = read_table(spark, path, "csv", BAR)
    if markets:
        first = bars.select("market").distinct().orderBy("market").limit(markets)
        bars = bars.join(first, "market", "left_semi")
    return bars.select("ts", "market", *columns) if columns else bars


def to_wide(long: DataFrame, value: str, markets: list[str] | None = None) -> DataFrame:
    """One row a time, one column a market. Markets that are given need no pass to find them."""
    return long.groupBy("ts").pivot("market", markets).agg(F.first(value, ignorenulls=True))


def from_wide(wide: DataFrame, name: str, markets: list[str] | None = None, most: int | None = None, tail: int | None = None) -> DataFrame:
    """Long rows (ts, market, name) of a wide frame, null cells included: of the markets asked for, or the first so many; of the last so
    many times. Only the columns kept are read."""
    kept = [c for c in (markets or wide.columns) if c != "ts" and c in wide.columns][:most]
    if tail:
        last = wide.select("ts").orderBy(F.desc("ts")).limit(tail)
        wide = wide.join(last, "ts", "left_semi")
    return wide.select("ts", *[F.col(f"`{c}`") for c in kept]).unpivot("ts", [F.col(f"`{c}`") for c in kept], "market", name)


def metadata(bars: DataFrame, *fields: str) -> DataFrame:
    """One row a market: its first day and the fields as of its last."""
    return bars.groupBy("market").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in fields])


def import_prices(rows: DataFrame, ts: str, market: str, price: str, allow: tuple[str, ...] = ()) -> DataFrame:
    """Foreign price rows as (ts, market, price): names upper-cased and trimmed, numbers read where they can be, of repeated keys one
    with the greatest price, markets without any price left out."""
    name = F.upper(F.trim(F.col(market).cast("string")))
    number = F.expr(f"try_cast(regexp_replace(cast(`{price}` as string), ',', '') as double)")
    out = rows.select(F.to_date(F.col(ts)).alias("ts"), name.alias("market"), number.alias("price"))
    out = out.where(F.col("market").isin(*allow)) if allow else out
    known = out.where("price is not null").select("market").distinct()
    return out.groupBy("ts", "market").agg(F.max("price").alias("price")).join(known, "market", "left_semi").select("ts", "market", "price")


def weight_format(columns: list[str]) -> str:
    """sparse (a row a request) or wide (a column a market), by the header."""
    return "sparse" if {"market", "target_weight"} <= set(columns) else "wide"


def expand_sparse(requests: DataFrame, grid: DataFrame) -> DataFrame:
    """Sparse weight rows on a grid (ts, market): at a time with any request, markets without one get 0, an exit; other times null."""
    times = requests.select("ts").distinct().withColumn("__on", F.lit(True))
    rows = grid.select("ts", "market").join(times, "ts", "left").join(requests.select("ts", "market", "target_weight"), ["ts", "market"], "left")
    return rows.withColumn("target_weight", F.when(F.col("__on"), F.coalesce("target_weight", F.lit(0.0)))).drop("__on")


def _file(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_curves(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """run_id (the folder or file a curve lies in), ts, value from date and value columns of many curve files in one scan."""
    rows = read_table(spark, path, form, "date date, value double")
    return rows.select(_file(F.col("_metadata.file_path")).alias("run_id"), F.col("date").alias("ts"), "value").where("ts is not null and value is not null")


def collect_vertical(rows: DataFrame, run: str, key: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Vertical reports (a row a figure) as one row a run, a column a key."""
    return rows.groupBy(run).pivot(key, keys).agg(F.first(value))


def collect_records(parts: list[DataFrame]) -> DataFrame:
    """Report tables of different headers, one under the other; a column that a table lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def build_cache(bars: DataFrame, path: str, fields: tuple[str, ...]) -> dict[str, str]:
    """A bar cache: numbers by month, warnings, and one row of metadata a market. Returns the paths."""
    parts = {"numbers": bars.select("ts", "market", *fields, F.date_format("ts", "yyyyMM").alias("month")), "warnings": bars.where("warning is not null").select("ts", "market", "warning"), "markets": metadata(bars, "warning")}
    return {k: write_table(v, f"{path}/{k}", by="month" if k == "numbers" else None) for k, v in parts.items()}


def with_source(panel: DataFrame, source: DataFrame, value: str) -> DataFrame:
    """A user's own field (ts, market, value) beside the panel's; one that ends before the panel does raises."""
    late = source.agg(F.max("ts").alias("__z")).crossJoin(panel.agg(F.max("ts").alias("__p")))  # one row each
    checked = late.select(F.assert_true(F.coalesce(F.col("__z") >= F.col("__p"), F.lit(False)), F.lit("the custom source ends before the panel")).alias("__ok"), F.lit(True).alias("__k"))
    joined = panel.join(source.select("ts", "market", value), ["ts", "market"], "left")
    return joined.withColumn("__k", F.lit(True)).join(F.broadcast(checked), "__k").where("__ok is null").drop("__k", "__ok")


def with_market_series(panel: DataFrame, market: str, column: str, name: str, most: int = 200_000) -> DataFrame:
    """One market's column at every row of the same time; that market's rows are broadcast if they are at most so many."""
    side = panel.where(F.col("market") == market).select("ts", F.col(column).alias(name))
    side = F.broadcast(side) if side.limit(most + 1).count() <= most else side
    return panel.join(side, "ts", "left")



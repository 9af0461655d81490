"""Tables that batches are merged into, bucket by bucket.

Rows are dealt to a fixed number of buckets by a hash of their key. Batch N reads and writes only the buckets that it touches, as
path/data/v=N/bucket=K; path/map/v=N says which version each bucket has after it, a row a bucket. So what is written follows the
batch, not the table, a reader of version N sees batch N whole or not at all, and a batch that is run again writes the same
files. A bucket is written whole, so it never falls into small files. Versions that no kept map names are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import upsert

MAP = "bucket int, version int, rows long"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _listed(spark: SparkSession, path: str, mark: str) -> list[int]:
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    return sorted(int(n[len(mark) :]) for f in files.listStatus(where) if (n := f.getPath().getName()).startswith(mark))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read."""
    return _listed(spark, f"{path}/map", "v=")


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _mapped(spark: SparkSession, path: str, version: int) -> dict[int, tuple[int, int]]:
    """A row a bucket, as many as the table was made with."""
    return {r.bucket: (r.version, r.rows) for r in spark.read.schema(MAP).parquet(f"{path}/map/v={version}").collect()}


def read(spark: SparkSession, path: str, schema: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The table after a version (the last one, if not said), or some of its buckets."""
    held = versions(spark, path)
    version = (held[-1] if held else None) if version is None else version
    mapped = _mapped(spark, path, version) if version is not None else {}
    paths = [f"{path}/data/v={v}/bucket={k}" for k, (v, rows) in sorted(mapped.items()) if rows and (only is None or k in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(batch: DataFrame, path: str, keys: list[str], order: str, number: int, buckets: int = 64, keep: int = 2) -> list[int]:
    """Merges a batch as version `number`: of its rows of one key the last by `order` counts, and it replaces the table's. Returns the
    buckets that were written. The last `keep` versions stay readable."""
    spark, schema = batch.sparkSession, batch._jdf.schema().toDDL()
    last = batch.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    touched = sorted(r[0] for r in last.select(bucket_of(keys, buckets)).distinct().collect())  # at most as many as buckets
    before = [v for v in versions(spark, path) if v < number]
    mapped = _mapped(spark, path, before[-1]) if before else {}
    if mapped and len(mapped) != buckets:
        raise ValueError(f"the table has {len(mapped)} buckets")
    rows = upsert(read(spark, path, schema, before[-1], touched), last, keys) if before else last
    if touched:
        placed = rows.withColumn("bucket", bucket_of(keys, buckets))
        placed.repartition(min(len(touched), buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={number}")
        counts = {r.bucket: r.rows for r in spark.read.parquet(f"{path}/data/v={number}").groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).collect()}
        mapped |= {k: (number, counts.get(k, 0)) for k in touched}
    every = [(k, *mapped.get(k, (-1, 0))) for k in range(buckets)]
    spark.createDataFrame(every, MAP).coalesce(1).write.mode("overwrite").parquet(f"{path}/map/v={number}")
    _sweep(spark, path, keep)
    return touched


def _sweep(spark: SparkSession, path: str, keep: int) -> None:
    """Removes the maps before the last `keep`, and then the buckets' versions that none of those names."""
    held = versions(spark, path)
    files, _ = _folder(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for v in held[:-keep]:
        files.delete(hadoop(f"{path}/map/v={v}"), True)
    named = {(v, k) for m in held[-keep:] for k, (v, _) in _mapped(spark, path, m).items()}
    for v in _listed(spark, f"{path}/data", "v="):
        inside = _listed(spark, f"{path}/data/v={v}", "bucket=")
        gone = [k for k in inside if (v, k) not in named]
        for k in gone:
            files.delete(hadoop(f"{path}/data/v={v}/bucket={k}"), True)
        if len(gone) == len(inside):
            files.delete(hadoop(f"{path}/data/v={v}"), True)


def rebucket(spark: SparkSession, path: str, schema: str, to: str, keys: list[str], buckets: int) -> None:
    """The last version as a new table of another number of buckets, as its version 0."""
    merge(read(spark, path, schema), to, keys, keys[0], 0, buckets)


def keep_current(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64):
    """Merges each batch of a stream into the table; a row that comes late replaces its key all the same."""
    write = lambda batch, number: merge(batch, path, keys, order, number, buckets) and None
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

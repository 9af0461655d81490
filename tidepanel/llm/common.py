"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset (as in tests), a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        folder = _OWN[0]
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and what follows reads it instead of computing it anew. options
    are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing reads the write's shuffle files after it
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that only steps before clear() read: then they are deleted, so that they do not pile up."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        self.paths += [f.rpartition("/")[0] for f in out.inputFiles()[:1]]
        return out

    def clear(self) -> None:
        spark = SparkSession.active()
        for path in self.paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_of(col: str = "text") -> Column:
    """A text column as a string; null is empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_of_id(col: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def text_slices(texts: pa.Array, size: int = 1 << 24) -> Iterator[tuple[pa.Array, int]]:
    """Parts of a text column of about `size` bytes together, one text at least, and where each begins."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield texts.slice(lo, hi - lo), lo
        lo = hi


def tidy() -> None:
    """Gives memory that is free back to the system, at the end of a task: Python workers are kept, and what one stage once took would
    stand beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's UTF-8 bytes, without decoding them."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def hot_keys(rows: DataFrame, key: str, share: int = 1000, least: int = 1000) -> list:
    """The keys that hold more than a share-th of all rows, and more than `least` of them: fewer than `share` keys. rows is
    counted once, so it should be a written table."""
    total = rows.count()
    return [r[0] for r in rows.groupBy(key).count().where(F.col("count") > max(least, total // share)).select(key).collect()]


def salted_join(many: DataFrame, few: DataFrame, key: str, hot: list, salts: int = 64) -> DataFrame:
    """An inner join on key in which the rows of hot keys are dealt to `salts` groups on the side of many, and repeated for
    each on the other. Null keys join nothing."""
    if not hot:
        return many.join(few, key)
    is_hot = F.broadcast(many.sparkSession.createDataFrame([(k,) for k in hot], many.select(F.col(key).alias("__hot")).schema))
    a = many.join(is_hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*[c for c in many.columns]), F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
    b = few.join(is_hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return a.join(b, [key, "__salt"]).drop("__salt")

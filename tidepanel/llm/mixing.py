"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

A source's target is its share of the mix by weight; where that passes max_epochs times its size it is clamped there and
the excess is shared out again, by weight, among the rest, until none is above. With r = cap / weight, the clamped
sources are those with the smallest r, so one running sum over the sources (not the documents) finds the water level.

A source at e epochs takes each document floor(e) times whole. The fraction left over is taken once more from documents in
a seeded order until the target is met; the document on the edge is taken in part. The order is dealt into 4096 buckets
by hash, so no task ever holds one source's documents: bucket totals give each bucket its start.

Null or empty texts have size 0 and are taken 0 times. Long texts are counted whole; mixed_documents carries a document's row as one
struct, so columns of any name pass as they are. Null sources form one source, last in order. Repeated ids keep one
row each. Sources of size 0 have target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """sized: source, size, one row per document or per part of a source. Returns source, source_size, target, whole, extra."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("nth", F.row_number().over(Window.orderBy("source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    capped = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "source")
    everything = Window.partitionBy()
    level = (
        capped.withColumn("caps_before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("weights_from", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") * F.lit(float(share)) - F.coalesce("caps_before", F.lit(0.0))) / F.col("weights_from"))
        .withColumn("water", F.max("level").over(everything))  # the level rises while sources are clamped, then falls
    )
    target = F.least(F.col("cap"), F.col("water") * F.col("weight"))
    out = level.select("source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = out.withColumn("whole", whole.cast("long"))
    return out.withColumn("extra", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))


def mix_plan(
    docs: DataFrame,
    keep: tuple[str, ...] = (),
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, whole (times taken whole), part (words taken once more), taken; and the columns in keep."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # code points keep their order behind the first letter, and null comes last
    source = F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b"))
    sized = docs.select("doc_id", source.alias("source"), word_count(text_of()).alias("size"), key.alias("key"), *keep)
    sized = sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(totals, weights, share, max_epochs)
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("size").over(in_source), F.lit(0))).drop("size")
    plan = starts.join(targets, "source")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = sized.join(plan, ["source", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("before"))).cast("long")
    out = joined.withColumn("part", part).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    return out.select("doc_id", "size", "source_size", "target", "whole", "part", "taken", *keep)


def mixed_documents(docs: DataFrame, whole_texts: bool = False, **options) -> DataFrame:
    """The mix itself: each document repeated as planned; columns as in docs. The last repetition of the document on a source's
    edge is cut after `part` words, or, with whole_texts, whole or left out, whichever ends nearer to the target."""
    columns = docs.columns
    kept = docs.withColumn("__row", F.struct(*[F.col(c) for c in columns]))
    plan = mix_plan(kept, keep=("__row",), **options)
    more = F.col("part") * 2 >= F.col("size") if whole_texts else F.lit(True)
    times = F.col("whole") + F.when((F.col("part") > 0) & more, 1).otherwise(0)
    copies = plan.where(times > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    if whole_texts:
        return copies.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])
    cut = (F.col("__copy") > F.col("whole")) & (F.col("part") < F.col("size"))
    words = F.filter(F.split(F.col("__row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(cut, F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")).otherwise(F.col("__row.text"))
    return copies.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in columns])

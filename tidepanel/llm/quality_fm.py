"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct lower-cased words, hashed into 2^BITS slots and weighted by sublinear counts scaled
to unit length, binned statistics of its structure (shares of capitals, digits, marks, repeated words and lines, word lengths), and
the bin of its length as metadata. The score is sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)):
the sum-of-squares identity makes the pairwise part linear in the number of features. lang, source, doc_id and labels are
no inputs.

Training: each of ROUNDS rounds, every shard of a bounded sample (SAMPLE_ROWS rows expected, by hash of the id) runs one
epoch of Adagrad steps from the common parameters, and the shards' parameters are averaged on Spark. The parameters are
of fixed size, so they may be broadcast.

Null or empty texts have only structure features, and are scored. Several labels for one id: each is a training row. Null
labels are left out. Without any training row all scores are 0.5. Repeated rows are scored each. Labels that all agree
give a constant-leaning model. A very long text is one row of features, as many as its distinct words. Columns besides doc_id
and text are not read, and high_quality() passes all on, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, crc_of_id, stage, text_of, tidy

BITS = 16
FACTORS = 4
SAMPLE_ROWS = 12_000
SHARDS = 8
ROUNDS = 4
STATS, BINS = 13, 16
SLOTS = (1 << BITS) + STATS * BINS
CACHE_WORDS = 300_000

_slot: dict[bytes, int] = {}


def _statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n, w = max(len(text), 1), max(len(words), 1)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=5) / n
    lines = text.split(b"\n")
    ends = Counter(x[-3:] for x in words)
    top = counts.most_common(1)[0][1] if counts else 0
    return [*kinds, len(words) / n * 5, len(counts) / w, top / w, len(set(lines)) / len(lines), max(ends.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, min(1.0, n / w / 20), math.log2(n) / 24]


_KIND = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b > 127 or b in b" \t\n\r\v\f" else 4 for b in range(256)], np.uint8)


def features(text: bytes) -> tuple[list[int], list[float]]:
    """Slots and values of a document: STATS structure features of value 0.5, then its words, together of length 1."""
    words = text.lower().split()
    counts = Counter(words)
    stats = _statistics(text, words, counts)
    slots = [(1 << BITS) + k * BINS + min(BINS - 1, int(x * BINS)) for k, x in enumerate(stats)]
    if len(_slot) > CACHE_WORDS:
        _slot.clear()
    own = []
    for x in counts:
        s = _slot.get(x)
        if s is None:
            s = _slot[x] = zlib.crc32(x) & ((1 << BITS) - 1)
        own.append(s)
    values = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(own):
        values /= np.sqrt((values * values).sum())
    return slots + own, [0.5] * STATS + values.tolist()


def fm_score(slots: np.ndarray, values: np.ndarray, starts: np.ndarray, b: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Raw scores of documents whose features lie one after the other from `starts`, in time linear in the features."""
    x = values[:, None]
    vx = v[slots] * x
    sums = np.add.reduceat(vx, starts)
    squares = np.add.reduceat(vx * vx, starts)
    return b + np.add.reduceat(w[slots] * values, starts) + 0.5 * (sums * sums - squares).sum(1)


def start_parameters(seed: int = 42) -> tuple[float, np.ndarray, np.ndarray]:
    return 0.0, np.zeros(SLOTS), np.random.default_rng(seed).normal(0, 0.05, (SLOTS, FACTORS))


def epoch(rows: list[tuple[list[int], list[float], float, float]], b: float, w: np.ndarray, v: np.ndarray, rate: float = 0.15, decay: float = 1e-5) -> tuple[float, np.ndarray, np.ndarray]:
    """One pass of Adagrad steps over (slots, values, label, row weight) in the given order."""
    w, v, gb, gw, gv = w.copy(), v.copy(), 1e-2, np.full(SLOTS, 1e-2), np.full((SLOTS, FACTORS), 1e-2)
    for s, x, y, weight in rows:
        s, x = np.asarray(s), np.asarray(x)
        vx = v[s] * x[:, None]
        total = vx.sum(0)
        raw = b + w[s] @ x + 0.5 * ((total * total) - (vx * vx).sum(0)).sum()
        slope = (1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))) - y) * weight
        dw = slope * x + decay * w[s]
        dv = slope * x[:, None] * (total - vx) + decay * v[s]
        gb += slope * slope
        np.add.at(gw, s, dw * dw)
        np.add.at(gv, s, dv * dv)
        b -= rate * slope / math.sqrt(gb)
        np.subtract.at(w, s, rate * dw / np.sqrt(gw[s]))
        np.subtract.at(v, s, rate * dv / np.sqrt(gv[s]))
    return b, w, v


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, label, shard of about sample_rows labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_of_id("doc_id") % 3 != 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    n = marked.count()
    if n > sample_rows:  # the sample's size does not depend on the table's, so it may be broadcast
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * sample_rows / n))
    text = docs.select("doc_id", text_of().alias("text"))
    return text.join(F.broadcast(marked), "doc_id").select("text", "label", F.xxhash64("doc_id", F.lit("order")).alias("key"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    spark = docs.sparkSession

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [features(t) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_pydict({"slots": pa.array([x[0] for x in both], pa.list_(pa.int32())), "vals": pa.array([x[1] for x in both], pa.list_(pa.float64())), "label": batch.column(1), "key": batch.column(2)})

    rows = stage(training_rows(docs, labels, sample_rows).mapInArrow(featurise, "slots array<int>, vals array<double>, label int, key long"), "fm-rows")
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n:
        return 0.0, np.zeros(SLOTS), np.zeros((SLOTS, FACTORS))
    share = min(max((ones or 0) / n, 1 / (n + 1)), 1 - 1 / (n + 1))
    heavier = (0.5 / share, 0.5 / (1 - share))  # both labels weigh the same in all, softened below
    b, w, v = start_parameters()
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((b, w, v))

        parts = rows.groupBy(F.pmod(F.col("key"), F.lit(shards)).alias("shard")).applyInPandas(_shard(sent, heavier, bool(turn % 2)), "b double, w binary, v binary, n long").collect()
        total = sum(p.n for p in parts)
        b = sum(p.b * p.n for p in parts) / total
        w = sum(np.frombuffer(bytes(p.w), np.float32).astype(np.float64) * p.n for p in parts) / total
        v = sum(np.frombuffer(bytes(p.v), np.float32).astype(np.float64).reshape(SLOTS, FACTORS) * p.n for p in parts) / total
    return b, w, v


def _shard(sent, heavier: tuple[float, float], forward: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ascending=forward, kind="stable")
        data = [(s, x, y, math.sqrt(heavier[0] if y else heavier[1])) for s, x, y in zip(pdf["slots"], pdf["vals"], pdf["label"], strict=True)]
        b, w, v = epoch(data, *sent.value)
        return pd.DataFrame({"b": [b], "w": [w.astype(np.float32).tobytes()], "v": [v.astype(np.float32).tobytes()], "n": [len(data)]})

    return run


def scorer(spark: SparkSession, model: tuple[float, np.ndarray, np.ndarray]):
    """A function of a text column: its score. Only the text goes to Python, whatever other columns the rows have."""
    b, w, v = model
    sent = spark.sparkContext.broadcast((b, w.astype(np.float32), v.astype(np.float32)))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        b, w, v = sent.value
        for batch in batches:
            scores: list[float] = []
            for k in range(0, len(batch), 64):
                both = [features(t) for t in batch.slice(k, 64).cast(pa.binary()).to_pylist()]
                starts = np.cumsum([0] + [len(x[0]) for x in both[:-1]])
                raw = fm_score(np.concatenate([x[0] for x in both]).astype(np.int64), np.concatenate([x[1] for x in both]), starts, b, w, v)
                scores += (1 / (1 + np.exp(-np.clip(raw, -30, 30)))).tolist()
            yield pa.array(scores, pa.float64())
        _slot.clear()
        tidy()

    return score


def score_documents(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and score."""
    return docs.select(*keep, scorer(docs.sparkSession, model)(text_of()).alias("score"))


def high_quality(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], least: float = 0.5) -> DataFrame:
    """The documents, with their own columns only, that score so much."""
    return docs.where(scorer(docs.sparkSession, model)(text_of()) >= least)

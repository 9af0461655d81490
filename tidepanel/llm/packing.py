"""Packing of token ids into sequences of a fixed capacity.

Documents above the capacity are cut; a piece's place depends on its length alone, so the packing is worked out on the
histogram of lengths (at most `capacity` numbers, summed by Spark) and dealt to pieces by their rank among equal lengths.
Pieces above a third of the capacity stand at most two to a sequence: they are matched from the longest down, each with the
longest that still fits, which makes as many pairs as can be made. Shorter pieces then go, longest first, to the smallest
gap that takes them. Sequences that are filled alike are one row of the plan. A sequence holds k distinct lengths only if
k(k+1)/2 <= capacity, and each length adds two kinds of sequence at most, so the plan's size is bounded by the capacity.

A piece's rank is its place in its own input task plus the numbers of the tasks before, so no length is one group, however
many documents share it.

doc_id must be an integer or cast to one (else Spark raises). Null and empty texts are one piece of the end id. A long text is
encoded whole. Columns besides doc_id and text are not read. Repeated rows are pieces each; pieces of one length are
interchangeable, so which of them goes where is open. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of, text_slices
from .huffman_ids import SLICE_BYTES, encode_texts

CAPACITY = 2048
END_ID = 0


def matched(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The kinds of sequence that the lengths above a third of the capacity make, and how many of each. Empties those of left.
    The longest has the fewest partners, and all others have those too, so to give it the longest of them loses no pair."""
    kinds, lengths = [], sorted(n for n in left if 3 * n > capacity)
    while lengths:
        n = lengths[-1]
        at = bisect_left(lengths, capacity - n + 1) - 1  # the longest that fits
        if at == len(lengths) - 1 and left[n] == 1:
            at -= 1
        if at < 0:
            kinds.append((((n, 1),), left[n]))
            left[n] = 0
        elif lengths[at] == n:
            kinds.append((((n, 2),), left[n] // 2))
            left[n] %= 2
        else:
            k = min(left[n], left[lengths[at]])
            kinds.append((((n, 1), (lengths[at], 1)), k))
            left[n] -= k
            left[lengths[at]] -= k
        lengths = [x for x in lengths if left[x]]
    return kinds


def kinds_of_sequence(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Kinds of sequence, ((length, how often), ...), and how many sequences of each kind there are."""
    left = {n: c for n, c in histogram.items() if c > 0}
    gaps: dict[int, list] = defaultdict(list)

    def put(kind: tuple, count: int) -> None:
        gaps[capacity - sum(n * c for n, c in kind)].append((kind, count))

    for kind, count in matched(left, capacity):
        put(kind, count)
    for n in sorted((x for x in left if left[x]), reverse=True):
        todo = left[n]
        for gap in sorted(g for g in gaps if g >= n):
            if not todo:
                break
            fit = gap // n
            for kind, count in gaps.pop(gap):
                full = min(count, todo // fit)
                if full:
                    put((*kind, (n, fit)), full)
                    todo, count = todo - full * fit, count - full
                if count and 0 < todo < fit:
                    put((*kind, (n, todo)), 1)
                    todo, count = 0, count - 1
                if count:
                    put(kind, count)
        fit = capacity // n
        if todo // fit:
            put(((n, fit),), todo // fit)
        if todo % fit:
            put(((n, todo % fit),), 1)
    return [x for gap in sorted(gaps) for x in gaps[gap]]


def plan_rows(kinds: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence, how many to a sequence, offset) by length and rank: what becomes of equal lengths
    from a rank on."""
    rows, used, sequence = [], defaultdict(int), 0
    for kind, count in kinds:
        offset = 0
        for n, each in kind:
            rows.append((n, used[n], sequence, each, offset))
            used[n] += count * each
            offset += n * each
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, its input task and its place among the task's pieces of its
    length, and the ids (little-endian 32-bit) if with_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for texts, lo in text_slices(batch.column(1), SLICE_BYTES):
                ids, counts = encode_texts(texts, tokenizer_file)
                counts = counts + 1
                ends = np.cumsum(counts)
                all_ids = np.full(int(ends[-1]), end_id, "<u4")
                inner = np.ones(len(all_ids), bool)
                inner[ends - 1] = False
                all_ids[inner] = ids
                cut = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), cut)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cut) - cut, cut)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = (ends - counts)[doc] + start
                data = memoryview(all_ids.tobytes())
                parts = [data[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.zeros(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).take(pa.array(doc + lo)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
                names = [x.split()[0] for x in PIECES.split(", ")]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(x) for x in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for: a row for each piece."""
    spark = docs.sparkSession
    made = stage(pieces(docs, tokenizer_file, capacity, end_id, with_ids), "pieces")
    per_task = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    total = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    sent = spark.sparkContext.broadcast(plan_rows(kinds_of_sequence(total, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.num_columns - k).to_numpy() for k in (2, 1))
            row = rows[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            bins, inside = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(row[:, 2] + bins), pa.array(row[:, 4] + inside * length)], [*kept, "sequence_id", "offset"])

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    return ranked.select(*kept, F.col("length").alias("size"), "rank").mapInArrow(place, fields)

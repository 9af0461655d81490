"""Substring dedup by recompression: words covered by a window of `width` words that starts earlier elsewhere are removed.

Each of ROUNDS Spark rounds names maximal runs of one symbol, and pairs of neighbours whose left one is of the low half and whose
right one is of the high half of all symbols (by a bit of the symbol's name). Every task sends its distinct runs and pairs to
buckets; a bucket gives each one that stands twice or more in all documents a number, which is its name everywhere from then
on, and answers nothing for those that stand once. So equal windows are named alike but for a few symbols at their ends, which
ones follows from the window's content alone, and a window with a symbol inside that stands once repeats nowhere. Of the other
windows' inner symbols, the chain of three with the least name is the anchor. Spark counts the anchors of all documents: where
an anchor stands once, no window is a repeat. What is left (and the few windows with fewer than three inner symbols) is
verified by 128-bit names of the whole windows, made of 128-bit names of their words, and the earliest place of each is found.

Documents are handled in chunks of about CHUNK_WORDS words, as one row with its distinct words and their order, written once
in a table that is bucketed by chunk (a bucket for each TABLE_BYTES of text), so that the rounds' answers come to the chunks and
not the chunks to them. What is
exchanged are arrays of a chunk's distinct symbols by bucket, and numbers or bits in reply; a passage that stands in a third of
all documents is a few symbols a chunk. There are as many buckets as BUCKET_WORDS words need.

doc_id must be an integer or cast to one (else Spark raises). Null texts have no words. Texts of fewer words than the window keep
all. A text longer than a chunk is one chunk of its own. A null doc_id sorts before all others; rows of equal doc_id are in
the order in which they are first scanned, later ones repeat earlier ones. Extra columns are not read. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, shared_folder, stage, text_of

WIDTH = 20
CHUNK_WORDS = 500_000
BUCKET_WORDS = 4_000_000
TABLE_BYTES = 1 << 26
ROUNDS = 2
CHAIN = 3
NO_ID = -(1 << 63)
_U = np.uint64


def mix(a: np.ndarray, b: np.ndarray | int, salt: int = 0) -> np.ndarray:
    x = a * _U(0x9E3779B97F4A7C15) + (b if isinstance(b, np.ndarray) else _U(b)) * _U(0xC2B2AE3D27D4EB4F) + _U(salt * 2 + 1)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


class Chunk:
    """Some documents, in order, as the places of their words among the distinct ones."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, words: list[bytes], index: np.ndarray) -> None:
        self.ids, self.sizes, self.words, self.index = ids, sizes, words, index
        self.name = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[index]
        self.doc = np.repeat(np.arange(len(ids)), sizes)

    def starts(self, width: int) -> np.ndarray:
        """The words at which a window starts."""
        n = len(self.doc)
        return np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)

    def parse(self, width: int, replies: list) -> Parse:
        """The rounds that are answered, and what the next one has to name. A reply gives the names of this chunk's distinct
        runs and pairs of a round, in order; 0 stands for those that stand once."""
        first = self.starts(width)
        out = Parse(self.name, self.doc, first.copy(), first + width - 1, np.ones(len(first), bool))
        for turn in range(len(replies) + 1):
            out.step(turn, replies[turn] if turn < len(replies) else None)
        return out

    def window_names(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the windows that start at the given words, as two halves."""
        whole = b"".join(xxhash.xxh3_128_digest(w) for w in self.words)
        halves = np.frombuffer(whole, ">u8").astype(np.uint64).reshape(-1, 2)
        out = []
        for salt in (0, 1):
            level, span, done, covered = halves[self.index, salt], 1, None, 0
            while True:
                if width & span:
                    part = level[at + covered]
                    done = part if done is None else mix(done, part, salt + 51)
                    covered += span
                if span * 2 > width:
                    break
                level = mix(level[:-span], level[span:], salt + 11)
                span *= 2
            out.append(done)
        return out[0], out[1]


class Parse:
    """Symbols by name and document, and for each window its inner symbols lo..hi (both included) and whether it may repeat."""

    def __init__(self, name: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, alive: np.ndarray) -> None:
        self.name, self.doc, self.lo, self.hi, self.alive = name, doc, lo, hi, alive
        self.left = self.right = np.zeros(0, np.uint64)  # the next round's distinct runs (right is 0) and pairs
        self.many = np.zeros(0, bool)

    def step(self, turn: int, reply) -> None:
        if not len(self.name):
            return
        name, doc, lo, hi = self.name, self.doc, self.lo, self.hi
        # runs: the outermost run of a window may go on outside
        new = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
        at = np.flatnonzero(new)
        index = np.cumsum(new) - 1
        length = np.diff(np.r_[at, len(name)]).astype(np.uint64)
        run = (length > 1) & (name[at] != 0)
        code, doc = np.where(run, mix(name[at], length, 3 * turn), name[at]), doc[at]
        empty = lo > hi
        lo, hi = index[np.minimum(lo, len(index) - 1)] + 1, index[np.maximum(hi, 0)] - 1
        hi[empty] = lo[empty] - 1
        # pairs: a low symbol takes in a high one on its right, so only a high first or a low last one may go on outside
        high = (mix(code, 0, 3 * turn + 1) & _U(1)).astype(bool)
        taken = np.r_[False, ~high[:-1] & high[1:] & (doc[1:] == doc[:-1])]
        at = np.flatnonzero(~taken)
        index = np.cumsum(~taken) - 1
        pair = np.r_[taken[1:], False][at]
        after = code[np.minimum(at + 1, len(code) - 1)]
        left, right = code[at], np.where(pair, after, _U(0))
        dead = (left == 0) | (pair & (after == 0))  # holds what stands once
        asked = np.flatnonzero((pair | run[at]) & ~dead)
        order, starts = _groups(mix(left[asked], right[asked], 3 * turn + 2), left[asked], right[asked])
        leads = asked[order[starts]]
        if reply is None:
            self.left, self.right, self.many = left[leads], right[leads], np.diff(np.r_[starts, len(order)]) > 1
            return
        names = reply(self.keys(left[leads], right[leads], turn))
        found = np.where(dead, _U(0), left)
        found[asked[order]] = np.repeat(names, np.diff(np.r_[starts, len(order)]))
        empty = lo > hi
        safe_lo, safe_hi = np.clip(lo, 0, len(high) - 1), np.clip(hi, 0, len(high) - 1)
        lo, hi = index[safe_lo] + high[safe_lo], index[safe_hi] - ~high[safe_hi]
        hi[empty] = lo[empty] - 1
        before = np.r_[0, np.cumsum(found == 0)]
        inner = lo <= hi
        self.alive[inner] &= before[hi[inner] + 1] == before[lo[inner]]
        self.name, self.doc, self.lo, self.hi = found, doc[at], lo, hi

    @staticmethod
    def keys(left: np.ndarray, right: np.ndarray, turn: int) -> np.ndarray:
        """By which runs and pairs are dealt to buckets; they are in this order."""
        return mix(left, right, 3 * turn + 2)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The chains' names, and for each window its anchor's place (-1: fewer than CHAIN inner symbols)."""
        n = len(self.name) - CHAIN + 1
        place = np.full(len(self.lo), -1, np.int64)
        if n <= 0:
            return self.name[:0], place
        chain = mix(mix(self.name[:n], self.name[1 : n + 1], 97), self.name[2 : n + 2], 98)
        last = self.hi - CHAIN + 1
        some = np.flatnonzero((last >= self.lo) & self.alive)
        place[some] = _least(chain, self.lo[some], last[some])
        return chain, place


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The place of the first least value in each range."""
    out = np.zeros(len(lo), np.int64)
    length = hi - lo + 1
    table, span = np.arange(len(values)), 1
    while len(length):
        now = np.flatnonzero((length >= span) & (length < 2 * span))
        if len(now):
            a, b = table[lo[now]], table[hi[now] - span + 1]
            out[now] = np.where(values[b] < values[a], b, a)
        if not (length >= 2 * span).any():
            break
        a, b = table[:-span], table[span:]
        table = np.where(values[b] < values[a], b, a)
        span *= 2
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, ties as given; and the places in it where a new key begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _shares(sorted_names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that ascending 64-bit names fall into, and where each of those begins, with the end at last. Buckets are equal ranges of
    the upper 32 bits; the work follows the names, however many buckets there are."""
    bucket = (((sorted_names >> _U(32)) + _U(1)) * _U(buckets) - _U(1)) >> _U(32)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return bucket[first].astype(np.int64), np.r_[first, len(bucket)]


def _slices(shares: tuple[np.ndarray, np.ndarray], reply: list[dict] | None) -> Iterator[tuple[dict, slice]]:
    """A reply's buckets, each with its part of the names."""
    used, cut = shares
    for r in reply or []:
        k = int(np.searchsorted(used, r["bucket"]))
        yield r, slice(int(cut[k]), int(cut[k + 1]))


def _dealt(shares: tuple[np.ndarray, np.ndarray], chunk: int, *columns: np.ndarray, flags: np.ndarray | None = None) -> list[pa.Array]:
    """A row for each bucket that is used: the bucket, the chunk, the columns' parts as bytes, and the flags' as bits."""
    used, cut = shares
    parts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    out = [pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), *[pa.array([c[a:b].tobytes() for a, b in parts], pa.binary()) for c in columns]]
    return out if flags is None else [*out, pa.array([np.packbits(flags[a:b]).tobytes() for a, b in parts], pa.binary())]


_CHUNK = "chunk long, doc_ids binary, sizes binary, words array<binary>, places binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scanned documents (doc_id, text) to chunks."""
    number = TaskContext.get().partitionId() << 32
    ids: list[int] = []
    texts: list[pa.Array] = []
    size = 0

    def out() -> pa.RecordBatch:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        split = pc.ascii_split_whitespace(pa.concat_arrays(texts).take(pa.array(order)))
        flat, cuts = split.values, split.offsets.to_numpy().astype(np.int64)
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at a text's end splits off an empty word
        cuts = np.r_[0, np.cumsum(real)][cuts]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        row = [number, np.array(ids, np.int64)[order].tobytes(), np.diff(cuts).tobytes(), coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.uint32).tobytes()]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["chunk", "doc_ids", "sizes", "words", "places"])

    for batch in batches:
        need = pc.add(pc.divide(pc.binary_length(batch.column(1)), 6), 1).to_pylist()
        names, lo = batch.column(0).to_pylist(), 0
        for k, more in enumerate(need):
            ids.append(NO_ID if names[k] is None else names[k])
            size += more
            if size >= CHUNK_WORDS or k == len(need) - 1:
                texts.append(batch.column(1).slice(lo, k + 1 - lo))
                lo = k + 1
            if size >= CHUNK_WORDS:
                yield out()
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield out()


def _chunk_of(r: dict) -> Chunk:
    return Chunk(np.frombuffer(r["doc_ids"], np.int64), np.frombuffer(r["sizes"], np.int64), r["words"], np.frombuffer(r["places"], np.uint32))


def _names_in(reply: list[dict] | None, turn: int, buckets: int):
    """A round's reply as a function of the sorted keys of a chunk's runs and pairs: their names, 0 for those that stand once."""

    def names(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint64)
        for r, part in _slices(_shares(keys, buckets), reply):
            number = np.frombuffer(r["bits"], np.uint32).astype(np.uint64)
            out[part] = np.where(number > 0, (_U(turn + 1) << _U(60)) | (_U(r["bucket"]) << _U(32)) | number, _U(0))
        return out

    return names


def _parsed(r: dict, chunk: Chunk, width: int, turns: int, buckets: int) -> Parse:
    return chunk.parse(width, [_names_in(r[f"names{t}"], t, buckets) for t in range(turns)])


def _symbol_rows(width: int, turn: int, buckets: int):
    """A chunk's distinct runs and pairs of a round by bucket, and which of them stand more than once in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            p = _parsed(r, _chunk_of(r), width, turn, buckets)
            shares = _shares(p.keys(p.left, p.right, turn), buckets)
            yield pa.RecordBatch.from_arrays(_dealt(shares, r["chunk"], p.left, p.right, flags=p.many), ["bucket", "chunk", "left", "right", "many"])

    return run


def _named(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers a bucket's runs and pairs: from 1 for those that stand more than once anywhere, 0 for the others."""
    left, right = (np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("left", "right"))
    sizes = [len(x) // 8 for x in pdf["left"]]
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(pdf["many"], sizes, strict=True)]).astype(bool)
    order, first = _groups(left, right)
    group = np.zeros(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    again = (np.bincount(group) > 1) | (np.bincount(group, many) > 0)
    number = np.where(again, np.cumsum(again), 0).astype(np.uint32)[group]
    cuts = np.cumsum([0, *sizes])
    out = [(c, b, number[cuts[k] : cuts[k + 1]].tobytes()) for k, (c, b) in enumerate(zip(pdf["chunk"], pdf["bucket"], strict=True))]
    return pd.DataFrame(out, columns=["chunk", "bucket", "bits"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _anchor_rows(width: int, buckets: int):
    """A chunk's distinct anchors by bucket, and which of them stand more than once in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            names, many = _own_anchors(*_parsed(r, _chunk_of(r), width, ROUNDS, buckets).anchors())
            yield pa.RecordBatch.from_arrays(_dealt(_shares(names, buckets), r["chunk"], names, flags=many), ["bucket", "chunk", "names", "many"])

    return run


def _own_anchors(chain: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used = np.zeros(len(chain), bool)
    used[place[place >= 0]] = True
    names, counts = np.unique(chain[used], return_counts=True)
    return names, counts > 1


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's anchors: bits by chunk, set for those that stand more than once anywhere."""
    parts = [np.frombuffer(x, np.uint64) for x in pdf["names"]]
    sizes = [len(p) for p in parts]
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(pdf["many"], sizes, strict=True)]).astype(bool)
    order, first = _groups(np.concatenate(parts))
    group = np.zeros(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    hit = (np.bincount(group) > 1) | (np.bincount(group, many) > 0)
    return _bits(pdf, hit[group], sizes)


def _bits(pdf: pd.DataFrame, flags: np.ndarray, sizes: list[int]) -> pd.DataFrame:
    cuts = np.cumsum([0, *sizes])
    out = [(c, b, np.packbits(flags[cuts[k] : cuts[k + 1]]).tobytes()) for k, (c, b) in enumerate(zip(pdf["chunk"], pdf["bucket"], strict=True)) if flags[cuts[k] : cuts[k + 1]].any()]
    return pd.DataFrame(out, columns=["chunk", "bucket", "bits"])


def _flags(reply: list[dict] | None, shares: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(int(shares[1][-1]), bool)
    for r, part in _slices(shares, reply):
        out[part] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=part.stop - part.start)
    return out


def _candidates(r: dict, chunk: Chunk, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words at which windows start that may repeat, their names (two halves), and their order and groups by name."""
    p = _parsed(r, chunk, width, ROUNDS, buckets)
    chain, place = p.anchors()
    names, _ = _own_anchors(chain, place)
    again = _flags(r["anchors"], _shares(names, buckets))
    may = p.alive.copy()
    known = np.flatnonzero(place >= 0)
    if len(known):
        may[known] = again[np.searchsorted(names, chain[place[known]])]
    at = chunk.starts(width)[may]
    high, low = chunk.window_names(at, width) if len(at) else (np.zeros(0, np.uint64),) * 2
    order, first = _groups(high, low)
    return at, high, low, order, first


def _window_rows(width: int, buckets: int):
    """A chunk's distinct candidate windows by bucket, each with the first document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            chunk = _chunk_of(r)
            at, high, low, order, first = _candidates(r, chunk, width, buckets)
            lead = order[first]  # the order is stable, so a group's first is its earliest place
            high, low, doc = high[lead], low[lead], chunk.ids[chunk.doc[at[lead]]]
            yield pa.RecordBatch.from_arrays(_dealt(_shares(high, buckets), r["chunk"], high, low, doc), ["bucket", "chunk", "high", "low", "doc"])

    return run


def _later(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's windows: bits by chunk, set for those that another chunk has earlier."""
    sizes = [len(x) // 8 for x in pdf["high"]]
    high, low = (np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("high", "low"))
    doc, chunk = np.frombuffer(b"".join(pdf["doc"]), np.int64), np.repeat(pdf["chunk"].to_numpy(), sizes)
    order = np.lexsort((chunk, doc, low, high))
    h, lo = high[order], low[order]
    lead = np.r_[True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])]
    later = np.zeros(len(order), bool)
    later[order] = ~lead
    return _bits(pdf, later, sizes)


def _removals(r: dict, chunk: Chunk, width: int, buckets: int) -> np.ndarray:
    """Which words of a chunk go."""
    at, high, _, order, first = _candidates(r, chunk, width, buckets)
    gone = np.zeros(len(at), bool)
    if len(at):
        elsewhere = _flags(r["later"], _shares(high[order[first]], buckets))
        gone[order] = np.repeat(elsewhere, np.diff(np.r_[first, len(order)]))
        here = np.ones(len(at), bool)
        here[order[first]] = False  # all but the earliest in this chunk repeat it
        gone |= here
    edge = np.zeros(len(chunk.doc) + 1, np.int64)
    edge[at[gone]] += 1  # a window starts at a word once
    edge[at[gone] + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def _chunk_table(docs: DataFrame) -> tuple[DataFrame, str]:
    """The chunks as a table in the shared folder, bucketed by chunk, and its name. It has a bucket for each TABLE_BYTES of text, up
    to as many as Spark allows a table (spark.sql.sources.bucketing.maxBuckets); beyond that its buckets grow, of which a task reads a
    chunk at a time."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    name, n = f"chunks_{uuid.uuid4().hex}", min(most, max(partitions(spark), int(size // TABLE_BYTES) + 1))
    rows = source.mapInArrow(_chunks, _CHUNK)
    rows.repartition(n, "chunk").write.bucketBy(n, "chunk").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and text: the kept words joined by one space). The rows are written,
    and the table of chunks is dropped with its files."""
    scratch = Scratch()
    chunks, name = _chunk_table(docs)
    n_words = chunks.agg(F.sum(F.length("places") / 4)).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), int(n_words // BUCKET_WORDS) + 1)
    reply_type = "chunk long, bucket int, bits binary"
    state = chunks
    for turn in range(ROUNDS):
        asked = state.mapInArrow(_symbol_rows(width, turn, buckets), "bucket int, chunk long, left binary, right binary, many binary")
        state = state.join(_gathered(asked.groupBy("bucket").applyInPandas(_named, reply_type), f"names{turn}", scratch), "chunk", "left")
    anchors = state.mapInArrow(_anchor_rows(width, buckets), "bucket int, chunk long, names binary, many binary")
    state = state.join(_gathered(anchors.groupBy("bucket").applyInPandas(_repeated, reply_type), "anchors", scratch), "chunk", "left")
    windows = state.mapInArrow(_window_rows(width, buckets), "bucket int, chunk long, high binary, low binary, doc binary")
    state = state.join(_gathered(windows.groupBy("bucket").applyInPandas(_later, reply_type), "later", scratch), "chunk", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            chunk = _chunk_of(r)
            gone = _removals(r, chunk, width, buckets)
            cuts = np.r_[0, np.cumsum(chunk.sizes)]
            kept = np.r_[0, np.cumsum(~gone)][cuts]
            words = pa.array(chunk.words, pa.binary()).take(pa.array(chunk.index[~gone]))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words), b" ")
            cols = [
                pa.array([None if i == NO_ID else i for i in chunk.ids.tolist()], pa.int64()), pa.array(chunk.sizes, pa.int64()), pa.array(chunk.sizes - np.diff(kept), pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts.to_pylist()], pa.string()),
            ]
            if with_text:
                cols.append(texts.cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text)

    out = stage(state.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text), "kept-words")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    scratch.paths.append(f"{shared_folder(docs.sparkSession)}/{name}")  # a table of a path of its own leaves its files
    scratch.clear()
    return out


def _gathered(replies: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """A row for each chunk: its replies, one for each bucket at most. Written, as all later steps read them."""
    return scratch.stage(replies, name).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

An item's windows are its runs of `width` words (all its words, if fewer). A window's tokens are its shingles of SHINGLE
words (all its words, if fewer). A document that holds a window holds all of its shingles, so in any one order of the shingles
the first one is a sufficient prefix; they are ordered by rarity, by their counts over all documents. Documents and windows
are joined on that shingle. The join's pairs then pass a length bound (the window fits between the document's ends from the
shingle's place) and a positional bound (the shingle's place in the window fixes where the window would start), and what is
left is compared word by word.

Two passes read the documents: one counts the windows' shingles, one finds places of the rarest ones. A pass lets through
what is in a Bloom filter of FILTER_BITS bits, the only thing that is broadcast and of one size whatever the benchmark's. Keys
that stand in many rows are salted in the joins.

Null and empty texts have no words: never hit, and items without words have no windows. Very long texts are read whole; of
them only the places of rare shingles, each with the words around it, go on. Repeated document rows give one row each;
repeated item ids and repeated windows count once per item id. Ties in rarity go by the shingle's hash, then its place. Null
item ids are left out. An empty benchmark leaves all documents clean; no documents give no rows. Columns in keep are held in
a struct, so their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, stage, text_of, text_slices, tidy

WIDTH = 10
SHINGLE = 3
FILTER_BITS = 25
SLICE_BYTES = 1 << 22
#: Bytes 0-9, a-z and all above 127 stay, A-Z become lower case, the rest become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_U = np.uint64


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts' words one after the other, their 64-bit hashes, and the word at which each text begins (and the last ends)."""
    whole = pa.array([t.translate(FOLD) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    lists = pc.ascii_split_whitespace(whole)
    flat, cuts = lists.values, lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at a text's end splits off an empty word
    if not real.all():
        cuts = np.r_[0, np.cumsum(real)][cuts]
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return flat, hashes[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64), cuts


def _shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words from a word on (over a text's end too)."""
    out = hashes[: max(0, len(hashes) - n + 1)] * _U(0x9E3779B97F4A7C15) + _U(n)
    for k in range(1, n):
        out = (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9) + hashes[k : len(hashes) - n + 1 + k]
    out = (out ^ (out >> _U(32))) * _U(0x94D049BB133111EB)
    return out ^ (out >> _U(31))


def _inside(cuts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which places of _shingles() have all their words in one text."""
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    return text[: max(0, length - n + 1)] == text[n - 1 :] if length >= n else np.zeros(0, bool)


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """win (words joined by spaces), words (how many), at and key (place and hash of each of its shingles), item_id (string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat, hashes, _ = _split(pa.array([text], pa.string()))
                w = flat.to_pylist()
                by_size = {n: _shingles(hashes, n).view(np.int64).tolist() for n in {min(SHINGLE, len(w))} - {0}}
                seen = set()
                for k in range(max(1, len(w) - width + 1) if w else 0):
                    win = w[k : k + width]
                    if (name := " ".join(win)) not in seen:
                        seen.add(name)
                        n = min(SHINGLE, len(win))
                        keys = by_size[n][k : k + len(win) - n + 1]
                        out.append((name, len(win), n, keys, i))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["win", "words", "size", "keys", "item_id"])

    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "win string, words int, size int, keys array<long>, item_id string")


def _places(key: Column) -> list[Column]:
    """A key's two bits of the filter."""
    return [F.shiftrightunsigned(key, 64 - FILTER_BITS), F.shiftrightunsigned(F.shiftleft(key, FILTER_BITS), 64 - FILTER_BITS)]


def bloom(keys: DataFrame) -> np.ndarray:
    """keys: key (long). A filter of 2 ** FILTER_BITS bits as bytes; at most 2 ** (FILTER_BITS - 6) rows come to the driver."""
    bits = keys.select(F.explode(F.array(*_places(F.col("key")))).alias("bit"))
    found = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("ones")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["ones"].to_numpy(np.int64)
    return out.view(np.uint64)


def _passes(keys: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """The places of the keys that may be in the filter."""
    down, some = _U(64 - FILTER_BITS), None
    for turn in (_U(0), _U(FILTER_BITS)):
        bit = ((keys if some is None else keys[some]) << turn) >> down
        ok = (filter_[bit >> _U(6)] >> (bit & _U(63))) & _U(1) == 1
        some = np.flatnonzero(ok) if some is None else some[ok]
    return some


def _count(sent, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, _ in text_slices(batch.column(0), SLICE_BYTES):
                _, hashes, cuts = _split(texts)
                for n in sizes:
                    keys = _shingles(hashes, n)[_inside(cuts, n, len(hashes))]
                    own, counts = np.unique(keys[_passes(keys, sent.value)].view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(own, pa.int64()), "n": pa.array(counts, pa.int64())})
        tidy()

    return run


_FOUND = "n_words long, places array<struct<key:long,pos:long,first:long,around:array<string>>>"


def _find(sent, sizes: list[int], width: int):
    """Adds n_words and the places of shingles in the filter, each with the words within width of it."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int64()), ("first", pa.int64()), ("around", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            others = [k for k in range(batch.num_columns) if k != at]
            for texts, done in text_slices(batch.column(at), SLICE_BYTES):
                flat, hashes, cuts = _split(texts)
                places: list[list[dict]] = [[] for _ in range(len(texts))]
                for n in sizes:
                    keys = _shingles(hashes, n)
                    some = _passes(keys, sent.value)
                    some = some[_inside(cuts, n, len(hashes))[some]]
                    text = np.searchsorted(cuts, some, "right") - 1
                    for key, p, t in zip(keys[some].view(np.int64).tolist(), some.tolist(), text.tolist(), strict=True):
                        lo, hi = max(int(cuts[t]), p - width), min(int(cuts[t + 1]), p + width)
                        places[t].append({"key": key, "pos": p - int(cuts[t]), "first": lo - int(cuts[t]), "around": flat.slice(lo, hi - lo).to_pylist()})
                kept = [batch.column(k).slice(done, len(texts)) for k in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(cuts), pa.int64()), pa.array(places, kind)], [*(batch.schema.names[k] for k in others), "n_words", "places"])
        tidy()

    return run


def _covered(spans: Column) -> Column:
    """How many words the spans (start, words) cover together."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct((a["total"] + F.greatest(F.lit(0), s["start"] + s["words"] - F.greatest(a["end"], s["start"]))).alias("total"), F.greatest(a["end"], s["start"] + s["words"]).alias("end"))
    return F.aggregate(F.sort_array(spans), start, step)["total"]


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, hot: int = 1000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit and items (array of item ids, sorted as strings)."""
    spark = docs.sparkSession
    source = docs.select("doc_id", text_of().alias("__text"))
    held = stage(item_windows(items, width), "item-windows")
    windows = stage(held.groupBy("win").agg(F.first("words").alias("words"), F.first("size").alias("size"), F.first("keys").alias("keys")), "windows")
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # SHINGLE values at most
    tokens = windows.select("win", "words", F.posexplode("keys").alias("at", "key"))
    counted = source.select("__text").mapInArrow(_count(spark.sparkContext.broadcast(bloom(tokens)), sizes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct("n", "key", "at")).alias("rarest")
    every = tokens.select("key").distinct().join(counted, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    prefixes = stage(tokens.join(every, "key").groupBy("win", "words").agg(rarest).where("rarest.n > 0").select("win", "words", "rarest.key", "rarest.at", "rarest.n"), "prefixes")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text")
    found = source.mapInArrow(_find(spark.sparkContext.broadcast(bloom(prefixes)), sizes, width), f"{fields}, {_FOUND}")
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "places")  # a row's number is given once and written
    places = stage(found.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*"), "place-rows")
    pairs = salted_join(places, prefixes.drop("n"), "key", hot_keys(places, "key", least=hot))
    start = F.col("pos") - F.col("at")
    bounded = pairs.withColumn("start", start).where((F.col("start") >= F.col("first")) & (F.col("start") + F.col("words") <= F.col("n_words")))
    same = F.array_join(F.slice("around", (F.col("start") - F.col("first") + 1).cast("int"), F.col("words")), " ") == F.col("win")
    hits = stage(bounded.where(same).select("row", "start", "words", "win").distinct(), "hits")
    covered = hits.groupBy("row").agg(_covered(F.collect_set(F.struct("start", "words"))).alias("n_hit"))
    hit_windows = stage(hits.select("row", "win").distinct(), "hit-windows")
    named = salted_join(hit_windows, held.select("win", "item_id").distinct(), "win", hot_keys(hit_windows, "win", least=hot))
    listed = named.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = found.drop("places").join(covered, "row", "left").join(listed, "row", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, with their own columns only, that hold no window of an item. docs must be read from files, so that its
    rows keep their places when read again: only the numbers of hit rows are joined back, never a text."""
    numbered = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.monotonically_increasing_id().alias("__row"))
    found = decontaminate(numbered.select(F.col("__row").alias("doc_id"), "text"), items, width)
    hit = stage(found.where("n_hit > 0").select(F.col("doc_id").alias("__row")), "hit-rows")
    return numbered.join(hit, "__row", "left_anti").select("__doc.*")

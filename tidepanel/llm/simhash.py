"""SimHash near-duplicates, found by pigeonring filtering.

A 64-bit fingerprint is a ring of SEGMENTS segments. Two fingerprints at distance d <= MAX_BITS have a place on the ring
from which every chain of l segments differs in at most l * MAX_BITS / SEGMENTS bits. Its first five segments (20 bits)
must then be equal, and the ten first differ in one bit at most, so either segments 6-7 or 8-10 are equal too: each place
gives two keys, of 28 and 32 equal bits. Fingerprints that meet under a key are checked along the chain, and what is left
by the full Hamming distance.

Equal fingerprints are one row from the start. Within a key only the links that join sets not yet joined are kept, so a
group of n gives n-1 links, not n(n-1)/2. A key with more than BLOCK fingerprints is dealt as pairs of blocks, so no task
holds an unbounded group. The copies of one text are salted where their component is joined to them.

Null and empty texts have fingerprint zero and link like any other. Fewer words than a shingle: the whole sequence is the
shingle. Repeated rows keep one output row each. Null ids are kept as rows but give no component its name unless all ids
of it are null (then null). A long text is hashed PART shingles at a time. Columns besides doc_id and text are not read by
near_duplicates(); deduplicate() passes all on. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, hot_keys, salted_join, stage, text_of
from .components import components

MAX_BITS = 3
SEGMENTS = 16
SEED = 42
BLOCK = 2048
PART = 4096
_WIDTH = 64 // SEGMENTS


def fingerprint(text: bytes, shingle: int) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; no words: 0."""
    w = text.lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) < shingle:
        grams = iter([b" ".join(w)])
    elif shingle == 3:
        grams = (b"%b %b %b" % x for x in zip(w, w[1:], w[2:]))
    else:
        grams = (b" ".join(x) for x in zip(*(w[k:] for k in range(shingle))))
    ones, n = np.zeros(64, np.int64), 0
    while part := [h(g, SEED) for g in islice(grams, PART)]:  # a long text's hashes are never held all at once
        ones += np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and fp: the fingerprint as a signed long."""
    source = docs.select(*keep, text_of().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch, "__text")], np.uint64).view(np.int64)
            kept = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(fps, pa.int64())], [*kept, "fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return source.mapInArrow(run, f"{fields}, fp long")


def _keys(fp: Column) -> Column:
    """The keys of a fingerprint: for each place on the ring, the ring turned there and cut to 5+2 or 5 and 8-10 segments."""
    keys = []
    for k in range(SEGMENTS):
        turned = fp if k == 0 else F.shiftleft(fp, k * _WIDTH).bitwiseOR(F.shiftrightunsigned(fp, 64 - k * _WIDTH))
        head = F.shiftrightunsigned(turned, 36)  # seven segments
        five = F.shiftrightunsigned(turned, 44)
        eight_ten = F.shiftrightunsigned(turned, 24).bitwiseAND(F.lit(0xFFF))
        keys.append(F.struct(F.lit(2 * k).cast("int").alias("place"), head.alias("bits")))
        keys.append(F.struct(F.lit(2 * k + 1).cast("int").alias("place"), F.shiftleft(five, 12).bitwiseOR(eight_ten).alias("bits")))
    return F.explode(F.array(*keys))


def _chain_ok(x: np.ndarray, place: int) -> np.ndarray:
    """Differences x (uint64), turned to the place: does each chain of l segments stay within l * MAX_BITS / SEGMENTS?"""
    turn = np.uint64((place // 2) * _WIDTH)
    t = x if turn == 0 else (x << turn) | (x >> (np.uint64(64) - turn))
    ok = np.ones(len(t), bool)
    for length in (5, 10, 15):  # the budgets grow by one after these lengths only
        ok &= np.bitwise_count(t >> np.uint64(64 - length * _WIDTH)) <= length * MAX_BITS // SEGMENTS
    return ok


def _links(left: np.ndarray, right: np.ndarray | None, place: int) -> list[tuple[int, int]]:
    """Links among the fingerprints (or between two blocks) that join sets not yet joined."""
    both = left if right is None else np.concatenate([left, right])
    parent = list(range(len(both)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(left)):
        others = both[i + 1 :] if right is None else right
        base = i + 1 if right is None else len(left)
        x = others ^ both[i]
        near = np.flatnonzero(_chain_ok(x, place))
        near = near[np.bitwise_count(x[near]) <= MAX_BITS]
        for j in near.tolist():
            a, b = root(i), root(base + j)
            if a != b:
                parent[a] = b
                out.append((i, base + j))
    return [(int(both[i]), int(both[j])) for i, j in out]


def _scan_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (place, bits): links within each run of one key. A run may span batches; runs are BLOCK long at most."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        place, bits = pdf["place"].to_numpy(), pdf["bits"].to_numpy()
        last = int(np.flatnonzero((place != place[-1]) | (bits != bits[-1]))[-1]) + 1 if ((place != place[-1]) | (bits != bits[-1])).any() else 0
        rest = pdf.iloc[last:]
        yield _runs(place[:last], bits[:last], pdf["fp"].to_numpy()[:last])
    if rest is not None and len(rest):
        yield _runs(rest["place"].to_numpy(), rest["bits"].to_numpy(), rest["fp"].to_numpy())


def _runs(place: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    out: list[tuple[int, int]] = []
    if len(fp):
        cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (bits[1:] != bits[:-1]), True])
        many = np.flatnonzero(np.diff(cuts) > 1)
        u = fp.view(np.uint64)
        for k in many.tolist():
            out += _links(u[cuts[k] : cuts[k + 1]], None, int(place[cuts[k]]))
    pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
    place = int(pdf["place"].iloc[0])
    first = pdf["i"].iloc[0]
    u = pdf["fp"].to_numpy().view(np.uint64)
    own = (pdf["block"] == first).to_numpy()
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    pairs = np.array(_links(u if same else u[own], None if same else u[~own], place), np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """fps: fp, distinct. Returns a, b: links enough to join all that lie within MAX_BITS, and only such links."""
    keyed = fps.select("fp", _keys(F.col("fp")).alias("k")).select("fp", "k.place", "k.bits")
    hot = stage(keyed.groupBy("place", "bits").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot-keys")
    few = keyed.join(hot, ["place", "bits"], "left_anti") if hot.head(1) else keyed
    links = few.repartition("place", "bits").sortWithinPartitions("place", "bits").mapInPandas(_scan_sorted, "a long, b long")
    if hot.head(1):
        blocks = F.ceil(F.col("n") / block).cast("int")
        dealt = keyed.join(hot, ["place", "bits"]).withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        links = links.unionByName(dealt.groupBy("place", "bits", "i", "j").applyInPandas(_block_pair, "a long, b long"))
    return links.distinct()


def _groups(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The documents as doc_id, row, fp (row: the place in the scan); and for each fp its group's smallest doc_id and first row."""
    rows = stage(fingerprints(docs.withColumn("__row", F.monotonically_increasing_id()), shingle, ("doc_id", "__row")), "fingerprints")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    first = stage(rows.groupBy("fp").agg(lead.alias("lead")), "distinct-fingerprints")
    joined = components(fingerprint_links(first.select("fp")))
    rooted = stage(joined.join(first.withColumnRenamed("fp", "node"), "node"), "rooted")
    named = salted_join(rooted, rooted.groupBy("root").agg(F.min("lead").alias("group")), "root", hot_keys(rooted, "root")).select(F.col("node").alias("fp"), "group")
    return rows, first.join(named, "fp", "left").select("fp", F.coalesce("group", "lead").alias("group"))


def near_duplicates(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable by links, itself included."""
    rows, groups = _groups(docs, shingle)
    return salted_join(rows, groups, "fp", hot_keys(rows, "fp")).select("doc_id", "fp", F.col("group.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (of repeated rows, the first). docs must be
    read from files, so that its rows keep their places when read again."""
    _, groups = _groups(docs, shingle)
    keepers = groups.select(F.col("group.__row").alias("__row")).distinct()
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(keepers, "__row", "left_semi").select(docs.columns)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

"""Token ids as files of canonical, length-limited Huffman codes.

The files are a Parquet dataset in the shared folder, a row for each block of about BLOCK_IDS ids: the block's place
(part, number), its documents' ids and token counts, the bit offset of each CHECKPOINT-th id, and the packed bits. One
more dataset holds the code lengths by id, from which the canonical codes follow. Blocks decode on their own, and within
a block each checkpoint does, so decoding steps through all checkpoints' bits at once, one table look-up an id.

Documents are dealt by ranges of doc_id (ties by the text's hash) and sorted within; a part's first id number comes from the parts'
totals, of which there is one row a part. Counts are summed by id over all documents: as many rows as ids.

Ids fit 16 bits (the vocabulary must have at most 65,536 ids; more raise an error).

doc_id must be an integer or cast to one (else Spark raises). Null and empty texts hold the end id alone. Null ids come
first. A long text is encoded whole, in one slice of its own. Columns besides doc_id and text are not read. Repeated rows are written each. An empty table gives
empty files and no rows. If one id alone occurs, its code is one bit long.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage, text_of, text_slices, tidy

END_ID = 1
BLOCK_IDS = 1 << 18
CHECKPOINT = 256
MAX_BITS = 20
CACHE_WORDS = 1_000_000
STRING_WORDS = 1000
SLICE_BYTES = 1 << 24

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts, word by word. White space never joins tokens in this vocabulary (it is dropped), and letters are
    lower-cased by it, so each distinct lower-cased run without ASCII white space is encoded once by the library and kept in
    a table, which Arrow looks the others up in. Texts that may hold a special token's string keep their capitals."""

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(tokenizer_file)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.letters = Tokenizer(self.whole.model)  # a word of a-z is one token run, whatever normalises or splits the rest
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(1 << 16, bool)
        for name, i in self.whole.get_vocab().items():
            self.ends[i] = name.endswith("</w>")
        self.bars = np.zeros(1 << 16, bool)
        self.bars[self.whole.encode("|", add_special_tokens=False).ids] = True
        self.words, self.flat, self.at = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        special = pc.match_substring(texts, "<|")
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        cuts, words = np.asarray(split.offsets, np.int64), split.values
        place = pc.index_in(words, value_set=self.words)
        if place.null_count:
            self._learn(pc.unique(words.filter(pc.is_null(place))))
            place = pc.index_in(words, value_set=self.words)
        place = place.to_numpy()
        ids, counts = self._gather(place)
        if len(self.words) > CACHE_WORDS:
            some = np.flatnonzero(np.bincount(place, minlength=len(self.words)) > 1)
            self.words, (self.flat, kept) = self.words.take(pa.array(some)), self._gather(some)
            self.at = np.r_[0, np.cumsum(kept)]
        return ids, np.diff(np.r_[0, np.cumsum(counts)][cuts])

    def _learn(self, words: pa.Array) -> None:
        """A word's last mark, after a letter a-z, is a token run of its own; what is before it is a word itself."""
        marked = pc.match_substring_regex(words, "[a-z][.,]$")
        late, others = words.filter(marked), words.filter(pc.invert(marked))
        stems = pc.utf8_slice_codeunits(late, 0, -1)
        need = pc.unique(pa.concat_arrays([others, stems, pa.array([".", ","])]))
        need = need.filter(pc.is_null(pc.index_in(need, value_set=self.words)))
        plain = pc.match_substring_regex(need, "^[a-z]+$")
        alone = pc.or_(pc.match_substring(need, "|"), pc.equal(pc.binary_length(need), 0))
        some = need.filter(plain)
        self._add(some, *self._parted(self.letters, some, " ", self.ends))
        some = need.filter(pc.invert(pc.or_(plain, alone)))
        self._add(some, *self._parted(self.whole, some, " | ", self.bars))
        some = need.filter(alone)
        each = [self.whole.encode(w, add_special_tokens=False).ids for w in some.to_pylist()]
        self._add(some, np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64))
        if len(late):
            pair = [pc.index_in(x, value_set=self.words).to_numpy() for x in (stems, pc.utf8_slice_codeunits(late, -1))]
            ids, counts = self._gather(np.stack(pair, 1).ravel())
            self._add(late, ids, counts.reshape(-1, 2).sum(1))

    def _add(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.flat = np.concatenate([self.flat, ids])
        self.at = np.r_[self.at, self.at[-1] + np.cumsum(counts)]

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places of the table, and their numbers."""
        counts = np.diff(self.at)[place]
        ends = np.cumsum(counts)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[place] - ends + counts, counts)], counts

    @staticmethod
    def _parted(tok, words: pa.Array, between: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words that are encoded STRING_WORDS to a string. Those of a-z end where an id ends a token run;
        others, which hold no bar, are parted by bars, whose ids go."""
        cuts = np.r_[np.arange(0, len(words), STRING_WORDS), len(words)].astype(np.int32)
        strings = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), between).to_pylist() if len(words) else []
        inside = between == " "
        found = [tok.encode_batch_fast([s if inside else s + " |"], add_special_tokens=False)[0].ids for s in strings]
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        last = ends[ids]
        counts = np.diff(np.r_[-1, np.flatnonzero(last)]) - (not inside)
        return (ids if inside else ids[~last]), counts


def encode_texts(texts: pa.Array, tokenizer_file: str) -> tuple[np.ndarray, np.ndarray]:
    if tokenizer_file not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file](texts)


def code_lengths(counts: dict[int, int], most: int = MAX_BITS) -> dict[int, int]:
    """Huffman code lengths of at most `most` bits (package-merge where plain Huffman passes it)."""
    items = sorted((n, i) for i, n in counts.items() if n > 0)
    if len(items) < 2:
        return {i: 1 for _, i in items}
    if len(items) > 1 << most:
        raise ValueError("too many ids for the length limit")
    heap = [(n, k, k) for k, (n, _) in enumerate(items)]
    up, fresh = [-1] * len(items), len(items)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up.append(-1)
        up[a[2]] = up[b[2]] = fresh
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    depth = [0] * fresh
    for k in range(fresh - 2, -1, -1):
        depth[k] = depth[up[k]] + 1
    if max(depth[: len(items)]) <= most:
        return {i: depth[k] for k, (_, i) in enumerate(items)}
    leaf = np.array([n for n, _ in items], np.float64)
    merged, marks = np.zeros(0), []
    for _ in range(most):
        both = np.concatenate([leaf, merged])
        order = np.argsort(both, kind="stable")
        both = both[order]
        marks.append(order < len(leaf))
        merged = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(len(leaf), int), 2 * (len(leaf) - 1)
    for is_leaf in reversed(marks):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    return {i: int(lengths[k]) for k, (_, i) in enumerate(items)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths by id (length 0: no code): codes count up within a length, shorter ones first, ids in order."""
    size = max(lengths, default=0) + 1
    codes, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    code, last = 0, 0
    for n, i in sorted((n, i) for i, n in lengths.items()):
        code <<= n - last
        codes[i], bits[i], last = code, n, n
        code += 1
    return codes, bits


def decode_table(codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next `width` bits: the id and its length."""
    width = int(bits.max(initial=1))
    used = np.flatnonzero(bits)
    order = used[np.lexsort((codes[used], bits[used]))]  # canonical codes fill the table in this order
    spans = 1 << (width - bits[order])
    ids = np.zeros(1 << width, np.uint32)
    lens = np.ones(1 << width, np.int64)
    filled = int(spans.sum())
    ids[:filled], lens[:filled] = np.repeat(order, spans), np.repeat(bits[order], spans)
    return ids, lens, width


def pack(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of a block and the bit offsets of its checkpoints."""
    n = bits[ids]
    ends = np.cumsum(n)
    at = ends - n
    value = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    word = at >> 5
    out = np.zeros(int(ends[-1] >> 5) + 3 if len(ids) else 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), at[::CHECKPOINT].astype(np.uint32)


def unpack(data: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids of a block: all checkpoints advance together, one id a step."""
    ids, lens, width = table
    words = np.frombuffer(data, ">u4").astype(np.uint64)
    both = (words[:-1] << np.uint64(32)) | words[1:]
    at = offsets.astype(np.int64)
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    mask, shift = np.uint64((1 << width) - 1), 64 - width
    last = n - (len(at) - 1) * CHECKPOINT if len(at) else 0
    for k in range(min(CHECKPOINT, n)):
        if k == last:  # the last checkpoint has fewer ids
            at = at[:-1]
        peek = ((both[at >> 5] >> (shift - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)
        out[k, : len(at)] = ids[peek]
        at = at + lens[peek]
    return out.T.reshape(-1)[:n]


def _chunks(tokenizer_file: str, end_id: int):
    """Sorted documents to rows of about BLOCK_IDS ids: part, block, docs, sizes, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sizes, held, total, block, part = [], [], [], 0, 0, None
        end = np.array([end_id], np.uint16)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "docs": pa.array([docs], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())), "ids": pa.array([np.concatenate(held).astype("<u2").tobytes()], pa.binary()),
            })

        for batch in batches:
            texts, names = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            if part is None and len(names):
                part = batch.column(batch.schema.get_field_index("part"))[0].as_py()
            for some, lo in text_slices(texts, SLICE_BYTES):
                ids, counts = encode_texts(some, tokenizer_file)
                cuts = np.r_[0, np.cumsum(counts)].tolist()
                for k in range(len(some)):
                    docs.append(names[lo + k])
                    sizes.append(cuts[k + 1] - cuts[k] + 1)
                    held += [ids[cuts[k] : cuts[k + 1]].astype(np.uint16), end]
                    total += sizes[-1]
                    if total >= BLOCK_IDS:
                        yield out()
                        docs, sizes, held, total, block = [], [], [], 0, block + 1
        if docs:
            yield out()
        tidy()

    return run


def write_ids(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Writes the files; returns them as read back: blocks (part, block, docs, sizes, before, offsets, bits) and code lengths (id, length)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    spread = source.withColumn("tie", F.xxhash64("text"))  # rows of one id, or of none, need not go to one task
    ranged = spread.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    chunks = stage(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_chunks(tokenizer_file, end_id), "part int, block int, docs array<long>, sizes array<long>, ids binary"), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, "<u2"), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    counts = {r.id: r.n for r in chunks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    lengths = code_lengths(counts)
    code = stage(spark.createDataFrame(pd.DataFrame({"id": list(lengths), "length": list(lengths.values())}, dtype="int64"), "id long, length long"), "code-lengths")
    sent = spark.sparkContext.broadcast(canonical(lengths))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                data, offsets = pack(np.frombuffer(batch.column(4)[k].as_py(), "<u2").astype(np.int64), codes, bits)
                one = [batch.column(c).slice(k, 1) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*one, pa.array([offsets.astype(np.int64)], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["part", "block", "docs", "sizes", "offsets", "bits"])

    blocks = chunks.select("part", "block", "docs", "sizes", "ids").mapInArrow(encode, "part int, block int, docs array<long>, sizes array<long>, offsets array<long>, bits binary")
    return stage(blocks, "id-blocks"), code


def read_ids(blocks: DataFrame, code: DataFrame) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens, ids (binary, little-endian 32-bit)."""
    return _decoded(blocks, code, "ids binary", lambda x: x.tobytes(), pa.binary())


def id_digests(blocks: DataFrame, code: DataFrame) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens, ids_crc32."""
    return _decoded(blocks, code, "ids_crc32 long", zlib.crc32, pa.int64())


def _decoded(blocks: DataFrame, code: DataFrame, field: str, of, kind: pa.DataType) -> DataFrame:
    spark = blocks.sparkSession
    lengths = {r.id: r.length for r in code.collect()}  # as many as the vocabulary has ids
    sent = spark.sparkContext.broadcast(decode_table(*canonical(lengths)) if lengths else None)
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    per = blocks.select("part", "block", total.alias("n"))
    parts = per.groupBy("part").agg(F.sum("n").alias("n"))
    of_part = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.withColumn("before", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(of_part, "part").select("part", "block", (F.col("before") + F.col("part_start")).alias("start"))
    placed = blocks.join(starts, ["part", "block"]).select("start", "docs", "sizes", "offsets", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, docs, sizes, offsets, bits = (batch.column(c)[k].as_py() for c in range(5))
                sizes = np.array(sizes, np.int64)
                ids = unpack(bits, np.array(offsets, np.int64), int(sizes.sum()), sent.value).astype("<u4")
                ends = np.cumsum(sizes)
                values = [of(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, kind)], ["doc_id", "start", "n_tokens", field.split()[0]])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {field}")

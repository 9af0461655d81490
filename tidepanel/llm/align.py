"""Alignment of two tokenizers' tokens over the same bytes.

A token covers a range of bytes, so a document's tokens are a 0/1 matrix of tokens by bytes, held in compressed rows (Csr).
Overlap links are the nonzeros of A * B^T, by Gustavson's row products: for each byte of a row of A, the row of B^T at that
byte. Bytes where tokens of both sides end cut the tokens into groups; links of a shared group are the nonzeros of the
product of the two group-incidence matrices, of which the documents' rows hold the number, and shared_links() the pairs.

Documents are read in blocks of about BLOCK_BYTES. A block is a row of a written table: its documents, their links as places
in the block's list of distinct id pairs, and that list with the number of the block's documents that hold each pair. The
counts over all documents are a sum by pair, joined back to the blocks' lists; no task holds more than a block and its list.

doc_id must be an integer or cast to one (else Spark raises). Null and empty texts, and texts of which either tokenizer's
bytes are not the text's own, have no tokens: zeros and an empty groups string. A long text is a block of its own. Repeated
rows are rows each, and each counts as a document. Columns besides doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, text_slices

BLOCK_BYTES = 1 << 23
SLICE_BYTES = 1 << 21
CACHE_WORDS = 1_000_000
STRING_WORDS = 1000
SPACE_MARK = "▁"
#: Texts in which a space stands first, last or beside white space, and texts with the mark itself, are encoded whole.
IRREGULAR = r"^ | $| [\s\x{0B}\p{Z}\p{C}]|[\s\x{0B}\p{Z}\p{C}] |\x{2581}"


class Csr(NamedTuple):
    """A matrix in compressed rows: row i has the columns cols[at[i] : at[i + 1]], in order, with these values."""

    at: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int


def incidence(rows: np.ndarray, n_rows: int, width: int) -> Csr:
    """A 0/1 matrix with a one at (rows[k], k): rows in order, so a row's columns stand together."""
    at = np.searchsorted(rows, np.arange(n_rows + 1)).astype(np.int64)
    return Csr(at, np.arange(len(rows), dtype=np.int64), np.ones(len(rows), np.int64), width)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.cols, kind="stable")
    rows = np.repeat(np.arange(len(m.at) - 1), np.diff(m.at))[order]
    return Csr(np.searchsorted(m.cols[order], np.arange(m.width + 1)).astype(np.int64), rows, m.values[order], len(m.at) - 1)


def row_terms(a: Csr, b: Csr) -> np.ndarray:
    """How many terms each row of the product has before equal columns are added up: the symbolic pass."""
    each = np.diff(b.at)[a.cols]
    return np.diff(np.r_[0, np.cumsum(each)][a.at])


def product(a: Csr, b: Csr) -> Csr:
    """a * b by rows: row i is the sum over its columns k of a[i, k] times row k of b, equal columns added up."""
    each = np.diff(b.at)[a.cols]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) + np.repeat(b.at[a.cols] - ends + each, each)
    cols, values = b.cols[place], np.repeat(a.values, each) * b.values[place]
    rows = np.repeat(np.repeat(np.arange(len(a.at) - 1), np.diff(a.at)), each)
    key = rows * b.width + cols
    if total and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, values = key[order], values[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if total else np.zeros(0, np.int64)
    key = key[first]
    at = np.searchsorted(key, np.arange(len(a.at), dtype=np.int64) * b.width)
    return Csr(at, key % b.width if b.width else key, np.add.reduceat(values, first) if total else values, b.width)


class Tokens(NamedTuple):
    """The tokens of some documents, one after the other: ids, their bytes' numbers, and how many each document has."""

    ids: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray


def token_bytes(m: np.ndarray) -> Csr:
    """Tokens by bytes, from the tokens' sizes."""
    return incidence(np.repeat(np.arange(len(m)), m), len(m), int(m.sum()))


def overlaps(a: Tokens, b: Tokens) -> Csr:
    """Links: the bytes that each token of A shares with each of B."""
    return product(token_bytes(a.sizes), transposed(token_bytes(b.sizes)))


def groups_of(a: Tokens, b: Tokens) -> tuple[Csr, Csr]:
    """Groups by tokens, of A and of B."""
    ends_a, ends_b = np.cumsum(a.sizes), np.cumsum(b.sizes)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    found = []
    for ends in (ends_a, ends_b):
        found.append(incidence(np.searchsorted(common, ends), len(common), len(ends)))
    return found[0], found[1]


def shared_links(a: Tokens, b: Tokens) -> Csr:
    """Links of tokens that stand in one group: the product of the group incidences."""
    in_a, in_b = groups_of(a, b)
    return product(transposed(in_a), in_b)


class Vocabulary:
    """The bytes of a tokenizer's ids."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.flat, self.at = np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum(self.sizes)]
        self.names = np.array([str(i) for i in range(len(pieces))], object)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - ends + n, n)]


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones themselves, the others from 256 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of whole texts, and of words as they stand after one space."""

    def whole(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after the other, and how many each has: STRING_WORDS are encoded to a string, in which an id that
        begins with a space begins a word."""
        found = self.whole([" ".join(words[k : k + STRING_WORDS]) for k in range(0, len(words), STRING_WORDS)])
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):
            raise ValueError("words and ids differ")
        return ids, np.diff(np.r_[starts, len(ids)])


class ByteSide(Side):
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        letters, names = byte_letters(), {i: t for t, i in self.tok.get_vocab().items()}
        size = max(names) + 1
        self.vocab = Vocabulary([bytes(letters[c] for c in names[i]) if i in names and all(c in letters for c in names[i]) else b"" for i in range(size)])
        self.begins = np.array([names.get(i, "").startswith("Ġ") for i in range(size)])

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide(Side):
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tok.id_to_piece(i) for i in range(self.tok.get_piece_size())]
        as_bytes = [bytes([int(p[3:5], 16)]) if self.tok.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.vocab = Vocabulary(as_bytes)
        self.begins = np.array([p.startswith(SPACE_MARK) for p in pieces])

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.tok.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers. No piece of either joins what stands before a space with the space, so the words of a regular text are
    encoded once each and kept, and Arrow looks the others up."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        self.sides = (ByteSide(byte_file), PieceSide(piece_file))
        self._forget()

    def _forget(self) -> None:
        self.seen = pa.array([], pa.string())
        self.kept = [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in self.sides]

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The places of the texts in the order in which their tokens are given; for each side all ids, and each text's number."""
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        order = np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)]
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        cuts, words = np.asarray(split.offsets, np.int64), split.values
        if len(self.seen) > CACHE_WORDS:
            self._forget()
        place = pc.index_in(words, value_set=self.seen)
        if place.null_count:
            new = pc.unique(words.filter(pc.is_null(place)))
            self.seen = pa.concat_arrays([self.seen, new])
            for k, side in enumerate(self.sides):
                ids, counts = side.words(new.to_pylist())
                flat, at = self.kept[k]
                self.kept[k] = (np.concatenate([flat, ids]), np.r_[at, at[-1] + np.cumsum(counts)])
            place = pc.index_in(words, value_set=self.seen)
        place, rest, found = place.to_numpy(), texts.filter(pa.array(odd)).to_pylist(), []
        for side, (flat, at) in zip(self.sides, self.kept, strict=True):
            n = np.diff(at)[place]
            ends = np.cumsum(n)
            ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[place] - ends + n, n)]
            each = side.whole(rest) if rest else []
            counts = np.r_[np.diff(np.r_[0, ends][cuts]), np.array([len(x) for x in each], np.int64)]
            found.append((np.concatenate([ids, np.fromiter(chain.from_iterable(each), np.int32)]), counts))
        return order, found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, Tokens, Tokens]:
        """The places of the texts that have tokens, and their tokens of both sides."""
        order, found = self.tokens(texts)
        want = pc.binary_length(texts).to_numpy(zero_copy_only=False)[order].astype(np.int64) + 1
        data = pc.binary_join_element_wise("", texts.take(pa.array(order)), " ").cast(pa.binary())  # a space before each text
        own = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        good = np.ones(len(order), bool)
        sized = []
        for side, (ids, counts) in zip(self.sides, found, strict=True):
            sizes, cut = side.vocab.sizes[ids], np.r_[0, np.cumsum(counts)]
            sized.append(sizes)
            good &= np.diff(np.r_[0, np.cumsum(sizes)][cut]) == want
        for side, sizes, (ids, counts) in zip(self.sides, sized, found, strict=True):
            held = side.vocab.bytes_of(ids[np.repeat(good, counts)])
            mine = own[np.repeat(good, want)]
            wrong = np.r_[0, np.cumsum(held != mine)]
            which = np.flatnonzero(good)
            ends = np.cumsum(want[which])
            good[which[wrong[ends] != wrong[ends - want[which]]]] = False
        out = [Tokens(ids[keep].astype(np.int64), sizes[keep], counts[good]) for (ids, counts), sizes in zip(found, sized, strict=True) for keep in (np.repeat(good, counts),)]
        return order[good], out[0], out[1]


def group_strings(a: Tokens, b: Tokens, in_a: Csr, in_b: Csr, names: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Each document's groups: ids of A by commas, a bar, ids of B by commas; groups by semicolons."""
    na, nb = np.diff(in_a.at), np.diff(in_b.at)
    before_a = np.repeat(in_b.at[:-1], na)  # tokens of the other side that stand before
    before_b = np.repeat(in_a.at[1:], nb)
    merged = np.empty(2 * (len(a.ids) + len(b.ids)), object)
    place_a, place_b = 2 * (np.arange(len(a.ids)) + before_a), 2 * (np.arange(len(b.ids)) + before_b)
    merged[place_a], merged[place_b] = names[0][a.ids], names[1][b.ids]
    merged[place_a + 1], merged[place_b + 1] = ",", ","
    merged[place_a[in_a.at[1:] - 1] + 1], merged[place_b[in_b.at[1:] - 1] + 1] = "|", ";"
    cuts = np.r_[0, 2 * np.cumsum(a.counts + b.counts)].tolist()
    parts = merged.tolist()
    return ["".join(parts[lo : hi - 1]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(files: tuple[str, str]) -> Pair:
    if files not in _pairs:
        _pairs.clear()
        _pairs[files] = Pair(*files)
    return _pairs[files]


BLOCK = "block long, docs array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_shared array<long>, groups array<string>, at binary, places binary, times binary, pairs array<long>, held array<long>"


def _blocks(files: tuple[str, str], whole_groups: bool):
    """Documents (doc_id, text) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, number = _pair(files), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            docs, counts = list(chain.from_iterable(h[0] for h in held)), np.concatenate([h[1] for h in held], 1)
            ids = np.concatenate([h[3] for h in held])
            pairs, local = np.unique(ids, return_inverse=True)
            owner = np.repeat(np.arange(len(docs)), counts[3])
            key, times = np.unique(owner * max(1, len(pairs)) + local, return_counts=True)
            owner, place = np.divmod(key, max(1, len(pairs)))
            at = np.searchsorted(owner, np.arange(len(docs) + 1))
            lists = [pa.array([x], pa.list_(pa.int64())) for x in counts]
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), *lists, pa.array([list(chain.from_iterable(h[2] for h in held))], pa.list_(pa.string()))]
                + [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (at, place, times)]
                + [pa.array([x], pa.list_(pa.int64())) for x in (pairs, np.bincount(place, minlength=len(pairs)))],
                [c.split()[0] for c in BLOCK.split(", ")],
            )

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for some, lo in text_slices(texts, SLICE_BYTES):
                held.append((names[lo : lo + len(some)], *_slice(both, some, whole_groups)))
                size += int(pc.sum(pc.binary_length(some)).as_py()) + 64 * len(some)
                if size >= BLOCK_BYTES:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    return run


def _slice(both: Pair, texts: pa.Array, whole_groups: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each text n_a, n_b, n_groups, n_links, n_shared; its groups (or their digest); all links' id pairs."""
    counts, groups = np.zeros((5, len(texts)), np.int64), [""] * len(texts)
    some = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    if not len(some):
        return counts, groups, np.zeros(0, np.int64)
    which, a, b = both(texts.take(pa.array(some)))
    which = some[which]
    links, (in_a, in_b) = overlaps(a, b), groups_of(a, b)
    cut_a = np.r_[0, np.cumsum(a.counts)]
    of_group = np.diff(in_a.at)
    first = np.searchsorted(in_a.at[:-1], cut_a)  # a document's tokens begin a group
    shared = np.r_[0, np.cumsum(of_group * np.diff(in_b.at))]
    counts[:, which] = a.counts, b.counts, np.diff(first), np.diff(links.at[cut_a]), np.diff(shared[first])
    strings = group_strings(a, b, in_a, in_b, (both.sides[0].vocab.names, both.sides[1].vocab.names))
    for k, s in zip(which.tolist(), strings, strict=True):
        groups[k] = s if whole_groups else hashlib.sha256(s.encode()).hexdigest()
    pairs = (np.repeat(a.ids, np.diff(links.at)) << 32) | b.ids[links.cols]
    order = np.zeros(len(texts), np.int64)
    order[which] = np.arange(len(which))
    sizes = counts[3]
    start = np.r_[0, np.cumsum(counts[3][which])][order]  # links of the texts in their own order
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) + np.repeat(start - ends + sizes, sizes)
    return counts, groups, pairs[place]


def write_blocks(docs: DataFrame, byte_file: str, piece_file: str, whole_groups: bool = False) -> DataFrame:
    """Writes the blocks and reads them back. groups holds the strings themselves, or their sha256."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return stage(source.mapInArrow(_blocks((byte_file, piece_file), whole_groups), BLOCK), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, count: how many documents hold the id pair linked."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held")
    total = each.groupBy("pairs").agg(F.sum("held").alias("count"))
    return total.select(F.shiftright("pairs", 32).alias("a"), F.col("pairs").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "count")


def align(docs: DataFrame, byte_file: str, piece_file: str, whole_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (strings or sha256), n_shared (links of shared groups)."""
    blocks = write_blocks(docs, byte_file, piece_file, whole_groups)
    counts = pair_counts(blocks)
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    judged = counts.join(best, "a").select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("pairs"), "count", (F.col("count") == F.col("most")).alias("best"))
    listed = blocks.select("block", F.posexplode("pairs").alias("place", "pairs"))
    known = listed.join(judged, "pairs").select("block", "place", "count", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("place").to_numpy())
        count, best_of = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order].astype(np.int64)
        out = []
        for row in left.to_batches():
            for k in range(row.num_rows):
                at, place, times = (np.frombuffer(row.column(c)[k].as_py(), "<u4").astype(np.int64) for c in ("at", "places", "times"))
                sums = [np.diff(np.r_[0, np.cumsum(times * x[place])][at]) for x in (best_of, count)]
                lists = {c: row.column(c)[k].values for c in ("docs", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups")}
                out.append(pa.table({"doc_id": lists["docs"], **{c: lists[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": sums[0], "count_sum": sums[1], "groups": lists["groups"], "n_shared": lists["n_shared"]}))
        return pa.concat_tables(out)

    of_docs = blocks.withColumnRenamed("block", "own_block").drop("pairs", "held")
    return of_docs.groupBy("own_block").cogroup(known.groupBy("block")).applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, n_shared long")

"""Exact ranked search of many items over all documents by two hierarchies.

A document is a sparse vector of one weight a term; an item's score of it is the sum over the item's terms. Documents are read
in blocks of about BLOCK_BYTES, each a row of a written table (its terms, and its documents' counts by place in that list). Rows are
that small, and the table's row groups are of about ROW_GROUP bytes, so what a task holds at once does not grow with its share of the table.
Items are dealt to groups of about GROUP_ITEMS by a hash of their rows, with their terms' weights, which come from sums over all
blocks. A group of items meets every slice of blocks, a block's payload once a group: the stated items against all documents.

Within a slice both sides are trees, those of documents over TREE_BLOCKS blocks each. A node holds, for each term, the largest weight
below it; the sum over terms of the products of two nodes' maxima is at least any score below the pair, so the pair is dropped when that lies below the weakest kth score of
its items. The kth scores that a first share of the slices gives are known to all the others, and nothing that reaches them is dropped, so
the result is exact. A slice gives k rows an item at most, and past the first share only rows that reach the item's kth score.

Weights and scores are 64-bit integers; sums are taken in doubles where all of them stay below 2^53, so that they are exact.

doc_id must be an integer or cast to one (else Spark raises). Null texts have no terms and are never found, and items without
terms find nothing. Null doc_ids come last among equal scores. A long text is one document of a block of its own. Repeated documents
are found each; repeated items, and items of one id, have their own lists each. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stage, text_of, text_slices, tidy

K = 50
BLOCK_BYTES = 1 << 18
ROW_GROUP = 1 << 24
SLICE_BLOCKS, SLICE_TERMS = 64, 1 << 22
TREE_BLOCKS = 16
GROUP_ITEMS = 1024
LEAF_DOCS, LEAF_ITEMS, FAN = 32, 16, 8
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LAST = np.iinfo(np.int64).max
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SPACED = bytes(_SPACED[c] + (32 if 65 <= c <= 90 else 0) for c in range(256))

BLOCK = "block long, terms array<string>, held array<int>, n_docs long, n_terms long, docs array<long>, sizes array<long>, at binary, places binary, times binary"


def terms_of(text: str = "text") -> Column:
    """All terms of a text column, in order."""
    return F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(TERM), F.lit(0))


def counted(docs: list, texts: list[bytes], number: int) -> pa.RecordBatch:
    """A block: documents without terms are left out."""
    split = [t.translate(_SPACED).split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    words = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
    place, terms = words.indices.to_numpy().astype(np.int64), words.dictionary.cast(pa.string())
    some = np.flatnonzero(sizes)
    owner = np.repeat(np.arange(len(some)), sizes[some])
    key, times = np.unique(owner * max(1, len(terms)) + place, return_counts=True)
    owner, place = np.divmod(key, max(1, len(terms)))
    at = np.searchsorted(owner, np.arange(len(some) + 1))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([terms.to_pylist()], pa.list_(pa.string())), pa.array([np.bincount(place, minlength=len(terms))], pa.list_(pa.int32())), pa.array([len(some)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())]
        + [pa.array([[docs[k] for k in some.tolist()]], pa.list_(pa.int64())), pa.array([sizes[some]], pa.list_(pa.int64()))]
        + [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (at, place, times)],
        [c.split()[0] for c in BLOCK.split(", ")],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, docs, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        names, column = batch.column(0).to_pylist(), batch.column(1)
        for some, lo in text_slices(column, BLOCK_BYTES // 4):
            docs += names[lo : lo + len(some)]
            texts += some.cast(pa.binary()).to_pylist()
            size += int(pc.sum(pc.binary_length(some)).as_py()) + 64 * len(some)
            if size >= BLOCK_BYTES:
                yield counted(docs, texts, number)
                number, docs, texts, size = number + 1, [], [], 0
    if docs:
        yield counted(docs, texts, number)
    tidy()


def write_blocks(docs: DataFrame) -> DataFrame:
    """Writes the blocks and reads them back."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # by default the writer looks at sizes only after 100 rows
    sizes = {"parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    return stage(source.mapInArrow(_blocks, BLOCK).where("n_docs > 0"), "term-blocks", **sizes)


def weighted_items(items: DataFrame, blocks: DataFrame, n_docs: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item, item_id, terms, weights: for each row of items its distinct terms that some document holds, and their weights."""
    terms = F.array_distinct(terms_of(text))
    listed = stage(items.select(F.expr("uuid()").alias("item"), F.col(item_id).alias("item_id"), terms.alias("terms")), "items")
    each = listed.select("item", "item_id", F.explode("terms").alias("term"))
    held = blocks.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.held").alias("held"))
    df = held.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    return each.join(df, "term").select("item", "item_id", "term", weight.alias("weight"))


class Docs:
    """A slice's documents over the items' terms: weights in compressed rows, similar documents side by side, and the nodes."""

    def __init__(self, doc_ids: np.ndarray, at: np.ndarray, cols: np.ndarray, values: np.ndarray, term_weight: np.ndarray) -> None:
        part = term_weight[cols] * values.astype(np.float64)
        filled = np.flatnonzero(np.diff(at))  # documents without any of the terms score nothing
        order = filled
        if len(filled):
            strongest = np.maximum.reduceat(part, at[filled])
            is_top = part == np.repeat(strongest, np.diff(at)[filled])
            row = np.repeat(np.arange(len(filled)), np.diff(at)[filled])[is_top]
            first = np.searchsorted(row, np.arange(len(filled)))
            order = filled[np.lexsort((-strongest, cols[is_top][first]))]
        n = np.diff(at)[order]
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[order] - ends + n, n)
        self.ids, self.at, self.cols, self.values = doc_ids[order], np.r_[0, ends], cols[place], values[place]
        self.levels = [self._maxima(np.arange(0, len(order), LEAF_DOCS))]  # leaves, then their parents, up to a root
        while len(self.levels[-1][0]) > 2:
            at_rows, c, v = self.levels[-1]
            self.levels.append(self._up(at_rows, c, v))

    def _maxima(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = np.repeat(np.arange(len(self.ids)) // LEAF_DOCS, np.diff(self.at))
        return _largest(node, self.cols, self.values, len(starts))

    @staticmethod
    def _up(at: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(at) - 1
        return _largest(np.repeat(np.arange(n) // FAN, np.diff(at)), cols, values, -(-n // FAN))


def _largest(node: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's largest value by column, in compressed rows."""
    order = np.lexsort((cols, node))
    node, cols, values = node[order], cols[order], values[order]
    first = np.flatnonzero(np.r_[True, (np.diff(node) != 0) | (np.diff(cols) != 0)]) if len(node) else np.zeros(0, np.int64)
    return np.searchsorted(node[first], np.arange(n + 1)), cols[first], np.maximum.reduceat(values, first) if len(first) else values


def dense(rows: tuple[np.ndarray, np.ndarray, np.ndarray], which: np.ndarray, place: np.ndarray, width: int, kind: type) -> np.ndarray:
    """Some rows as a full matrix over the terms that have a place."""
    at, cols, values = rows
    n = np.diff(at)[which]
    ends = np.cumsum(n)
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[which] - ends + n, n)
    row, col = np.repeat(np.arange(len(which)), n), place[cols[take]]
    out = np.zeros((len(which), width), kind)
    out[row[col >= 0], col[col >= 0]] = values[take][col >= 0]
    return out


class Items:
    """A group of items: weights by term, leaves of similar items, and each node's largest weights."""

    def __init__(self, items: list[np.ndarray], weights: list[np.ndarray], n_terms: int) -> None:
        strongest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in zip(items, weights, strict=True)]
        order = np.array(sorted(range(len(items)), key=lambda k: (strongest[k], k)), np.int64)
        self.n_terms, self.nodes = n_terms, {}
        self.leaves = [order[lo : lo + LEAF_ITEMS] for lo in range(0, len(order), LEAF_ITEMS)]
        self.items, self.weights = items, weights
        self.kth = np.ones(len(items), np.int64)  # a score that counts is 1 at least
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2 for _ in items]

    def node(self, leaves: list[np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A node's items, its terms, and the weights: terms by items for a leaf, the largest of each term above."""
        which = np.concatenate(leaves)
        key = (int(which[0]), len(leaves))
        if key not in self.nodes:
            held, weights = np.concatenate([self.items[k] for k in which]), np.concatenate([self.weights[k] for k in which])
            terms, place = np.unique(held, return_inverse=True)
            if len(leaves) == 1:
                out = np.zeros((len(terms), len(which)), kind)
                out[place, np.repeat(np.arange(len(which)), [len(self.items[k]) for k in which])] = weights
            else:
                out = np.zeros((len(terms), 1), kind)
                np.maximum.at(out[:, 0], place, weights.astype(kind))
            self.nodes[key] = (which, terms, out)
        return self.nodes[key]

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        """Keeps the k best of an item's held and new documents, equal scores by id."""
        s, d = (np.concatenate([a, b]) for a, b in zip(self.best[item], (scores, ids), strict=True))
        order = np.lexsort((d, -s))[:k]
        self.best[item] = (s[order], d[order])
        if len(order) == k:
            self.kth[item] = max(self.kth[item], int(s[order[-1]]))


def search(items: Items, docs: Docs, k: int, kind: type) -> int:
    """Offers the items all documents of a slice that may be among their k best; how many documents were scored."""
    place, scored = np.full(items.n_terms, -1), 0

    def descend(nodes: list[np.ndarray], live: np.ndarray, level: int) -> None:
        """A node of items (its leaves) against the live nodes of a level of documents."""
        nonlocal scored
        which, terms, weights = items.node(nodes, kind)
        place[terms] = np.arange(len(terms))
        alone = len(nodes) == 1
        bounds = dense(docs.levels[level], live, place, len(terms), kind) @ weights
        weakest = items.kth[which] if alone else items.kth[which].min()
        good = (bounds >= weakest).any(1)
        live, bound = live[good], bounds[good]
        if alone and level == 0:
            order = np.argsort(-bound.max(1), kind="stable")
            for lo in range(0, len(order), FAN):  # the most promising leaves first: they raise the kth scores for the others
                some = order[lo : lo + FAN]
                some = some[(bound[some] >= items.kth[which]).any(1)]
                if len(some):
                    rows = (live[some][:, None] * LEAF_DOCS + np.arange(LEAF_DOCS)).ravel()
                    rows = rows[rows < len(docs.ids)]
                    scores = dense((docs.at, docs.cols, docs.values), rows, place, len(terms), kind) @ weights
                    scored += len(rows)
                    for j, item in enumerate(which.tolist()):
                        high = np.flatnonzero(scores[:, j] >= items.kth[item])
                        if len(high):
                            items.offer(item, scores[high, j].astype(np.int64), docs.ids[rows[high]], k)
        place[terms] = -1
        if not len(live) or (alone and level == 0):
            return
        if level:  # the documents' side opens first, then the items'
            below = len(docs.levels[level - 1][0]) - 1
            live = (live[:, None] * FAN + np.arange(FAN)).ravel()
            live, level = live[live < below], level - 1
        step = -(-len(nodes) // FAN)
        for lo in range(0, len(nodes), step):
            descend(nodes[lo : lo + step], live, level)

    if len(docs.ids) and items.leaves:
        top = len(docs.levels) - 1
        descend(items.leaves, np.arange(len(docs.levels[top][0]) - 1), top)
    return scored


def document_weights(times: np.ndarray, sizes: list[int], counts: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's weight in a document: (1000000000 tf) div (1000 tf + 20 m), m = 100 - 50 + ((50 n N) div L)."""
    m = np.array([50 + 50 * n * n_docs // n_terms for n in sizes], np.int64)
    return (1_000_000_000 * times) // (1000 * times + 20 * np.repeat(m, counts))


def _over_items(held: list[tuple[pa.RecordBatch, int]], vocab: pa.Array, n_docs: int, n_terms: int) -> tuple[np.ndarray, ...]:
    """Blocks' doc_ids, and their weights of the items' terms in compressed rows."""
    ids, counts, cols, values = [], [], [], []
    for batch, row in held:
        here = pc.fill_null(pc.index_in(batch.column("terms")[row].values, value_set=vocab), -1).to_numpy().astype(np.int64)
        at, place, times = (np.frombuffer(batch.column(c)[row].as_py(), "<u4").astype(np.int64) for c in ("at", "places", "times"))
        col = here[place]
        keep = col >= 0
        ids.append(pc.fill_null(batch.column("docs")[row].values, LAST).to_numpy())
        counts.append(np.diff(np.r_[0, np.cumsum(keep)][at]))
        cols.append(col[keep])
        values.append(document_weights(times, batch.column("sizes")[row].as_py(), np.diff(at), n_docs, n_terms)[keep])
    return np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(counts))], np.concatenate(cols), np.concatenate(values)


def _search_slice(k: int, n_docs: int, n_terms: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        vocab = pc.unique(pa.chunked_array([pa.array([t for r in rows for t in r["terms"]], pa.string())]))
        places = pc.index_in(pa.array([t for r in rows for t in r["terms"]], pa.string()), value_set=vocab).to_numpy().astype(np.int64)
        cuts = np.cumsum([0, *[len(r["terms"]) for r in rows]])
        items = Items([places[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], [np.array(r["weights"], np.int64) for r in rows], len(vocab))
        for j, r in enumerate(rows):
            items.kth[j] = max(1, r["kth"])
        most = max([int(w.sum()) for w in items.weights], default=0) * 1_000_000  # a weight in a document is below a million
        kind = np.float64 if most < 1 << 53 else np.int64
        heaviest = np.zeros(len(vocab), np.int64)
        np.maximum.at(heaviest, places, np.concatenate(items.weights) if rows else places)
        held = [(batch, row) for batch in left.to_batches() for row in range(batch.num_rows)]
        for lo in range(0, len(held), TREE_BLOCKS):
            search(items, Docs(*_over_items(held[lo : lo + TREE_BLOCKS], vocab, n_docs, n_terms), heaviest), k, kind)
        tidy()
        found = [(r["item"], r["item_id"], d, s) for j, r in enumerate(rows) for s, d in zip(items.best[j][0].tolist(), items.best[j][1].tolist(), strict=True)]
        item, name, doc, score = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({"item": pa.array(item, pa.string()), "item_id": pa.array(name, right.schema.field("item_id").type), "doc": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of a score above 0."""
    spark, blocks = docs.sparkSession, write_blocks(docs)
    n_docs, n_terms, n_blocks, top = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count(F.lit(1)), F.max("block")).first()
    fields = f"item string, item_id {items.schema[item_id].dataType.simpleString()}, doc long, score long"
    if not n_docs:
        return spark.createDataFrame([], fields).select("item_id", F.lit(0).alias("rank"), F.col("doc").alias("doc_id"), "score")
    n_slices = max(-(-n_blocks // SLICE_BLOCKS), n_terms // SLICE_TERMS)  # by terms where long texts make long blocks
    weighted = weighted_items(items, blocks, n_docs, item_id, text)
    listed = weighted.groupBy("item").agg(F.first("item_id").alias("item_id"), F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    listed = stage(listed, "weighted-items")
    n_groups = -(-listed.count() // GROUP_ITEMS) or 1
    group = F.pmod(F.xxhash64("item"), F.lit(n_groups)).cast("int")
    of_slice = F.pmod(F.xxhash64("block"), F.lit(n_slices)).cast("int")
    first = max(1, int(n_slices**0.5))  # the slices whose kth scores the others start from
    every = blocks.select(of_slice.alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"), "terms", "docs", "sizes", "at", "places", "times")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc")

    def searched(some: DataFrame, known: DataFrame, slices: Column) -> DataFrame:
        sent = known.select(group.alias("its_group"), F.explode(slices).alias("its_slice"), "item", "item_id", "terms", "weights", "kth")
        met = some.groupBy("group", "slice").cogroup(sent.groupBy("its_group", "its_slice"))
        return met.applyInArrow(_search_slice(k, n_docs, n_terms), fields)

    none = listed.withColumn("kth", F.lit(1).cast("long"))
    found = stage(searched(every.where(F.col("slice") < first), none, F.sequence(F.lit(0), F.lit(first - 1))), "first-found")
    if n_slices > first:
        kth = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("item", F.col("score").alias("kth"))
        known = listed.join(kth, "item", "left").withColumn("kth", F.coalesce("kth", F.lit(1)))
        rest = searched(every.where(F.col("slice") >= first), known, F.sequence(F.lit(first), F.lit(n_slices - 1)))
        found = found.unionByName(stage(rest, "then-found"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.when(F.col("doc") != int(LAST), F.col("doc")).alias("doc_id"), "score")

"""Language-model scores from a subword lattice: the probability of a text is summed over all its segmentations.

The pieces are those of an existing public vocabulary. As that file gives merge ranks, not probabilities, each piece's
unigram score starts as its add-one share among the distinct training words as the vocabulary's own library cuts them, and
EM_ROUNDS of expectation-maximisation over the lattices of all distinct training words follow: what pieces have to explain is
words not seen before, and those are like distinct words, not like tokens. A word's arcs are the pieces that fit it (bytes,
where no piece holds a letter) and, if the word was seen in training, one arc over the whole word with the word's discounted
share; the pieces share what the discount leaves. A forward recursion in log space over the lattice gives the word's marginal.
A text's pieces never cross words.

Texts come in kinds (by default their languages; the commonest KINDS - 1 in training, the others are one more). A kind's words
have their discounted shares within it, and what that discount leaves is shared as over all kinds. A document's probability
is the sum over kinds of the kind's share times the product of the words' and the end's probabilities, so the kind of the scored
document is not looked at. Words, pieces, ends and kinds add up to one: the model is proper over all texts.

Whole-word arcs and the plain add-one base need every word's count. Words counted over all documents form a written
table; the commonest, at most FREQUENT of them by a count found from a histogram, are broadcast, and each document's other
words are joined. No joined word has more occurrences than the least common of those. Documents are numbered once, in a
written table.

Null and empty texts have one token, the end. A null id counts as the id of empty text. Repeated rows are scored each and
count each. Very long texts are one row of sums and their rare distinct words; words longer than BATCH_CHARS take a lattice of
their own. Without training rows (N = 0) base and score use one token's room: log10(1/(V+1)) a token with V = 0, the pieces'
even shares, and one half for a word and for the end. A null kind is a kind. Extra columns are not read. An empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, stage, text_of, text_slices

FREQUENT = 200_000
DISCOUNT = 0.75
EM_ROUNDS = 2
KINDS = 8
BATCH_CHARS = 64
BATCH_WORDS = 20_000
START = "▁"  # the vocabulary's mark of a word's start
LN10 = math.log(10)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words, and the number of the text of each."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    real = pc.not_equal(split.values, "")  # white space at a text's end splits off an empty word
    return split.values.filter(real), text[real.to_numpy(zero_copy_only=False)]


def count_words(docs: DataFrame, kinds: int) -> DataFrame:
    """docs: text, kind (int; null: held out). word, counts: occurrences in training documents by kind, all 0 for words of
    held-out ones alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, lo in text_slices(batch.column(0)):
                words, text = _words(texts)
                kind = pc.fill_null(batch.column(1).slice(lo, len(texts)), -1).to_numpy()[text]
                found = pa.table({"word": words, "kind": pa.array(kind, pa.int32())}).group_by(["word", "kind"]).aggregate([([], "count_all")])
                for part in found.select(["word", "kind", "count_all"]).to_batches():
                    yield pa.RecordBatch.from_arrays(part.columns, ["word", "kind", "n"])

    rows = docs.select("text", "kind").mapInArrow(run, "word string, kind int, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in range(kinds)]
    return rows.groupBy("word").agg(F.array(*sums).alias("counts")) if kinds else rows.select("word").distinct().select("word", F.array().cast("array<long>").alias("counts"))


class Lattice:
    """Log marginals of words over their segmentations into pieces, and expected counts of the pieces."""

    def __init__(self, model_file: str, scores: np.ndarray | None = None) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = set(self.bytes.values()) | {0, 1, 2}
        self.known = {p: i for i, p in enumerate(names) if i not in special and p and START not in p[1:]}
        self.longest = max(map(len, self.known))
        hashes = np.array([self._hash(p) for p in self.known], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(self.known.values()))[order]
        self.scores = np.full(n, -math.log(n)) if scores is None else scores

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for x in piece:
            h = (h * 0x9E3779B97F4A7C15 + ord(x) + 1) % (1 << 64)
        return h

    def __call__(self, words: list[str], counts: np.ndarray | None = None) -> np.ndarray:
        """The words' logs. With counts, each piece's expected number in all words is added to them."""
        out = np.zeros(len(words))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        for n, all_of in by_length.items():
            if n > BATCH_CHARS:
                for k in all_of:
                    out[k] = self._alone(START + words[k], counts)
                continue
            for at in range(0, len(all_of), BATCH_WORDS):
                some = all_of[at : at + BATCH_WORDS]
                letters = np.frombuffer("".join(START + words[k] for k in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                out[some] = self._together(letters, counts)
        return out

    def _byte_score(self, letter: str) -> float:
        return sum(self.scores[self.bytes[b]] for b in letter.encode("utf-8", "replace"))

    def _arcs(self, letters: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By first letter and end: the words that have a piece there, the pieces (-1: bytes) and their scores."""
        n, m = letters.shape
        code = letters.astype(np.uint64) + np.uint64(1)
        out = {}
        for first in range(m):
            h = np.zeros(n, np.uint64)
            for end in range(first, min(m, first + self.longest)):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[:, end]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                has = self.hashes[at] == h
                some = np.flatnonzero(has)
                ids = self.ids[at[some]]
                score = self.scores[ids]
                if end == first and len(some) < n:
                    missing = np.flatnonzero(~has)
                    kinds, which = np.unique(letters[missing, first], return_inverse=True)
                    some, ids = np.r_[some, missing], np.r_[ids, np.full(len(missing), -1)]
                    score = np.r_[score, np.array([self._byte_score(chr(x)) for x in kinds.tolist()])[which]]
                if len(some):
                    out[first, end + 1] = some, ids, score
        return out

    def _together(self, letters: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        """Words of one length: the recursions step through the letters of all of them at once."""
        n, m = letters.shape
        arcs = self._arcs(letters)
        forward = np.full((m + 1, n), -np.inf)
        forward[0] = 0
        for end in range(1, m + 1):
            for first in range(max(0, end - self.longest), end):
                if (first, end) in arcs:
                    some, _, score = arcs[first, end]
                    forward[end][some] = np.logaddexp(forward[end][some], forward[first][some] + score)
        if counts is not None:
            back = np.full((m + 1, n), -np.inf)
            back[m] = 0
            for first in range(m - 1, -1, -1):
                for end in range(first + 1, min(m, first + self.longest) + 1):
                    if (first, end) in arcs:
                        some, _, score = arcs[first, end]
                        back[first][some] = np.logaddexp(back[first][some], back[end][some] + score)
            for (first, end), (some, ids, score) in arcs.items():
                p = np.exp(forward[first][some] + score + back[end][some] - forward[m][some])
                known = ids >= 0
                counts += np.bincount(ids[known], p[known], len(counts))
                self._count_bytes(letters[some[~known], first], p[~known], counts)
        return forward[m]

    def _count_bytes(self, letters: np.ndarray, p: np.ndarray, counts: np.ndarray) -> None:
        kinds, which = np.unique(letters, return_inverse=True)
        for x, total in zip(kinds.tolist(), np.bincount(which, p, len(kinds)).tolist(), strict=True):
            for b in chr(x).encode("utf-8", "replace"):
                counts[self.bytes[b]] += total

    def _alone(self, text: str, counts: np.ndarray | None) -> float:
        """One word of any length, arc by arc."""
        n = len(text)
        arcs: list[tuple[int, int, int, float]] = []  # in order of their first letter
        for first in range(n):
            for end in range(first + 1, min(n, first + self.longest) + 1):
                i = self.known.get(text[first:end], -1)
                if i >= 0 or end == first + 1:
                    arcs.append((first, end, i, float(self.scores[i]) if i >= 0 else self._byte_score(text[first])))
        forward = [0.0] + [-math.inf] * n
        for first, end, _, score in arcs:
            forward[end] = _plus(forward[end], forward[first] + score)
        if counts is not None:
            back = [-math.inf] * n + [0.0]
            for first, end, _, score in reversed(arcs):
                back[first] = _plus(back[first], back[end] + score)
            for first, end, i, score in arcs:
                p = math.exp(forward[first] + score + back[end] - forward[n])
                for k in [i] if i >= 0 else [self.bytes[b] for b in text[first].encode("utf-8", "replace")]:
                    counts[k] += p
        return forward[n]


def _plus(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))


def piece_scores(words: DataFrame, model_file: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log shares of the pieces. words: word, all distinct training words. As many rows as pieces at most come to the driver."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(sp.get_piece_size())
        for batch in batches:
            ids = sp.encode(batch.column(0).to_pylist(), num_threads=1)
            total += np.bincount(np.fromiter(chain.from_iterable(ids), np.int64), minlength=len(total))
        yield rows(total)

    def expected(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(model_file, sent.value)
            total = np.zeros(len(sent.value))
            for batch in batches:
                lattice(batch.column(0).to_pylist(), total)
            yield rows(total)

        return run

    def rows(total: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(total)
        return pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.float64())})

    scores = None
    for turn in range(rounds + 1):
        run = expected(words.sparkSession.sparkContext.broadcast(scores)) if turn else cut
        found = words.select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(len(Lattice(model_file).scores) if scores is None else len(scores), 1.0 if turn == 0 else 0.01)
        counts[found["piece"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
        scores = np.log(counts / counts.sum())
    return scores


def _shares(counts: np.ndarray, logs: np.ndarray, totals: np.ndarray, kinds_of_words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log probability of each word (row) by kind (column): its discounted share in the kind, and what that leaves shared as over
    all kinds, where what the discount leaves is shared by the pieces. counts: by word and kind; logs: of the pieces."""
    c, n = counts.sum(1), totals.sum()
    everywhere = np.maximum(c - DISCOUNT, 0) / n + DISCOUNT * kinds_of_words[-1] / n * np.exp(logs)
    with np.errstate(divide="ignore"):  # a word whose logs are below all doubles keeps them
        low = np.where(everywhere > 0, np.log(everywhere), math.log(DISCOUNT * kinds_of_words[-1] / n) + logs)
    all_of = totals + ends
    left = DISCOUNT * kinds_of_words[:-1] / all_of
    own = np.maximum(counts - DISCOUNT, 0) / all_of
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(own), np.log(left) + low[:, None])


def word_scores(words: DataFrame, model_file: str, scores: np.ndarray, totals: np.ndarray, kinds_of_words: np.ndarray, ends: np.ndarray) -> DataFrame:
    """word, c (all training occurrences), logs (natural log of its probability by kind)."""
    sent = words.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_file, sent.value)
        for batch in batches:
            counts = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            logs = lattice(batch.column(0).to_pylist())
            by_kind = _shares(counts, logs, totals, kinds_of_words, ends) if len(totals) else (logs + math.log(0.5))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.sum(1), pa.int64()), _lists(by_kind)], ["word", "c", "logs"])

    return words.select("word", "counts").mapInArrow(run, "word string, c long, logs array<double>")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.float64()))


def _frequent_cut(words: DataFrame, most: int) -> int:
    """The least count such that at most `most` words have it or more."""
    rows = words.where("c > 0").groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("bin")).collect()
    seen, cut = 0, 1 << 62
    for r in rows:
        seen += r.n
        if seen > most:
            break
        cut = r.c
    return cut


def _known_sums(sent, known_end: int):
    """A row for each document: tokens, known ones, the sums of its common words, and its other words."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, base, logs = sent.value
        for batch in batches:
            for texts, lo in text_slices(batch.column(2)):
                words, text = _words(texts)
                n = len(texts)
                place = pc.index_in(words, value_set=often)
                rare = pc.is_null(place).to_numpy(zero_copy_only=False)
                at, owner = pc.drop_null(place).to_numpy(), text[~rare]
                sums = np.stack([np.bincount(owner, logs[at, k], n) for k in range(logs.shape[1])], 1)
                table = pa.table({"text": pa.array(text[rare]), "word": words.filter(pa.array(rare))}).group_by(["text", "word"]).aggregate([([], "count_all")]).sort_by("text").combine_chunks()
                cuts = np.searchsorted(table["text"].to_numpy(), np.arange(n + 1)).astype(np.int32)
                one = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table["word"], table["count_all"])]
                others = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(one, fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(np.bincount(text, minlength=n) + 1, pa.int64()), pa.array(np.bincount(owner, minlength=n) + known_end, pa.int64()), pa.array(np.bincount(owner, base[at], n), pa.float64()), _lists(sums), others],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "sums", "others"],
                )

    return run


def score_documents(docs: DataFrame, model_file: str, held_out: tuple[int, int] = (7, 2), kind: str | None = "lang", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    of = F.coalesce(F.concat(F.lit("="), F.col(kind).cast("string")), F.lit("")) if kind in docs.columns else F.lit("")
    source = docs.select("doc_id", (crc_of_id("doc_id") % held_out[0] == held_out[1]).alias("held_out"), text_of().alias("text"), of.alias("name"))
    names = [r.name for r in source.where("not held_out").groupBy("name").count().orderBy(F.desc("count"), "name").limit(KINDS).collect()]
    number = F.lit(None).cast("int")
    if names:
        number = F.coalesce(*[F.when(F.col("name") == x, k) for k, x in enumerate(names[: KINDS - 1])], F.lit(min(len(names), KINDS) - 1)).cast("int")
    source = source.withColumn("kind", F.when(~F.col("held_out"), number)).drop("name")
    kinds = len(names)
    per_kind = {r.kind: r.n for r in source.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    ends = np.array([per_kind.get(k, 0) for k in range(kinds)], np.int64)  # each training document has one end
    words = stage(count_words(source, kinds), "word-counts")
    seen = F.exists("counts", lambda c: c > 0)
    totals = words.agg(*[F.sum(F.get("counts", F.lit(k))) for k in range(kinds)], *[F.count(F.when(F.get("counts", F.lit(k)) > 0, 1)) for k in range(kinds)], F.count(F.when(seen, 1))).first()
    by_kind, kinds_of_words = np.array([x or 0 for x in totals[:kinds]], np.float64), np.array(totals[kinds:], np.float64)
    n, v = int(by_kind.sum()) + int(ends.sum()), int(kinds_of_words[-1]) + bool(ends.sum())
    if by_kind.sum() == 0:  # no training words: the pieces alone
        by_kind = by_kind[:0]
    scored = stage(word_scores(words, model_file, piece_scores(words.where(seen), model_file), by_kind, kinds_of_words, ends), "word-scores")
    room = math.log10(n + v + 1)
    cut = _frequent_cut(scored, frequent)
    often = scored.where(F.col("c") >= cut).select("word", F.log10(F.col("c") + 1).alias("base"), "logs").toArrow()  # `frequent` rows at most
    width = max(1, len(by_kind))
    logs = pc.list_flatten(often["logs"]).to_numpy().reshape(-1, width)
    sent = spark.sparkContext.broadcast((often["word"].combine_chunks() if len(often) else pa.array([], pa.string()), often["base"].to_numpy(), logs))
    ends_log = np.log(ends / (by_kind + ends)) + np.log(ends / ends.sum()) if len(by_kind) else np.array([math.log(0.5)])

    fields = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, sums array<double>, others array<struct<word:string,tf:long>>"
    sums = stage(source.select("doc_id", "held_out", "text").mapInArrow(_known_sums(sent, int(ends.sum() > 0)), fields).withColumn("row", F.monotonically_increasing_id()), "known-sums")
    rare = sums.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.tf").join(scored.where(F.col("c") < cut), "word")
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare_base"),
        F.array(*[F.sum(F.col("tf") * F.get("logs", F.lit(k))) for k in range(width)]).alias("rare_sums"),
    )
    out = sums.drop("others").join(more, "row", "left")
    zero = F.lit(0.0)
    parts = [F.get("sums", F.lit(k)) + F.coalesce(F.get("rare_sums", F.lit(k)), zero) + F.lit(float(ends_log[k])) for k in range(width)]
    top = F.greatest(*parts) if width > 1 else parts[0]
    score = (top + F.log(sum((F.exp(p - top) for p in parts), zero))) / LN10
    base = F.col("base") + F.coalesce("rare_base", zero) + math.log10(int(ends.sum()) + 1) - F.col("n_tokens") * F.lit(room)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
